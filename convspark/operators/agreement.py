"""Agreement of annotators: Fleiss' and Cohen's kappa, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions.vocab import NOT_SURE
from convspark.operators.annotation import similarity_to_gold

RATERS, OTHER = ("p1", "p2", "p3"), "Other"
VOTED = [(a, b) for k, a in enumerate((*RATERS, "vote")) for b in (*RATERS, "vote")[k + 1 :]]


def fleiss_kappa(aligned: DataFrame, by: Sequence[str] = (), exclude: str | None = None) -> DataFrame:
    """Over first labels of three raters; null where chance agreement is 1.

    exclude leaves out utterances to which any rater gave that first label. One pass: agreement within an utterance
    comes from its row, shares of labels from its three ratings.
    """
    first = [F.get(F.col(p), F.lit(0)) for p in RATERS]
    rows = aligned.select(*by, F.array(*first).alias("r"))
    if exclude is not None:
        rows = rows.filter(~F.array_contains("r", exclude))
    a, b, c = (F.col("r")[k] for k in range(3))
    within = ((a == b).cast("int") + (a == c).cast("int") + (b == c).cast("int")) / 3
    observed = rows.groupBy(*by).agg(F.avg(within).alias("po"), F.count("*").alias("n"))
    labels = rows.select(*by, F.explode("r").alias("label")).groupBy(*by, "label").agg(F.count("*").alias("k"))
    if by:
        chance = labels.groupBy(*by).agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), F.lit(2))).alias("pe"))
        both = observed.join(chance, list(by))
    else:
        chance = labels.agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), F.lit(2))).alias("pe"))
        both = observed.crossJoin(chance)  # one row each
    return both.select(*by, "n", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def _entries() -> list[Column]:
    """What an utterance adds to each pair of raters and the vote: both first labels, whether they are the same, whether
    the lists overlap; and to Fleiss' kappa: its three first labels, and the pairs of them that are the same."""
    named = {p: F.col(p) for p in RATERS} | {"vote": F.col("multi")}
    first = {p: F.get(F.col(p), F.lit(0)) for p in RATERS} | {"vote": F.col("main")}
    same = lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))

    def entry(pair: str, label: Column, a: int = 0, b: int = 0, agree: Column | None = None, overlap: Column | None = None) -> Column:
        whole = {"pair": F.lit(pair), "label": label, "a": F.lit(a), "b": F.lit(b), "same": agree, "overlap": overlap}
        return F.struct(*[(F.lit(0) if c is None else c).alias(k) for k, c in whole.items()])

    out = []
    for x, y in VOTED:
        out.append(entry(f"{x}_{y}", first[x], a=1, agree=same(first[x], first[y]), overlap=F.coalesce(F.arrays_overlap(named[x], named[y]).cast("int"), F.lit(0))))
        out.append(entry(f"{x}_{y}", first[y], b=1))
    labels = [first[r] for r in RATERS]
    agreed = same(labels[0], labels[1]) + same(labels[0], labels[2]) + same(labels[1], labels[2])
    other = F.exists(F.array(*labels), lambda x: F.coalesce(x == OTHER, F.lit(False)))
    out += [entry("fleiss", x, a=1, agree=F.lit(0) if k else agreed) for k, x in enumerate(labels)]
    out += [F.when(~other, entry("fleiss_no_other", x, a=1, agree=F.lit(0) if k else agreed)) for k, x in enumerate(labels)]
    return out


def agreement_scores(voted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A9 to A13 at once: by, pair, n, kappa, overlap for each pair of raters and the vote, and kappa of all raters as
    `fleiss` and, over utterances without a first label Other, `fleiss_no_other`.

    Counts by pair and label, which each task adds up first, give both marginals; their products are summed by pair.
    Null where chance agreement is 1. A null label agrees with none.
    """
    keys = [*by, "pair"]
    each = voted.select(*by, F.inline(F.filter(F.array(*_entries()), lambda e: e.isNotNull())))
    cells = each.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("a", "b", "same", "overlap")])
    known = lambda x: F.sum(F.when(F.col("label").isNotNull(), x).otherwise(0)).cast("double")
    a, b = F.col("a"), F.col("b")
    sums = cells.groupBy(*keys).agg(F.sum("a").alias("n"), F.sum("same").alias("same"), F.sum("overlap").alias("overlap"), known(a * b).alias("ab"), known(a * a).alias("aa"))
    n = F.col("n").cast("double")
    chance = F.when(F.col("pair").startswith("fleiss"), F.col("aa")).otherwise(F.col("ab")) / n / n
    kappa = F.try_divide(F.col("same") / n - chance, 1 - chance)
    pair = ~F.col("pair").startswith("fleiss")
    return sums.select(*keys, F.when(pair, F.col("n")).otherwise((F.col("n") / 3).cast("long")).alias("n"), kappa.alias("kappa"), F.when(pair, F.col("overlap") / n).alias("overlap"))


def cohen_kappa_pairs(voted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pair, kappa over first labels for the raters and the vote; null where chance agreement is 1."""
    return agreement_scores(voted, by).filter(~F.col("pair").startswith("fleiss")).select(*by, "pair", "kappa")


def overlap_similarity_pairs(voted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of utterances whose label lists overlap, for the raters and the vote."""
    return agreement_scores(voted, by).filter(~F.col("pair").startswith("fleiss")).select(*by, "pair", "overlap")


def overlap_similarity_dialog(aligned: DataFrame) -> DataFrame:
    """Share of a dialog's utterances with a label of all three."""
    return aligned.groupBy("movie", "dialog_id").agg(F.avg(_common().cast("int")).alias("overlap"))


def _common() -> Column:
    return F.size(F.array_intersect(F.array_intersect("p1", "p2"), "p3")) > 0


def decision_report(voted: DataFrame, quality: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """One row a movie: kappas, undecided votes, similarities of pairs, of dialogs and, with gold rows, to these, and
    with the annotators' quality their stars. voted is read three times and should be cut."""
    by = ["movie"]
    names = [f"{a}_{b}" for a, b in VOTED]
    one = lambda value, pair: F.max(F.when(F.col("pair") == pair, F.col(value)))
    columns = [one("kappa", "fleiss").alias("fleiss"), one("kappa", "fleiss_no_other").alias("fleiss_no_other")]
    columns += [one(value, pair).alias(f"{value}_{pair}") for value in ("kappa", "overlap") for pair in names]
    out = agreement_scores(voted, by).groupBy("movie").agg(*columns)
    unsure = F.count_if(F.col("main") == NOT_SURE).alias("unsure")
    dialogs = voted.groupBy("movie", "dialog_id").agg(F.avg(_common().cast("int")).alias("overlap"), unsure)
    dialogs = dialogs.groupBy("movie").agg(F.min("overlap").alias("least_dialog"), F.avg("overlap").alias("mean_dialog"), F.sum("unsure").alias("n_not_sure"))
    out = out.join(dialogs, "movie")
    if gold is not None:
        out = out.join(similarity_to_gold(voted, gold, by), "movie", "left")
    if quality is not None:
        stars = [F.max(F.when(F.col("annotator") == k, F.col("stars"))).alias(f"stars{k}") for k in (1, 2, 3)]
        out = out.join(quality.groupBy("movie").agg(*stars), "movie", "left")
    return out
