"""Corpus statistics and emotion dynamics. Utterances have movie, dialog_id, pos, speaker, main and multi."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.operators import annotation as A


def movie_statistics(voted: DataFrame) -> DataFrame:
    """One row a movie: counts, turns a dialog, utterances a turn, counts and shares of agreement.

    One pass: a dialog's order marks where turns start, and one aggregate counts all."""
    w = A.in_dialog()
    first = (F.row_number().over(w) == 1).cast("int")
    change = F.when(F.col("speaker") != F.lag("speaker", 1, "A").over(w), 1).otherwise(0)
    rows = voted.select("movie", "dialog_id", "pos", "speaker", "p1", "p2", "p3", "main").withColumns({"_first": first, "_change": change})
    counts = [F.sum("_first").alias("n_dialogs"), F.sum(F.col("_first") + F.col("_change")).alias("n_turns"), F.count("*").alias("n_utts")]
    out = rows.groupBy("movie").agg(*counts, *A.agreement_counts(), F.count_if(F.col("main") == A.NOT_SURE).alias("n_not_sure"))
    rates = {f"{k}_rate": F.col(k) / F.col("n_utts") for k in ("all_same", "all_first", "all_overlap", "pair_same", "pair_first", "pair_overlap")}
    return out.withColumns({"turns_per_dialog": F.col("n_turns") / F.col("n_dialogs"), "utts_per_turn": F.col("n_utts") / F.col("n_turns"), **rates})


def duration_stats(utts: DataFrame, start: Column, end: Column, by: Sequence[str] = ()) -> DataFrame:
    """Total and mean seconds of utterances, mean text length, total and mean seconds of dialogs, first start to
    last end. One shuffle by dialog."""
    per = utts.groupBy(*by, "dialog_id").agg(
        F.sum(end - start).alias("s"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), (F.max_by(end, "pos") - F.min_by(start, "pos")).alias("span")
    )
    return per.groupBy(*by).agg(
        F.sum("s").alias("utt_seconds"), (F.sum("s") / F.sum("n")).alias("mean_utt_seconds"), (F.sum("chars") / F.sum("n")).alias("mean_chars"),
        F.sum("span").alias("dialog_seconds"), F.avg("span").alias("mean_dialog_seconds"),
    )


def label_distribution(utts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C2"""
    return utts.groupBy(*by, "main").agg(F.count("*").alias("n")).orderBy("n", "main")


def multi_label_distribution(utts: DataFrame, min_count: int = 5) -> DataFrame:
    """Ordered combinations of several labels that occur at least min_count times."""
    combos = utts.filter(F.size("multi") > 1).groupBy(F.array_join("multi", "_").alias("labels")).agg(F.count("*").alias("n"))
    return combos.filter(F.col("n") >= min_count).orderBy(F.desc("n"), "labels")


def multi_label_rate(utts: DataFrame, min_count: int = 5) -> DataFrame:
    """C4: utterances with a kept combination, of all. Both counts are aggregates of one row."""
    kept = multi_label_distribution(utts, min_count).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    return kept.crossJoin(utts.agg(F.count("*").alias("n_utts"))).select("kept", "n_utts", F.try_divide("kept", "n_utts").alias("rate"))


def _moves(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    before = F.lag("main").over(Window.partitionBy(*keys).orderBy("pos"))
    pairs = rows.withColumn("from_label", before).filter(F.col("from_label").isNotNull())
    kind = F.when(F.col("from_label") == F.col("main"), "inertia").otherwise("shift")
    return pairs.select(*[c for c in ("movie", "dialog_id", "turn_no", "pos") if c in rows.columns], "from_label", F.col("main").alias("to_label"), kind.alias("kind"))


def turn_transitions(utts: DataFrame) -> DataFrame:
    """Label of a turn's first utterance against that of the turn before."""
    return _moves(A.segment_turns(utts).filter("pos_in_turn = 1"), ["dialog_id"])


def within_turn_transitions(utts: DataFrame, include_last_turn: bool = False) -> DataFrame:
    """Labels that follow each other in a turn; a dialog's last turn counts only if asked for."""
    turns = A.segment_turns(utts)
    if not include_last_turn:
        turns = turns.withColumn("_last", F.max("turn_no").over(Window.partitionBy("dialog_id"))).filter("turn_no < _last").drop("_last")
    return _moves(turns, ["dialog_id", "turn_no"])


def transition_counts(moves: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """C7"""
    return moves.groupBy(*by, F.concat_ws("_", "from_label", "to_label").alias("move")).agg(F.count("*").alias("n")).orderBy("n", "move")


def corpus_rollup(stats: DataFrame, movies: DataFrame) -> DataFrame:
    """Sums over the listed movies, and their ratios."""
    total = stats.join(movies.select("movie"), "movie", "left_semi").agg(*[F.sum(c).alias(c) for c in ("n_dialogs", "n_turns", "n_utts")])
    return total.withColumns({"turns_per_dialog": F.col("n_turns") / F.col("n_dialogs"), "utts_per_turn": F.col("n_utts") / F.col("n_turns"), "utts_per_dialog": F.col("n_utts") / F.col("n_dialogs")})


def speaker_demographics(speakers: DataFrame) -> DataFrame:
    """Counts by age and by gender, in one pass."""
    sets = speakers.groupingSets([["age"], ["gender"]], "age", "gender").agg(F.count("*").alias("n"), F.grouping("age").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "age").otherwise("gender").alias("kind"), F.coalesce("age", "gender").alias("value"), "n")


def not_first_speaker_count(utts: DataFrame) -> DataFrame:
    """Dialogs, transitions between neighbours, and the "turns" of a corpus whose current speaker is never
    updated: 1 + utterances not by the dialog's first speaker."""
    w = A.in_dialog()
    first = F.first("speaker").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = utts.withColumns({"_other": (F.col("speaker") != first).cast("int"), "_move": (F.lag("main").over(w) != F.col("main")).cast("int")})
    per = rows.groupBy("dialog_id").agg((1 + F.sum("_other")).alias("t"), F.sum("_move").alias("shift"), F.count("_move").alias("moves"))
    return per.agg(F.count("*").alias("n_dialogs"), F.sum("t").alias("n_turns"), F.coalesce(F.sum("shift"), F.lit(0)).alias("shift"), (F.sum("moves") - F.coalesce(F.sum("shift"), F.lit(0))).alias("inertia"))


def selection_stats(clips: DataFrame) -> DataFrame:
    """C11: by tag of `a+b` cells: clips and their seconds."""
    tags = F.explode(F.split(F.replace("tags", F.lit(" "), F.lit("")), r"\+"))
    return clips.select(tags.alias("tag"), "seconds").groupBy("tag").agg(F.count("*").alias("n_clips"), F.sum("seconds").alias("seconds"))


def movie_profile(utts: DataFrame, raters: Sequence[str] = ()) -> DataFrame:
    """Long table movie, what, key, n: turns, utterances, labels and the four kinds of transition.

    One pass: in a dialog's order each utterance meets the label before it in its turn and that of the turn before, and
    gives the counts it stands for, which one aggregate adds up. With raters (three columns of label lists) also what
    kappa needs: what `rating`, a count of each first label, and `agreement`, pairs of raters that agree.
    """
    w, dialog = A.in_dialog(), Window.partitionBy("dialog_id")
    named = [F.get(r, F.lit(0)).alias(f"_{k}") for k, r in enumerate(raters)]
    rows = utts.select("movie", "dialog_id", "pos", "speaker", "main", *named)
    rows = rows.withColumns({"_change": F.when(F.col("speaker") != F.lag("speaker", 1, "A").over(w), 1).otherwise(0), "_k": F.row_number().over(w), "_lag": F.lag("main").over(w)})
    starts = (F.col("_change") == 1) | (F.col("_k") == 1)
    rows = rows.withColumns({"_turn": F.sum("_change").over(w), "_starts": starts})
    earlier = F.last(F.when(F.col("_starts"), F.struct("main")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_earlier": earlier["main"], "_last": F.max("_turn").over(dialog)})
    one = F.lit(1).cast("long")
    entry = lambda what, key, n, holds=F.lit(True): F.when(holds, F.struct(what.alias("what"), key.alias("key"), n.cast("long").alias("n")))

    def move(name: str, before: Column, holds: Column) -> Column:
        kind = F.when(before == F.col("main"), f"{name}_inertia").otherwise(f"{name}_shift")
        return entry(kind, F.concat_ws("_", before, "main"), one, holds & before.isNotNull())

    first = F.col("_k") == 1
    count = lambda key, n, holds=F.lit(True): entry(F.lit("count"), F.lit(key), n, holds)
    entries = [
        count("n_utts", one), count("n_dialogs", one, first), count("n_turns", F.col("_change") + first.cast("int"), starts),
        entry(F.lit("label"), F.col("main"), one), move("turn", F.col("_earlier"), F.col("_starts")),
        move("within", F.col("_lag"), ~F.col("_starts") & (F.col("_turn") < F.col("_last"))),
    ]
    if raters:
        pairs = [(F.col(f"_{a}") == F.col(f"_{b}")).cast("int") for a, b in ((0, 1), (0, 2), (1, 2))]
        entries += [entry(F.lit("rating"), F.col(f"_{k}"), one) for k in range(3)] + [entry(F.lit("agreement"), F.lit("pairs"), sum(pairs, F.lit(0)))]
    each = rows.select("movie", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    return each.groupBy("movie", "what", "key").agg(F.sum("n").alias("n"))


MAPS = ("label", "turn_inertia", "turn_shift", "within_inertia", "within_shift")


def profile_maps(profile: DataFrame) -> DataFrame:
    """One row a movie: n_dialogs, n_turns, n_utts, kappa of the raters' first labels (null where chance agreement
    is 1, or without raters) and a map of counts for labels and each kind of transition."""
    of = lambda what: F.col("what") == what
    number = lambda key: F.coalesce(F.max(F.when(of("count") & (F.col("key") == key), F.col("n"))), F.lit(0).cast("long"))
    listed = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(of(what), F.struct("key", "n")))))
    ratings = F.sum(F.when(of("rating"), F.col("n")))
    chance = F.sum(F.when(of("rating"), F.col("n").cast("double") * F.col("n"))) / ratings / ratings
    observed = F.max(F.when(of("agreement"), F.col("n"))) / ratings
    rows = profile.groupBy("movie").agg(
        *[number(k).alias(k) for k in ("n_dialogs", "n_turns", "n_utts")], F.try_divide(observed - chance, 1 - chance).alias("kappa"), *[listed(x).alias(x) for x in MAPS]
    )
    return rows


def subset_profile(profile: DataFrame, movies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of some movies added up; movies: movie and the columns of `by`."""
    return profile.join(movies.select("movie", *by), "movie").groupBy(*by, "what", "key").agg(F.sum("n").alias("n"))


def share_of_total(subset: DataFrame, total: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C14: each key's share of the total, 0 where the subset lacks it, to 4 decimals."""
    sets = subset.select(*by).distinct() if by else None
    every = total.select("what", "key", F.col("n").alias("all_n"))
    every = every.crossJoin(F.broadcast(sets)) if by else every  # a row for each of a few sets
    return every.join(subset, [*by, "what", "key"], "left").select(*by, "what", "key", F.round(F.coalesce("n", F.lit(0)) / F.col("all_n"), 4).alias("share"))


def length_stats(lengths: DataFrame, n: str, by: Sequence[str] = (), at: Sequence[float] = (0.5, 0.8, 0.95)) -> DataFrame:
    """Mean, and for each q the value at index floor(n q) of the sorted lengths.

    Ranks come from counts of distinct lengths, so no window sees more rows than there are lengths.
    """
    counts = lengths.groupBy(*by, n).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"upto": F.sum("k").over(w.orderBy(n)), "total": F.sum("k").over(w)})
    value = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col(n)))
    return ranked.groupBy(*by).agg((F.sum(F.col(n) * F.col("k")) / F.sum("k")).alias("mean"), *[value(q).alias(f"p{int(q * 100)}") for q in at])


def class_weights(labels: DataFrame, label: str) -> DataFrame:
    """C20: inverse frequency; the window runs over one row a label."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, "n", (F.sum("n").over(Window.partitionBy()) / F.col("n")).alias("weight"))


def dataset_label_counts(utts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """By set: dialogs, sentences and a column for each label."""
    wide = [F.count_if(F.col("main") == x).alias(x) for x in labels]
    return utts.groupBy("set_name").agg(F.countDistinct("dialog_id").alias("n_dialogs"), F.count("*").alias("n_utts"), *wide)
