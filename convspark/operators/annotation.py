"""Merging of annotation sheets: turns, forward fill, alignment, votes and reports.

A sheet has movie, dialog_id, utt_id, pos, text, speaker, annotator, labels (array, null where the label before holds)
and feedback; the aligned table has p1, p2, p3 in place of annotator and labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions.keys import count_stars, parse_labels
from convspark.functions.vocab import NOT_SURE
from convspark.operators.numbering import with_neighbours

def in_dialog():
    return Window.partitionBy("dialog_id").orderBy("pos")


PAIRS = [("p1", "p2"), ("p1", "p3"), ("p2", "p3")]


def segment_turns(utts: DataFrame) -> DataFrame:
    """A2: turn_no from 1 and pos_in_turn from 1; a turn is a run of one speaker, and a dialog starts with A's."""
    change = F.when(F.col("speaker") != F.lag("speaker", 1, "A").over(in_dialog()), 1).otherwise(0)
    turns = utts.withColumn("turn_no", 1 + F.sum(change).over(in_dialog()))
    return turns.withColumn("pos_in_turn", F.row_number().over(Window.partitionBy("dialog_id", "turn_no").orderBy("pos")).cast("long"))


def dialog_turn_counts(utts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1: dialogs, turns and utterances."""
    per = segment_turns(utts).groupBy(*by, "dialog_id").agg(F.max("turn_no").alias("turns"), F.count("*").alias("utts"))
    return per.groupBy(*by).agg(F.count("*").alias("n_dialogs"), F.sum("turns").alias("n_turns"), F.sum("utts").alias("n_utts"))


def fill_labels_forward(sheet: DataFrame, labels: str = "labels", by: Sequence[str] = ("annotator", "dialog_id")) -> DataFrame:
    """A3: a null label takes the last one before it in the dialog."""
    return sheet.withColumn(labels, F.last(labels, ignorenulls=True).over(Window.partitionBy(*by).orderBy("pos")))


def label_volume(filled: DataFrame, by: Sequence[str] = ("annotator",)) -> DataFrame:
    """A4: labels assigned."""
    return filled.groupBy(*by).agg(F.sum(F.size("labels")).cast("long").alias("n_labels"))


def align_annotators(filled: DataFrame) -> DataFrame:
    """A5: one row an utterance that all three have; other columns from annotator 3. One shuffle by utterance.

    Rows are narrowed to what is taken from them and shuffled before they are sorted: an utterance's annotators lie apart,
    so that nothing can be added up earlier.
    """
    names = [c for c in filled.columns if c not in ("utt_id", "annotator", "labels", "cell", "feedback")]
    whose = F.col("annotator")
    taken = [F.when(whose == k, F.col("labels")).alias(f"p{k}") for k in (1, 2, 3)] + [F.when(whose == 3, F.col(c)).alias(c) for c in names]
    rows = filled.select("utt_id", *taken).repartition("utt_id")
    keyed = rows.groupBy("utt_id").agg(*[F.max(c).alias(c) for c in ("p1", "p2", "p3", *names)])
    return keyed.filter("p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL")


def merge_sheets(sheets: DataFrame) -> DataFrame:
    """A3 and A5: sheets (labels parsed) filled and aligned. What is taken from annotator 3 only is dropped from the other
    sheets before anything is shuffled."""
    keys = ("dialog_id", "utt_id", "pos", "annotator", "labels")
    rows = sheets.drop("cell", "feedback")
    narrow = rows.select(*[F.col(c) if c in keys else F.when(F.col("annotator") == 3, F.col(c)).alias(c) for c in rows.columns])
    return align_annotators(fill_labels_forward(narrow))


def _share(conditions: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def agreement_counts() -> list[Column]:
    """The counts of A6 and A7 as aggregates."""
    return _share(_of_all() | _of_pairs())


def agreement_all(aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Utterances whose three lists are the same; those, or the same first label; those, or a label of all three."""
    return aligned.groupBy(*by).agg(*_share(_of_all()))


def _of_all() -> dict[str, Column]:
    same = (F.col("p1") == F.col("p2")) & (F.col("p1") == F.col("p3"))
    first = (F.get("p1", F.lit(0)) == F.get("p2", F.lit(0))) & (F.get("p1", F.lit(0)) == F.get("p3", F.lit(0)))
    common = F.size(F.array_intersect(F.array_intersect("p1", "p2"), "p3")) > 0
    return {"all_same": same, "all_first": same | first, "all_overlap": same | first | common}


def agreement_any_pair(aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Utterances where some pair of annotators agrees, counted for each kind of agreement by itself."""
    return aligned.groupBy(*by).agg(*_share(_of_pairs()))


def _of_pairs() -> dict[str, Column]:
    some = lambda f: f(*PAIRS[0]) | f(*PAIRS[1]) | f(*PAIRS[2])
    return {
        "pair_same": some(lambda a, b: F.col(a) == F.col(b)),
        "pair_first": some(lambda a, b: F.get(a, F.lit(0)) == F.get(b, F.lit(0))),
        "pair_overlap": some(lambda a, b: F.arrays_overlap(a, b)),
    }


def pooled_vote(p1: Column, p2: Column, p3: Column) -> Column:
    """struct(multi, main) of three label lists; a label that one annotator repeats counts at most three times.

    Labels that three name are the result, or else those that two name; none: NotSure. With one such label it is the
    main one, and if three name it, labels of two follow it. With several, the main one is what two annotators name
    first, which need not be among them, or else the first of them.
    """
    pool = F.concat(p1, p2, p3)
    times = lambda x: F.size(F.filter(pool, lambda y: y == x))
    each = F.array_distinct(pool)
    three, two = F.filter(each, lambda x: times(x) >= 3), F.filter(each, lambda x: times(x) == 2)
    first = lambda p: F.get(p, F.lit(0))
    agreed = F.when((first(p1) == first(p2)) | (first(p1) == first(p3)), first(p1)).when(first(p2) == first(p3), first(p2))
    vote = lambda multi, main: F.struct(multi.alias("multi"), main.alias("main"))
    several = lambda labels: vote(labels, F.coalesce(agreed, first(labels)))
    return (
        F.when(F.size(three) == 1, vote(F.concat(three, two), first(three)))
        .when(F.size(three) > 1, several(three))
        .when(F.size(two) == 1, vote(two, first(two)))
        .when(F.size(two) > 1, several(two))
        .otherwise(vote(F.array(F.lit(NOT_SURE)), F.lit(NOT_SURE)))
    )


def vote_labels(aligned: DataFrame, strategy: Callable[[Column, Column, Column], Column] = pooled_vote) -> DataFrame:
    """With multi and main by the strategy; no shuffle."""
    return aligned.withColumn("_vote", strategy(F.col("p1"), F.col("p2"), F.col("p3"))).withColumns({"multi": F.col("_vote.multi"), "main": F.col("_vote.main")}).drop("_vote")


def feedback_dialogs(sheet: DataFrame) -> DataFrame:
    """Annotator and dialog with some feedback of over one character."""
    return sheet.groupBy("annotator", "dialog_id").agg(F.bool_or(F.length("feedback") > 1).alias("has")).filter("has").drop("has")


def gold_from_feedback(filled: DataFrame) -> DataFrame:
    """utt_id, gold, source: whole dialogs that were reviewed, of annotator 3, else 1, else 2."""
    return filled.join(_reviewed(filled), ["dialog_id", "annotator"]).select("utt_id", F.col("labels").alias("gold"), F.col("annotator").alias("source"))


def _reviewed(sheet: DataFrame) -> DataFrame:
    """dialog_id, annotator: whose labels are gold."""
    order = F.array_position(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("annotator").cast("int"))
    return feedback_dialogs(sheet).groupBy("dialog_id").agg(F.min_by("annotator", order).alias("annotator"))


def gold_of_aligned(aligned: DataFrame, sheet: DataFrame) -> DataFrame:
    """A16 for utterances that are aligned already: their dialog's reviewed annotator is one of p1, p2, p3, so that sheets
    are not filled again. Each utterance once."""
    labels = F.when(F.col("annotator") == 1, F.col("p1")).when(F.col("annotator") == 2, F.col("p2")).otherwise(F.col("p3"))
    return aligned.join(_reviewed(sheet), "dialog_id").select("utt_id", labels.alias("gold"), F.col("annotator").alias("source"))


def similarity_to_gold(aligned: DataFrame, gold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of reviewed utterances where an annotator's labels overlap the gold ones; null without any."""
    joined = aligned.join(gold.select("utt_id", "gold"), "utt_id")
    return joined.groupBy(*by).agg(*[F.avg(F.arrays_overlap(p, "gold").cast("int")).alias(f"{p}_gold") for p in ("p1", "p2", "p3")])


def annotator_quality(admin: DataFrame) -> DataFrame:
    """Movie, annotator, name, stars from one wide row a movie (name1.., rating1..)."""
    long = admin.select("movie", F.expr("stack(3, 1, name1, rating1, 2, name2, rating2, 3, name3, rating3) AS (annotator, name, rating)"))
    return long.select("movie", "annotator", "name", count_stars(F.col("rating")).alias("stars"))


def low_agreement_dialogs(per_dialog: DataFrame, kappas: DataFrame) -> DataFrame:
    """Dialogs whose overlap is under 0.3 where the movie's kappa is over 0.45, else under 0.5."""
    limit = F.when(F.col("kappa") > 0.45, 0.3).otherwise(0.5)
    return per_dialog.join(kappas.select("movie", "kappa"), "movie").filter(F.col("overlap") < limit).select("movie", "dialog_id", "overlap")


def low_agreement_utterances(utts: DataFrame, low: DataFrame) -> DataFrame:
    """The utterances of low dialogs, with their dialog's overlap."""
    return utts.join(low.select("dialog_id", "overlap"), "dialog_id")


def low_agreement_by_annotator(low: DataFrame, annotators: Sequence[str] = ("P1", "P2", "P3")) -> DataFrame:
    """Each low dialog for each annotator."""
    return low.select(F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator"), "movie", "dialog_id")


def smooth_uncertain(utts: DataFrame) -> DataFrame:
    """NotSure and Other take the label of the utterance before in the movie if its speaker is the same and its
    label certain; the movie's first utterance looks at the one after. Only original labels count. Adds smoothed.
    Writes its rows once, in ranges of the movie's order, so that a movie is not one task's."""
    unsure = lambda c: c.isin(NOT_SURE, "Other")
    mate = F.coalesce("before", "after")
    takes = unsure(F.col("main")) & (mate["speaker"] == F.col("speaker")) & ~unsure(mate["main"])
    rows = with_neighbours(utts, "movie", ["dialog_id", "pos"], ["speaker", "main"])
    return rows.withColumn("smoothed", F.when(takes, mate["main"]).otherwise(F.col("main"))).drop("before", "after")


def speaker_annotation_template(utts: DataFrame) -> DataFrame:
    """The first utterance of each dialog."""
    return utts.groupBy("dialog_id").agg(F.min_by(F.struct("utt_id", "start_tc", "text"), "pos").alias("u")).select("dialog_id", "u.*")


def uncertain_count(utts: DataFrame) -> DataFrame:
    """A25"""
    return utts.groupBy("movie").agg(F.count_if(F.col("main") == NOT_SURE).alias("n_not_sure"))


def sheet_labels(sheet: DataFrame, cell: str = "cell") -> DataFrame:
    """The label cell parsed."""
    return sheet.withColumn("labels", parse_labels(F.col(cell)))
