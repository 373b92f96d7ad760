"""The three jobs that the operators make up, each as one call on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions import vectors as V
from convspark.functions.keys import dialog_id as dialog_of
from convspark.functions.vocab import LABELS, SPEAKERS
from convspark.operators import agreement, annotation, corpus, evaluation, features, quality, split
from convspark.sources.checkpoints import cut
from convspark.sources.files import parse_logs


class Annotated(NamedTuple):
    """What annotation sheets become. Tables are read as often as they are used: voted is written once."""

    violations: DataFrame
    voted: DataFrame
    report: DataFrame
    statistics: DataFrame
    low_agreement: DataFrame


def check_sheets(sheets: DataFrame, speakers: Sequence[str] = SPEAKERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """check, key, found: each row that breaks a rule, as text; no row means that sheets can be merged.

    Checks: speakers, first_speaker, repeated_utterances, annotators_aligned, first_label, labels.
    """
    row = lambda df, name, key, found: df.select(F.lit(name).alias("check"), key.cast("string").alias("key"), found.cast("string").alias("found"))
    one = sheets.filter("annotator = 3")  # the sheet whose text and speakers are kept
    col = F.col
    return (
        row(quality.check_speaker_domain(one, speakers), "speakers", col("utt_id"), col("speaker"))
        .union(row(quality.check_first_speaker(one, speakers[0]), "first_speaker", col("dialog_id"), col("first_speaker")))
        .union(row(quality.check_unique_utts(sheets, F.concat_ws(" ", "annotator", "utt_id")), "repeated_utterances", col("key"), col("times")))
        .union(row(quality.check_annotators_aligned(sheets), "annotators_aligned", col("dialog_id"), F.concat_ws(" ", "n_annotators", "utt_counts", "turn_counts")))
        .union(row(quality.check_first_label_present(sheets), "first_label", col("dialog_id"), col("annotator")))
        .union(row(quality.check_label_vocab(annotation.sheet_labels(sheets), labels), "labels", col("label"), col("times")))
    )


def annotate(sheets: DataFrame, admin: DataFrame | None = None, speakers: Sequence[str] = SPEAKERS, labels: Sequence[str] = LABELS) -> Annotated:
    """Sheets in; checks, merged and voted utterances, report and statistics of each movie, and low dialogs out.

    sheets: movie, dialog_id, utt_id, pos, text, speaker, annotator (1 to 3), cell (labels as text; null: as before) and
    feedback, with whatever else each utterance has; admin: movie, name1.., rating1... An utterance that an annotator lacks
    is left out of the merge and shows among the violations. Empty sheets give empty tables. The merged rows are computed and
    written while this is called.
    """
    voted = cut(annotation.vote_labels(annotation.merge_sheets(annotation.sheet_labels(sheets))))
    stars = annotation.annotator_quality(admin) if admin is not None else None
    report = cut(agreement.decision_report(voted, stars, annotation.gold_of_aligned(voted, sheets)))
    statistics = corpus.movie_statistics(voted).join(report.select("movie", F.col("fleiss").alias("kappa")), "movie")
    low = annotation.low_agreement_dialogs(agreement.overlap_similarity_dialog(voted), report.select("movie", F.col("fleiss").alias("kappa")))
    return Annotated(check_sheets(sheets, speakers, labels), voted, report, statistics, annotation.low_agreement_utterances(voted.drop("overlap"), low))


SCORES = ("wa", "uar", "f1", "wf1")


def run_table(lines: DataFrame, configuration: Column, run: Column, score: str = "wf1") -> DataFrame:
    """configuration, part, row, wa, uar, f1, wf1: the table of results of a configuration's runs, from their logs' lines.

    lines: path, line. Of each run the log with the latest time in its name counts, if it has exactly one result line of the
    score for validation and one for test. The run with the lowest validation score is left out; part is Val or Tst, row
    `mean` of the other runs, `first` or `second` of them in the order of run. Scores have four decimals.
    """
    kind = {"wf1": "WF1-result", "f1": " F1-result"}[score]
    wanted = lines.select("path", "line").filter(F.col("line").contains(kind))
    results = parse_logs(wanted).withColumns({"configuration": configuration, "run": run})
    names = lines.select("path").distinct().withColumns({"configuration": configuration, "run": run})
    latest = evaluation.latest_log_per_run(names.withColumn("of", F.struct("configuration", "run")), "of").select("path")
    each = results.join(latest, "path").groupBy("configuration", "run").agg(
        F.count("*").alias("_n"), *[F.max(F.when(F.col("part") == p, F.col(s))).alias(f"{p}_{s}") for p in ("Val", "Tst") for s in SCORES]
    )
    each = each.filter((F.col("_n") == 2) & F.col(f"Val_{score}").isNotNull() & F.col(f"Tst_{score}").isNotNull())
    metrics = [f"{p}_{s}" for p in ("Val", "Tst") for s in SCORES]
    done = evaluation.summarise_runs(each, ["configuration"], f"Val_{score}", metrics, "run")
    value = lambda p, s, row: {"mean": F.col(f"mean_{p}_{s}"), "first": F.col(f"{p}_{s}_1"), "second": F.col(f"{p}_{s}_2")}[row]
    rows = [F.struct(F.lit(p).alias("part"), F.lit(row).alias("row"), *[F.format_number(value(p, s, row), 4).alias(s) for s in SCORES]) for p in ("Val", "Tst") for row in ("mean", "first", "second")]
    return done.select("configuration", F.inline(F.array(*rows)))


def dialog_packs(utts: DataFrame, modalities: Mapping[str, tuple[DataFrame, int]], sets: DataFrame, labels: DataFrame) -> DataFrame:
    """dialog_id, set_name, turns: one row a dialog with its utterances in order: pos, key, speaker, label, text and one
    vector for each modality.

    utts: movie, utt_id, pos, speaker, text; key is speaker_utt_id. modalities: name to (features, dim); features: key, ft
    (array<double>, sentence level). A feature that is missing, empty or one number only is dim zeros. labels: key, label;
    sets: movie, set_name; dialogs of other movies are left out. Every utterance stays: a label that is missing is null.
    """
    rows = utts.filter(F.col("utt_id").isNotNull()).withColumn("speaker", F.regexp_replace("speaker", " ", ""))
    rows = split.apply_group_split(rows, sets).withColumn("key", F.concat_ws("_", "speaker", "utt_id"))
    rows = rows.select(dialog_of(F.col("utt_id")).alias("dialog_id"), "set_name", "pos", "key", "speaker", "text").join(labels.select("key", "label"), "key", "left")
    for name, (table, dim) in modalities.items():
        own = table.select("key", F.when(F.size("ft") > 1, F.col("ft")).alias("_ft"))
        rows = rows.join(own, "key", "left").withColumn(name, V.zero_if_missing(F.col("_ft"), dim)).drop("_ft")
    names = ["label", "text", *modalities]
    turns = F.array_sort(F.collect_list(F.struct("pos", "key", "speaker", *names)))
    return rows.groupBy("dialog_id", "set_name").agg(turns.alias("turns"))


def training_batches(packs: DataFrame, modalities: Mapping[str, int], batch_size: int, tokens: str | None = None, drop_last: bool = True) -> DataFrame:
    """Packs of a set as padded batches: padding has label -1, zero vectors and the flag padded; see batch_and_pad."""
    zeros = [F.array_repeat(F.lit(0.0), dim).alias(name) for name, dim in modalities.items()]
    kinds = packs.schema["turns"].dataType.elementType
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields}
    made = {name: z for name, z in zip(modalities, zeros, strict=True)} | {"label": F.lit(-1).cast(kinds["label"].dataType).alias("label")}
    if tokens is not None:
        made[tokens] = F.array().cast(kinds[tokens].dataType).alias(tokens)
    pad = F.struct(*[made.get(f.name, empty[f.name]) for f in kinds.fields])
    filler = F.lit(None) if tokens is not None else None
    return features.batch_and_pad(packs, "turns", "dialog_id", batch_size, pad, drop_last, tokens, filler=filler)
