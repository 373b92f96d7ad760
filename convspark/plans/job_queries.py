"""The jobs over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark import jobs
from convspark.functions import vectors as V
from convspark.plans.annotation_queries import A18_SQL, A19_SQL, ALIGNED, ANN, LOW, VOTED, ann, doubles_rounded, stars
from convspark.plans.evaluation_queries import PREDS, metrics
from convspark.plans.fixtures import TABLES, fixture, sheets
from convspark.plans.registry import query

c = F.col
SPEAKERS = ("A", "B")


def annotated(spark, d):
    return jobs.annotate(sheets(ann(spark, d)), stars(spark, d), SPEAKERS)


J1_SQL = f"""SELECT a.*, b.* EXCLUDE (movie, n_not_sure), b.fleiss AS kappa
FROM ({A19_SQL}) a JOIN ({A18_SQL}) b USING (movie)"""


@query("J1_annotation_job", J1_SQL)
def j1(spark, d):
    """Statistics and report of each movie, from sheets."""
    done = annotated(spark, d)
    return doubles_rounded(done.statistics.join(done.report.drop("n_not_sure"), "movie"))


@query("J1_annotation_votes", f"{VOTED} SELECT utt_id, dialog_id, movie, pos, speaker, text, array_to_string(multi, '|') AS multi, main FROM voted")
def j1_votes(spark, d):
    return annotated(spark, d).voted.select("utt_id", "dialog_id", "movie", "pos", "speaker", "text", F.array_join("multi", "|").alias("multi"), "main")


@query("J1_annotation_low", f"{ALIGNED}, {LOW} SELECT al.movie, dialog_id, utt_id, overlap FROM al JOIN low USING (dialog_id)")
def j1_low(spark, d):
    return annotated(spark, d).low_agreement.select("movie", "dialog_id", "utt_id", F.round("overlap", 6).alias("overlap"))


CHECKS_SQL = f"""{ANN}, s AS (SELECT unnest([1, 2, 3]) AS k, unnest([l1, l2, l3]) AS cell, * FROM ann),
kept AS (SELECT * FROM s WHERE NOT (k = 2 AND event_id % 97 = 0)),
said AS (SELECT *, CASE WHEN event_id % 89 = 0 THEN 'C' ELSE speaker END AS spk FROM kept),
t AS (SELECT k, dialog_id, count(*) AS u, 1 + sum(ch) AS t FROM
  (SELECT k, dialog_id, CASE WHEN spk <> lag(spk, 1, 'A') OVER (PARTITION BY k, dialog_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM said) GROUP BY 1, 2)
SELECT 'speakers' AS "check", utt_id AS key, spk AS found FROM said WHERE k = 3 AND spk = 'C'
UNION ALL SELECT 'first_speaker', dialog_id, min_by(spk, pos) FROM said WHERE k = 3 GROUP BY 2 HAVING min_by(spk, pos) <> 'A'
UNION ALL SELECT 'annotators_aligned', dialog_id, concat_ws(' ', count(*), count(DISTINCT u), count(DISTINCT t)) FROM t GROUP BY 2
  HAVING count(*) < 3 OR count(DISTINCT u) > 1 OR count(DISTINCT t) > 1
UNION ALL SELECT 'first_label', dialog_id, CAST(k AS VARCHAR) FROM said WHERE cell IS NULL AND pos = (SELECT min(pos) FROM said x WHERE x.dialog_id = said.dialog_id AND x.k = said.k)
UNION ALL SELECT 'labels', label, CAST(count(*) AS VARCHAR) FROM (SELECT unnest(string_split(replace(cell, ' ', ''), ',')) AS label FROM said) WHERE label NOT IN ('Happy', 'Neutral', 'Sad') GROUP BY 2"""


@query("J1_annotation_checks", CHECKS_SQL)
def j1_checks(spark, d):
    """Sheets with rows that annotator 2 lacks and a third speaker; half of the labels are unknown."""
    rows = sheets(ann(spark, d).withColumn("speaker", F.when(c("event_id") % 89 == 0, "C").otherwise(c("speaker"))))
    lacks = ann(spark, d).filter("event_id % 97 = 0").select("utt_id", F.lit(2).alias("annotator"))
    return jobs.check_sheets(rows.join(lacks, ["utt_id", "annotator"], "left_anti"), SPEAKERS, ("Happy", "Neutral", "Sad"))


RUNS = "SELECT run, epoch, part, round(avg(CAST(label = pred AS INT)), 6) AS wa FROM preds GROUP BY 1, 2, 3"
J2_SQL = f"""{PREDS}, m AS ({RUNS}), v AS (SELECT a.run, a.epoch, a.wa AS val, b.wa AS tst FROM m a JOIN m b ON a.run = b.run AND a.epoch = b.epoch AND a.part = 0 AND b.part = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val, epoch) AS low FROM v),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM r WHERE low > 1),
o AS (SELECT run, 'Val' AS part, 'mean' AS row, avg(val) AS x FROM s GROUP BY 1 UNION ALL SELECT run, 'Tst', 'mean', avg(tst) FROM s GROUP BY 1
  UNION ALL SELECT run, 'Val', CASE k WHEN 1 THEN 'first' ELSE 'second' END, val FROM s WHERE k < 3 UNION ALL SELECT run, 'Tst', CASE k WHEN 1 THEN 'first' ELSE 'second' END, tst FROM s WHERE k < 3)
SELECT 'c' || CAST(run AS VARCHAR) AS configuration, part, row, format('{{:.4f}}', x) AS wa, format('{{:.4f}}', x / 2) AS wf1 FROM o"""


@query("J2_run_table", J2_SQL)
def j2(spark, d):
    """Logs of runs, one for each epoch of the predictions, beside an older log of each with other scores."""
    score = lambda x: F.format_number(x, 6)
    name = F.when(c("part") == 0, "Val").otherwise("Tst")
    text = lambda wa, kind: F.concat(name, F.lit(f" best {kind} WA: "), score(wa), F.lit(" UAR: "), score(wa), F.lit(" F1: "), score(wa), F.lit(" WF1: "), score(wa / 2))
    path = lambda day: F.format_string(f"results/c%d/run%d/log/none_2023-01-{day}-10.30.00.log", "run", "epoch")
    rows = metrics(spark, d)
    lines = rows.select(path("05").alias("path"), text(c("wa"), "WF1-result").alias("line"))
    older = rows.select(path("04"), text(F.lit(0.9), "WF1-result"))
    other = rows.select(path("05"), text(F.lit(0.8), "F1-result"))
    rest = rows.select(path("05"), F.lit("epoch 3"))
    part = lambda k: F.regexp_extract("path", r"results/(c\d+)/run(\d+)/", k)
    got = jobs.run_table(lines.union(older).union(other).union(rest), part(1), part(2).cast("int"))
    return got.select("configuration", "part", "row", "wa", "wf1")


J3_SQL = f"""{ANN}, sets AS ({TABLES["movie_set"][0]}), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
rows AS (SELECT dialog_id, set_name, pos, speaker || '_' || utt_id AS key, CASE WHEN event_id % 11 > 0 THEN event_id % 7 END AS label,
  CASE WHEN event_id % 13 > 0 AND v IS NOT NULL THEN list_sum(v) ELSE 0 END AS s, CASE WHEN event_id % 13 > 0 AND v IS NOT NULL THEN len(v) ELSE 64 END AS n
  FROM ann JOIN sets USING (movie) LEFT JOIN e ON e.vec_id = event_id)
SELECT dialog_id, set_name, count(*) AS n_turns, string_agg(key || ':' || coalesce(CAST(label AS VARCHAR), '-'), ' ' ORDER BY pos) AS turns,
  round(sum(s), 4) AS total, CAST(sum(n) AS BIGINT) AS dims FROM rows GROUP BY 1, 2"""


@query("J3_dialog_packs", J3_SQL)
def j3(spark, d):
    rows = ann(spark, d)
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(c("vec_id").alias("event_id"), V.doubles(c("embedding")).alias("ft"))
    key = F.concat_ws("_", "speaker", "utt_id").alias("key")
    own = rows.join(vectors, "event_id").select(key, F.when(c("event_id") % 13 > 0, c("ft")).otherwise(F.array(F.lit(1.0))).alias("ft"))
    labels = rows.filter("event_id % 11 > 0").select(key, (c("event_id") % 7).alias("label"))
    packs = jobs.dialog_packs(rows, {"audio": (own, 64)}, fixture(spark, d, "movie_set"), labels)
    total = lambda f: F.aggregate("turns", F.lit(0.0), lambda a, t: a + f(t))
    line = F.transform("turns", lambda t: F.concat_ws(":", t["key"], F.coalesce(t["label"].cast("string"), F.lit("-"))))
    return packs.select(
        "dialog_id", "set_name", F.size("turns").cast("long").alias("n_turns"), F.array_join(line, " ").alias("turns"),
        F.round(total(lambda t: V.total(t["audio"])), 4).alias("total"), total(lambda t: F.size(t["audio"])).cast("long").alias("dims"),
    )
