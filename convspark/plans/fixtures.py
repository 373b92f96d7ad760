"""Tables in the shape the operators take, derived from the given ones with integer arithmetic.

Each is one SQL text that Spark and DuckDB both run, so that operators and their reference SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions.vocab import LABELS


def _name(index: str) -> str:
    return "CASE " + index + "".join(f" WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"


def _cell(k: int) -> str:
    main = f"(b + CASE WHEN event_id % {k + 2} = 0 THEN {k} ELSE 0 END) % 8"
    second = f"CASE WHEN event_id % 7 = 0 THEN (b + 4) % 8 WHEN event_id % {k + 4} = 0 THEN (b + {1 + 2 * k}) % 8 ELSE -1 END"
    return f"CASE WHEN pos > 1 AND event_id % {k + 5} = 1 THEN NULL WHEN {second} < 0 OR {second} = {main} THEN {_name(main)} ELSE {_name(main)} || ',' || {_name(second)} END"


def _tc(f: str) -> str:
    two = lambda x: f"lpad(CAST(CAST({x} AS BIGINT) AS STRING), 2, '0')"
    return f"'00:' || {two(f'({f} - {f} % 1500) / 1500')} || ':' || {two(f'({f} % 1500 - {f} % 25) / 25')} || ':' || {two(f'{f} % 25')}"


#: Utterances with the label cells of three annotators; a null cell stands for the label before.
ANNOTATIONS = f"""
SELECT *, {", ".join(f"{_cell(k)} AS l{k}" for k in (1, 2, 3))}, {_tc('f0')} AS start_tc, {_tc('f1')} AS end_tc,
  {", ".join(f"CASE WHEN user_id % {k + 3} = 0 AND pos % 10 = 0 THEN 'ok' END AS fb{k}" for k in (1, 2, 3))}
FROM (SELECT *, 'm' || CAST(user_id % 10 AS STRING) AS movie,
    'm' || CAST(user_id % 10 AS STRING) || '_' || CAST(user_id AS STRING) AS dialog_id,
    'm' || CAST(user_id % 10 AS STRING) || '_' || CAST(user_id AS STRING) || '_' || CAST(pos AS STRING) AS utt_id,
    CASE WHEN pos = 1 THEN 'A' WHEN event_id % 5 < 2 THEN 'B' ELSE 'A' END AS speaker, event_type || ' ' || props AS text,
    (event_id * 5 + user_id) % 8 AS b, pos * 40 AS f0, pos * 40 + 20 + event_id % 50 AS f1
  FROM (SELECT event_id, user_id, event_type, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos FROM events) base) keyed
"""

CONV = "SELECT CAST(conv_id AS STRING) AS dialog_id, turn AS pos, role AS speaker, text FROM conversations"

MOVIE_SET = "SELECT 'm' || CAST(n_nationkey AS STRING) AS movie, CASE WHEN n_nationkey < 7 THEN 'train' WHEN n_nationkey = 7 THEN 'val' ELSE 'test' END AS set_name FROM nation WHERE n_nationkey < 10"

PREDICTIONS = """
SELECT *, CASE WHEN (event_id * event_id + user_id) % 10 >= 3 THEN label ELSE (label + 1 + event_id % 2) % 7 END AS pred
FROM (SELECT event_id, user_id, event_id % 4 AS run, (event_id * 5 + user_id) % 7 AS label,
  CASE WHEN event_id % 11 <> 0 THEN 1 ELSE 0 END AS mask, CAST((event_id - event_id % 12) / 12 AS BIGINT) % 6 AS epoch,
  CAST((event_id - event_id % 4) / 4 AS BIGINT) % 2 AS part FROM events) p
"""

#: Faces by frame, with the boxes of detections and of tracks, and the active speaker of a frame.
FACES = """
SELECT vec_id, embedding, dialog, frame, face_idx, x1, x1 + 30 AS x2, (q * 7) % 5 - 1 AS score,
  CASE WHEN dialog = 4 THEN q % 12 = 1 ELSE q % 3 <> 0 END AS tracked, CASE WHEN CAST((frame - frame % 7) / 7 AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS spk
FROM (SELECT vec_id, embedding, q, dialog, CAST((q - q % 2) / 2 AS BIGINT) AS frame, q % 2 AS face_idx, CAST((q - q % 2) / 2 AS BIGINT) * 3 % 97 + q % 2 * 200 - 5 AS x1
  FROM (SELECT vec_id, embedding, CAST((vec_id - vec_id % 5) / 5 AS BIGINT) AS q, vec_id % 5 AS dialog FROM embeddings) a) f
WHERE NOT (face_idx = 1 AND frame % 4 = 0)
"""

TABLES = {"ann": (ANNOTATIONS, "events"), "conv": (CONV, "conversations"), "movie_set": (MOVIE_SET, "nation"), "preds": (PREDICTIONS, "events"), "faces": (FACES, "embeddings")}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = TABLES[name]
    return spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def with_sql(*names: str) -> str:
    """The WITH clause, without a comma at its end, that defines those fixtures for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][0]})" for n in names)


def sheets(ann: DataFrame) -> DataFrame:
    """One row for each utterance and annotator: the annotation sheets."""
    stacked = ", ".join(f"{k}, l{k}, fb{k}" for k in (1, 2, 3))
    return ann.select("movie", "dialog_id", "utt_id", "pos", "start_tc", "end_tc", "text", "speaker", F.expr(f"stack(3, {stacked}) AS (annotator, cell, feedback)"))
