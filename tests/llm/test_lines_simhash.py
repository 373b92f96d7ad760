import random
import subprocess
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convspark.llm import lines, queries, simhash

DOCS = "doc_id long, text string, key string, n_docs int, lang string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def make(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, "en") for i, t in texts], DOCS)


@pytest.mark.parametrize("broadcast_bits", [28, 0])
def test_lines_against_brute(spark, monkeypatch, broadcast_bits):
    monkeypatch.setattr(lines, "BROADCAST_BITS", broadcast_bits)
    rng = random.Random(5)
    pool = ["Common line", " common LINE\t", "other", "", "  ", "É", "é", "x" * 5000, "uniq"]
    texts = [(i, "\n".join([rng.choice(pool) for _ in range(rng.randrange(6))] + [f"own {i}"])) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "\n\n"), (5, texts[5][1]), (103, "a\r\nCommon line\r\n"), (None, "other\nuniq"), (None, "other")]
    for min_docs, min_chars in ((10, 1), (2, 3)):
        got = rows(lines.kept_digest(lines.dedup_lines(make(spark, texts), min_docs, min_chars)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert got == sorted(lines.brute(texts, min_docs, min_chars), key=repr)


def test_sql_of_lines_counts_rows(spark, tmp_path):
    """Rows that repeat a doc_id, or have none, are documents of their own to the operator and to its SQL."""
    duck = pytest.importorskip("duckdb").connect()
    texts = [(7, f"same\nown {i}") for i in range(10)] + [(None, "few"), (None, None), (8, " FEW\t\nx"), (9, "")] + [(20 + i, "few") for i in range(6)]
    df = make(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.execute(queries.OP5_SQL)
    order = [[d[0] for d in found.description].index(c) for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")]
    want = sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)
    assert rows(lines.kept_digest(lines.dedup_lines(df)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert sum(r[2] for r in want) == 10


def test_lines_keep_first_and_empty(spark):
    texts = [(3, "a\nb\nA"), (1, "c\na\na"), (2, None)]
    got = rows(lines.dedup_lines(make(spark, texts), min_docs=2, keep="first"), "doc_id", "kept")
    assert got == [(1, "c\na"), (2, ""), (3, "b")]
    assert lines.dedup_lines(make(spark, []), 2).count() == 0


def test_simhash_against_brute(spark):
    rng = random.Random(7)
    vocabulary = [f"W{i}" for i in range(40)]
    texts = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 200]))]
        texts.append((3 * i, " ".join(base)))
        texts.append((3 * i + 1, "\n".join(base)))
        texts.append((3 * i + 2, " ".join(base[:-1] + ["zz"])))
    texts += [(500, None), (501, ""), (502, " \t"), (7, texts[7][1]), (503, "ABC é É"), (504, "word " * 70000)]
    got = rows(simhash.near_duplicates(make(spark, texts)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(simhash.brute(texts), key=repr)
    assert simhash.near_duplicates(make(spark, [])).count() == 0


def test_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        prints |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    base = rng.getrandbits(64)  # a dense group, many to an entry
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {base ^ (7 << k) ^ (7 << k + 30) for k in range(20)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {(r["node"]): r["root"] for r in simhash.connected_components(links).collect()}
    root = {p: p for p in prints}
    near = [(p, q) for p in prints for q in prints if ((p ^ q) & ((1 << 64) - 1)).bit_count() <= 2]
    before = None
    while before != root:
        before = dict(root)
        for p, q in near:
            root[p] = root[q] = min(root[p], root[q])
    assert {p: got.get(p, p) for p in prints} == root
    assert links.filter(F.col("a") == F.col("b")).count() == 0


def test_tasks_hold_little():
    """What a task hashes at once stays small, however many lines it reads."""
    batch = pa.RecordBatch.from_pydict({"text": ["\n".join(str(k) for k in range(at, at + 1000)) for at in range(0, 1_200_000, 1000)]})
    tracemalloc.start()
    found = sum(sum(b.column("lines").to_pylist()) for b in lines._filter_bits(24, 1)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1_200_000 and peak < 100e6


def test_workers_of_the_pipeline_need_no_pandas():
    """A worker lives through all stages, and so would pandas, in each of them."""
    code = "import sys; import corpus_pipeline; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
