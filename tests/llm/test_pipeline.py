import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np

from convspark.llm import decontam, langid, lines, packing, resemblance


def say(rng, n):
    return " ".join("".join(rng.choice(["tha", "ing", "on", "er", "of"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_against_brute(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, say(rng, 30)) for i in range(3)]
    docs = []
    for i in range(80):
        text = say(rng, rng.choice([5, 60]))
        docs.append((i, f"Menu line\n{text}" if i % 3 else text))
    docs += [(100 + i, docs[i][1] + (" x" if i % 2 else "")) for i in range(9)]
    docs += [(200, f"a {items[0][1]} b"), (201, say(rng, 20) + "\n" + items[1][1].replace("a", "b", 1)), (202, None), (203, "12 !"), (204, ""), (3, docs[3][1])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t in docs if t and langid._LETTER.search(t)]
    counts = Counter(k for _, t in left for k in lines.document_keys(t.encode(), 1))
    left = [(i, "\n".join(x for x in t.split("\n") if counts[lines.line_key(x.encode())] < 10)) for i, t in left]
    left = list(dict(left).items())
    gone = resemblance.brute([(i, i, t) for i, t in left])
    assert len(gone) >= 5
    left = [(i, t) for i, t in left if i not in gone]
    hit = {i for i, _, _ in decontam.brute(left, items)}
    left = [(i, t) for i, t in left if i not in hit]
    assert {200, 201} <= hit and 202 not in dict(left) and len(left) > 50
    want = Counter()
    for i, t in left:
        ids = packing.text_ids([t.encode()], packing.default_tokenizer())[0] + np.array([1], dtype="<u4").tobytes()
        want[i, 0, 0, len(ids) // 4, zlib.crc32(ids)] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
