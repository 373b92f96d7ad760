import random
import zlib

from convspark.llm import langid


def test_every_language_is_learned(spark):
    """Also languages beyond the 64 most frequent ones."""
    rng = random.Random(5)
    rows = []
    for k in range(70):
        syllables = ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(2)) for _ in range(8)]
        for _ in range(12 if k < 64 else 10):
            rows.append((len(rows), " ".join("".join(rng.choices(syllables, k=2)) for _ in range(20)), f"l{k:02}"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(set(got.values())) == 70
    unseen = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == lang for i, lang in unseen) > 0.97 * len(unseen)
