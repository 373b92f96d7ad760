"""Interval sweeps, the profile of a movie in one pass, and upserts that leave other partitions alone."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convspark.operators import agreement, annotation, corpus, faces
from convspark.sources import upkeep

UTTS = "dialog long, utt long, speaker string, pos long, f0 long, f1 long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def intervals(n=60, seed=2, dialogs=3, reach=4000):
    draw = random.Random(seed)
    rows = [(k % dialogs, k, draw.choice("ABC"), k, a := draw.randrange(reach), a + draw.randrange(-1, reach // 6)) for k in range(n)]
    return rows + [(9, 900, "A", 0, 0, 90_000), (9, 901, "B", 1, 45_000, 135_000), (9, 902, "A", 2, 50_000, 50_000)]


def winners(rows, frames):
    seen = {}
    for d, _, s, pos, _, _ in rows:
        seen[d, s] = min(seen.get((d, s), pos), pos)
    out = {}
    for d, at in frames:
        open_ = [(seen[d, s], f0, utt, s) for d2, utt, s, _, f0, f1 in rows if d2 == d and f0 <= at <= f1]
        if open_:
            out[d, at] = max(open_)[2:]
    return out


@pytest.mark.parametrize("block", [1 << 14, 512])
def test_frames_of_overlapping_intervals(spark, monkeypatch, block):
    monkeypatch.setattr(faces, "BLOCK", block)
    rows = intervals()
    frames = [(d, f) for d in (0, 1, 2) for f in range(0, 5200, 13)] + [(9, f) for f in (0, 44_999, 45_000, 50_000, 50_001, 90_000, 90_001, 135_000, 135_001)]
    got = faces.assign_frames(spark.createDataFrame(rows, UTTS), spark.createDataFrame(frames, "dialog long, frame long"))
    assert {(r.dialog, r.frame): (r.utt, r.speaker) for r in got.collect()} == winners(rows, frames)
    assert "explode(sequence(f0" not in plan(got)


def test_pieces_follow_the_number_of_intervals(spark):
    rows = intervals()
    utts = spark.createDataFrame(rows, UTTS)
    pieces = faces.frame_pieces(utts).collect()
    assert len(pieces) < 4 * len(rows)
    for d in {r.dialog for r in pieces}:
        own = sorted((r.f0, r.f1) for r in pieces if r.dialog == d)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False)) and all(a <= b for a, b in own)
    every = {(d, f) for d, _, _, _, a, b in rows if d != 9 for f in range(a, b + 1)}
    got = faces.assign_frames(utts.filter("dialog <> 9"))
    assert {(r.dialog, r.frame): (r.utt, r.speaker) for r in got.collect()} == winners(rows, every)
    assert faces.assign_frames(utts.limit(0)).count() == 0


def voted(spark, n=200):
    draw = random.Random(1)
    labels = ["a", "b", "c"]
    rows = [(f"m{k % 2}", f"d{k % 14}", k, draw.choice("AB"), draw.choice(labels), *[[draw.choice(labels)] for _ in range(3)]) for k in range(n)]
    return spark.createDataFrame(rows, "movie string, dialog_id string, pos long, speaker string, main string, p1 array<string>, p2 array<string>, p3 array<string>")


def test_profile_in_one_pass(spark):
    df = voted(spark)
    got = corpus.movie_profile(df, ("p1", "p2", "p3"))
    found = {(r.movie, r.what, r.key): r.n for r in got.collect()}
    want = Counter()
    for r in annotation.dialog_turn_counts(df, ["movie"]).collect():
        want.update({(r.movie, "count", k): r[k] for k in ("n_dialogs", "n_turns", "n_utts")})
    want.update((r.movie, "label", r.main) for r in df.collect())
    for name, moves in (("turn", corpus.turn_transitions(df)), ("within", corpus.within_turn_transitions(df))):
        want.update((r.movie, f"{name}_{r.kind}", f"{r.from_label}_{r.to_label}") for r in moves.collect())
    assert {k: n for k, n in found.items() if k[1] not in ("rating", "agreement")} == dict(want)
    kappas = {r.movie: r.kappa for r in agreement.fleiss_kappa(df, ["movie"]).collect()}
    maps = {r.movie: r for r in corpus.profile_maps(got).collect()}
    assert {m: r.kappa for m, r in maps.items()} == pytest.approx(kappas)
    assert maps["m0"].label == {k[2]: n for k, n in want.items() if k[:2] == ("m0", "label")}
    assert {r.kappa for r in corpus.profile_maps(corpus.movie_profile(df)).collect()} == {None}
    # dialogs by one exchange for the windows, movies by another for the counts
    assert plan(corpus.movie_profile(df, ("p1", "p2", "p3"))).count("Exchange hashpartitioning") == 2


def test_upsert_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = lambda ids, v: spark.createDataFrame([(i, i % 4 if i % 4 else None, v) for i in ids], "k long, part long, v string")
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "set").rglob("*.parquet")}
    upkeep.upsert_partitions(spark, path, rows(range(20), "old"), ["k"], ["part"])
    before = files()
    upkeep.upsert_partitions(spark, path, rows([2, 22], "new"), ["k"], ["part"])
    after = files()
    assert {f for f in before if "part=2" not in f} == {f for f in after if "part=2" not in f} and before != after
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {**dict.fromkeys(range(20), "old"), 2: "new", 22: "new"}
    upkeep.upsert_partitions(spark, path, rows([0, 4], "null part"), ["k"], ["part"])
    got = spark.read.parquet(path)
    assert {r.k for r in got.filter("v = 'null part'").collect()} == {0, 4} and got.count() == 21
    upkeep.upsert_partitions(spark, path, rows([], "none"), ["k"], ["part"])
    assert got.count() == 21
