"""Whole jobs on hand-written tables."""

from convspark import jobs

SHEET = "movie string, dialog_id string, utt_id string, pos long, text string, speaker string, annotator int, cell string, feedback string, start_tc string"


def sheet(rows):
    """(utterance, speaker, cells of three annotators) of one dialog."""
    return [("m", "m_1", f"m_1_{k}", k, f"t{k}", s, a, cell, "ok" if a == 1 and k == 1 else None, "00:00:00:00") for k, (s, *cells) in enumerate(rows, 1) for a, cell in enumerate(cells, 1) if cell != "gone"]


def test_annotation(spark):
    rows = sheet([("A", "Happy", "Happy", "Sad"), ("B", None, "Sad", "Sad"), ("B", "Odd", "Odd", "Odd"), ("A", "Sad", "gone", "Sad")])
    admin = spark.createDataFrame([("m", "x", "★★", "y", "★", "z", "")], "movie string, name1 string, rating1 string, name2 string, rating2 string, name3 string, rating3 string")
    done = jobs.annotate(spark.createDataFrame(rows, SHEET), admin)
    assert sorted((r.check, r.key, r.found) for r in done.violations.collect()) == [("annotators_aligned", "m_1", "3 2 2"), ("labels", "Odd", "3")]
    assert [(r.utt_id, r.main) for r in done.voted.orderBy("pos").collect()] == [("m_1_1", "Happy"), ("m_1_2", "Sad"), ("m_1_3", "Odd")]
    report, statistics = done.report.collect()[0], done.statistics.collect()[0]
    assert (report.stars1, report.stars2, report.stars3, report.p1_gold, report.p3_gold) == (2, 1, 0, 1.0, 1 / 3)
    assert (statistics.n_dialogs, statistics.n_turns, statistics.n_utts, statistics.kappa) == (1, 2, 3, report.fleiss)
    assert {r.utt_id for r in done.low_agreement.collect()} <= {"m_1_1", "m_1_2", "m_1_3"}
    empty = jobs.annotate(spark.createDataFrame([], SHEET))
    assert [t.count() for t in empty] == [0, 0, 0, 0, 0]


def test_run_table(spark):
    line = "{} best WF1-result WA: {} UAR: 0.1 F1: 0.2 WF1: {}"
    logs = {
        ("a", 1, "01"): (0.9, 0.9), ("a", 1, "02"): (0.5, 0.6), ("a", 2, "01"): (0.4, 0.7), ("a", 3, "01"): (0.6, 0.8), ("b", 1, "01"): (0.3, 0.3),
    }
    rows = [(f"{c}/{run}/none_2023-01-{day}-00.00.00.log", line.format(part, x, x)) for (c, run, day), (v, t) in logs.items() for part, x in (("Val", v), ("Tst", t))]
    rows += [("a/4/none_2023-01-01-00.00.00.log", line.format("Val", 0.99, 0.99)), ("a/1/none_2023-01-02-00.00.00.log", "epoch 1")]
    path = spark.createDataFrame(rows, "path string, line string")
    from pyspark.sql import functions as F

    part = lambda k: F.split_part(F.col("path"), F.lit("/"), F.lit(k))
    got = {(r.configuration, r.part, r.row): r.wf1 for r in jobs.run_table(path, part(1), part(2).cast("int")).collect()}
    # run 2 has the lowest validation score, run 4 lacks a test line; the later log of run 1 counts
    assert (got["a", "Val", "mean"], got["a", "Val", "first"], got["a", "Val", "second"]) == ("0.5500", "0.5000", "0.6000")
    assert (got["a", "Tst", "mean"], got["a", "Tst", "first"], got["a", "Tst", "second"]) == ("0.7000", "0.6000", "0.8000")
    assert got["b", "Tst", "mean"] is None


def test_packs_and_batches(spark):
    utts = [("m0", f"m0_{d}_{k}", k, "A " if k % 2 else "B", f"t{k}") for d in range(3) for k in range(1, 3 + d)] + [("m9", "m9_1_1", 1, "A", "x"), ("m0", None, 1, "A", "x")]
    rows = spark.createDataFrame(utts, "movie string, utt_id string, pos long, speaker string, text string")
    fts = spark.createDataFrame([("A_m0_0_1", [1.0, 2.0]), ("B_m0_0_2", [5.0]), ("A_m0_1_1", [])], "key string, ft array<double>")
    labels = spark.createDataFrame([("A_m0_0_1", 3), ("B_m0_0_2", 4)], "key string, label long")
    sets = spark.createDataFrame([("m0", "train")], "movie string, set_name string")
    packs = jobs.dialog_packs(rows, {"audio": (fts, 2)}, sets, labels)
    got = {r.dialog_id: r for r in packs.collect()}
    assert {d: [(t.key, t.speaker, t.label, t.audio) for t in r.turns][:2] for d, r in got.items()}["m0_0"] == [("A_m0_0_1", "A", 3, [1.0, 2.0]), ("B_m0_0_2", "B", 4, [0.0, 0.0])]
    assert {d: len(r.turns) for d, r in got.items()} == {"m0_0": 2, "m0_1": 3, "m0_2": 4} and {r.set_name for r in got.values()} == {"train"}
    batches = {r.dialog_id: r for r in jobs.training_batches(packs, {"audio": 2}, 2).collect()}
    assert set(batches) == {"m0_0", "m0_1"}
    assert [t.label for t in batches["m0_0"].turns] == [3, 4, -1] and batches["m0_0"].padded == [False, False, True] and batches["m0_0"].turns[2].audio == [0.0, 0.0]


def test_gold_without_filling_again(spark):
    """Gold labels of aligned utterances are those that filled sheets give; only annotator 3's columns reach the merge."""
    from convspark.operators import annotation

    rows = [("m1", f"m1_{d}", f"m1_{d}_{p}", p, f"t{a}", "A" if p % 2 else "B", a, None if p > 1 and (p + a) % 3 == 0 else "Happy" if p % a else "Sad", "ok" if (d + a) % 3 == 0 and p == 2 else None, "00:00:01") for d in (1, 2, 3) for p in (1, 2, 3, 4) for a in (1, 2, 3)]
    sheets = annotation.sheet_labels(spark.createDataFrame(rows, SHEET))
    merged = annotation.merge_sheets(sheets)
    filled = annotation.fill_labels_forward(sheets)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(merged.select(sorted(merged.columns))) == key(annotation.align_annotators(filled).select(sorted(merged.columns)))
    assert {r.text for r in merged.collect()} == {"t3"} and merged.count() == 12
    gold = key(annotation.gold_from_feedback(filled))
    assert gold and key(annotation.gold_of_aligned(merged, sheets)) == gold
    plan = annotation.gold_of_aligned(merged.checkpoint(), sheets)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_bundled_subtitles(spark, tmp_path):
    """As many dialogs as one likes are few files, and parsed like files of their own."""
    from convspark.sources import files

    text = "1\n00:00:01,031 --> 00:00:01,047\n hi \n\n\n00:00:02,062 --> 00:00:02,094\nno index\n"
    rows = spark.createDataFrame([(str(i), text) for i in range(300)], "dialog_id string, text string").coalesce(2)
    files.write_subtitles(rows, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("**/*.parquet"))) <= 2
    got = files.parse_subtitles(spark, str(tmp_path / "s"), bundled=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, files.parse_cues(rows).collect())) and got.count() == 300
