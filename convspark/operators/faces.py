"""Frames, faces and speakers: interval and similarity joins.

Faces have dialog, frame, face_idx, bbox or emb; utterances dialog, utt, speaker, pos, f0, f1 (frames, ends included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions import keys as K
from convspark.functions import vectors as V
from convspark.operators.joins import join_counted
from convspark.sources.checkpoints import cut


def speaker_timeline(utts: DataFrame) -> DataFrame:
    """dialog, speaker and its intervals in order."""
    return utts.groupBy("dialog", "speaker").agg(F.array_sort(F.collect_list(F.struct("f0", "f1", "utt"))).alias("intervals"))


def interval_frames(utts: DataFrame) -> DataFrame:
    """a row for each frame of an utterance."""
    return utts.withColumn("frame", F.explode(F.sequence("f0", "f1")))


#: Frames of a block, in which intervals are swept: some eleven minutes at 25 frames a second.
BLOCK = 1 << 14


def frame_pieces(utts: DataFrame) -> DataFrame:
    """dialog, block, f0, f1, utt, speaker: pieces that do not overlap, each with the utterance that has it.

    Where utterances overlap, that of the speaker first seen later wins, then the later one. A sweep over the sorted
    boundaries of a block of a dialog holds the intervals that are open and puts the winner on each piece up to the next
    boundary, so that the cost follows the number of intervals, not of frames. Intervals are cut at the blocks' ends.
    """
    seen = F.min("pos").over(Window.partitionBy("dialog", "speaker"))
    block = F.explode(F.sequence(F.floor(F.col("f0") / BLOCK), F.floor(F.col("f1") / BLOCK)))
    rows = utts.withColumn("_seen", seen).filter("f0 <= f1").withColumn("block", block)
    start, last = F.greatest("f0", F.col("block") * BLOCK), F.least("f1", (F.col("block") + 1) * BLOCK - 1)
    own = F.struct(F.col("_seen").alias("seen"), F.col("f0").alias("f0"), F.col("utt").alias("utt"), F.col("speaker").alias("speaker"), last.alias("last"))
    # an interval opens at its first frame; the one after its last is a boundary, too
    edges = F.inline(F.array(F.struct(start.alias("at"), own.alias("opens")), F.struct((last + 1).alias("at"), F.lit(None).alias("opens"))))
    points = rows.select("dialog", "block", edges).repartition("dialog", "block").groupBy("dialog", "block", "at").agg(F.collect_list("opens").alias("opens"))
    swept = points.groupBy("dialog", "block").agg(F.array_sort(F.collect_list(F.struct("at", "opens"))).alias("points"))
    kind = points.schema["opens"].dataType.simpleString()
    piece = f"struct<f0:bigint,best:{kind[len('array<'):-1]}>"
    start_state = F.struct(F.array().cast(kind).alias("open"), F.array().cast(f"array<{piece}>").alias("pieces"))

    def step(state: Column, point: Column) -> Column:
        still = F.concat(F.filter(state["open"], lambda x: x["last"] >= point["at"]), point["opens"])
        return F.struct(still.alias("open"), F.concat(state["pieces"], F.array(F.struct(point["at"].cast("bigint").alias("f0"), F.array_max(still).alias("best")).cast(piece))).alias("pieces"))

    pieces = swept.select("dialog", "block", F.aggregate("points", start_state, step)["pieces"].alias("pieces"))
    ends = F.transform("pieces", lambda p, k: F.struct(p["f0"].alias("f0"), (F.get("pieces", k + 1)["f0"] - 1).alias("f1"), p["best"]["utt"].alias("utt"), p["best"]["speaker"].alias("speaker")))
    return pieces.select("dialog", "block", F.inline(F.filter(ends, lambda p: p["utt"].isNotNull())))


def assign_frames(utts: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """dialog, frame, utt, speaker of each of frames (dialog, frame) that an utterance has; without frames, of all.

    The frames of a block of a dialog look up the piece that starts last before them.
    """
    pieces = frame_pieces(utts)
    if frames is None:
        return pieces.select("dialog", F.explode(F.sequence("f0", "f1")).alias("frame"), "utt", "speaker")
    asked = frames.select("dialog", "frame").distinct().withColumn("block", F.floor(F.col("frame") / BLOCK))
    piece = F.struct("f1", "utt", "speaker")
    rows = asked.select("dialog", "block", "frame", F.lit(None).cast(pieces.select(piece.alias("p")).schema["p"].dataType).alias("p"), F.lit(1).alias("kind"))
    rows = rows.union(pieces.select("dialog", "block", F.col("f0").alias("frame"), piece, F.lit(0)))
    held = F.last("p", ignorenulls=True).over(Window.partitionBy("dialog", "block").orderBy("frame", "kind"))
    return rows.withColumn("p", held).filter("kind = 1 AND frame <= p.f1").select("dialog", "frame", "p.utt", "p.speaker")


def clamp_boxes(detections: DataFrame) -> DataFrame:
    """whole numbers, no corner below 0."""
    return detections.withColumn("bbox", F.transform("bbox", lambda x: F.greatest(x, F.lit(0.0)).cast("int")))


def match_tracks(detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """dialog, frame, face_idx of the detection whose truncated box a track of positive score has; of several the
    later crop and then the later face."""
    box = lambda df: df.withColumn("bbox", F.transform("bbox", lambda x: x.cast("int")))
    met = box(detections).join(box(tracks.filter("score > 0")).select("dialog", "frame", "bbox", "crop_id"), ["dialog", "frame", "bbox"])
    return met.groupBy("dialog", "frame").agg(F.max(F.struct("crop_id", "face_idx"))["face_idx"].alias("face_idx"))


def active_faces_by_speaker(matches: DataFrame, assigned: DataFrame, min_faces: int = 10) -> DataFrame:
    """matched faces by the frame's speaker; speakers with under min_faces of them are left out."""
    met = matches.join(assigned, ["dialog", "frame"])
    return met.withColumn("n", F.count("*").over(Window.partitionBy("dialog", "speaker"))).filter(F.col("n") >= min_faces)


def pick_anchors(active: DataFrame) -> DataFrame:
    """of n faces of a speaker a third if n > 300, half if n > 100, else all, evenly spaced: places
    j (n - 1) div (k - 1)."""
    w = Window.partitionBy("dialog", "speaker")
    rows = active.withColumns({"_i": F.row_number().over(w.orderBy("frame", "face_idx")) - 1, "_n": F.count("*").over(w)})
    k = F.when(F.col("_n") > 300, F.floor(F.col("_n") / 3)).when(F.col("_n") > 100, F.floor(F.col("_n") / 2)).otherwise(F.col("_n"))
    rows = rows.withColumn("_k", k)
    j = F.expr("(_i * (_k - 1) + _n - 2) div greatest(_n - 1, 1)")
    keep = (F.col("_k") == F.col("_n")) | ((j * (F.col("_n") - 1) / (F.col("_k") - 1)).cast("long") == F.col("_i"))
    return rows.filter(keep).drop("_i", "_n", "_k")


def anchor_means(anchors: DataFrame) -> DataFrame:
    """dialog, speaker, the mean of the anchors' unit vectors: a face's dot product with it is its mean cosine."""
    parts = anchors.select("dialog", "speaker", F.posexplode(V.unit(V.doubles(F.col("emb")))).alias("dim", "x"))
    means = parts.groupBy("dialog", "speaker", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("dialog", "speaker").agg(F.array_sort(F.collect_list(F.struct("dim", "x")))["x"].alias("anchor"))


def mean_similarity(faces: DataFrame, anchors: DataFrame) -> DataFrame:
    """F8: each face with each speaker of its dialog and the mean cosine to that speaker's anchors."""
    met = faces.join(anchor_means(anchors), "dialog")
    return met.select("dialog", "frame", "face_idx", "speaker", V.dot(V.unit(V.doubles(F.col("emb"))), F.col("anchor")).alias("sim"))


def best_match(sims: DataFrame, score: Column) -> DataFrame:
    """dialog, frame, speaker, best, worst: the faces of the highest and the lowest score, the first of equals."""
    face, low = F.col("face_idx"), -F.col("face_idx")
    return sims.groupBy("dialog", "frame", "speaker").agg(F.max_by(face, F.struct(score, low)).alias("best"), F.max_by(face, F.struct(-score, low)).alias("worst"))


def _frame_faces(faces: DataFrame, anchors: DataFrame) -> DataFrame:
    """dialog, frame, sims: each face of a frame and its similarity to each speaker of the dialog, an empty list where the
    dialog has no anchors. One shuffle of faces by frame; the speakers' means are one row a dialog."""
    means = anchor_means(anchors).groupBy("dialog").agg(F.collect_list(F.struct("speaker", "anchor")).alias("speakers"))
    own = V.unit(V.doubles(F.col("emb")))
    met = faces.select("dialog", "frame", "face_idx", own.alias("_v")).join(means, "dialog", "left")
    sims = F.transform(F.coalesce("speakers", F.array().cast(means.schema["speakers"].dataType)), lambda s: F.struct(s["speaker"].alias("speaker"), V.dot(F.col("_v"), s["anchor"]).alias("sim")))
    return met.select("dialog", "frame", F.struct("face_idx", sims.alias("sims")).alias("face")).groupBy("dialog", "frame").agg(F.array_sort(F.collect_list("face")).alias("faces"))


def link_faces(faces: DataFrame, matches: DataFrame, assigned: DataFrame, anchors: DataFrame, seed: int = 0) -> DataFrame:
    """dialog, frame, utt, speaker, face_idx, case for every frame with faces and a speaker.

    In turn: the only face; the active one; where all active faces of the utterance have one index, that face if its
    mean similarity to the speaker's anchors is over 0.6, else the other; the face most like the speaker's anchors;
    the one least like the other speaker's; one by a seeded hash.

    All that is known of a frame's few faces is one row, so that the rest is joins by frame and one window by utterance.
    """
    rows = _frame_faces(faces, anchors).join(assigned, ["dialog", "frame"]).join(matches.withColumnRenamed("face_idx", "active_face"), ["dialog", "frame"], "left")
    utterance = Window.partitionBy("dialog", "utt")
    least, most = F.min("active_face").over(utterance), F.max("active_face").over(utterance)
    rows = rows.withColumn("usual", F.when(least == most, least))
    # scores as (rounded similarity, -face): the largest is the best, the first of equals; of the negative the worst
    scored = lambda f, of: F.get(F.filter(f["sims"], of), F.lit(0))["sim"]
    mine = lambda s: s["speaker"] == F.col("speaker")
    ids = F.transform("faces", lambda f: f["face_idx"])

    def extreme(of, sign: int) -> Column:
        values = F.transform("faces", lambda f: F.struct((F.round(scored(f, of), 9) * sign).alias("sim"), (-f["face_idx"]).alias("low")))
        return -F.array_max(F.filter(values, lambda x: x["sim"].isNotNull()))["low"]

    usual_sim = F.get(F.filter(F.transform("faces", lambda f: F.when(f["face_idx"] == F.col("usual"), scored(f, mine))), lambda x: x.isNotNull()), F.lit(0))
    rest = F.get(F.filter(ids, lambda i: i != F.col("usual")), F.lit(0))
    chance = F.get(ids, F.pmod(F.conv(F.substring(K.seeded(seed, "dialog", "frame"), 1, 8), 16, 10).cast("long"), F.size(ids)).cast("int"))
    rows = rows.withColumns({"own_face": extreme(mine, 1), "other_face": extreme(lambda s: s["speaker"] != F.col("speaker"), -1), "usual_sim": usual_sim})
    steps = [
        ("single", F.size("faces") == 1, F.get(ids, F.lit(0))),
        ("active", F.col("active_face").isNotNull(), F.col("active_face")),
        ("same_utterance", F.col("usual_sim").isNotNull(), F.when(F.col("usual_sim") > 0.6, F.col("usual")).otherwise(F.coalesce(rest, F.col("usual")))),
        ("own", F.col("own_face").isNotNull(), F.col("own_face")),
        ("other", F.col("other_face").isNotNull(), F.col("other_face")),
    ]
    face, case = F, F
    for name, holds, value in steps:
        face, case = face.when(holds, value), case.when(holds, name)
    return rows.select("dialog", "frame", "utt", "speaker", face.otherwise(chance).alias("face_idx"), case.otherwise("random").alias("case"))


def link_case_counts(links: DataFrame) -> DataFrame:
    """F11"""
    return links.groupBy("case").agg(F.count("*").alias("n"))


def utterance_faces(links: DataFrame, utts: DataFrame) -> DataFrame:
    """each utterance with its speaker's faces in frame order; none is an empty list."""
    found = links.groupBy("dialog", "utt").agg(F.array_sort(F.collect_list(F.struct("frame", "face_idx"))).alias("faces"))
    return utts.join(found, ["dialog", "utt"], "left").withColumn("faces", F.coalesce("faces", F.array().cast("array<struct<frame:bigint,face_idx:bigint>>")))


def face_density(detections: DataFrame, assigned: DataFrame) -> DataFrame:
    """by dialog: frames with faces, faces, and faces in frames of utterances."""
    inside = assigned.select("dialog", "frame", F.lit(1).alias("_in"))
    per = detections.groupBy("dialog", "frame").agg(F.count("*").alias("n")).join(inside, ["dialog", "frame"], "left")
    return per.groupBy("dialog").agg(F.count("*").alias("n_frames"), F.sum("n").alias("n_faces"), F.sum(F.when(F.col("_in") == 1, F.col("n")).otherwise(0)).alias("n_in_utterances"))


#: Points of a group whose distances index the others, and how many of these make cells.
PIVOTS, RINGS = 4, 2


def _indexed(folded: DataFrame, by: str, eps: float) -> DataFrame:
    """folded with ball, the first pivot of the group at most eps / 2 away (null: none), and cells of rings of width eps.

    Two members of a ball are at most eps apart. The distances of two points at most eps apart from any pivot differ by
    eps at most, so they lie in one cell or in cells that touch. Widths have a margin for rounding.
    """
    chosen = [F.min_by("_v", F.xxhash64(F.lit(k), "_v")).alias(f"_pivot{k}") for k in range(PIVOTS)]
    near = folded.join(folded.groupBy(by).agg(*chosen), by)
    near = near.withColumns({f"_d{k}": V.euclidean(F.col("_v"), F.col(f"_pivot{k}")) for k in range(PIVOTS)})
    ball = F.coalesce(*[F.when(F.col(f"_d{k}") <= eps / 2 * (1 - 1e-9), F.lit(k)) for k in range(PIVOTS)])
    cell = F.array(*[F.floor(F.col(f"_d{k}") / (eps * (1 + 1e-9))) for k in range(RINGS)])
    return near.select(by, "p", "w", "_v", ball.alias("ball"), cell.alias("cell"))


def near_pairs(indexed: DataFrame, by: str, eps: float) -> DataFrame:
    """by, a, b, wb: points of a group at most eps apart that are not in one ball, each pair both ways, and b's weight.

    Cells that touch are joined: points outside balls with all points, and each ball with each other one, so that no
    pair within a ball is made.
    """
    around = F.expr("transform(sequence(0, 8), k -> array(cell[0] + k div 3 - 1, cell[1] + k % 3 - 1))")
    left = indexed.select(by, F.col("p").alias("a"), F.col("w").alias("wa"), F.col("_v").alias("va"), F.col("ball").alias("ball_a"), "cell")
    right = indexed.select(by, F.col("p").alias("b"), F.col("w").alias("wb"), F.col("_v").alias("vb"), F.col("ball").alias("ball_b"), F.explode(around).alias("cell"))
    close = V.euclidean(F.col("va"), F.col("vb")) <= eps
    loose = left.filter("ball_a IS NULL").join(right, [by, "cell"]).filter((F.col("a") != F.col("b")) & close).select(by, "a", "wa", "b", "wb", "ball_b")
    others = F.array(*[F.lit(k) for k in range(PIVOTS)])
    balls = left.filter("ball_a IS NOT NULL").withColumn("ball_b", F.explode(F.filter(others, lambda k: k != F.col("ball_a"))))
    mates = right.filter("ball_b IS NOT NULL").withColumn("ball_a", F.explode(F.filter(others, lambda k: k != F.col("ball_b"))))
    across = balls.join(mates, [by, "cell", "ball_a", "ball_b"]).filter(close).select(by, "a", "b", "wb")
    back = loose.filter("ball_b IS NOT NULL").select(by, F.col("b").alias("a"), F.col("a").alias("b"), F.col("wa").alias("wb"))
    return loose.select(by, "a", "b", "wb").union(back).union(across)


def cluster_dbscan(points: DataFrame, key: str, v: str, by: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """F16: by, key, cluster: the smallest core point that chains of core points reach; -1: noise. A border point takes
    the smallest cluster beside it.

    Equal vectors are one point with their number as its weight. A group's points are indexed by their distances to a few
    of them; balls of radius eps / 2 need no pairs inside, as all of a ball are neighbours. The other pairs are written
    once; rounds of least labels go over them. Computes while it is called.
    """
    rows = cut(points.select(by, key, V.doubles(F.col(v)).alias("_v")).filter("_v IS NOT NULL"))
    folded = cut(rows.groupBy(by, "_v").agg(F.min(key).alias("p"), F.count("*").alias("w")))
    indexed = cut(_indexed(folded, by, eps))
    pairs = cut(near_pairs(indexed, by, eps))
    ball_weights = indexed.filter("ball IS NOT NULL").groupBy(by, "ball").agg(F.sum("w").alias("_inside"))
    beside = pairs.groupBy(by, F.col("a").alias("p")).agg(F.sum("wb").alias("_beside"))
    met = indexed.drop("_v").join(ball_weights, [by, "ball"], "left").join(beside, [by, "p"], "left")
    n = F.coalesce("_inside", "w") + F.coalesce("_beside", F.lit(0))
    met = cut(met.select(by, "p", "ball", (n >= min_samples).alias("core")))
    cores = met.filter("core").select(by, "p", "ball")
    hubs = cores.filter("ball IS NOT NULL").groupBy(by, "ball").agg(F.min("p").alias("hub"))
    spokes = cores.join(hubs, [by, "ball"]).filter("p <> hub").select(by, F.col("p").alias("a"), F.col("hub").alias("b"))
    links = pairs.join(cores.select(by, F.col("p").alias("a")), [by, "a"], "left_semi").join(cores.select(by, F.col("p").alias("b")), [by, "b"], "left_semi").select(by, "a", "b")
    links = cut(links.union(spokes).union(spokes.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).union(cores.select(by, F.col("p").alias("a"), F.col("p").alias("b"))))
    labels = cut(cores.select(by, "p", F.col("p").alias("_root")))
    while True:
        spread = links.join(labels.withColumnRenamed("p", "b"), [by, "b"]).groupBy(by, F.col("a").alias("p")).agg(F.min("_root").alias("_root"))
        # a label's own label is as good or better: the jump halves the way of long chains
        jumped = cut(spread.join(spread.select(by, F.col("p").alias("_root"), F.col("_root").alias("further")), [by, "_root"]).select(by, "p", F.col("further").alias("_root")))
        changed = jumped.join(labels, [by, "p", "_root"], "left_anti").limit(1).count()
        labels = jumped
        if not changed:
            break
    rooted = met.join(labels, [by, "p"], "left")
    in_ball = rooted.filter("ball IS NOT NULL").groupBy(by, "ball").agg(F.min("_root").alias("_ball_root"))
    border = pairs.join(labels.withColumnRenamed("p", "b"), [by, "b"]).groupBy(by, F.col("a").alias("p")).agg(F.min("_root").alias("_next"))
    near = rooted.join(in_ball, [by, "ball"], "left").join(border, [by, "p"], "left")
    cluster = F.coalesce("_root", F.least("_ball_root", "_next"), F.lit(-1)).alias("cluster")
    found = cut(near.select(by, "p", cluster).join(folded, [by, "p"]).select(F.struct(by, "_v").alias("_at"), "cluster", "w"))
    return join_counted(rows.select(by, key, F.struct(by, "_v").alias("_at")), found, "_at", "w").select(by, key, "cluster")


def cluster_label_table(clustered: DataFrame, flag: Column) -> DataFrame:
    """by cluster the members for which the flag holds, and the others."""
    return clustered.groupBy("cluster").agg(F.count_if(flag).alias("suffix_0"), F.count_if(~flag).alias("others"))
