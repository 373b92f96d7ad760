"""Context graphs of dialogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.operators.numbering import with_sum_before


#: Positions of a block: what a task joins of a dialog is at most a block with a block.
BLOCK = 256


def window_edges(utts: DataFrame, past: int, future: int) -> DataFrame:
    """G1: dialog_id, src, dst and speakers: dst lies at most `past` before or `future` after src; -1: no limit.

    Rows join by dialog and block of positions, so that a long dialog is not one task's product. Without a limit blocks
    reach to the dialog's ends, and each of its blocks meets each other one by itself.
    """
    width = min(BLOCK, past + future + 1) if past >= 0 and future >= 0 else BLOCK
    cols = lambda p: [F.col("dialog_id"), F.col("pos").alias(p), F.col("speaker").alias(f"{p}_speaker")]
    block = lambda x: F.floor(x / width)
    left = utts
    if past < 0 or future < 0:
        left = utts.join(utts.groupBy("dialog_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last")), "dialog_id")
    low = F.col("pos") - past if past >= 0 else F.col("_first")
    high = F.col("pos") + future if future >= 0 else F.col("_last")
    near = F.explode(F.when(block(low) <= block(high), F.sequence(block(low), block(high))))
    left = left.select(*cols("src"), block(F.col("pos")).alias("own"), near.alias("block"))
    right = utts.select(*cols("dst"), block(F.col("pos")).alias("block"))
    if past < 0 or future < 0:  # the pair of blocks is the key: those of a long dialog are dealt to many tasks
        reach = utts.groupBy("dialog_id", block(F.col("pos")).alias("own")).agg(F.lit(1).alias("_one")).drop("_one")
        right = right.join(reach, "dialog_id")
        pairs = left.join(right, ["dialog_id", "own", "block"])
    else:
        pairs = left.drop("own").join(right, ["dialog_id", "block"])
    after = F.lit(True) if past < 0 else F.col("dst") >= F.col("src") - past
    before = F.lit(True) if future < 0 else F.col("dst") <= F.col("src") + future
    return pairs.filter(after & before).select("dialog_id", "src", "src_speaker", "dst", "dst_speaker")


def typed_edges(edges: DataFrame, speakers: list[str], mode: str = "speakers") -> DataFrame:
    """rel = 2 (s0 S + s1) + (src >= dst); G3, mode same_speaker: 2 (other speaker) + (src >= dst)."""
    late = (F.col("src") >= F.col("dst")).cast("int")
    if mode == "same_speaker":
        return edges.withColumn("rel", 2 * (F.col("src_speaker") != F.col("dst_speaker")).cast("int") + late)
    index = lambda c: F.array_position(F.array(*[F.lit(s) for s in speakers]), F.col(c)) - 1
    return edges.withColumn("rel", 2 * (index("src_speaker") * len(speakers) + index("dst_speaker")) + late)


def global_node_ids(utts: DataFrame, order: str = "dialog_id") -> DataFrame:
    """dialog_id, pos, node: numbers over all dialogs in order. Sizes of dialogs are added up by ranges."""
    sizes = utts.groupBy(order).agg(F.count("*").alias("n"))
    before = with_sum_before(sizes, [F.asc(order)], F.col("n"), "before").select(order, "before")
    place = F.row_number().over(Window.partitionBy(order).orderBy("pos")) - 1
    return utts.withColumn("_k", place).join(before, order).select("dialog_id", "pos", (F.col("before") + F.col("_k")).alias("node"))


def _limits(past: int, future: int, n: str) -> Column:
    """Events of a position that n utterances have: n as a point, and its n windows' ends, where the running count of
    points is added (upper end) or taken away (lower end, the position before)."""
    event = lambda value, point, sign: F.struct(value.alias("value"), point.alias("point"), sign.alias("sign"))
    zero, times = F.lit(0).cast("long"), F.col(n)
    return F.array(event(F.col("pos"), times, zero), event(F.col("pos") + future, zero, times), event(F.col("pos") - past - 1, zero, -times))


def edge_counts(utts: DataFrame, past: int, future: int) -> DataFrame:
    """dialog_id, n_edges of window_edges, counted without them.

    The edges of src are the utterances up to its upper end less those before its lower one; both come from a running
    count of positions. A dialog whose windows have no limit has n * n of them.
    """
    places = utts.groupBy("dialog_id", "pos").agg(F.count("*").alias("n"))
    if past < 0 and future < 0:
        return utts.groupBy("dialog_id").agg((F.count("*") * F.count("*")).alias("n_edges"))
    # an end without a limit lies behind all positions, or before them
    events = places.select("dialog_id", "pos", "n", F.inline(_limits(max(past, 0), max(future, 0), "n")))
    upto = F.sum("point").over(Window.partitionBy("dialog_id").orderBy("value"))
    kept = F.lit(True) if past >= 0 else F.col("sign") >= 0
    kept = kept if future >= 0 else kept & (F.col("sign") <= 0)
    counted = events.withColumn("upto", upto).groupBy("dialog_id").agg(F.sum(F.when(kept, F.col("sign") * F.col("upto")).otherwise(0)).alias("k"), F.sum("point").alias("n"))
    return counted.select("dialog_id", (F.col("k") + (F.col("n") * F.col("n") if future < 0 else F.lit(0))).alias("n_edges"))


def context_pairs(utts: DataFrame, mode: str, window: int = 3) -> DataFrame:
    """Pairs of a dialog: global, intra (one speaker), inter (others, and itself), local (less than window apart)."""
    if mode == "local":
        return window_edges(utts, window - 1, window - 1)
    edges = window_edges(utts, -1, -1)
    same = F.col("src_speaker") == F.col("dst_speaker")
    return {"global": edges, "intra": edges.filter(same), "inter": edges.filter(~same | (F.col("src") == F.col("dst")))}[mode]


def context_pair_counts(utts: DataFrame, window: int = 3) -> DataFrame:
    """Mode, n: how many pairs each mode of context_pairs has, from counts by dialog, speaker and position in one pass.

    Pairs of a dialog are the square of its utterances, those of one speaker the square of that speaker's; a null
    speaker is neither the same as another nor different, as in context_pairs.
    """
    d, p, s = "dialog_id", "pos", "speaker"
    sets = utts.groupingSets([[d], [d, s], [d, p], [d, p, s]], d, p, s).agg(F.grouping_id().alias("set"), F.count("*").alias("n"), F.count(s).alias("named"))
    of = lambda k, x: F.when(F.col("set") == k, x).otherwise(0)
    square = lambda x: F.col(x) * F.col(x)
    whole, by_speaker, by_place, by_both = 0b011, 0b010, 0b001, 0b000
    one = of(by_speaker, F.when(F.col(s).isNotNull(), square("n")).otherwise(0))
    both = of(by_both, F.when(F.col(s).isNotNull(), square("n")).otherwise(0))
    inter = of(whole, square("named")) - one + of(by_place, square("n") - square("named")) + both
    zero = F.lit(0).cast("long")
    none = F.array(F.struct(F.lit(None).cast("long").alias("value"), zero.alias("point"), zero.alias("sign")))
    ends = F.when(F.col("set") == by_place, _limits(window - 1, window - 1, "n")).otherwise(none)
    rows = sets.select(d, of(whole, square("n")).alias("global"), one.alias("intra"), inter.alias("inter"), F.posexplode(ends).alias("k", "e"))
    upto = F.sum("e.point").over(Window.partitionBy(d).orderBy("e.value"))
    once = lambda x: F.sum(F.when(F.col("k") == 0, F.col(x)).otherwise(0))
    sums = rows.withColumn("local", F.col("e.sign") * upto).agg(once("global").alias("global"), once("intra").alias("intra"), once("inter").alias("inter"), F.sum("local").alias("local"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(m, F.lit(0)).alias("n")) for m in ("global", "intra", "inter", "local")])))
