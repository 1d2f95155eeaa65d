"""Chat formatting: logged snapshots of conversations are collapsed, the maximal ones rendered.

Only DataFrame functions. A turn's prefix hash is the XOR of the hashes of (position, role, text) of
the turns up to it. A conversation whose whole hash is a proper prefix hash of another one is a
snapshot of that and goes; of equal conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwise.llm.frames import stored

PAGE_TURNS = 256
# Fixed marks of the rendered format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with position, n_turns and prefix hashes h1 and h2.

    Rows are dealt by range over the whole order, so a conversation of any length spreads over many
    tasks; counts and hashes of the parts before a part come from one row per part.
    """
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text")
    dealt = stored(dealt.withColumn("local", F.row_number().over(within)), "turns")

    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("own"))
    parts = parts.select(
        "part",
        F.col("conv_id").alias("conv"),
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"),
        F.sum("own").over(whole).alias("n_turns"),
    )
    same = (F.col("p.part") == F.col("t.part")) & F.col("p.conv").eqNullSafe(F.col("t.conv_id"))
    placed = dealt.alias("t").join(parts.alias("p"), same).select("t.*", "before", "n_turns")
    placed = placed.withColumn("position", F.col("local") + F.col("before"))
    first = F.xxhash64("position", "role", "text")
    second = F.xxhash64(F.lit("second"), "text", "position", "role")
    grown = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("*", F.bit_xor(first).over(grown).alias("l1"), F.bit_xor(second).over(grown).alias("l2"))
    placed = stored(placed, "placed")

    last = F.max(F.struct("local", "l1", "l2")).alias("last")
    parts = placed.groupBy("part", "conv_id").agg(last)
    parts = parts.select(
        "part",
        F.col("conv_id").alias("conv"),
        F.coalesce(F.bit_xor("last.l1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("last.l2").over(earlier), F.lit(0)).alias("b2"),
    )
    joined = placed.alias("t").join(parts.alias("p"), same)
    return joined.select(
        "conv_id", "role", "text", "position", "n_turns",
        F.col("l1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("l2").bitwiseXOR(F.col("b2")).alias("h2"),
    )


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END))


def chat_pages(conversations: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """The maximal conversations, rendered: conv_id, page, n_turns, copies, rendered.

    Reads conv_id, turn, role and text; other columns are left alone. A null role is ``unknown``, a
    null text empty. Repeated rows count once; turns of one number stand in the order of role and
    text, a null turn first, and rows of a null conv_id are one conversation. ``copies`` counts the
    equal conversations that the row stands for. A conversation over ``page_turns`` turns goes on in
    further pages, which put together give it whole. An empty table gives an empty one.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    placed = stored(_placed(turns), "prefixes")
    hashes = ["h1", "h2", "position"]
    least = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("least")
    ends = placed.filter("position = n_turns").groupBy(*hashes).agg(least, F.count("*").alias("copies"))
    prefixes = placed.filter("position < n_turns").select(*hashes).distinct()
    kept = ends.join(prefixes, hashes, "left_anti").select(F.col("least.conv_id").alias("kept_id"), "copies")
    shown = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    page = F.expr(f"CAST((position - 1) DIV {page_turns} AS INT)").alias("page")
    lines = F.array_sort(F.collect_list(F.struct("position", rendered(F.col("role"), F.col("text")).alias("line"))))
    return shown.groupBy("conv_id", page, "n_turns", "copies").agg(
        F.concat_ws("", F.transform(lines, lambda turn: turn["line"])).alias("rendered")
    )
