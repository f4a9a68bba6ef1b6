"""Chat formatting: logged snapshots of a conversation collapse into the longest (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize


def _hashed_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns in order with rolling hashes: conv, nth (from 1), is_last, piece, h0 and h1 of all turns up to it.

    A prefix's hash is the exclusive or of its turns' hashes, each taken with
    its number, so one running aggregate gives all prefixes of a conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    order = Window.partitionBy("conv").orderBy("turn", role, text)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    return (
        turns.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
        )
        .withColumn("nth", F.row_number().over(order))
        .withColumn("is_last", F.lead(F.lit(True)).over(order).isNull())
        .withColumn("h0", F.bit_xor(F.xxhash64("nth", role, text)).over(upto))
        .withColumn("h1", F.bit_xor(F.xxhash64(F.lit("second"), text, "nth", role)).over(upto))
        .select("conv", "nth", "is_last", piece.alias("piece"), "h0", "h1")
    )


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, n_turns and chat (all turns, rendered) of every maximal conversation.

    A conversation goes if its turns are the first turns of a longer one, or all
    turns of one with a smaller id.  Both are anti-joins on hashes of prefixes,
    which are reduced to distinct ones before they are exchanged; texts move
    once, to be put in order, and once, if kept, to be rendered.

    Turns are ordered by number, ties by role and text; equal rows are turns of
    their own.  Null role or text: empty.  Null turn numbers come first.  Rows
    with a null id form one conversation, with null id, counted as the smallest.
    Empty table: empty result.  Extra columns: ignored.
    """
    hashed = materialize(_hashed_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    full = hashed.where("is_last").select("conv", F.col("nth").alias("n"), "h0", "h1")
    firsts = full.groupBy("n", "h0", "h1").agg(F.min(F.struct(F.col("conv").isNotNull().alias("named"), "conv")).alias("first"))
    firsts = firsts.select("n", "h0", "h1", F.col("first.conv").alias("conv"))
    longer = hashed.where("not is_last").select(F.col("nth").alias("p"), F.col("h0").alias("p0"), F.col("h1").alias("p1")).distinct()
    is_prefix = (F.col("n") == F.col("p")) & (F.col("h0") == F.col("p0")) & (F.col("h1") == F.col("p1"))
    kept = firsts.join(longer, is_prefix, "left_anti").select(F.col("conv").alias("kept"), "n")
    rendered = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("nth", "piece"))), lambda t: t["piece"]))
    return (
        hashed.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
        .groupBy(F.col("conv").alias("conv_id"), F.col("n").cast("long").alias("n_turns"))
        .agg(rendered.alias("chat"))
    )
