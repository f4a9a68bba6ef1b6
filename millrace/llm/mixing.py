"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import discard, materialize

#: A document is never repeated more often than this.
MAX_COPIES = 3
#: Weights by the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: Documents that may join behind the cut to bring a source nearer to its target.
CLOSING = 3
#: A source this share of its target away from it passes over the documents that are too long for what is open.
NEAR = 0.05
RANK = "struct<pareto:double,doc_id:bigint,text_md5:string>"
#: Documents of a source that share one step of the cumulative sum.
BUCKET_ROWS = 4000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(text.isNull() | (flat == ""), 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Targets by water-filling: share all words by weight, cap each source, reshare the excess.

    ``sizes`` has one row per source (source, source_size, n_docs); the result
    adds weight, target and capped.  Capping in ascending order of
    capacity / weight leaves one level L with target = min(capacity, weight * L),
    which is where repeated resharing ends.  The windows run over one row per
    source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (position % len(weights) + 1).cast("int"))
    cap = (F.lit(max_copies) * F.col("source_size")).cast("double")
    rows = sizes.withColumn("weight", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # the first source that its level does not fill up stays below its cap, and so do all after it
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return (
        rows.withColumn("final", final)
        .withColumn("capped", F.col("final").isNull() | (F.col("weight") * F.col("final") >= F.col("cap")))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")))
        .select("source", "source_size", "n_docs", "weight", "target", "capped")
    )


def drawn_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """doc_id, source, size, text_md5 and u, uniform in (0, 1) from a digest of seed, id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("text_md5")))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.coalesce(F.md5(F.col(text_col)), F.lit("")).alias("text_md5"),
    ).withColumn("u", (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan of its source to each row, its bucket and its Pareto rank."""
    u, p = F.col("u"), F.col("p")
    return (
        rows.withColumnRenamed("source", "of_source")
        .join(plan, F.col("of_source").eqNullSafe(F.col("source")))
        .drop("of_source")
        .withColumn("bucket", F.least(F.floor(u * F.col("n_buckets")), F.col("n_buckets") - 1))
        .withColumn("rank", F.struct(F.when(p > 0, (u / (1 - u)) / (p / (1 - p))).alias("pareto"), "doc_id", "text_md5"))
    )


def source_plan(rows: DataFrame, weights: tuple, max_copies: int, bucket_rows: int) -> DataFrame:
    """What each source takes: certain copies, the cut of the Pareto ranking, the closing documents.

    One row per source; every step over documents is a sum, minimum or maximum
    by source (and bucket), and only the bucket of the cut is put in order.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    share = (
        F.when(F.col("source_size") == 0, 0.0)
        .when(F.col("capped"), float(max_copies))
        .otherwise(F.col("target") / F.col("source_size"))
    )
    plan = (
        source_targets(sizes, weights, max_copies)
        .withColumn("certain", F.floor(share).cast("long"))
        .withColumn("p", share - F.floor(share))
        .withColumn("open_words", F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / F.lit(bucket_rows)))
        .drop("weight", "capped", "n_docs")
    )
    plan = materialize(plan.coalesce(1), "mix-plan")
    cuts = prefix_cuts(with_plan(rows, plan.where("p > 0")).withColumn("room", F.col("open_words")))
    none = F.array().cast(f"array<{RANK}>")
    passes = F.array().cast(f"array<struct<room:double,bucket:bigint,rank:{RANK}>>")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    plan = plan.withColumn("closing", none).withColumn("passes", passes).withColumn("far", F.lit(True))
    plan = with_closing(rows, materialize(plan.coalesce(1), "mix-cuts"))
    left = open_left(rows, plan)
    far = F.coalesce(F.abs(F.col("open")) > NEAR * F.col("target"), F.lit(False))
    plan = plan.join(left, F.col("source").eqNullSafe(F.col("got_source")), "left").withColumn("far", far).drop("got_source", "open")
    plan = materialize(plan.withColumn("closing", F.when(F.col("far"), none).otherwise(F.col("closing"))).coalesce(1), "mix-far")
    if plan.where("far").count():
        plan = with_closing(rows, with_passes(rows, plan))
    return plan.drop("far")


def prefix_cuts(open_rows: DataFrame) -> DataFrame:
    """By source, where the longest prefix of the ranking within ``room`` ends; no row for a source that fits whole."""
    sums = open_rows.groupBy("source", "room", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .where("before <= room and before + words > room")
        .groupBy(F.col("source").alias("cut_source"))
        .agg(F.min(F.struct("bucket", "before")).alias("at"))
    )
    of_cut = F.col("source").eqNullSafe(F.col("cut_source"))
    ordered = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        open_rows.join(cuts, of_cut & (F.col("bucket") == F.col("at.bucket")))
        .withColumn("upto", F.sum("size").over(ordered) + F.col("at.before"))
        .groupBy("cut_source", F.col("at.bucket").alias("cut_bucket"))
        .agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("rank"))).alias("cut_rank"))
    )


def open_left(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """got_source and the words still ``open`` of every source that draws."""
    state = with_plan(rows, plan.where("p > 0"))
    got = state.groupBy("source", "open_words").agg(F.sum(F.when(drawn() | closing(), F.col("size")).otherwise(0)).alias("got"))
    return got.select(F.col("source").alias("got_source"), (F.col("open_words") - F.col("got")).alias("open"))


def with_passes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Far sources go on down their ranking past the documents that exceed the room left, until none fits.

    A pass takes the longest prefix of the documents that fit.  The room only
    shrinks, so what was passed over never fits later, and a pass is told by
    its room and its end.
    """
    while True:
        left = materialize(open_left(rows, plan.where("far")).where("open > 0").coalesce(1), "mix-open")
        state = with_plan(rows, plan.where("p > 0 and far")).where(~drawn())
        fits = state.join(left, F.col("source").eqNullSafe(F.col("got_source"))).where("size > 0 and size <= open").withColumn("room", F.col("open"))
        able = materialize(fits.groupBy(F.col("source").alias("able_source"), F.col("room").alias("able_room")).count().drop("count").coalesce(1), "mix-able")
        if not able.count():
            return plan
        ends = able.join(prefix_cuts(fits), F.col("able_source").eqNullSafe(F.col("cut_source")), "left")
        ends = ends.select("able_source", F.struct(F.col("able_room").cast("double").alias("room"), F.col("cut_bucket").alias("bucket"), F.col("cut_rank").alias("rank")).alias("end"))
        more = F.when(F.col("end").isNotNull(), F.array_append("passes", F.col("end"))).otherwise(F.col("passes"))
        joined = plan.join(ends, F.col("source").eqNullSafe(F.col("able_source")), "left").withColumn("passes", more)
        plan = materialize(joined.drop("able_source", "end").coalesce(1), "mix-passes")


def with_closing(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Up to CLOSING times, the document left that brings a far source nearest to its target joins."""
    for _ in range(CLOSING):
        state = with_plan(rows, plan.where("p > 0 and far")).withColumn("in", drawn() | closing())
        miss = F.abs(F.col("size") - F.col("open"))
        nearest = (
            state.where(~F.col("in"))
            .join(open_left(rows, plan.where("far")), F.col("source").eqNullSafe(F.col("got_source")))
            .where(miss < F.abs(F.col("open")))
            .groupBy(F.col("got_source").alias("near_source"))
            .agg(F.min(F.struct(miss.alias("miss"), "rank"))["rank"].alias("near"))
        )
        more = F.when(F.col("near").isNotNull(), F.array_append("closing", F.col("near"))).otherwise(F.col("closing"))
        joined = plan.join(nearest, F.col("source").eqNullSafe(F.col("near_source")), "left").withColumn("closing", more)
        plan = materialize(joined.drop("near_source", "near").coalesce(1), "mix-closing")
    return plan


def drawn() -> Column:
    """Whether a row's Pareto rank is within its source's cut (a source without a cut takes all that is open) or a pass took it."""
    within = F.coalesce(F.col("rank") <= F.col("cut_rank"), F.lit(False))

    def taken(s: Column) -> Column:
        before = s["bucket"].isNull() | (F.col("bucket") < s["bucket"]) | ((F.col("bucket") == s["bucket"]) & F.coalesce(F.col("rank") <= s["rank"], F.lit(False)))
        return (F.col("size") > 0) & (F.col("size") <= s["room"]) & before

    return (
        F.when(F.col("p") <= 0, False)
        .when(F.col("cut_bucket").isNull(), True)
        .otherwise((F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & within) | F.exists("passes", taken))
    )


def closing() -> Column:
    """Whether a row is one of its source's closing documents."""
    return F.exists("closing", lambda r: F.coalesce(r == F.col("rank"), F.lit(False)))


def copies_taken() -> Column:
    return (F.col("certain") + F.when(drawn() | closing(), 1).otherwise(0)).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Copies of every document in the mix: doc_id, size, source, source_size, target, copies, taken.

    Of a source with target share f = target / source_size, each document gets
    floor(f) certain copies.  The rest p = f - floor(f) is drawn by Pareto order
    sampling: documents are ranked by [u / (1 - u)] / [p / (1 - p)], u uniform
    from a digest of id and text, and the longest prefix within the open words
    is taken.  p is the source's own, so inclusion is unequal between sources.
    Last, and up to CLOSING times, the document left whose size comes nearest
    to the words still open joins if that brings the source nearer to its target.
    A source that this leaves further than NEAR from its target (a very long
    document came before the cut or closed it) instead goes on down its ranking
    past every document longer than what is open, until none fits, and closes then.

    A source's ranking is cut into buckets of u (the rank is monotone in u
    within a source), whose sums locate the cut; only the bucket that holds the
    cut is ordered row by row.  So no source, however hot, meets in one task.

    Null text: size 0.  Null source: a source of its own, last.  Null ids and
    repeated rows: rows like any other; rows equal in id and text are drawn
    alike.  Empty table: empty result.  Extra columns: ignored.
    """
    rows = materialize(drawn_rows(docs, id_col, text_col, source_col, seed), "mix-rows")
    plan = source_plan(rows, weights, max_copies, bucket_rows)
    return with_plan(rows, plan).withColumn("copies", copies_taken()).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The documents of the mix, each row as often as mix() says; the columns of ``docs``.

    Each row meets its source's plan (a row per source); texts aren't shuffled.
    """
    rows = materialize(drawn_rows(docs, id_col, text_col, source_col, seed), "mix-rows")
    plan = source_plan(rows, weights, max_copies, bucket_rows)
    discard(rows)
    any_pass = plan.where("size(passes) > 0").count() > 0
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.withColumn("__whole", whole).select("__whole")
    fields = {"doc_id": id_col, "text": text_col, "source": source_col}
    given = given.select("__whole", *[F.col("__whole")[c].alias(k) for k, c in fields.items()]).withColumn("doc_id", F.col("doc_id").cast("long"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("text_md5")))
    keyed = given.withColumn("text_md5", F.coalesce(F.md5("text"), F.lit(""))).withColumn("source", F.col("source").cast("string"))
    keyed = keyed.withColumn("size", n_words(F.col("text")) if any_pass else F.lit(0))  # only passes ask for it
    keyed = keyed.withColumn("u", (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52))
    return (
        with_plan(keyed.drop("text"), plan)
        .withColumn("copies", copies_taken())
        .where("copies > 0")
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("__whole.*")
    )
