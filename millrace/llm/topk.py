"""Exact top-k search by inner product in three phases with one uniform threshold.

A score is the sum of partial scores over slices of the components; each slice
is a list.  (1) Every list names its highest entries for each query; the scores
of what is named are resolved, and the k-th of them is a safe lower bound.
(2) That bound, divided by the number of lists, goes to all lists, which give
every entry that reaches it: what stays below it everywhere can't be among the
best.  (3) Of what came, sums and upper bounds prune, and what is left is resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectors import answers, best, kept, packed, query_classes, unpacked, usable_vectors, vector_classes, width_of

CHUNK_ROWS, BLOCK_QUERIES = 8192, 1024
_LIMIT = 2**63 - 1


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of integer-valued ``a`` and ``b``, held to the range of a long.

    Doubles are exact up to 2**53; where larger sums could occur Python's integers are used.
    """
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return held(as_integers(a) @ as_integers(b).T)


def as_integers(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x)


def held(x: np.ndarray) -> np.ndarray:
    """Python's integers, held to the range of a long."""
    return np.frompyfunc(lambda v: min(max(v, -_LIMIT - 1), _LIMIT), 1, 1)(x).astype(np.int64)


def exact_top_k(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    lists: int = 2,
    depth: int = 20,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products; ties to the smaller id.

    Components x become floor(scale * x).  ``is_query`` is a condition on the
    column ``id``.  Queries and candidates meet in blocks of bounded size.

    Vectors null or with null or non-finite components, and null ids, take no
    part.  Shorter vectors count as ending in zeros.  Equal vectors are one
    class; repeated rows of an id count once.  Empty table, or no query: empty
    result.  Extra columns: ignored.
    """
    rows = usable_vectors(df, id_col, vector_col).select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec")).distinct()
    classes, n = kept(vector_classes(rows, k + 1), "topk-classes")
    width = width_of(classes) if n else 0
    queries, n_queries = kept(query_classes(rows, classes, is_query), "topk-queries")
    if not n or not n_queries or not width:
        if n and n_queries:  # vectors without components: every score is 0
            found = best(queries.select("q").distinct().crossJoin(classes.orderBy("class_id").limit(k + 1).select("class_id")), "q", k + 1, F.col("class_id"))
            return answers(queries, found.withColumn("score", F.lit(0).cast("long")), classes, k)
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    edges = np.linspace(0, width, min(lists, width) + 1).astype(int).tolist()
    slices = list(zip(edges, edges[1:], strict=False))
    m, keep = len(slices), k + 1
    chunks, blocks = -(-n // CHUNK_ROWS), -(-n_queries // BLOCK_QUERIES)

    vectors, _ = kept(packed(classes, width), "topk-vectors")
    of_queries = queries.select("q").distinct().join(vectors, F.col("q") == F.col("class_id")).select("q", F.col("vector").alias("query_vector"))
    of_queries, _ = kept(of_queries, "topk-query-vectors")

    parts = F.array(*[F.struct(F.lit(i).alias("list"), F.expr(f"substring(vector, {8 * a + 1}, {8 * (b - a)})").alias("part")) for i, (a, b) in enumerate(slices)])
    entries = vectors.select("class_id", F.explode(parts).alias("p"), F.pmod(F.xxhash64("class_id"), F.lit(chunks)).cast("long").alias("chunk"))
    entries = entries.select("p.list", "chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "class_id", "p.part")

    def asked(with_bound: DataFrame) -> DataFrame:
        q_parts = F.array(*[F.struct(F.lit(i).alias("list"), F.expr(f"substring(query_vector, {8 * a + 1}, {8 * (b - a)})").alias("part")) for i, (a, b) in enumerate(slices)])
        out = with_bound.select("q", "bound", F.explode(q_parts).alias("p"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
        return out.select("p.list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "block", "q", "bound", "p.part")

    def in_cells(with_bound: DataFrame) -> DataFrame:
        """Entries of the lists: the ``depth`` highest of a cell without a bound, else all that reach it."""

        def cell(key: tuple, own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
            span = slices[key[0]][1] - slices[key[0]][0]
            if not len(own) or not len(questions):
                return pd.DataFrame({"q": [], "class_id": [], "list": [], "part": []}).astype("int64")
            ids = own["class_id"].to_numpy()
            own_matrix = unpacked(own["part"], span)
            out: list[list[np.ndarray]] = [[], [], []]
            for at in range(0, len(questions), 256):
                some = questions.iloc[at : at + 256]
                scores = inner_products(unpacked(some["part"], span), own_matrix)
                bound = some["bound"].to_numpy(dtype="float64", na_value=np.nan)
                if np.isnan(bound).any():
                    top = np.argpartition(-scores, min(depth, len(ids)) - 1, axis=1)[:, :depth]
                    who, which = np.repeat(np.arange(len(some)), top.shape[1]), top.ravel()
                else:
                    who, which = np.nonzero(scores >= np.ceil(bound / m)[:, None])
                for column, values in zip(out, (some["q"].to_numpy()[who], ids[which], scores[who, which]), strict=True):
                    column.append(values)
            q, c, s = (np.concatenate(x) for x in out)
            return pd.DataFrame({"q": q, "class_id": c, "list": np.full(len(q), key[0]), "part": s})

        keys = ["list", "chunk", "block"]
        return entries.groupBy(*keys).cogroup(asked(with_bound).groupBy(*keys)).applyInPandas(cell, "q long, class_id long, list long, part long")

    def resolved(pairs: DataFrame) -> DataFrame:
        """q, class_id and exact score of pairs."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.empty(batch.num_rows, dtype=np.int64)
                for at in range(0, batch.num_rows, 2048):
                    a, b = (unpacked(batch.column(i).slice(at, 2048).to_pylist(), width) for i in (2, 3))
                    small = not a.size or np.abs(a).max() * np.abs(b).max() * width < 2.0**53
                    values[at : at + len(a)] = (a * b).sum(axis=1) if small else held((as_integers(a) * as_integers(b)).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["q", "class_id", "score"])

        v = vectors.withColumnRenamed("class_id", "of_class")
        w = of_queries.withColumnRenamed("q", "of_q")
        both = pairs.join(v, F.col("class_id") == F.col("of_class")).join(w, F.col("q") == F.col("of_q"))
        return both.select("q", "class_id", "vector", "query_vector").mapInArrow(score, "q long, class_id long, score long")

    # 1: the lists' highest entries, resolved
    named = in_cells(of_queries.withColumn("bound", F.lit(None).cast("long")))
    named = best(named.withColumn("of", F.struct("q", "list")), "of", max(depth, keep), F.col("part").desc(), F.col("class_id"))
    known, _ = kept(resolved(named.select("q", "class_id").distinct()), "topk-known")
    highest = best(known, "q", keep, F.col("score").desc(), F.col("class_id"))
    bounds = highest.groupBy(F.col("q").alias("of_q")).agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).withColumn("bound", F.when(F.col("n") >= min(keep, n), F.col("bound")).otherwise(-_LIMIT))
    bounds, _ = kept(bounds.select("of_q", "bound"), "topk-bounds")
    # 2: all entries that reach the bound's share
    asked_again = of_queries.join(bounds, F.col("q") == F.col("of_q")).drop("of_q")
    sums = in_cells(asked_again).groupBy("q", "class_id").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("sum"), F.count(F.lit(1)).alias("seen"))
    sums, _ = kept(sums, "topk-sums")
    whole = sums.where(F.col("seen") == m).select("q", "class_id", F.least(F.greatest("sum", F.lit(-_LIMIT - 1)), F.lit(_LIMIT)).cast("long").alias("score")).union(known).distinct()
    floor = best(whole, "q", keep, F.col("score").desc(), F.col("class_id")).groupBy(F.col("q").alias("floor_q")).agg(F.min("score").alias("floor"))
    # 3: what could still reach the k-th known score
    could = F.col("sum").cast("double") + (m - F.col("seen")) * F.col("bound") / m
    open_pairs = (
        sums.where(F.col("seen") < m)
        .join(bounds, F.col("q") == F.col("of_q"))
        .join(floor, F.col("q") == F.col("floor_q"))
        .where((could >= F.col("floor")) | (F.col("bound") == -_LIMIT))
        .select("q", "class_id")
    )
    found = best(whole.union(resolved(open_pairs)).distinct(), "q", keep, F.col("score").desc(), F.col("class_id"))
    return answers(queries, found, classes, k)
