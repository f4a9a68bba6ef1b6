"""What the vector searches share: classes of equal vectors, packed rows, and answers by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """id and vec (doubles) of rows with an id, whose vector is there and has finite components only."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    out = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null").where(finite)
    return out.where(F.exists("vec", lambda x: x != 0)) if nonzero else out


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """class_id, vec and ids of each distinct vector: its ``keep`` smallest ids in order, the first names the class.

    Copies of a vector tie in every score, and ties go to the smaller id, so no
    more of its ids can be among the ``keep`` best.  The rank filter works
    before the shuffle as well, so a hot vector sends ``keep`` rows from a task.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= keep)
    classes = kept.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return classes.select(F.col("ids")[0].alias("class_id"), "vec", "ids")


def query_classes(rows: DataFrame, classes: DataFrame, is_query: Column) -> DataFrame:
    """query_id and q (the class of its vector) of the rows that are queries."""
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return queries.join(classes, F.col("query_vec") == F.col("vec")).select("query_id", F.col("class_id").alias("q"))


def width_of(classes: DataFrame) -> int:
    return classes.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` doubles from a list column; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def packed(classes: DataFrame, width: int) -> DataFrame:
    """class_id and the vector's doubles as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in matrix(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["class_id", "vector"])

    return classes.select("class_id", "vec").mapInArrow(pack, "class_id long, vector binary")


def unpacked(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, width)


def best(found: DataFrame, key: str, keep: int, *order: Column) -> DataFrame:
    """The first ``keep`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.withColumn("place", rank).where(F.col("place") <= keep).drop("place")


def answers(queries: DataFrame, found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best ids of each query's class but its own.

    ``found`` (q, class_id, score) holds the k + 1 best classes of each q.
    """
    ids = classes.select(F.col("class_id").alias("of_class"), "ids")
    listed = found.join(ids, F.col("class_id") == F.col("of_class")).select("q", "score", F.explode("ids").alias("vec_id"))
    listed = best(listed, "q", k + 1, F.col("score").desc(), F.col("vec_id"))
    own = queries.join(listed.withColumnRenamed("q", "of_q"), F.col("q") == F.col("of_q")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def kept(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    out = materialize(df, label)
    return out, out.count()
