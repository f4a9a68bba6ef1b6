"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and put in the order of a
Hilbert curve, many times with other projections and shifts.  Each order is
range-partitioned and numbered by Spark.  Orders carry codes of the vectors'
differences from their mean, which rank alike.  A query asks those orders in
which its projections are most pronounced, since there its neighbours crowd
most, and meets the codes within a window of places around its own; what the
windows propose is merged, and the best of it is ranked on the original vectors.

Codes and windows are measured, not guessed: a bounded sample of queries is
answered exactly.  Codes have four bits a component if these tell the true
neighbours from all others, and else more, in fewer orders, so that all orders
take about as many bytes.  The width is the distance in place, in the nearest
of the orders asked, that holds the wanted share of the true neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.vectors import answers, best, kept, packed, query_classes, unpacked, usable_vectors, vector_classes, width_of

#: Orders of the shortest codes, how many of them a query asks, projected dimensions, and bits of each in a key (DIMS * BITS at most 62).
CURVES, ASKED, DIMS, BITS = 32, 24, 8, 7
#: Bits of a component in a code: scaled whole numbers up to 16, floats, doubles; bytes of a row in an order besides its code.
CODE_BITS, ROW_BYTES = (4, 8, 16, 32, 64), 20
#: Share of the true neighbours that a code must have in its shortlist, all vectors against it; doubles are taken if no shorter code does.
CODE_WANTED = 0.99
#: At most so many queries, those of least hash, are answered exactly to set the window.
SAMPLE_QUERIES = 256
#: Share of their neighbours, themselves not counted, that the windows must hold; recall of all queries comes out near it.
WANTED = 0.95
#: Bytes of codes, and queries, in one cell.
CELL_BYTES, CELL_QUERIES = 1 << 19, 8192
#: Candidates by code that are ranked on the original vectors, for each neighbour wanted.
SHORTLIST = 2


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of grid cells (rows of non-negative integers below 2**bits)."""
    x = cells.T.astype(np.uint64)
    n, one = len(x), np.uint64(1)
    bit = one << np.uint64(bits - 1)
    q = bit
    while q > one:  # undo the rotations of each level, from the coarsest on
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = bit
    while q > one:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def projection(curve: int, width: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions, as far as there are so many, and shifts."""
    rng = np.random.default_rng([seed, curve])
    directions = np.linalg.qr(rng.normal(0, 1, (width, min(DIMS, width))))[0]
    if width < DIMS:
        directions = np.hstack([directions, rng.normal(0, 1, (width, DIMS - width)) / math.sqrt(width)])
    return directions * math.sqrt(width), rng.random(DIMS)


def curve_keys(points: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unit vectors (projected, brought to even use of [0, 1], shifted within a grid of twice the size), and how pronounced the projections are."""
    matrix, shift = projection(curve, points.shape[1])
    projected = points @ matrix
    spread = 1 / (1 + np.exp(-1.7 * projected))
    cells = np.minimum((spread + shift) * 2 ** (BITS - 1), 2**BITS - 1).astype(np.int64)
    return hilbert_keys(cells, BITS), np.abs(projected).sum(axis=1)


def codes_of(vectors: np.ndarray, bits: int = 4) -> list[bytes]:
    """Components in ``bits`` bits: up to 16 scaled by the vector's largest, behind the scale."""
    if bits > 16:
        return [v.tobytes() for v in vectors.astype(f"<f{bits // 8}")]
    most = 2 ** (bits - 1) - 1
    scale = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1e-300) / most
    levels = np.rint(vectors / scale[:, None])
    if bits == 4:
        levels = (levels + 8).astype(np.uint8)
        if levels.shape[1] % 2:
            levels = np.hstack([levels, np.full((len(levels), 1), 8, dtype=np.uint8)])
        levels = levels[:, ::2] << 4 | levels[:, 1::2]
    else:
        levels = levels.astype(f"<i{bits // 8}")
    return [s.tobytes() + n.tobytes() for s, n in zip(scale.astype("<f8"), levels, strict=True)]


def code_bytes(width: int, bits: int) -> int:
    return bits * width // 8 if bits > 16 else 8 + (bits * width + 7) // 8


def decoded(codes, width: int, bits: int = 4) -> np.ndarray:
    rows = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, code_bytes(width, bits))
    if bits > 16:
        return rows.view(f"<f{bits // 8}")
    scale, levels = rows[:, :8].copy().view("<f8"), rows[:, 8:]
    if bits == 4:
        levels = np.stack([levels >> 4, levels & 15], axis=2).reshape(len(rows), -1)[:, :width].astype(np.float32) - 8
    else:
        levels = levels.copy().view(f"<i{bits // 8}").astype(np.float32)
    return levels * scale.astype(np.float32)


def orders_of(width: int, bits: int) -> tuple[int, int]:
    """Orders, and how many of them a query asks, for codes of so many bits: all take the bytes that CURVES orders of the shortest codes take."""
    curves = max(4, CURVES * (ROW_BYTES + code_bytes(width, CODE_BITS[0])) // (ROW_BYTES + code_bytes(width, bits)))
    return curves, -(-curves * ASKED // CURVES)


def mean_of(vectors: DataFrame, width: int) -> np.ndarray:
    """The mean of all vectors, in single precision: any vector near it serves, and reruns agree."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch.column(0).to_pylist(), width)
            columns = [pa.array(np.arange(width)), pa.array(rows.sum(axis=0)), pa.array(np.full(width, len(rows)))]
            yield pa.RecordBatch.from_arrays(columns, ["at", "total", "rows"])

    found = vectors.select("vector").mapInArrow(sums, "at long, total double, rows long")
    found = found.groupBy("at").agg((F.sum("total") / F.sum("rows")).alias("mean")).toPandas().sort_values("at")
    return found["mean"].to_numpy().astype(np.float32).astype(np.float64)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Candidates on the unit sphere of one more dimension, where the largest inner product is the nearest point."""
    scaled = vectors / longest
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))])


def asking(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.hstack([unit, np.zeros((len(unit), 1))])


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one fixed order."""
    return (a * b).sum(axis=1)


def top_rows(queries: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows of its ``keep`` largest inner products: query rows, vector rows."""
    who, which = [], []
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256] @ vectors.T
        n = min(keep, len(vectors))
        top = np.argpartition(-some, n - 1, axis=1)[:, :n]
        who.append(np.repeat(np.arange(at, at + len(some)), n))
        which.append(top.ravel())
    return (np.concatenate(who), np.concatenate(which)) if who else (np.empty(0, int), np.empty(0, int))


def sample_truth(sample: pd.DataFrame, vectors: DataFrame, width: int, keep: int, mean: np.ndarray) -> pd.DataFrame:
    """q, bits, class_id: the nearest of a bounded sample of queries, from one pass over all vectors.

    By the original vectors (bits 0) the ``keep`` best, by codes of each length those that they would shortlist.
    """
    asked, ids = unpacked(sample["query_vector"], width), sample["q"].to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unpacked(batch.column(1).to_pylist(), width)
            for bits in (0, *CODE_BITS):
                held = decoded(codes_of(own - mean, bits), width, bits) if bits else own
                by = asked.astype("<f4").astype(held.dtype) if bits else asked
                who, which = top_rows(by, held, SHORTLIST * keep if bits else keep)
                scores = scores_of(by[who], held[which]).astype(np.float64)
                columns = [ids[who], np.full(len(who), bits), batch.column(0).to_numpy()[which], scores]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["q", "bits", "class_id", "score"])

    found = vectors.select("class_id", "vector").mapInArrow(scan, "q long, bits long, class_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q", "bits").orderBy(F.col("score").desc(), "class_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("bits") == 0, keep).otherwise(SHORTLIST * keep))
    return found.where("class_id <> q").select("q", "bits", "class_id").toPandas()


def enough_bits(found: pd.DataFrame) -> int:
    """The shortest codes that hold the true neighbours in their shortlists."""
    pairs = {bits: set(zip(x["q"], x["class_id"], strict=True)) for bits, x in found.groupby("bits")}
    true = pairs.get(0, set())
    return next((b for b in CODE_BITS if len(true & pairs.get(b, set())) >= CODE_WANTED * len(true)), CODE_BITS[-1])


def ordered(vectors: DataFrame, of_queries: DataFrame, width: int, mean: np.ndarray, longest: float, bits: int) -> DataFrame:
    """curve, role (0 candidate, 1 query), id, code and place of all vectors in every order, and of queries in those that they ask.

    Places count from 0 within a curve.  Spark range-partitions by (curve, key);
    rows are numbered within partitions, written down, and shifted by the counts
    of the partitions before (one row per partition).  A query's code is its
    vector as it is; candidates' codes are those of their differences from
    ``mean``, since a query's inner products with these are all less by the same.
    """
    curves, asked = orders_of(width, bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch.column(2).to_pylist(), width)
            role = batch.column(0).to_numpy()
            points = np.where(role[:, None] == 0, lifted(rows, longest), asking(rows))
            found = [curve_keys(points, curve) for curve in range(curves)]
            weakest = np.sort([strength for _, strength in found], axis=0)[curves - asked]
            codes = np.array(codes_of(rows - mean, bits), dtype=object)
            codes[role == 1] = [r.astype("<f4").tobytes() for r in rows[role == 1]]
            for curve, (key, strength) in enumerate(found):
                use = (role == 0) | (strength >= weakest)
                columns = [np.full(use.sum(), curve, dtype=np.int32), key[use], role[use], batch.column(1).to_numpy()[use]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(codes[use], pa.binary())], ["curve", "key", "role", "id", "code"])

    both = vectors.select(F.lit(0).alias("role"), F.col("class_id").alias("id"), "vector").unionByName(
        of_queries.select(F.lit(1).alias("role"), F.col("q").alias("id"), F.col("query_vector").alias("vector"))
    )
    keyed = both.mapInArrow(keys, "curve int, key long, role int, id long, code binary")
    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # by id within a key, so that queries stand among candidates where many keys are equal
    dealt = keyed.repartitionByRange(parts, "curve", "key", "id", "role").sortWithinPartitions("curve", "key", "id", "role")
    # the low 33 bits of this number count rows within a partition, the others are the partition
    numbered = dealt.withColumn("number", F.monotonically_increasing_id())
    numbered = numbered.select("curve", "role", "id", "code", F.shiftright("number", 33).alias("part"), F.col("number").bitwiseAND((1 << 33) - 1).alias("nth"))
    numbered, _ = kept(numbered, "ann-order")
    counts = numbered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("curve").alias("of_curve"), F.col("part").alias("of_part"), (before - F.col("from")).alias("start"))
    at = (F.col("curve") == F.col("of_curve")) & (F.col("part") == F.col("of_part"))
    return numbered.join(starts, at).select("curve", "role", "id", "code", (F.col("start") + F.col("nth")).alias("place"))


def window_width(places: DataFrame, truth: pd.DataFrame, wanted: float) -> int:
    """Distance in place, in the nearest of the orders asked, within which the wanted share of the true pairs lies."""
    ids = places.sparkSession.createDataFrame(
        pd.DataFrame({"of_role": [1] * len(truth) + [0] * len(truth), "of_id": [*truth["q"], *truth["class_id"]]}).drop_duplicates(), "of_role int, of_id long"
    )
    mine = places.join(F.broadcast(ids), (F.col("role") == F.col("of_role")) & (F.col("id") == F.col("of_id"))).select("curve", "role", "id", "place").toPandas()
    at: dict[tuple[int, int], dict[int, int]] = {}
    for c, r, i, p in mine.itertuples(index=False):
        at.setdefault((r, i), {})[c] = p
    if not len(truth):
        return 0
    gaps = [min(abs(p - at[0, v][c]) for c, p in at[1, q].items()) for q, v in zip(truth["q"], truth["class_id"], strict=True)]
    return int(np.sort(gaps)[min(len(gaps) - 1, math.ceil(wanted * len(gaps)))]) + 1


def window_pairs(places: DataFrame, window: int, width: int, bits: int, keep: int, n_places: int, asked: int) -> DataFrame:
    """q, class_id and score by code: of each order that a query asks, the ``keep`` best within the window around its place.

    An order is cut into blocks of places.  A candidate is in one block; a query
    goes to the blocks that its window meets.  If these windows hold more
    queries than a cell should have, they are dealt to several cells of the block.
    """
    block_rows = max(256, CELL_BYTES // code_bytes(width, bits))
    parts = -(-(block_rows + 2 * window) * asked // (n_places * CELL_QUERIES)) or 1
    last = (n_places - 1) // block_rows
    own = places.where("role = 0").select("curve", F.floor(F.col("place") / block_rows).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "place", "id", "code")
    first, end = (F.floor((F.col("place") + d * window) / block_rows) for d in (-1, 1))
    blocks = F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(end, F.lit(last).cast("long")))
    seekers = places.where("role = 1").select(
        F.col("curve").alias("in_curve"), F.explode(blocks).alias("in_block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("in_part"),
        F.col("place").alias("from_place"), F.col("id").alias("q"), F.col("code").alias("asked"),
    )

    def cell(key: tuple, held: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(held) and len(questions):
            held, questions = held.sort_values("place"), questions.sort_values("from_place")
            codes, places_, ids = decoded(held["code"], width, bits), held["place"].to_numpy(), held["id"].to_numpy()
            at, who = questions["from_place"].to_numpy(), questions["q"].to_numpy()
            asking_ = np.frombuffer(b"".join(questions["asked"]), dtype="<f4").reshape(-1, width).astype(codes.dtype)
            low, high = np.searchsorted(places_, at - window), np.searchsorted(places_, at + window, side="right")
            for i in range(0, len(at), 16):  # neighbours in place, whose windows mostly cover the same rows
                a, b = low[i], high[i : i + 16].max()
                if a == b:
                    continue
                some = asking_[i : i + 16] @ codes[a:b].T
                row = np.arange(a, b)
                some[(row < low[i : i + 16, None]) | (row >= high[i : i + 16, None])] = -np.inf
                top = np.argpartition(-some, min(keep, b - a) - 1, axis=1)[:, :keep]
                score = np.take_along_axis(some, top, axis=1)
                good = score > -np.inf
                out.append((np.repeat(who[i : i + 16], good.sum(axis=1)), ids[a + top[good]], score[good]))
        if not out:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"q": q, "class_id": c, "score": s.astype(np.float64)})

    cells, asking_cells = own.groupBy("curve", "block", "part"), seekers.groupBy("in_curve", "in_block", "in_part")
    return cells.cogroup(asking_cells).applyInPandas(cell, "q long, class_id long, score double")


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    wanted: float = WANTED,
    sample_queries: int = SAMPLE_QUERIES,
    least_window: int = 32,
    stats: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: ``k`` near neighbours by inner product, nearest first; ties to the smaller id.

    Every vector is in every order; at least ``k`` are returned if there are as
    many.  ``is_query`` is a condition on the column ``id``.  ``stats``, if
    given, gets the window, the share of all vectors that a query meets, and the bits of a code.

    Vectors null, zero or with null or non-finite components, and null ids, take
    no part.  Shorter vectors count as ending in zeros.  Equal vectors are one
    class.  Empty table, or no query: empty result.  Extra columns: ignored.
    """
    rows = usable_vectors(df, id_col, vector_col, nonzero=True).distinct()
    classes, n = kept(vector_classes(rows, k + 1), "ann-classes")
    queries, n_queries = kept(query_classes(rows, classes, is_query), "ann-queries")
    if not n or not n_queries:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, keep = width_of(classes), k + 1
    vectors, _ = kept(packed(classes, width), "ann-vectors")
    of_queries = queries.select("q").distinct().join(vectors, F.col("q") == F.col("class_id")).select("q", F.col("vector").alias("query_vector"))
    of_queries, asked = kept(of_queries, "ann-query-vectors")
    mean = mean_of(vectors, width)
    longest = math.sqrt(classes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0])
    sample = of_queries.orderBy(F.xxhash64("q"), "q").limit(sample_queries).toPandas()
    truth = sample_truth(sample, vectors, width, keep, mean)
    bits = enough_bits(truth)
    places = ordered(vectors, of_queries, width, mean, longest, bits)
    window = max(least_window, keep, window_width(places, truth[truth["bits"] == 0], wanted))
    if stats is not None:
        stats |= {"window": window, "share": orders_of(width, bits)[1] * (2 * window + 1) / (n + asked), "bits": bits}

    found = window_pairs(places, window, width, bits, SHORTLIST * keep, n + asked, asked)
    found = best(found.groupBy("q", "class_id").agg(F.max("score").alias("score")), "q", SHORTLIST * keep, F.col("score").desc(), F.col("class_id"))
    own = of_queries.select("q", F.col("q").alias("class_id"))  # copies of a query are as near to it as it is
    short, _ = kept(found.select("q", "class_id").union(own).distinct(), "ann-shortlist")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (unpacked(batch.column(i).to_pylist(), width) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores_of(a, b))], ["q", "class_id", "score"])

    with_vectors = short.join(vectors.withColumnRenamed("class_id", "of_class"), F.col("class_id") == F.col("of_class"))
    with_vectors = with_vectors.join(of_queries.withColumnRenamed("q", "of_q"), F.col("q") == F.col("of_q"))
    ranked = with_vectors.select("q", "class_id", "vector", "query_vector").mapInArrow(exact, "q long, class_id long, score double")
    return answers(queries, best(ranked, "q", keep, F.col("score").desc(), F.col("class_id")), classes, k)
