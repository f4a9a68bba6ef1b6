"""Quality classifier: random-indexing word vectors, pooled, under a small calibrated network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_slices, release

#: Words share this many vectors by hash, which bounds the table whatever the vocabulary.
SLOTS = 1 << 14
DIMS = 64
#: Non-zero components of an index vector, and the reach of a context.
SPARSE, REACH = 4, 2
#: Pooled numbers of a text.
FEATURES = 2 * DIMS + 3
#: Rows of one block of vectors in the exchange.
BLOCK = 256
#: At most so many labelled rows, those of least hash, are used to fit the network.
MAX_LABELLED = 20_000
THRESHOLD = 0.7
#: Small samples are read more often, up to so many steps.
LEAST_STEPS = 600
#: Folds: rows whose crc32 of the id's text leaves this remainder are held out.
FOLDS, HELD_OUT = 4, 2

_UNIT = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def units(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words and runs of marks, in order."""
    found = _UNIT.findall(text) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def add_contexts(total: np.ndarray, texts: list[np.ndarray]) -> None:
    """Add to each unit's slot the sparse ternary index vectors of its neighbours in the same text.

    A unit's index vector is read off its hash: SPARSE components, +1 or -1.
    """
    gap = np.zeros(REACH, dtype=np.uint64)
    row = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    slot = (row % np.uint64(SLOTS)).astype(np.int64)
    for k in range(SPARSE):
        bits = row >> np.uint64(16 + 8 * k)
        dim = (bits % np.uint64(DIMS)).astype(np.int64)
        sign = np.where((bits >> np.uint64(6)) & np.uint64(1), 1.0, -1.0) * (row != 0)
        for step in range(1, REACH + 1):
            for at, of in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                real = sign[of] * (row[at] != 0)
                total += np.bincount(slot[at] * DIMS + dim[of], weights=real, minlength=SLOTS * DIMS)


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts, size = np.zeros(SLOTS * DIMS), [], 0
    for batch in batches:
        for text in batch.column(0):
            texts.append(units(text.as_py()))
            size += len(texts[-1])
            if size > 200_000:
                add_contexts(total, texts)
                texts, size = [], 0
    add_contexts(total, texts)
    blocks = total.astype("<f4").reshape(-1, BLOCK * DIMS)
    used = [i for i, b in enumerate(blocks) if b.any()]
    release()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "part"])


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(part, dtype="<f4").astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], ["block", "part"]
    )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """SLOTS x DIMS unit vectors from the contexts in all texts.

    Each task sends its sums once, in blocks; a block's sums are added as they
    stream in.  The driver gets SLOTS * DIMS numbers, whatever the input.
    """
    blocks = SLOTS // BLOCK
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_batches, "block int, part binary")
    sums = parts.repartition(min(blocks, 16), "block").mapInArrow(_sum_batches, "block int, part binary")
    vectors = np.zeros((blocks, BLOCK * DIMS), dtype=np.float32)
    for r in sums.collect():
        vectors[r["block"]] += np.frombuffer(r["part"], dtype="<f4")
    vectors = vectors.reshape(SLOTS, DIMS)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(vectors: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's units; logarithm of their number, share that differ, share that repeat the one before."""
    out = np.zeros(FEATURES, dtype="<f4")
    if len(hashes):
        slots, n = np.unique(hashes % np.uint64(SLOTS), return_counts=True)
        own, share = vectors[slots.astype(np.int64)], (n / n.sum()).astype(np.float32)
        mean = share @ own
        out[:DIMS], out[DIMS : 2 * DIMS] = mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))
        out[2 * DIMS :] = np.log1p(len(hashes)), len(slots) / len(hashes), np.mean(hashes[1:] == hashes[:-1]) if len(hashes) > 1 else 0
    return out


@dataclass
class Network:
    """Two layers over standardised features; the temperature divides the logit."""

    shift: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    last: np.ndarray
    last_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        inner = np.tanh((x - self.shift) / self.scale @ self.hidden + self.hidden_bias)
        return (inner @ self.last + self.last_bias) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, width: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Fit by Adam on four fifths of the rows, set the temperature by the likelihood of the rest.

    With labels of one kind only, the network gives that kind's smoothed share.
    """
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    shift, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(shift, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], width)), np.zeros(width), rng.normal(0, width**-0.5, width), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.last_bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        net.last = np.zeros(width)
        return net
    order = rng.permutation(len(x))
    rest, train = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - shift) / scale
    state = [np.zeros((2, *np.shape(p))) for p in (net.hidden, net.hidden_bias, net.last, net.last_bias)]
    step = 0
    batches = -(-len(train) // 256)
    for _ in range(max(epochs, LEAST_STEPS // batches)):
        rng.shuffle(train)
        for at in range(0, len(train), 256):
            rows = train[at : at + 256]
            inner = np.tanh(z[rows] @ net.hidden + net.hidden_bias)
            error = (1 / (1 + np.exp(-np.clip(inner @ net.last + net.last_bias, -50, 50))) - y[rows]) / len(rows)
            back = error[:, None] * net.last * (1 - inner**2)
            grads = (z[rows].T @ back + 1e-4 * net.hidden, back.sum(axis=0), inner.T @ error + 1e-4 * net.last, error.sum())
            step += 1
            moves = []
            for s, g in zip(state, grads, strict=True):
                s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
                moves.append(2e-3 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            net.hidden, net.hidden_bias = net.hidden - moves[0], net.hidden_bias - moves[1]
            net.last, net.last_bias = net.last - moves[2], float(net.last_bias - moves[3])
    if len(rest):
        logit, kind = net.logits(x[rest]), y[rest]
        loss = lambda t: np.logaddexp(0, np.where(kind > 0, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Judge:
    """Word vectors and the network over their pools; scores whole texts."""

    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.network.scores(np.array([pooled(self.vectors, units(t)) for t in texts]))


def fit_judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> Judge:
    """Word vectors from all texts; the network from the labels of at most ``max_labelled`` ids that aren't held out.

    The sample is those of least id hash.  Of an id with several labels the
    least counts.  Without labels every text scores 0.5.
    """
    vectors = word_vectors(docs, text_col)

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [pooled(vectors, units(t.as_py())).tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "features", "label"])

    known = (
        labels.select(F.col("doc_id").cast("long").alias("of_doc"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("of_doc").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("of_doc")) != HELD_OUT))
        .groupBy("of_doc")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("of_doc"), "of_doc")
        .limit(max_labelled)
    )
    # the sample's size is bounded, so it goes to the texts and not they to it
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = given.join(F.broadcast(known), F.col("doc_id") == F.col("of_doc")).select("doc_id", "text", "label")
    sample = sample.mapInArrow(in_slices(pool), "doc_id long, features binary, label int").toPandas()
    sample = sample.sort_values(["doc_id", "features"]).drop_duplicates("doc_id")
    x = np.array([np.frombuffer(f, dtype="<f4") for f in sample["features"]]).reshape(-1, FEATURES)
    return Judge(vectors, fit_network(x, sample["label"].to_numpy(dtype=np.float64)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.7) of every row.

    Null or empty texts score as texts without words.  A null id isn't held out
    and has no label.  Repeated rows: a row each.  Empty table: empty result.
    Extra columns: ignored.
    """
    judge = fit_judge(docs, labels, id_col, text_col)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = judge.scores(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(in_slices(score), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least the threshold; the columns of ``docs``.

    Null and empty texts have a score like others.  Repeated rows stay or go
    together.  Empty table: empty result.  Without labels every score is one
    half, and nothing stays.
    """
    judge = fit_judge(docs, labels, id_col, text_col)

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = judge.scores(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(in_slices(good), docs.schema)
