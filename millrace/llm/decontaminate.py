"""Benchmark decontamination by winnowing.

A benchmark item is cut into windows of ten consecutive words (a shorter item is
one window).  Within a window of n words, k-grams of (n + 1) // 2 words are
hashed and the least hash is the window's fingerprint.  Which k-gram it is
depends on the window's words alone, so equal windows of an item and a document
have equal fingerprints: every shared span that holds a window is found.

Documents are read once.  Fingerprints that a filter of bounded size lets pass
are joined with the benchmark's, and the windows around those that are found
are compared by 128 bits over their words.  Both joins meet a table with one row
per key, so they never give more rows than they are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Memory, in_slices, materialize

#: Words of a window.
WINDOW = 10
#: Bits of the filter for a fingerprint, and its least and largest size; beyond that it lets more pass, and the joins decide all the same.
FILTER_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 25
#: Bytes of text whose words are in memory at once.
BLOCK = 1 << 20
#: Words of texts that are worked on together (a longer text alone).
GROUP_WORDS = 100_000

_LETTERS_AND_DIGITS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: Lower-cases A-Z and makes a space of every ASCII sign that is neither letter nor digit.
_PLAIN = bytes(b if b in _LETTERS_AND_DIGITS else 32 for b in (ord(chr(i).lower()) if i < 128 else i for i in range(256)))
#: Odd multipliers of the rolling hashes: of k-grams, and two of whole windows.
_GRAM, _FIRST, _SECOND = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def word_hashes(text: bytes, known: Memory) -> np.ndarray:
    """64-bit hashes of a text's words in order."""
    plain, at, parts = text.translate(_PLAIN), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK)
        end = len(plain) if end < 0 else end
        parts.append(b"".join(map(known.__getitem__, plain[at:end].split())))
        known.age()
        at = end
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def _rolled(hashes: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A hash of every n consecutive words."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * factor + hashes[i : i + len(out)]
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes whose least is no longer tied to a word; other lengths of windows give others."""
    x = (x ^ (x >> np.uint64(31))) * _SECOND + np.uint64(salt)
    x = (x ^ (x >> np.uint64(29))) * _FIRST
    return x ^ (x >> np.uint64(32))


def winnow(hashes: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of every window of n words: the least hash of its k-grams."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    k = (n + 1) // 2
    return sliding_window_view(_mixed(_rolled(hashes, k, _GRAM), n), n - k + 1).min(axis=1)


def _windows(hashes: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over the words of windows of n words at some places."""
    first, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for i in range(n):
        word = hashes[starts + i]
        first, second = first * _FIRST + word, (second ^ word) * _SECOND + np.uint64(i)
    return _mixed(first, n), _mixed(second, n)


def _new_memory() -> Memory:
    return Memory(lambda word: xxhash.xxh64_digest(word))


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _item_batches(window: int) -> Callable:
    known = _new_memory()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lengths, columns = [], [], [[], [], []]
        for i, text in enumerate(batch.column(1).to_pylist()):
            hashes = word_hashes(text or b"", known)
            n = min(window, len(hashes))
            if n:
                fingerprints = winnow(hashes, n)
                ids.append(np.full(len(fingerprints), i))
                lengths.append(np.full(len(fingerprints), n, np.int32))
                for column, values in zip(columns, (fingerprints, *_windows(hashes, n, np.arange(len(fingerprints)))), strict=True):
                    column.append(values)
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        item = batch.column(0).take(pa.array(whole(ids, np.int64)))
        return pa.RecordBatch.from_arrays([item, pa.array(whole(lengths, np.int32)), *(_as_long(whole(c, np.uint64)) for c in columns)], ["item", "length", "fp", "w1", "w2"])

    return in_slices(read, known.clear)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """length, fp, w1, w2 and items of the different windows of a benchmark; a null id is written as an empty string."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = items.mapInArrow(_item_batches(window), "item string, length int, fp long, w1 long, w2 long")
    return found.groupBy("length", "w1", "w2").agg(F.min("fp").alias("fp"), F.collect_set("item").alias("items"))


class Filter:
    """A bitmap of the low bits of fingerprints: whatever was put in passes, and little else while it has room."""

    def __init__(self, fingerprints: DataFrame):
        """``fingerprints`` has a column fp; the driver holds the bitmap (4 MB at most), not the fingerprints."""
        bits = LEAST_BITS
        while bits < min(MOST_BITS, FILTER_BITS * fingerprints.count()):
            bits *= 2
        slot = F.col("fp").bitwiseAND(F.lit(bits - 1))
        words = fingerprints.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.mask, self.words = np.uint64(bits - 1), np.zeros(bits // 64, np.uint64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def passes(self, fingerprints: np.ndarray) -> np.ndarray:
        slot = fingerprints & self.mask
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


_SEEN = "key long, n_words long, length int, fp long, starts array<int>, w1 array<long>, w2 array<long>"


def _groups(texts: list[bytes | None], known: Memory) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts worked on together: the first one's number, all their words' hashes, and where each text begins (and the last one ends)."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        parts.append(word_hashes(text or b"", known))
        size += len(parts[-1])
        if size >= GROUP_WORDS or i == len(texts) - 1:
            yield first, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            first, parts, size = i + 1, [], 0


def _doc_batches(lengths: list[int], known_fp: Filter) -> Callable:
    known = _new_memory()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []  # (number in the batch, n_words, length, fp, starts, w1, w2)
        for first, hashes, begins in _groups(batch.column(2).to_pylist(), known):
            rows += [(first + i, n, 0, None, None, None, None) for i, n in enumerate(np.diff(begins).tolist())]
            for n in lengths:
                fingerprints = winnow(hashes, n)
                at = np.flatnonzero(known_fp.passes(fingerprints))
                doc = np.searchsorted(begins, at, "right") - 1
                inside = at + n <= begins[doc + 1]
                at, doc = at[inside], doc[inside]
                w1, w2 = (w.view(np.int64) for w in _windows(hashes, n, at))
                fp, starts = fingerprints[at].view(np.int64), (at - begins[doc]).astype(np.int32)
                order = np.lexsort((at, fp, doc))
                cuts = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(fp[order]) != 0)) + 1
                rows += [(first + int(doc[x[0]]), 0, n, int(fp[x[0]]), starts[x], w1[x], w2[x]) for x in np.split(order, cuts) if len(x)]
        at = pa.array([r[0] for r in rows], pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["id", "key", "n_words", "length", "fp", "starts", "w1", "w2"])

    return in_slices(read, known.clear)


def _covered(windows: Column) -> Column:
    """Number of words that sorted windows cover together."""
    zero = F.lit(0).cast("long")

    def more(a: Column, w: Column) -> Column:
        end = (w["start"] + w["length"]).cast("long")
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(zero, end - F.greatest(a["end"], w["start"].cast("long")))).alias("n"))

    return F.aggregate(windows, F.struct(zero.alias("end"), zero.alias("n")), more, lambda a: a["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, n_words, n_hit, windows (start and length of each window that an item has) and items (sorted as strings) of every document.

    Words are runs of ASCII letters (A-Z taken as a-z), digits and characters
    beyond ASCII.  A word is hit if a window of the benchmark covers it.  An item
    of fewer than ``window`` words is one window of all its words.

    What is exchanged: a row per document, and the windows whose fingerprint the
    filter lets pass.  The benchmark's windows are written down once; whether
    they are broadcast is for Spark to decide by their size.  The items of one
    window, and the windows of one document, are held by one task, as the
    result's row is.

    Null texts have no words; texts without words meet nothing; items without
    words have no window.  An empty benchmark: nothing is hit.  Repeated rows are
    given as often as they come, equal ids with different texts are apart, null
    ids stay.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    bench = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    fingerprints = bench.select("length", "fp").distinct()
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())  # ``window`` at most
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([own.schema["id"], *T.StructType.fromDDL(_SEEN).fields])
    seen = own.mapInArrow(_doc_batches(lengths, Filter(bench)), schema)
    # a document's own row meets nothing (length 0); its key spreads it
    seen = seen.withColumn("fp", F.coalesce("fp", "key"))
    found = seen.join(fingerprints.withColumn("found", F.lit(True)), ["length", "fp"], "left")
    around = F.explode_outer(F.when(F.col("found"), F.arrays_zip("starts", "w1", "w2")))
    each = found.select("id", "key", "n_words", "length", around.alias("w")).where("length = 0 or w is not null")
    each = each.select("id", "key", "n_words", "length", F.col("w.starts").alias("start"), F.coalesce("w.w1", "key").alias("w1"), F.coalesce("w.w2", "key").alias("w2"))
    hits = each.join(bench.select("length", "w1", "w2", "items"), ["length", "w1", "w2"], "left").where("length = 0 or items is not null")
    by_doc = hits.groupBy("id", "key").agg(
        F.count_if(F.col("length") == 0).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("length") > 0, F.struct("start", "length")))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return by_doc.select(F.col("id").alias(id_col), "n_words", _covered(F.col("windows")).alias("n_hit"), "windows", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
