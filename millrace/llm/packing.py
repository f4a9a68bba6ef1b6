"""Packing token sequences by linear grouping, configurations and best fit.

Lengths are integers up to the capacity, so the table meets the driver as a
histogram of at most ``capacity`` counts.  The plan made from it has slots, each
a run of equal pieces that go to consecutive sequences at one offset; pieces
find their slot by their length and their rank within it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import MEMORY_BYTES, Memory, in_slices, materialize
from millrace.llm.token_counts import byte_alphabet

CAPACITY = 2048
#: Ends each document.
END_ID = 0

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


class WordEncoder:
    """Encoder of texts to little-endian 32-bit ids for a vocabulary that drops white space.

    The vocabulary's pre-tokenizer cuts at white space and drops it, so a
    text's ids are its words' ids in a row, and the ids of a word are those of
    the pieces into which the vocabulary's own pattern cuts it.  A task
    remembers words and pieces within a bounded number of bytes, frequent ones
    longest.  Texts with a special string, and words for which lower-casing or
    white space could differ between libraries, are encoded by the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            splits = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in splits if x["type"] == "Split"))
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.visible = {b: c for c, b in byte_alphabet().items()}
        self.forget()

    def forget(self) -> None:
        """Start a task with empty memories."""
        self.words, self.pieces = Memory(self.word, MEMORY_BYTES * 9 // 10), Memory(self.piece, MEMORY_BYTES // 10)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.visible)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone
            low = word.lower()
            return self.piece(low.decode()) if low == word else self.words[low]
        if word[-1] in b",.;:!?" and word[:-1].isalpha():
            return self.words[word[:-1].lower()] + self.pieces[chr(word[-1])]
        text = word.decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if not (text.isascii() and text.isprintable()) and _ODD.search(text):
            return self.whole(text)
        if text.isalpha():
            low = text.lower()
            return self.piece(low) if low == text else self.words[low.encode()]
        if text[-1] in ",.;:!?" and text[:-1].isalpha():
            return self.words[text[:-1].lower().encode()] + self.pieces[text[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        out = b"".join(map(self.words.__getitem__, text.encode().split()))
        self.words.age()
        self.pieces.age()
        return out


#: Capital sigma has a lower case that depends on its place, dotted capital I one of two characters;
#: the information separators are white space to some libraries only.
_ODD = re.compile("[\u03a3\u0130\x1c-\x1f]")


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _piece_batches(path: str, capacity: int) -> Callable:
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = word_encoder(path)
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoder.encode(text.as_py() or "") + end
            for at in range(0, len(ids), 4 * capacity):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*rows, strict=True) if rows else ([] for _ in _PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.types, strict=True)], schema=_PIECES)

    return in_slices(pieces, lambda: word_encoder(path).forget())


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; null texts are empty."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_piece_batches(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Whole-number uses of configurations (copies of each size) for a few sizes.

    The configuration linear program is solved by column generation: a revised
    simplex over the sizes' rows, and as pricing a knapsack over the capacity.
    Uses are rounded down; what they leave is packed with the small pieces.
    """
    n = len(sizes)
    basis = [[capacity // s if i == j else 0 for j in range(n)] for i, s in enumerate(sizes)]
    use = np.array([d / (capacity // s) for s, d in zip(sizes, demand, strict=True)])
    size = np.array(sizes)
    for _ in range(rounds):
        columns = np.array(basis, dtype=float).T
        price = np.linalg.solve(columns.T, np.ones(n))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(size.min()), capacity + 1):
            fits = np.nonzero(size <= room)[0]
            value = best[room - size[fits]] + price[fits]
            k = int(value.argmax())
            if value[k] > best[room - 1] + 1e-12:
                best[room], last[room] = value[k], fits[k]
            else:
                best[room], last[room] = best[room - 1], -1
        if best[capacity] <= 1 + 1e-7:
            break
        entering, room = [0] * n, capacity
        while room > 0:
            if (k := int(last[room])) < 0:
                room -= 1
            else:
                entering[k] += 1
                room -= sizes[k]
        step = np.linalg.solve(columns, np.array(entering, dtype=float))
        ratios = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratios.argmin())
        amount = ratios[leaving]
        use = np.maximum(use - amount * step, 0)
        use[leaving], basis[leaving] = amount, entering
    return [(config, int(x + 1e-6)) for config, x in zip(basis, use, strict=True) if x + 1e-6 >= 1]


class _Shelf:
    """Pieces of each length are dealt in order of rank: (length, first rank, how many) runs."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.next = dict(counts), dict.fromkeys(counts, 0)

    def take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return first


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 48, small: int | None = None, slack: int | None = None) -> np.ndarray:
    """Slots (length, first rank, pieces, first sequence, offset) that hold all counted pieces.

    Lengths above ``small`` (a quarter of the capacity) are sorted and cut into
    ``groups`` groups of equal cardinality, each rounded up to its largest
    length; configurations of these few sizes are optimised, and their places
    are then filled with the longest actual pieces up to each size, the last
    one with the longest piece for which there is room, as long as that fills
    the sequence but for ``slack`` places.  What is left, and all
    small lengths, are placed longest first, each to the fullest sequence that
    has room (in runs of equal sequences).

    Work and slots depend on the capacity and the number of groups alone, not
    on the number of pieces.
    """
    small = capacity // 4 if small is None else small
    slack = capacity // 128 if slack is None else slack
    shelf = _Shelf({k: n for k, n in counts.items() if n > 0})
    by_gap: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity)]
    open_gaps = 0  # bit g: some sequence has exactly g places left

    def put(times: int, parts: list[tuple[int, int]]) -> None:
        nonlocal open_gaps
        gap = capacity - sum(p[0] for p in parts)
        by_gap[gap].append((times, parts))
        open_gaps |= 1 << gap

    if n := shelf.left.get(capacity, 0):
        put(n, [(capacity, shelf.take(capacity, n))])
    large = [k for k in sorted(shelf.left, reverse=True) if small < k < capacity]
    group_size = max(1, -(-sum(shelf.left[k] for k in large) // groups))
    demand: dict[int, int] = {}  # by the rounded size
    room = 0
    for k in large:
        n = shelf.left[k]
        while n:
            if not room:
                size, room = k, group_size
            t = min(n, room)
            demand[size] = demand.get(size, 0) + t
            n, room = n - t, room - t
    available = sum(1 << k for k in large)  # bit k: pieces of length k are left
    for config, times in configurations(list(demand), list(demand.values()), capacity) if demand else []:
        wanted = [s for s, n in zip(demand, config, strict=True) for _ in range(n)]
        while times:
            parts: list[int] = []
            for size in [*wanted[:-1], capacity]:  # the last place goes to the longest piece for which there is room
                size = min(size, capacity - sum(parts))
                length = (available & ((2 << size) - 1)).bit_length() - 1
                while length > 0 and shelf.left[length] <= parts.count(length):
                    length = (available & ((1 << length) - 1)).bit_length() - 1
                parts.append(length)
            if min(parts) <= 0 or sum(parts) < capacity - slack:
                break
            t = min([times, *(shelf.left[k] // parts.count(k) for k in parts)])
            put(t, [(k, shelf.take(k, t)) for k in parts])
            times -= t
            for k in parts:
                if not shelf.left[k]:
                    available &= ~(1 << k)

    for k in sorted((k for k, n in shelf.left.items() if n), reverse=True):
        n = shelf.left[k]
        while n:
            if not (rest := open_gaps >> k):
                each = capacity // k
                t = max(1, n // each)
                fill = min(each, n)
                first = shelf.take(k, t * fill)
                put(t, [(k, first + i * t) for i in range(fill)])
                n -= t * fill
                continue
            gap = k + (rest & -rest).bit_length() - 1
            times, parts = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            t = min(times, n)
            if t < times:
                put(times - t, [(length, first + t) for length, first in parts])
            put(t, [*parts, (k, shelf.take(k, t))])
            n -= t

    slots, sequence = [], 0
    for same_gap in by_gap:
        for times, parts in same_gap:
            offset = 0
            for length, first in parts:
                slots.append((length, first, times, sequence, offset))
                offset += length
            sequence += times
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)


def _place_batches(slots: np.ndarray) -> Callable:
    keys = (slots[:, 0] << 40) + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            own = slots[at]
            sequence = own[:, 3] + rank - own[:, 1]
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(own[:, 4])], names)

    return place


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    groups: int = 48,
    chunk_rows: int = 2_000,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A piece's rank within its length is its number within (length, chunk) plus
    the counts of earlier chunks; chunks are a hash of id, piece and ids, so a length
    that a third of all pieces share is ranked in many tasks.

    Null or empty text: the end id alone.  Null ids and repeated rows: packed
    like others.  Very long texts: cut into pieces of the capacity.  Empty
    table: empty result.  Extra columns: ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, path, id_col, text_col, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_slots(counts, capacity, groups)
    chunks = max(1, sum(counts.values()) // chunk_rows)
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int"))
    sizes = chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")
    starts = sizes.select(F.col("length").alias("of_length"), F.col("chunk").alias("of_chunk"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")) - 1
    ranked = (
        chunked.withColumn("within", within)
        .join(starts, (F.col("length") == F.col("of_length")) & (F.col("chunk") == F.col("of_chunk")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).cast("long").alias("rank"))
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not counts:
        return spark.createDataFrame([], schema)
    return ranked.mapInArrow(_place_batches(slots), schema)
