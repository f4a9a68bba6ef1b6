"""Removal of word windows that repeat from earlier documents, by level-wise doubling.

Windows of the asked length are found from shorter ones: only where windows of
one length repeat in other documents are windows of (up to) twice that length
looked at, until the asked length is reached or nothing repeats any more.

The first level is sampled without loss: of the short windows inside each
window of the second level the one with the least hash is its anchor, so equal
windows have equal anchors, and only anchors are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: No level is shorter: below it random word sequences repeat too often to tell anything.
SHORTEST = 5

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Anchors are compared by 40 bits (a false match costs work only), windows by 96.
_ANCHOR_BITS = np.uint64((1 << 40) - 1)
#: Kinds of rows in the exchange by hash, kept in the two highest bits of the place.
SINGLE, REPEATED, DECIDED = 0, 1, 2
_KIND, _TEXT, _POS = 62, 32, (1 << 32) - 1


def levels(window: int) -> list[int]:
    """Lengths from the shortest useful one, each at most twice the one before, up to ``window``."""
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """A hash of the ``length`` words from each place on."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    words = mixed(words + _ODD[1]) if lane else words
    total = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        total = total * _ODD[lane] + words[i : i + n]
    return mixed(total)


def anchors(words: np.ndarray, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short windows, and for each long window the place of its anchor."""
    hashes = window_hashes(words, short)
    if len(words) < long:
        return hashes, np.empty(0, dtype=np.int64)
    inside = sliding_window_view(hashes, long - short + 1)
    return hashes, inside.argmin(axis=1) + np.arange(len(inside))


def _in_runs(columns: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (columns, doc); in that order: where runs of equal columns begin, and each row's run."""
    order = np.lexsort([doc, *columns[::-1]])
    starts = np.ones(len(order), dtype=bool)
    if len(order):
        starts[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, starts, np.cumsum(starts) - 1


def settle_locally(columns: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Decide what one batch can decide alone, before anything is sent: new hash columns, and places with kinds.

    A window that the batch also has in a smaller document repeats for certain:
    its row only passes through, under one of 65536 keys that spread.  The rows
    of the smallest document stay under their hash, marked if the window
    repeats.  So a passage that many documents share sends a row from each
    batch to its hash, not one from each document.
    """
    order, starts, run = _in_runs(columns, doc)
    if not len(order):
        return columns, place
    sorted_doc = doc[order]
    later = sorted_doc > sorted_doc[np.nonzero(starts)[0]][run]
    repeated = np.zeros(run[-1] + 1, dtype=bool)
    repeated[run[later]] = True
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.where(later, DECIDED, np.where(repeated[run], REPEATED, SINGLE))
    spread = (mixed(doc.astype(np.uint64) + place.astype(np.uint64) * _ODD[0])) & np.uint64(0xFFFF)
    decided = kind == DECIDED
    columns = [np.where(decided, np.uint64(0) if i else spread, c) for i, c in enumerate(columns)]
    return columns, place | (kind << _KIND)


def _places(text_key: int, pos: np.ndarray) -> np.ndarray:
    return (np.int64(text_key & 0x3FFFFFFF) << np.int64(_TEXT)) | pos.astype(np.int64)


def _hash_rows(find: Callable, lanes: int) -> Callable:
    """Batches of (doc_id, text_key, text, ...) to rows (h0[, h1], doc_id, place) of what ``find`` gives."""
    names = [f"h{i}" for i in range(lanes)] + ["doc_id", "place"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in names]
            extra = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for doc, key, text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), extra, strict=True):
                *hashes, pos = find(word_hashes(text.as_py()), known)
                for column, values in zip(found, [*hashes, np.full(len(pos), doc, dtype=np.int64), _places(key, pos)], strict=True):
                    column.append(values)
            joined = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in found]
            doc = joined[lanes]
            hashes, place = settle_locally([h.astype(np.uint64) for h in joined[:lanes]], *joined[lanes:])
            for at in range(0, max(1, len(doc)), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(h[part].view(np.int64)) for h in hashes), pa.array(doc[part]), pa.array(place[part])], names)

    return read


def _scan(lanes: int, only_later: bool) -> Callable:
    """Over rows sorted by (hash, doc_id): the places of windows that repeat.

    ``only_later``: those that a smaller document has too; else those that any
    other document has.  Of a run that a batch ends in, the rows of its first
    document are held back at most.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # rows of the last run, all of one document, not yet known to repeat
        last: tuple | None = None  # the last run: its hash, first document, whether it repeats
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            kind = rows[:, -1].view(np.uint64) >> np.uint64(_KIND)
            passed, rows, kind = rows[kind == DECIDED], rows[kind != DECIDED], kind[kind != DECIDED]
            out = [passed[:, -2:]]
            if len(rows):
                starts = np.ones(len(rows), dtype=bool)
                starts[1:] = np.any(rows[1:, :lanes] != rows[:-1, :lanes], axis=1)
                continued = last is not None and tuple(rows[0, :lanes]) == last[0]
                run = np.cumsum(starts) - 1
                first = rows[np.nonzero(starts)[0], -2]
                repeats = np.zeros(len(first), dtype=bool)
                if continued:
                    first[0], repeats[0] = last[1], last[2]
                differs = rows[:, -2] != first[run]
                repeats[run[differs | (kind == REPEATED)]] = True
                if held is not None and (not continued or repeats[0]):
                    out.append(held[:, -2:] if continued and repeats[0] else held[:0, -2:])
                    held = None
                hit = differs if only_later else repeats[run]
                out.append(rows[hit][:, -2:])
                open_rows = rows[(run == run[-1]) & ~hit]
                if only_later:
                    open_rows = open_rows[:0]
                elif held is not None and continued and run[-1] == 0:
                    open_rows = np.concatenate([held, open_rows])
                held = open_rows if len(open_rows) else None
                last = (tuple(rows[-1, :lanes]), first[-1], bool(repeats[-1]))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array((found[:, 1].astype(np.int64) >> _TEXT) & 0x3FFFFFFF), pa.array(found[:, 1] & _POS)], ["doc_id", "text_key", "pos"])

    return read


def _repeated(docs: DataFrame, find: Callable, lanes: int, only_later: bool) -> DataFrame:
    """doc_id, text_key and sorted places of the windows that ``find`` gives and that repeat."""
    hashes = [f"h{i}" for i in range(lanes)]
    rows = docs.mapInArrow(_hash_rows(find, lanes), ", ".join(f"{h} long" for h in hashes) + ", doc_id long, place long")
    dealt = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *hashes)
    found = dealt.sortWithinPartitions(*hashes, "doc_id").mapInArrow(_scan(lanes, only_later), "doc_id long, text_key long, pos long")
    return found.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")).agg(
        F.collect_list(F.col("pos").cast("int")).alias("places")
    )


def repeated_windows(docs: DataFrame, window: int, later_copies: DataFrame) -> DataFrame:
    """of_doc, of_text and the places of windows whose words also start in a smaller document.

    ``docs`` has doc_id, text_key and text; ``later_copies`` are rows to leave out.  Level by level: anchors of the
    second level's windows; the windows whose anchors repeat; then windows that
    begin and end with repeated windows of the level before.
    """
    lengths = levels(window)
    of_text = (F.col("doc_id") == F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    given = docs.join(later_copies, of_text, "left_anti").select("doc_id", "text_key", "text")
    if len(lengths) == 1:
        every = lambda w, _: (window_hashes(w, window), window_hashes(w, window, 1), np.arange(max(0, len(w) - window + 1)))
        return _repeated(given, every, 2, True)
    short, long = lengths[:2]

    def base(words: np.ndarray, _: None) -> tuple[np.ndarray, np.ndarray]:
        hashes, of_window = anchors(words, short, long)
        pos = np.unique(of_window)
        return hashes[pos] & _ANCHOR_BITS, pos

    found = _repeated(given, base, 1, False)
    for before, length in zip(lengths, lengths[1:], strict=False):

        def extended(words: np.ndarray, known: list[int], before: int = before, length: int = length) -> tuple:
            repeats = np.zeros(len(words) + 1, dtype=bool)
            repeats[np.array(known, dtype=np.int64)] = True
            if before == short:
                pos = np.nonzero(repeats[anchors(words, short, long)[1]])[0]
            else:
                n = max(0, len(words) - length + 1)
                pos = np.nonzero(repeats[:n] & repeats[length - before : length - before + n])[0]
            return window_hashes(words, length)[pos], window_hashes(words, length, 1)[pos] >> np.uint64(32), pos

        # joined to all rows, and not to ``given``, so that this and the last join share one exchange of texts
        candidates = docs.join(found, of_text).select("doc_id", "text_key", "text", "places")
        found = _repeated(candidates, extended, 2, length == window)
    return found


def _keep_batches(window: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            columns = (batch.column("text"), batch.column("places").to_pylist(), batch.column("copy").to_pylist())
            for text, places, copy in zip(*columns, strict=True):
                words = left = (text.as_py() or "").encode().split()
                if copy and len(words) >= window:
                    left = []
                elif places:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, np.array(places), 1)
                    np.add.at(change, np.array(places) + window, -1)
                    covered = np.cumsum(change)[: len(words)] > 0
                    left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return read


def copies(keyed: DataFrame) -> DataFrame:
    """of_doc and of_text of the rows whose text a smaller document has too (by 128 bits of hash)."""
    digests = keyed.select("doc_id", "text_key", F.xxhash64("text").alias("d0"), F.xxhash64("text", F.lit(1)).alias("d1"))
    firsts = digests.groupBy(F.col("d0").alias("e0"), F.col("d1").alias("e1")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    same = (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1")) & (F.col("doc_id") > F.col("first"))
    return digests.join(firsts.where("first < last"), same).select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))


def remove_repeated(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words, one blank between) of every row.

    A word goes if a window of ``window`` words that covers it also starts in a
    row with a smaller id; windows are judged on the input.  A copy of a whole
    text is settled by its digest, and only the first of its kind is cut up.

    Null or short texts lose nothing.  Rows with a null id keep all words and
    remove none elsewhere.  Rows that share an id don't remove from each other.
    Empty table: empty result.  Extra columns: ignored.
    """
    if (id_col, text_col, docs.schema[id_col].dataType.simpleString()) == ("doc_id", "text", "bigint"):
        given = docs.select("doc_id", "text")  # without aliases, all uses of the texts share one exchange
    else:
        given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = given.where(F.col("doc_id").isNotNull())
    shared_ids = named.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0x3FFFFFFF) if shared_ids else F.lit(0).cast("long")
    keyed = named.select("doc_id", text_key.alias("text_key"), "text")
    of_text = (F.col("doc_id") == F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    later = materialize(copies(keyed).distinct(), "copies")
    found = repeated_windows(keyed, window, later).withColumn("copy", F.lit(False))
    settled = later.select("of_doc", "of_text", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("copy"))
    judged = keyed.join(found.unionByName(settled), of_text, "left").select("doc_id", "text", "places", "copy")
    without = given.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(False).alias("copy"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return judged.unionByName(without).mapInArrow(_keep_batches(window), schema)
