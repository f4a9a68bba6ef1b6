"""Token counts of byte-level BPE by deterministic transducers.

Two transducers are compiled.  The splitter reads characters by class (letter,
number, white space, other, and the letters of contractions) and emits a cut
wherever the vocabulary's pre-tokenizer starts a new piece.  The merger reads
the bytes of one piece, and each of its transitions is annotated with the change
of the token count: a prefix's encoding is its last token behind the encoding
of what is before it, so the last tokens of the recent prefixes, as far back as
a vocabulary entry can still reach, decide every later step.  States are made
when they are first reached.

A text is read in chunks.  Where white space follows other characters, and
where a letter, a number and another sign meet (but for an apostrophe before a
letter), the splitter's state behind the place is the same whatever came before.
So a chunk's state map is what it holds before the first such place (its head,
to be read from the state that the chunk is entered in), the tokens between the
first and the last, and what follows the last (its tail).  Maps compose
associatively; the maps of a text are scanned in blocks, and then the blocks.
A run of one class of characters longer than a chunk, such as a genome, has no
such place: it is one piece to the vocabulary and is counted in one task.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import MEMORY_BYTES, in_slices

#: A chunk's head, the tokens between head and tail (None: all is head), and its tail.
Map = tuple[str, int | None, str]

#: States that a worker keeps.
CACHE_STATES = 200_000
#: Characters whose new segments advance together.
GROUP_CHARS = 1_000_000
#: Characters of a chunk, and chunks of a block: a text of the longest kind (2**31 bytes) has at most 128 blocks.
CHUNK = 1 << 16
BLOCK = 256


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Transducer over the bytes of a piece; emits changes of its token count.

    A state is (suffix, last tokens, counts): the longest suffix of the bytes
    read that a vocabulary entry can still extend, and for each place in it
    where such an entry could begin, the last token before the place and the
    count there, relative to the count of all that was read.

    Tokens are numbers in the order of merging: the bytes, then the merges.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = (self.number[a], self.number[b])
            self.joined[pair] = self.number[a + b] = len(self.halves)
            self.halves.append(pair)
        self.open = {t[:i] for t in self.number for i in range(len(t))}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        first = (b"", (-1,), (0,))
        self.ids = {first: 0}
        self.states = [first]
        self.moves: dict[int, tuple[int, int]] = {}  # by 256 * state + byte: next state, change of the count

    def fits(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging leaves two tokens side by side (by the merges earlier than ``before``).

        The merges next to the place between the two are undone from the latest
        on: if at some time the parts there would have been joined earlier than
        the merge just undone took place, the place would not have stayed.
        """
        a, b = left, right
        before = len(self.halves) if before is None else before
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            if max(a, b) < 256:
                return True
            if a > b:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def alone(self, token: int) -> bool:
        """Whether the bytes of a token merge to it."""
        if token not in self.whole:
            a, b = self.halves[token]
            self.whole[token] = token < 256 or (self.alone(a) and self.alone(b) and self.fits(a, b, token))
        return self.whole[token]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after ``byte`` and the change of the count; made once."""
        suffix, last, counts = self.states[state]
        text = suffix + bytes([byte])
        for i in range(len(text)):  # one token alone ends here; the longest is tried first
            token = self.number.get(text[i:])
            if token is not None and (self.alone(token) if last[i] < 0 else self.fits(last[i], token)):
                change = counts[i] + 1
                break
        at = 0
        while text[at:] not in self.open:
            at += 1
        last, counts = (*last, token)[at:], (*counts, change)[at:]
        useful = [text[i:] in self.open for i in range(at, len(text) + 1)]
        key = (
            text[at:],
            tuple(x if u else None for x, u in zip(last, useful, strict=True)),
            tuple(c - change if u else 0 for c, u in zip(counts, useful, strict=True)),
        )
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        self.moves[256 * state + byte] = found = (self.ids[key], change)
        return found

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Token counts of pieces, which all advance by one byte at a time."""
        if len(self.states) > CACHE_STATES:
            self.reset()
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        read = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        state, total = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        for at, n in enumerate(active.tolist()):
            keys, which = np.unique(256 * state[:n] + read[starts[:n] + at], return_inverse=True)
            moves = [self.moves.get(k) or self.step(k >> 8, k & 255) for k in keys.tolist()]
            after, change = np.array(moves, dtype=np.int64).T
            state[:n] = after[which]
            total[:n] += change[which]
        out = np.empty_like(total)
        out[order] = total
        return out.tolist()


#: The characters that the pre-tokenizer's pattern takes for white space (Unicode White_Space).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: States of the splitter behind white space.  MARK holds an apostrophe at the start of a piece,
#: R, V and L one and the first letter of a longer contraction; DONE has just read a contraction.
START, LETTERS, NUMBERS, OTHERS, MARK, R, V, L, DONE = range(9)


def begin(c: str) -> int:
    """State after the first character of a piece."""
    kind = unicodedata.category(c)[0]
    return LETTERS if kind == "L" else NUMBERS if kind == "N" else MARK if c == "'" else OTHERS


@lru_cache(maxsize=1 << 16)
def split_step(state: int, c: str) -> tuple[int, tuple[int, ...]]:
    """The state after ``c`` and the cuts it settles, as characters back from ``c`` (0: right before it)."""
    own = begin(c)
    if state == START:
        return own, ()
    if (state in (LETTERS, NUMBERS) and own == state) or (state in (OTHERS, MARK) and own in (OTHERS, MARK)):
        return (OTHERS if state == MARK else state), ()
    if state == MARK and c in "stmd":
        return DONE, ()
    if state == MARK and c in "rvl":
        return {"r": R, "v": V, "l": L}[c], ()
    if (state in (R, V) and c == "e") or (state == L and c == "l"):
        return DONE, ()
    if state in (R, V, L):  # no contraction: the apostrophe is a piece, and its letter begins the next
        return (LETTERS, (1,)) if own == LETTERS else (own, (1, 0))
    return own, (0,)


def split_cuts(segment: str, white: int) -> list[int]:
    """Starts of the pieces of a segment: ``white`` characters of white space and what follows them.

    Before a word a run of white space is a piece, but for its last character:
    that begins the next piece if it is a blank and else is a piece itself.
    """
    if white == len(segment):
        return [0]
    cuts, state, at = [0], START, white
    if white > 1:
        cuts.append(white - 1)
    if white and segment[white - 1] == " ":
        state = OTHERS if begin(segment[at]) == MARK else begin(segment[at])
        at += 1
    elif white:
        cuts.append(white)
    for i in range(at, len(segment)):
        state, back = split_step(state, segment[i])
        cuts.extend(i - b for b in back)
    if state in (R, V, L):
        cuts.append(len(segment) - 1)
    return cuts


_SEGMENT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_WHITE = re.compile(f"[{WHITE_SPACE}]*")


#: What a remembered segment takes besides its characters, and the longest segment that is remembered.
_ENTRY, _LONGEST = 120, 256


class Counter:
    """Token counts of texts, and state maps of chunks, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merger = Merger([tuple(bytes(alphabet[c] for c in part) for part in pair) for pair in pairs])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.longest_special = max(map(len, special), default=0)
        self.forget()

    def forget(self) -> None:
        """Start a task with empty memories (the transducers stay)."""
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size = 0

    def pieces(self, segment: str) -> tuple[list[str], int]:
        """The splitter over one segment that is entered in the start state: pieces, special tokens."""
        if segment[0] == " ":
            if segment[1:].isalpha():
                return [segment], 0
            if segment[-1] in ",.;:!?" and segment[1:-1].isalpha():
                return [segment[:-1], segment[-1]], 0
        parts = self.special.split(segment) if self.special else [segment]
        found = []
        for part in filter(None, parts):
            cuts = [*split_cuts(part, _WHITE.match(part).end()), len(part)]
            found += [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return found, len(parts) - 1

    def learn(self, segments: set[str]) -> None:
        """Run both transducers over segments that were not met lately; a piece is a segment as well."""
        plain = {s for s in segments if s[0] == " " and s[1:].isalpha()}  # each is its only piece
        split = {s: self.pieces(s) for s in segments.difference(plain)}
        fresh = plain.union(chain.from_iterable(p for p, _ in split.values())).difference(self.young)
        found = {p: self.old[p] for p in fresh if p in self.old}
        unknown = list(fresh.difference(found))
        found.update(zip(unknown, self.merger.counts([p.encode() for p in unknown]), strict=True))
        self.remember(found)
        count = self.young.__getitem__
        self.remember({s: sum(map(count, p)) + special for s, (p, special) in split.items() if special or len(p) != 1})

    def remember(self, counts: dict[str, int]) -> None:
        self.young.update(counts)
        self.size += _ENTRY * len(counts) + sum(map(len, counts))

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of texts; a segment that was met before is one step."""
        collected = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and a collection walks all that is remembered
        try:
            return self.count_each(texts)
        finally:
            if collected:
                gc.enable()

    def count_each(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < GROUP_CHARS:
                size += len(texts[end])
                end += 1
            split = [_SEGMENT.findall(t) for t in texts[at:end]]
            if fresh := set(chain.from_iterable(split)).difference(self.young):
                kept = {s: self.old[s] for s in fresh if s in self.old}
                self.remember(kept)
                self.learn(fresh.difference(kept))
            out += [sum(map(self.young.__getitem__, s)) for s in split]
            if any(len(s) > _LONGEST for s in fresh):
                for s in [s for s in self.young if len(s) > _LONGEST]:
                    del self.young[s]
                    self.size -= _ENTRY + len(s)
            if self.size > MEMORY_BYTES // 2:
                self.young, self.old, self.size = {}, self.young, 0
            at = end
        return out

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def resets(self, chunk: str, i: int) -> bool:
        """Whether the splitter's state behind place ``i`` of a chunk doesn't depend on what came before."""
        a, b = chunk[i - 1], chunk[i]
        if a in WHITE_SPACE:
            return False
        if b in WHITE_SPACE:
            return True
        left, right = (OTHERS if (k := begin(c)) == MARK else k for c in (a, b))
        if left == right or (a == "'" and right == LETTERS):
            return False
        reach = self.longest_special
        if not reach:
            return True
        if i < reach or i > len(chunk) - reach:  # a special string could lie across the chunk's end
            return False
        near = chunk[i - reach : i + reach]
        return not any(m.start() < reach < m.end() for m in self.special.finditer(near))

    def chunk_map(self, chunk: str) -> Map:
        """State map of a chunk: (head, tokens between, tail); tokens None: all is head, nothing resets the state."""
        a = next((i for i in range(1, len(chunk)) if self.resets(chunk, i)), None)
        if a is None:
            return chunk, None, ""
        b = next(i for i in range(len(chunk) - 1, a - 1, -1) if self.resets(chunk, i))
        return chunk[:a], self.count(chunk[a:b]), chunk[b:]

    def join(self, a: Map, b: Map) -> Map:
        """The map of two chunks in a row; associative."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[Map]) -> Map:
        """The map of chunks in order, joined pair by pair in rounds."""
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, whole: Map) -> int:
        """Tokens of a text from its map: it is entered in the start state."""
        return self.count(whole[0]) + (whole[1] or 0) + self.count(whole[2])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def _with_counter(path: str, read: Callable) -> Callable:
    return in_slices(lambda batch: read(counter(path), batch), lambda: counter(path).forget(), 2048)


_MAP = ("head", "tokens", "tail")
_MAP_TYPES = (pa.string(), pa.int64(), pa.string())


def _with_maps(batch: pa.RecordBatch, names: list[str], maps: list[Map]) -> pa.RecordBatch:
    columns = zip(*maps, strict=True) if maps else ((), (), ())
    return pa.RecordBatch.from_arrays([*map(batch.column, names), *(pa.array(c, t) for c, t in zip(columns, _MAP_TYPES, strict=True))], [*names, *_MAP])


def _map_chunks(c: Counter, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A chunk's map; a text of one chunk is counted at once."""
    chunks, whole = batch.column("chunk").to_pylist(), [n == 1 for n in batch.column("n_chunks").to_pylist()]
    counts = iter(c.count_all([t for t, w in zip(chunks, whole, strict=True) if w]))
    maps = [("", next(counts), "") if w else c.chunk_map(t) for t, w in zip(chunks, whole, strict=True)]
    return _with_maps(batch, ["row", "doc_id", "n_bytes", "nth"], maps)


def _scan_maps(c: Counter, batch: pa.RecordBatch) -> pa.RecordBatch:
    maps = [c.scan([(m["head"], m["tokens"], m["tail"]) for m in ms]) for ms in batch.column("maps").to_pylist()]
    return _with_maps(batch, ["row", "doc_id", "n_bytes", "nth"], maps)


def _count_texts(c: Counter, batch: pa.RecordBatch) -> pa.RecordBatch:
    maps = batch.column("maps").to_pylist()
    counts = [c.total(c.scan([(m["head"], m["tokens"], m["tail"]) for m in ms])) for ms in maps]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_chars: int = CHUNK
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Texts of more than ``chunk_chars`` characters are read in chunks, each giving
    a state map; the maps of a text, not its chunks, are scanned in order, first
    within blocks of BLOCK chunks and then over the blocks.  Null text: empty, no tokens.  Null ids and repeated rows: a row each.
    Special strings inside a text are one token.  Empty table: empty result.
    Extra columns: ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_chunks = F.greatest(F.ceil(F.length("whole") / chunk_chars), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda i: F.substring("whole", i * chunk_chars + 1, F.lit(chunk_chars)))
    # rows are numbered before, and not while, they are cut
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("whole"))
    rows = numbered.select(
        "row",
        "doc_id",
        F.octet_length("whole").cast("long").alias("n_bytes"),
        n_chunks.alias("n_chunks"),
        F.posexplode(F.when(n_chunks == 1, F.array("whole")).otherwise(cut)).alias("nth", "chunk"),
    )
    maps = rows.mapInArrow(_with_counter(path, _map_chunks), "row long, doc_id long, n_bytes long, nth int, head string, tokens long, tail string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", *_MAP))), lambda m: F.struct(*[m[x].alias(x) for x in _MAP])).alias("maps")
    keys = ["row", "doc_id", "n_bytes"]
    blocks = maps.groupBy(*keys, F.floor(F.col("nth") / BLOCK).cast("int").alias("nth")).agg(ordered)
    scanned = blocks.mapInArrow(_with_counter(path, _scan_maps), "row long, doc_id long, n_bytes long, nth int, head string, tokens long, tail string")
    counted = scanned.groupBy(*keys).agg(ordered).select("doc_id", "n_bytes", "maps").mapInArrow(_with_counter(path, _count_texts), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
