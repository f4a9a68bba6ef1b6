"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes.  The transducer reads tokens of the side that
is behind; its state is the side that leads and the bytes of its last token that
the other side has not matched yet.  A token read while bytes dangle overlaps
the leading token, which gives a link; when nothing dangles both sides end, and
a group is closed.  Transitions depend on the residual and the next token only
and are remembered.

A single space between two characters that aren't white space begins a token of
either tokenizer, whatever stands before it, so texts are read as the pieces
between such spaces, the transducer is at rest between them, and what a piece
gives is remembered too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import in_slices, materialize
from millrace.llm.token_counts import byte_alphabet

#: Spaces where a text may be cut.  U+180E is white space to older tables.
_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
#: Transitions and groups that are remembered, and characters of texts that are worked on together (a longer text alone).
MOST_MOVES, GROUP_CHARS = 500_000, 500_000
#: Pairs of ids that are broadcast at most, some 100 bytes each; more are joined by an exchange.
MOST_BROADCAST = 1_000_000
#: Bytes that remembered pieces may take in a worker (and what one group of texts adds).
PIECES_BYTES = 192_000_000


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; a piece is read behind a space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        self.bytes = {i: bytes(alphabet[c] for c in entry) for entry, i in vocabulary.items() if all(c in alphabet for c in entry)}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def encode(self, pieces: list[str]) -> Iterable[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch([f" {p}" for p in pieces], add_special_tokens=False))


class Pieces:
    """A sentencepiece model with byte fallback that adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        entry = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = {i: entry(i) for i in range(m.get_piece_size())}

    def encode(self, pieces: list[str]) -> Iterable[list[int]]:
        return self.model.encode(pieces, num_threads=1)


#: Tokens of side 0, both sides as text, and the links as numbers (first id times 2**32 plus the second).
Group = tuple[int, str, bytes]


class Transducer:
    """Aligns tokens of side 0 and side 1; a state is (the side that leads, its unmatched bytes)."""

    REST = (1, b"")  # nothing dangles: side 0 reads first

    def __init__(self, sides: tuple[dict[int, bytes], dict[int, bytes]]):
        self.sides = sides
        self.moves: dict[tuple[tuple[int, bytes], int], tuple[int, bytes] | None] = {}
        self.groups: dict[tuple[int, ...], Group] = {}

    def move(self, state: tuple[int, bytes], token: int) -> tuple[int, bytes] | None:
        """The state behind a token of the side that is behind; None where the bytes differ."""
        leads, residual = state
        own = self.sides[1 - leads][token]
        if len(own) <= len(residual):
            after = (leads, residual[len(own) :]) if residual.startswith(own) else None
        else:
            after = (1 - leads, own[len(residual) :]) if own.startswith(residual) else None
        if after is not None and not after[1]:
            after = self.REST
        if len(self.moves) >= MOST_MOVES:
            self.moves.clear()
        self.moves[state, token] = after
        return after

    def align(self, a: list[int], b: list[int]) -> list[Group] | None:
        """The groups of two sequences of tokens, or None if they don't spell the same bytes."""
        found: list[Group] = []
        rest, moves, tokens, at, path = self.REST, self.moves, (a, b), [0, 0], []
        state = rest
        while True:
            side = 1 - state[0]
            if at[side] == len(tokens[side]):
                return found if state is rest and at[0] == len(a) and at[1] == len(b) else None
            token = tokens[side][at[side]]
            at[side] += 1
            path.append(token)
            state = moves.get((state, token)) or self.move(state, token)
            if state is None:
                return None
            if state is rest:  # the tokens read since rest tell which side each is of
                key = tuple(path)
                found.append(self.groups.get(key) or self.group(key))
                path = []

    def group(self, path: tuple[int, ...]) -> Group:
        """The group of tokens that lead from rest to rest, read once more for its sides and links."""
        state, leading, sides, links = self.REST, -1, ([], []), []
        for token in path:
            side = 1 - state[0]
            sides[side].append(token)
            if state is not self.REST:
                links.append((leading, token) if side else (token, leading))
            state = self.moves.get((state, token)) or self.move(state, token)
            if state[0] == side:
                leading = token
        if len(self.groups) >= MOST_MOVES:
            self.groups.clear()
        text = "|".join(",".join(map(str, ids)) for ids in sides)
        self.groups[path] = found = (len(sides[0]), text, np.array([x << 32 | y for x, y in links], np.int64).tobytes())
        return found


class Aligned:
    """What a piece gives: its tokens of side 0, its groups as text, its links; ``groups`` is None if it has no alignment."""

    __slots__ = ("groups", "links", "n_a")

    def __init__(self, found: list[Group] | None):
        self.n_a = sum([g[0] for g in found or ()])
        self.groups = None if found is None else ";".join([g[1] for g in found])
        self.links = b"".join([g[2] for g in found or ()])


class Aligner:
    """Aligns texts by two vocabularies; remembers pieces in two generations of bounded size."""

    def __init__(self, a, b):
        self.a, self.b, self.transducer = a, b, Transducer((a.bytes, b.bytes))
        self.known: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}
        self.size = 0

    def learn(self, pieces: set[str]) -> dict[str, Aligned]:
        """What is known, these pieces included."""
        if self.size > PIECES_BYTES // 2:
            self.old, self.known, self.size = self.known, {}, 0
        missing, was = [p for p in pieces if p not in self.known], self.old
        new = [p for p in missing if p not in was]
        found = dict(zip(new, map(Aligned, map(self.transducer.align, self.a.encode(new), self.b.encode(new))), strict=True))
        for p in missing:
            v = was.get(p) or found[p]
            self.known[p] = v
            self.size += 350 + len(p) + len(v.groups or "") + len(v.links)
        return self.known

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, links, groups) of each text, None where it has no tokens."""
        cut = [_CUT.split(t) for t in texts]
        known = self.learn({p for pieces in cut for p in pieces if p})
        out: list[tuple | None] = []
        for pieces in cut:
            parts = [known[p] for p in pieces] if pieces != [""] else []
            texts_of = [p.groups for p in parts]
            if not parts or None in texts_of:
                out.append(None)
                continue
            groups = ";".join(texts_of)
            links = np.frombuffer(b"".join([p.links for p in parts]), np.int64)
            n_a, n_groups = sum([p.n_a for p in parts]), groups.count(";") + 1
            out.append((n_a, len(links) + n_groups - n_a, n_groups, links, groups))  # a group of x and y tokens has x + y - 1 links
        return out


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """Each worker reads the two vocabularies once."""
    return Aligner(ByteLevel(a), Pieces(b))


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<int>, groups string"


def _batches(a: str, b: str) -> Callable:
    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows, at = [t or "" for t in batch.column(1).to_pylist()], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_CHARS):
                size += len(texts[end])
                end += 1
            rows += aligner(a, b).texts(texts[at:end])
            at = end
        counted = [np.unique(r[3], return_counts=True) if r else ([], []) for r in rows]
        numbers = [pa.array([f(r) if r else 0 for r in rows], pa.int64()) for f in (lambda r: r[0], lambda r: r[1], lambda r: r[2], lambda r: len(r[3]))]
        lists = [pa.array([c[k] for c in counted], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *numbers, *lists, pa.array([r[4] if r else "" for r in rows])], ["id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups"])

    return in_slices(read)


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, pairs and times (the different links of a text and how often), groups (as text) per document.

    ``a`` is the path of a byte-level vocabulary that reads a space and the
    text, ``b`` of a sentencepiece model that adds the space; strings of special
    tokens are plain text.  ``groups`` are ids as ``a1,a2|b1;a3|b2,b3``; a pair is
    the first id times 2**32 plus the second.

    Null and empty texts, and texts whose tokens spell other bytes than a space
    and the text, have no tokens: zeros and empty groups.  Each row gives one
    row; a text of any length is read whole by one task, in its pieces.  Extra
    columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_batches(a, b), T.StructType([own.schema["id"], *T.StructType.fromDDL(_ALIGNED).fields]))


def with_link_counts(aligned: DataFrame, groups: Column) -> DataFrame:
    """Rows of align() without pairs, with n_best, count_sum and ``groups`` as given.

    A pair's count is in how many documents it is linked.  ``n_best`` are a
    document's links whose count is the highest of their first id, ``count_sum``
    is the sum of the counts of its links.  Tokens are read once: different links
    per document are written down, counted, and met with their counts again.  The
    counts have one row per pair; up to a million of them are broadcast.
    """
    rows = materialize(aligned.select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", groups.alias("groups")), "alignments")
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counted.withColumn("a", F.shiftright("pair", 32)), "link-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    few = counts.count() <= MOST_BROADCAST
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    if few:
        counts = F.broadcast(counts)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
