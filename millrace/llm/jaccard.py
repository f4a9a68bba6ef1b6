"""Sets of word shingles: their exact Jaccard similarity, and a prefix-filtered join for the pairs that fingerprints can't tell.

Of two texts with a similarity of 0.8 some ten of 64 fingerprint bits differ,
far beyond a small Hamming ball.  What multi-index hashing finds comes first
(millrace.llm.simhash); the join here completes it, so that no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import arrow_rows, discard, free_shuffles, in_slices, materialize
from millrace.llm.components import connected_components
from millrace.llm.decontaminate import Filter

#: Similarity as a fraction, so that sizes are compared in whole numbers.
SIMILARITY = (4, 5)
#: Texts that tell which shingles are frequent, and so many of these come last; this sets the work, never the result.
ORDER_TEXTS = 50_000
ORDER_SHINGLES = 200_000
#: Longs of a set's parities: 64 bits each, every one set if an odd number of the set's shingles fall on it.
PARITIES = 16
#: Sets of a head, drawn by hash, that its other sets are compared with before all pairs are.
PIVOTS = 8
#: Pairs of sets that are handed to Python at once: two sets of a very long text have some megabytes.
PAIRS_AT_ONCE = 256


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, one without words has none.

    Words are those of the fingerprints: A-Z lowered, cut at the six ASCII white spaces.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    width = min(shingle, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + of_word[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of some texts share, sorted, and how many do; the texts are told by their hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], ["h"])

    one_in = max(1, docs.count() // ORDER_TEXTS)
    texts = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    found = texts.mapInArrow(explode, "h long").groupBy("h").count().where("count > 3").orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toPandas()
    found = found.assign(h=found["h"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values("h")
    return found["h"].to_numpy(), found["count"].to_numpy()


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + 65536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def digest(hashes: np.ndarray) -> int:
    """What names a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def least_common(n: int, similarity: tuple[int, int]) -> int:
    """Shingles of a set of ``n`` that a similar set must have, at least."""
    p, q = similarity
    return -(-n * p // q)


_SETS = f"doc_id long, node long, fp long, n int, bits struct<{', '.join(f'b{i}: long' for i in range(PARITIES))}>, heads array<long>"


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES longs; those of two sets differ in at most as many bits as there are shingles in one set alone."""
    odd = np.bincount((hashes & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def may_be_similar(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Whether parities leave two sets enough in common; true of all similar pairs.  Columns n and bits end in ``a`` and ``b``."""
    p, q = similarity
    apart_ = sum((F.bit_count(F.col(f"bits_{a}.b{i}").bitwiseXOR(F.col(f"bits_{b}.b{i}"))) for i in range(PARITIES)), F.lit(0))
    both = F.col(f"n_{a}") + F.col(f"n_{b}")
    return (both - apart_) * (p + q) >= both * (2 * p)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Every row's doc_id, node (a digest of its set), fp (the set's SimHash), n, bits (its parities) and heads.

    Heads are the rarest shingles, of which a similar set must have one.  The
    sets themselves, some four bytes a word, aren't kept (see Sets).
    """
    frequent, counts = frequent_shingles(docs, text_col, shingle)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, prints, sizes, bits, heads = [], [], [], [], []
        for t in batch.column(1):
            s = shingle_set(t.as_py(), shingle)
            nodes.append(digest(s))
            prints.append(majority(s))
            sizes.append(len(s))
            bits.append(parities(s))
            if len(frequent) and len(s):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                often = np.where(frequent[at] == s, counts[at], 0)
                s = s[np.argsort(often, kind="stable")]
            heads.append(s[: len(s) - least_common(len(s), similarity) + 1].view(np.int64))
        ids = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints)]
        of_bits = [pa.array(x) for x in np.array(bits, dtype=np.int64).reshape(-1, PARITIES).T.copy()]
        of_bits = pa.StructArray.from_arrays(of_bits, [f"b{i}" for i in range(PARITIES)])
        columns = [batch.column(0), *ids, pa.array(sizes, pa.int32()), of_bits, pa.array(heads, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "n", "bits", "heads"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(in_slices(sets), _SETS)


@dataclass(frozen=True)
class Sets:
    """Different sets (``nodes``: node, first, which is a doc_id that has it, n and bits), and the texts that they are made of again when they are asked for."""

    nodes: DataFrame
    docs: DataFrame
    id_col: str
    text_col: str
    shingle: int

    def members(self, wanted: DataFrame) -> DataFrame:
        """Once each, the sets of the different ``node`` in ``wanted``: node and members, sorted 32-bit hashes.

        A pair's common count is off by chance collisions only, n * n / 2**32
        on average.  Only texts whose ids pass a filter of bounded size become
        sets again; what it lets pass besides is dropped by node.  A node whose
        ids are all null is found too, since nulls have a hash like others.
        """
        shingle, ids = self.shingle, Filter(self.nodes.join(wanted, "node", "left_semi").select(F.xxhash64("first").alias("fp")))

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            passed = ids.passes(batch.column(0).to_numpy().view(np.uint64))
            made = [shingle_set(t.as_py(), shingle) for t in batch.column(1).filter(pa.array(passed))]
            nodes = np.array([digest(s) for s in made], dtype=np.uint64).view(np.int64)
            members = [(s >> np.uint64(32)).astype("<u4").tobytes() for s in made]
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(members, pa.binary())], ["node", "members"])

        given = self.docs.select(F.xxhash64(F.col(self.id_col).cast("long")).alias("id"), F.col(self.text_col).alias("text"))
        return given.mapInArrow(in_slices(sets), "node long, members binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def shared_heads(sets: DataFrame) -> DataFrame:
    """h, node, n, at (place among the node's heads) and m (nodes with this head) of heads that several nodes have."""
    heads = sets.where("n > 0").select("node", "n", F.posexplode("heads").alias("at", "h"))
    heads = heads.repartition("h").dropDuplicates(["h", "node"])
    return heads.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("m > 1")


def head_pairs(a: DataFrame, b: DataFrame, similarity: tuple[int, int], others: Column | None = None) -> DataFrame:
    """Pairs u < v of nodes with a common head that sizes and places allow."""
    p, q = similarity
    a, b = (x.select("h", *[F.col(c).alias(f"{c}_{k}") for c in x.columns if c != "h"]) for k, x in (("a", a), ("b", b)))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p) & (room * (p + q) >= (F.col("n_a") + F.col("n_b")) * p)
    both = a.join(b, "h").where((F.col("node_a") != F.col("node_b")) & fits & (F.lit(True) if others is None else others))
    return both.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def verified(pairs: DataFrame, sets: Sets, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of at least the given Jaccard similarity, written down.

    Parities are compared first; only sets of pairs that these don't tell apart are made and moved.
    """
    p, q = similarity

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(z.as_py(), dtype="<u4") for z in (x, y))
            common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            keep.append(common * (p + q) >= (len(a) + len(b)) * p)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def of(k: str, table: DataFrame, *columns: str) -> DataFrame:
        return table.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])

    near = pairs.join(of("u", sets.nodes, "n", "bits"), "u").join(of("v", sets.nodes, "n", "bits"), "v").where(may_be_similar("u", "v", similarity)).select("u", "v")
    near = materialize(near, "near")
    if near.isEmpty():
        return near
    wanted = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
    members = materialize(sets.members(wanted), "members")
    both = near.join(of("u", members, "members"), "u").join(of("v", members, "members"), "v")
    with arrow_rows(near.sparkSession, PAIRS_AT_ONCE):
        similar = materialize(both.select("u", "v", "members_u", "members_v").mapInArrow(in_slices(judge), "u long, v long"), "similar")
    for done in (near, members):
        discard(done)
    free_shuffles(near.sparkSession)
    return similar


def apart(rows: DataFrame) -> DataFrame:
    """Rows of the keys h whose nodes have several labels; ``minor``: the label isn't the most frequent one there.

    Of two nodes with different labels one at least is minor.
    """
    sizes = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy(F.col("h").alias("of_h")).agg(F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return rows.join(most, F.col("h") == F.col("of_h")).withColumn("minor", F.col("label") != F.col("most.label")).drop("of_h", "most", "labels")


def similar_links(shared: DataFrame, sets: Sets, likely: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (u, v) that join the nodes of all pairs of sets of at least ``similarity``; ``likely`` pairs are compared first.

    Two such sets have a common head, whatever the common order of shingles is,
    and in the places of the first one enough of both is left.  Where a head
    has several sets, each is compared with the least of them at first, and where
    these leave several components, with PIVOTS others.  Then all pairs
    of different components are compared, by their parities as they meet: a pair
    that these tell apart can't be similar and makes no row.  No candidate is capped.
    """
    row = F.struct("node", "n", "at")
    least = shared.groupBy("h").agg(F.min(row).alias("e")).select("h", "e.*")
    found = verified(likely.unionByName(head_pairs(least, shared.drop("m"), similarity)), sets, similarity)
    bits = sets.nodes.select(F.col("node").alias("of_node"), "bits")

    def crowds(links: DataFrame) -> DataFrame:
        labels = connected_components(links).withColumnRenamed("node", "labelled")
        open_rows = shared.where("m > 2").drop("m").join(labels, F.col("node") == F.col("labelled"), "left").withColumn("label", F.coalesce("label", "node")).drop("labelled")
        rows = materialize(apart(open_rows).join(bits, F.col("node") == F.col("of_node")).drop("of_node"), "apart")
        free_shuffles(rows.sparkSession)
        return rows

    others = (F.col("label_a") != F.col("label_b")) & may_be_similar("a", "b", similarity)
    several = crowds(found)
    drawn = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("draw"), F.struct("node", "n", "at", "label", "bits").alias("row"))) for i in range(PIVOTS)])
    pivots = several.groupBy("h").agg(drawn.alias("drawn")).select("h", F.explode("drawn").alias("e")).select("h", "e.row.*").distinct()
    more = verified(head_pairs(pivots, several, similarity, others), sets, similarity)
    discard(several)
    found = found.unionByName(more)
    several = crowds(found)
    rest = verified(head_pairs(several.where("minor"), several, similarity, others), sets, similarity)
    discard(several)
    return found.unionByName(rest)
