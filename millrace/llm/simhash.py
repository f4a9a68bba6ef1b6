"""SimHash near-duplicates: 64-bit fingerprints, multi-index hashing, connected components.

With a similarity asked for, fingerprints are those of shingle sets, the pairs
that multi-index hashing finds are checked on the sets, and the pairs beyond
its Hamming balls come from a prefix-filtered join (millrace.llm.jaccard).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, free_shuffles, in_slices, materialize
from millrace.llm.components import connected_components
from millrace.llm.jaccard import SIMILARITY, Sets, majority, shared_heads, shingle_sets, similar_links

SEED = 42
SHINGLE = 3
#: Words of a shingle where a similarity is asked for.
WIDE_SHINGLE = 5
#: Bits that the multi-index hashing here can bridge.
MOST_BITS = 3
#: Fingerprints that more than one in so many rows has are joined apart.
HOT_SHARE = 200


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (repeats included); 0 for a text without words.

    bytes.lower() maps A-Z alone and bytes.split() cuts at the six ASCII white
    spaces, which is what the fingerprint is defined on.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def prints_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(in_slices(prints_of), "doc_id long, fp long")


def _cell_links(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among one cell's fingerprints, found in blocks of rows."""
    prints = np.unique(cell["fp"].to_numpy(dtype=np.int64))
    bits = prints.view(np.uint64)
    root = np.arange(len(prints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for at in range(0, len(bits), 256):
        near = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, at:]) <= key[-1]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = find(at + i), find(at + j)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((prints[at + i], prints[at + j]))
    return pd.DataFrame(forest, columns=["u", "v"], dtype=np.int64)


def near_links(prints: DataFrame, max_bits: int = MOST_BITS, bucket_limit: int = 256) -> DataFrame:
    """Links (u, v) that join all distinct ``fp`` within ``max_bits`` (at most MOST_BITS) differing bits.

    Multi-index hashing with two 32-bit segments: of two linked fingerprints one
    segment differs in at most one bit.  Each fingerprint enters the table of
    either segment once and probes the ball of radius one around its segment;
    of a pair that differs in one bit the side with a 0 there probes, so half
    the ball is enough.  Matches are verified on all 64 bits.

    A bucket of more than ``bucket_limit`` table entries isn't joined: there the
    other segment, which differs in at most three bits, is split once more into
    16-bit halves (one of which differs in at most one bit), and each such cell
    is searched in blocks and gives a spanning forest of its links, not all of
    them.  Nothing is capped or dropped.
    """
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"two segments with balls of radius one find at most {MOST_BITS} differing bits, not {max_bits}")
    halves = F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(0xFFFFFFFF).alias("key")) for s in (0, 1)])
    entries = prints.select("fp").distinct().select("fp", F.explode(halves).alias("e")).select("fp", "e.seg", "e.key")
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)), lambda m: F.col("key").bitwiseAND(m) == 0)
    probes = entries.select("seg", F.explode(flips).alias("mask"), "key", "fp").select("seg", (F.col("key") + F.col("mask")).alias("key"), "fp")
    crowded = materialize(entries.groupBy("seg", "key").count().where(F.col("count") > bucket_limit).select("seg", "key"), "crowded")
    far = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    left, right = entries.withColumnRenamed("fp", "u"), entries.withColumnRenamed("fp", "v")
    seek = left.unionByName(probes.withColumnRenamed("fp", "u"))
    any_crowded = crowded.limit(1).count() > 0
    if any_crowded:
        right = right.join(crowded, ["seg", "key"], "left_anti")
    links = seek.join(right, ["seg", "key"]).where((F.col("u") != F.col("v")) & far).select("u", "v")
    if any_crowded:
        members = entries.unionByName(probes).join(crowded, ["seg", "key"], "left_semi")
        other = F.shiftrightunsigned(F.col("fp"), 32).bitwiseAND(0xFFFFFFFF)
        other = F.when(F.col("seg") == 0, other).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
        masks = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.call_function("shiftleft", F.lit(1), b)))
        cells = (
            members.select("seg", "key", "fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.shiftrightunsigned(other, 16 * h).bitwiseAND(0xFFFF).alias("part")) for h in (0, 1)])).alias("p"))
            .select("seg", "key", "fp", "p.half", "p.part", F.explode(masks).alias("mask"))
            .select("seg", "key", "half", F.col("part").bitwiseXOR(F.col("mask").cast("long")).alias("part"), F.lit(max_bits).alias("bits"), "fp")
        )
        links = links.union(cells.groupBy("seg", "key", "half", "part", "bits").applyInPandas(_cell_links, "u long, v long"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Documents of equal fingerprint are one node from the start, so a group of
    copies, however large, costs one node.  Null or wordless texts have
    fingerprint zero and link like others.  Null ids have a row but name no
    component.  Empty table: empty result.  Extra columns: ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    labels = connected_components(near_links(prints, max_bits))
    linked = labels.join(classes, F.col("node") == F.col("fp")).select("label", "fp", "first")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = linked.join(smallest, "label").select(F.col("fp").alias("linked_fp"), "component_id")
    of_print = classes.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component_id", "first").alias("component_id"), "n"
    )
    of_print = materialize(of_print, "components")
    # fingerprints of over a 200th of all rows are fewer than 200; their rows stay where they are, and the others are dealt
    hot = F.col("n") * HOT_SHARE > prints.count()
    few = F.broadcast(of_print.where(hot).select(F.col("class_fp").alias("hot_fp"), F.col("component_id").alias("hot_component")))
    marked = prints.join(few, F.col("fp") == F.col("hot_fp"), "left")
    dealt = marked.where("hot_fp is null").join(of_print.where(~hot), F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")
    stay = marked.where("hot_fp is not null").select("doc_id", "fp", F.col("hot_component").alias("component_id"))
    return dealt.unionByName(stay).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every row: documents are linked by a Jaccard similarity of word shingles.

    Documents of equal shingle sets are one node from the start.  Fingerprints
    of the sets meet by multi-index hashing; of these links those of enough
    similarity stand, and the others' sets go on to the prefix-filtered join,
    since similar texts mostly lie further apart than its Hamming balls reach.
    ``docs`` is read several times and must give the same rows each time: only
    the sets of pairs that may be similar are made again, and none are kept.

    Null and wordless texts are all alike.  Null ids have a row but name no
    component.  Empty table: empty result.  Extra columns: ignored.
    """
    sets = materialize(shingle_sets(docs, id_col, text_col, shingle, similarity), "shingle-sets")
    rows = materialize(sets.select("doc_id", "node", "fp"), "shingle-nodes")
    nodes = materialize(sets.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "set-bits")
    shared = materialize(shared_heads(sets), "shared")
    discard(sets)
    free_shuffles(docs.sparkSession)
    of_print = rows.groupBy("fp").agg(F.min("node").alias("node"))
    prints = materialize(near_links(rows), "near-prints")
    links = prints.join(of_print.withColumnsRenamed({"fp": "u", "node": "un"}), "u").join(of_print.withColumnsRenamed({"fp": "v", "node": "vn"}), "v").select("un", "vn")
    equal = rows.select("fp", F.col("node").alias("un")).join(of_print.withColumnRenamed("node", "vn"), "fp").where("un <> vn").select("un", "vn")
    links = materialize(links.unionByName(equal).select(F.least("un", "vn").alias("u"), F.greatest("un", "vn").alias("v")).distinct(), "near-sets")
    labels = connected_components(similar_links(shared, Sets(nodes, docs, id_col, text_col, shingle), links, similarity)).withColumnRenamed("node", "labelled")
    classes = nodes.join(labels, F.col("node") == F.col("labelled"), "left").select("node", F.coalesce("label", "node").alias("label"), "first")
    classes = materialize(classes, "classes")
    for done in (shared, nodes, prints, links):
        discard(done)
    free_shuffles(docs.sparkSession)
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = classes.join(least, "label").select(F.col("node").alias("of_node"), "component_id")
    return rows.join(of_node, F.col("node") == F.col("of_node")).select("doc_id", "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MOST_BITS, shingle: int = SHINGLE, similarity: tuple[int, int] | None = None
) -> DataFrame:
    """The documents whose id is the smallest of its component; the columns of ``docs``.

    Components are those of fingerprints within ``max_bits`` or, where a
    ``similarity`` is given, of shingle sets that similar (similar_classes).

    Rows that share an id stay or go together, so of an id with different texts
    all stay if one of them is its component's first; rows with a null id stay.
    Null and wordless texts are alike.  Empty table: empty result.
    """
    found = similar_classes(docs, id_col, text_col, shingle, similarity) if similarity else near_duplicates(docs, id_col, text_col, max_bits, shingle)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
