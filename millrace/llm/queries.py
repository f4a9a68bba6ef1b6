"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.ann import nearest
from millrace.llm.chat import format_chats
from millrace.llm.common import table
from millrace.llm.cross_align import align, with_link_counts
from millrace.llm.decontaminate import contamination
from millrace.llm.mixing import CLOSING, mix
from millrace.llm.packing import pack
from millrace.llm.pii import find_pii, fit_pii
from millrace.llm.quality import score_quality
from millrace.llm.simhash import near_duplicates
from millrace.llm.substring_dedup import remove_repeated
from millrace.llm.token_counts import token_counts
from millrace.llm.topk import exact_top_k
from millrace.llm.turn_repair import damage, digest, repair

def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece
  FROM conversations
), chats AS (
  SELECT conv_id, count(*) AS n_turns, list(piece ORDER BY nth) AS pieces, string_agg(piece, '' ORDER BY nth) AS chat FROM turns GROUP BY conv_id
), firsts AS (
  SELECT min(conv_id) AS conv_id, n_turns, pieces, chat FROM chats GROUP BY n_turns, pieces, chat
)
SELECT conv_id, n_turns, chat FROM firsts a
WHERE NOT EXISTS (SELECT 1 FROM chats b WHERE b.n_turns > a.n_turns AND b.pieces[1] = a.pieces[1] AND b.pieces[1:a.n_turns] = a.pieces)
"""


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Folder of the public vocabulary files; a name in it is read by each worker.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP1_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS s FROM words
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s+12], ' ') AS gram FROM starts
), firsts AS (
  SELECT gram, min(doc_id) AS first_doc FROM windows GROUP BY gram
), hits AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (
    SELECT doc_id, unnest(range(s, s + 13)) AS p FROM windows JOIN firsts USING (gram) WHERE first_doc < doc_id
  ) GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(gone, []) AS gone,
    list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])) AS k
  FROM words LEFT JOIN hits USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(k, lambda x: x[1]), ' ')) AS kept_sha256
FROM kept
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _closing_sql(k: int) -> str:
    """One closing round: the document left whose size comes nearest to the words still open."""
    return f"""
), o{k} AS (
  SELECT source AS o_source, any_value(open_words) - sum(CASE WHEN chosen THEN size ELSE 0 END) AS open FROM c{k} WHERE p > 0 GROUP BY 1
), n{k} AS (
  SELECT doc_id AS n_doc, source AS n_source FROM c{k} JOIN o{k} ON source IS NOT DISTINCT FROM o_source WHERE p > 0 AND NOT chosen AND abs(size - open) < abs(open)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - open), pareto, doc_id) = 1
), c{k + 1} AS (
  SELECT c{k}.* REPLACE (chosen OR n_doc IS NOT NULL AS chosen) FROM c{k} LEFT JOIN n{k} ON doc_id = n_doc AND source IS NOT DISTINCT FROM n_source"""


OP7_SQL = (
    r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(md5(text), '') AS m FROM documents
), b AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, m)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM base
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY 1
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), r AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0)) AS level FROM r
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS final FROM l
), t AS (
  SELECT source, source_size, final IS NULL OR weight * final >= cap AS capped, CASE WHEN final IS NULL OR weight * final >= cap THEN cap ELSE weight * final END AS target FROM f
), h AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0::DOUBLE WHEN capped THEN 3::DOUBLE ELSE target / source_size END AS share FROM t
), q AS (
  SELECT source AS q_source, source_size, target, floor(share)::BIGINT AS certain, share - floor(share) AS p, target - floor(share) * source_size AS open_words FROM h
), d AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS pareto FROM b JOIN q ON source IS NOT DISTINCT FROM q_source
), c0 AS (
  SELECT *, p > 0 AND sum(size) OVER (PARTITION BY source ORDER BY pareto, doc_id, m ROWS UNBOUNDED PRECEDING) <= open_words AS chosen FROM d"""
    + "".join(map(_closing_sql, range(CLOSING)))
    + f"""
)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((certain + chosen::BIGINT) * size)::BIGINT AS taken, source, certain + chosen::BIGINT AS copies FROM c{CLOSING}
"""
)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit_pii(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _plain_words_sql(of: str) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return rf"regexp_extract_all(translate(coalesce({of}, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_plain_words_sql("text")} AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_plain_words_sql("text")} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s+n-1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))
), windows AS (
  SELECT DISTINCT n, gram FROM item_windows
), doc_windows AS (
  SELECT r, n, s, array_to_string(w[s:s+n-1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT r, n, s, gram FROM doc_windows JOIN windows USING (n, gram)
), hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT r, item FROM hits JOIN item_windows USING (n, gram)) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op12_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    digest_of_groups = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return with_link_counts(aligned, digest_of_groups).withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair(damage(table(spark, sf_dir, "conversations")))
    return repaired.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest(F.col("repaired")).alias("repaired_sha256"))


def _then_sql(state: str, cost: str, edit: str, line: str = "''") -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', o := {state}.o || {line})"


def _op13_sql() -> str:
    """A recursive query, turn by turn: the cheapest edits behind nothing (p0), a system (p1), a user (p2) and an assistant turn (p3), with their text."""
    far = "struct_pack(c := 1000000000000::BIGINT, a := '', o := '')"
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    i2 = f"least(p2, {', '.join(_then_sql(p, '2', 'I', user) for p in ('p0', 'p1', 'p3'))})"
    i3 = f"least(p3, {_then_sql('p2', '2', 'I', assistant)}, {', '.join(_then_sql(p, '4', 'II', user + ' || ' + assistant) for p in ('p0', 'p1'))})"
    keep = lambda p: _then_sql(p, "late", "K", "role || ':' || text || chr(10)")
    rerole = lambda p, role: _then_sql(p, "late + 2", "R", f"'{role}:' || text || chr(10)")
    stays = lambda *ways: ", ".join(f"CASE WHEN stays AND {when} THEN {way} ELSE {far} END" for when, way in ways)
    return rf"""
WITH RECURSIVE crc_steps AS (
  SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_steps
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), flagged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nth) || left(role, 1) AS pair
  FROM placed
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM flagged GROUP BY conv_id
), turns AS (
  SELECT *, left(role, 1) AS i, fault IN ('', 'truncated') AS stays, (fault = 'truncated')::BIGINT AS late FROM flagged
), steps AS (
  SELECT conv_id, 0::BIGINT AS done, struct_pack(c := 0::BIGINT, a := '', o := '') AS p0, {far} AS p1, {far} AS p2, {far} AS p3 FROM sums
  UNION ALL
  SELECT conv_id, nth, {_then_sql("p0", "3", "D")}, least({_then_sql("p1", "3", "D")}, {stays(("i = 's'", keep("p0")))}),
    least({_then_sql("i2", "3", "D")}, {stays(*[x for p in ("p0", "p1", "i3") for x in (("i = 'u'", keep(p)), ("i <> 'u'", rerole(p, "user")))])}),
    least({_then_sql("i3", "3", "D")}, {stays(("i = 'a'", keep("i2")), ("i <> 'a'", rerole("i2", "assistant")))})
  FROM (
    SELECT s.*, t.nth, t.role, t.text, t.i, t.stays, t.late, {i2} AS i2, {i3} AS i3
    FROM steps s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.nth = s.done + 1
  )
), ended AS (
  SELECT s.conv_id, least(p0, {i3}) AS best FROM steps s JOIN sums ON s.conv_id IS NOT DISTINCT FROM sums.conv_id AND done = n
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(regexp_replace(best.o, '
$', ''), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN ended ON c.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_hilbert_neighbours": op4_hilbert_neighbours,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_pii": op10_pii,
    "op11_decontamination": op11_decontamination,
    "op12_cross_alignment": op12_cross_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {"op1_exact_topk": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op7_mix_sources": OP7_SQL, "op11_decontamination": OP11_SQL, "op13_conversation_repair": _op13_sql()}
