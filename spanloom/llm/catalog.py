"""Queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, line_dedup, neighbours, ngram_join, packing, prefix_trie, quality, repeats, scoring, sharding, toxicity, vectors, whitening,
)

Run = Callable[[SparkSession, str], DataFrame]


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Run] = {f.__name__: f for f in (
    vectors.op1_embedding_near_dedup, packing.op2_packing, bpe.op3_bpe, scoring.op4_lm_scoring, sharding.op5_sharding,
    toxicity.op6_toxicity, quality.op7_quality_rules, ngram_join.op8_ngram_join, line_dedup.op9_line_dedup,
    repeats.op10_suffix_array_dedup, prefix_trie.op11_conversation_prefix_trie,
    whitening.op12_embedding_whitening, neighbours.op13_nearest_neighbours,
)} | {"pipeline": _pipeline}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Components by the closure of the links; {links} yields (a, b) for every link in both directions.
_COMPONENTS = """
reach(id, other) AS (
  SELECT DISTINCT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

_OP1 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), {_COMPONENTS},
n AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN low ON low.id = vec_id"""

_OP8 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN low ON low.id = d.doc_id"""

_OP9 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, line, pos, top IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

# crc32 of the digits of a number, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: i::BIGINT)),
    lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

_OP11 = f"""
WITH convs AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce("text", '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
cuts AS (SELECT *, ({_CRC.format("conv_id")} % 4)::BIGINT AS h FROM convs),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS path
  FROM cuts c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
),
members AS (
  SELECT conv_id, len(path) AS size, d, path[1:d] AS prefix, d > 0 AS inner_node,
         CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)
),
nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, max(size) = d AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
  FROM members GROUP BY d, prefix
),
numbered AS (SELECT *, row_number() OVER () AS id FROM nodes),
spots AS (SELECT n.id, m.conv_id AS member FROM numbered n JOIN members m ON m.d = n.d AND m.prefix = n.prefix),
under AS (
  SELECT a.id, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE b.leaf) AS n_leaves, count(*) FILTER (WHERE b.d = a.d + 1) AS n_children
  FROM spots s JOIN numbered a ON a.id = s.id JOIN numbered b ON b.conv_id = s.member AND b.d >= a.d GROUP BY a.id
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, u.n_children, u.n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM numbered n JOIN under u ON u.id = n.id LEFT JOIN numbered p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]"""

# Every 400-byte string by its hash; runs of starts that repeat are cut out.
_OP10 = """
WITH raw AS (SELECT doc_id, encode(coalesce("text", '')) AS b FROM documents),
starts AS (
  SELECT doc_id, p, hash(b[p:p + 399]) AS h
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM raw WHERE octet_length(b) >= 400)
),
twice AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, 0) AS fresh FROM starts SEMI JOIN twice USING (h)),
runs AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY doc_id, run),
gone AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS firsts, list(z ORDER BY a) AS ends
  FROM spans GROUP BY doc_id
),
pieces AS (
  SELECT raw.doc_id, b, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
         list_transform(range(0, coalesce(n_spans, 0) + 1), lambda i:
           b[CASE WHEN i = 0 THEN 1 ELSE ends[i] END : CASE WHEN i = coalesce(n_spans, 0) THEN octet_length(b) ELSE firsts[i + 1] - 1 END]) AS kept
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id
)
SELECT doc_id, octet_length(b) AS n_bytes, n_removed, n_spans, sha256(list_reduce(kept, lambda x, y: x || y)) AS kept_sha256,
       octet_length(b) - n_removed AS kept_bytes, n_removed = 0 AS whole
FROM pieces"""

CHECKS: dict[str, str] = {
    "op1_embedding_near_dedup": _OP1, "op8_ngram_join": _OP8, "op9_line_dedup": _OP9, "op10_suffix_array_dedup": _OP10,
    "op11_conversation_prefix_trie": _OP11,
}
