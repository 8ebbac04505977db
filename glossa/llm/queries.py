"""Registered queries of this subpackage: opN_<name> applies operator N with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import Row

from glossa.llm import bpe, chat, counts, covertree, decontaminate, jaccard, lexical, pii, quality, shards, topk, toxicity, whiten
from glossa.llm.common import spread, stored


def table(spark, sf_dir, name):
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.clusters(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_top_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return topk.top_k(v, v.where("vec_id % 50 = 0"), k=5)


def op10_sharding(spark, sf_dir):
    return shards.sharded(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.scanned(table(spark, sf_dir, "documents")).drop("redacted")


def op5_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([Row(conv_id=-1, turn=i, role=r, text="</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], turns.schema)
    return chat.digests(chat.formatted(turns.unionAll(planted)))


def op8_token_counts(spark, sf_dir):
    forest = stored(counts.trees(table(spark, sf_dir, "documents")), "trees", "zstd")
    return counts.updated(counts.sample_edits(forest))


def op3_toxicity(spark, sf_dir):
    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark, sf_dir):
    return quality.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_cover_tree(spark, sf_dir):
    return covertree.clusters(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_exact_top_k": op2_exact_top_k, "op3_toxicity": op3_toxicity, "op4_pii": op4_pii, "op5_chat_formatting": op5_chat_formatting, "op6_quality": op6_quality, "op7_decontamination": op7_decontamination, "op8_token_counts": op8_token_counts, "op9_byte_bpe": op9_byte_bpe, "op10_sharding": op10_sharding, "op11_cover_tree": op11_cover_tree, "op12_lexical_search": op12_lexical_search, "op13_whitening": op13_whitening}
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r.y) FROM r WHERE r.x = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op2_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 17 + length(role || text) + length(role || text) - length(replace(role || text, '\', ''))
  + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""".replace("\\\\", "\\"),
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
occ AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM d),
cnt AS (SELECT t, count(*) AS n FROM p GROUP BY t),
q AS (SELECT item_id, t, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), encode(t)) AS r FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM b) LEFT JOIN cnt USING (t)),
q4 AS (SELECT * FROM q WHERE r <= 4), rare AS (SELECT item_id, t, (SELECT count(*) FROM q4 x WHERE x.item_id = q4.item_id) AS wanted FROM q4 WHERE r = 1 AND n > 0),
near AS (SELECT DISTINCT item_id, doc_id FROM (SELECT rare.item_id, a.doc_id, a.i, wanted, count(DISTINCT q4.t) AS had FROM rare JOIN p a ON a.t = rare.t JOIN q4 ON q4.item_id = rare.item_id
  JOIN p c ON c.t = q4.t AND c.doc_id = a.doc_id AND abs(c.i - a.i) <= 10 GROUP BY ALL) WHERE had = wanted),
ns AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id LEFT JOIN ns ON ns.doc_id = d.doc_id""",
    "op11_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, doc_id, unnest(w) AS t, len(w) AS n FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM u GROUP BY ALL),
g AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY t, nd),
s AS (SELECT item_id, r, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM b JOIN f ON f.t = b.t JOIN w ON w.t = b.t, g GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
}
