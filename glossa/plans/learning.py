"""Queries of the store's single steps, its orders and settings, of messages and addresses, and of terms in texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import article, lex
from glossa.functions import constants as K
from glossa.functions import web as W
from glossa.operators import adapters as A
from glossa.operators import matching as M
from glossa.operators import phases as E
from glossa.operators import store as S
from glossa.operators.adapters import oracle
from glossa.operators.ranking import running
from glossa.plans.base import query
from glossa.sources.scratch import stored

_HOST = r"coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', ''), '')"
_STATUS = "CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 503 WHEN page_id % 10 = 2 THEN 304 WHEN page_id % 10 < 5 THEN NULL ELSE 200 END"
_CHECK = f"SELECT page_id, CASE WHEN e = 'timeout' THEN 'timeout' WHEN e IS NOT NULL THEN 'network-error' WHEN s >= 400 AND s < 500 THEN 'client-error' WHEN s >= 200 AND s < 300 THEN CASE WHEN h <> '' AND f <> h THEN 'redirect-domain-change' ELSE 'ok' END ELSE 'server-error' END AS category, f FROM (SELECT page_id, {_STATUS} AS s, CASE page_id % 10 WHEN 3 THEN 'timeout' WHEN 4 THEN 'refused' END AS e, {_HOST} AS h, CASE WHEN page_id % 10 = 5 THEN 'else.org' ELSE {_HOST} END AS f FROM pages)"


def _checks(spark, sf):
    """Recorded checks of the pages' addresses: responses, hosts reached and errors by page."""
    p, m = A.table(spark, sf, "pages"), F.col("page_id") % 10
    status = F.when(m == 0, 404).when(m == 1, 503).when(m == 2, 304).when(m < 5, F.lit(None).cast("int")).otherwise(200)
    host = lex.host(F.col("url"))
    final = F.when(m == 5, "else.org").otherwise(host)
    category = W.url_category(status, host, final, F.when(m == 3, "timeout").when(m == 4, "refused"))
    return p.select("page_id", category.alias("category"), final.alias("f"))


@query(f"SELECT page_id, category, CASE WHEN category = 'ok' AND f <> '' AND f <> 'example.com' THEN 'domain example.com mismatches host ' || f END AS note FROM ({_CHECK})")
def url_category(spark, sf):
    return _checks(spark, sf).select("page_id", "category", W.domain_note(F.col("category"), F.col("f"), F.lit("example.com")).alias("note"))


@query(f"SELECT c AS category, count(page_id) AS n FROM (SELECT unnest(['ok', 'redirect-domain-change', 'client-error', 'server-error', 'timeout', 'network-error']) AS c) LEFT JOIN ({_CHECK}) ON category = c GROUP BY c")
def url_category_counts(spark, sf):
    every = spark.createDataFrame([(c,) for c in W.CATEGORIES], "category string")
    n = _checks(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(n, "category", "left").fillna(0, ["n"])


_SENT = "SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN NULL WHEN conv_id % 10 = 0 THEN repeat(text, 600) ELSE text END AS text, CASE WHEN turn % 4 = 3 THEN conv_id % 6 END AS b FROM conversations"
_FAULT = "CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN 'role' WHEN text IS NOT NULL THEN CASE WHEN strlen(text) > 51200 THEN 'too long' END WHEN b IS NULL THEN 'no content' WHEN b = 1 THEN 'block without text' WHEN b = 2 THEN 'block too long' WHEN b = 3 THEN 'image malformed' WHEN b = 5 THEN 'unknown block' END"


def _messages(spark, sf):
    """Messages with texts, some very long, and every fourth one with blocks: a good one, and then one of six kinds."""
    c, b = A.table(spark, sf, "conversations"), F.col("conv_id") % 6
    block = lambda kind, text, source, data: F.struct(*(F.lit(x).cast("string").alias(n) if not hasattr(x, "alias") else x.alias(n) for x, n in zip((kind, text, source, data), ("type", "text", "source_type", "data"))))
    good = block("text", "fine", None, None)
    other = F.when(b == 1, block("text", None, None, None)).when(b == 2, block("text", F.repeat(F.lit("x"), 51_201), None, None)).when(b == 3, block("image", None, "url", "x")).when(b == 4, block("image", None, "base64", "x")).when(b == 5, block("video", None, None, None)).otherwise(good)
    inside = F.col("turn") % 4 == 3
    text = F.when(~inside, F.when(F.col("conv_id") % 10 == 0, F.repeat("text", 600)).otherwise(F.col("text")))
    return c.select("conv_id", "turn", W.message_fault(F.col("role"), text, F.when(inside, F.array(good, other))).alias("fault"))


@query(f"SELECT conv_id, turn, {_FAULT} AS fault FROM ({_SENT})")
def message_validation(spark, sf):
    return _messages(spark, sf)


@query(f"SELECT conv_id, CASE WHEN first IS NOT NULL THEN first WHEN t < 1 OR t > 32768 THEN 'max_tokens' END AS fault FROM (SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 32769 ELSE 4096 END AS t, arg_min(fault, (turn, coalesce(fault, ''))) FILTER (fault IS NOT NULL) AS first FROM (SELECT conv_id, turn, {_FAULT} AS fault FROM ({_SENT})) GROUP BY conv_id)")
def request_validation(spark, sf):
    tokens = F.when(F.col("conv_id") % 5 == 0, F.lit(None).cast("int")).when(F.col("conv_id") % 5 == 1, 0).when(F.col("conv_id") % 5 == 2, 32_769).otherwise(4096)
    each = _messages(spark, sf).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("fault", F.lit("")).alias("fault")))), lambda x: F.nullif(x["fault"], F.lit(""))).alias("faults"))
    return each.select("conv_id", W.request_fault(F.col("faults"), tokens).alias("fault"))


@query(oracle("contents", "SELECT k AS id, title FROM (SELECT doc_id * 2 AS k FROM documents) LEFT JOIN contents ON id = k"))
def content_by_id(spark, sf):
    asked = A.table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("id"))
    return S.looked_up(asked, A.contents(spark, sf), "id", "title")


@query(oracle("contents", "SELECT id, title FROM contents UNION ALL SELECT id + 1000000000, 'new' FROM contents WHERE id % 2 = 0"))
def insert_contents(spark, sf):
    c = A.contents(spark, sf).select("id", "title")
    return c.unionByName(c.where("id % 2 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("new").alias("title")))


@query(oracle("vocabulary", "SELECT id, CASE WHEN doc_id % 3 = 0 THEN upper(replace(original, 'ß', 'ss')) ELSE translation END AS translation, CASE WHEN doc_id % 3 = 0 AND pos % 2 = 0 THEN 5 ELSE leitner_box END AS leitner_box FROM vocabulary"))
def update_cards(spark, sf):
    v = A.vocabulary(spark, sf)
    new = v.where("doc_id % 3 = 0").select("id", F.upper(F.replace("original", F.lit("ß"), F.lit("ss"))).alias("translation"), F.when(F.col("pos") % 2 == 0, F.lit(5)).alias("leitner_box"))
    return S.updated(v, new, "id", ["translation", "leitner_box"]).select("id", "translation", "leitner_box")


@query(oracle("reviews", "SELECT DISTINCT ts::DATE AS day FROM reviews UNION SELECT DATE '2024-01-15' ORDER BY day"))
def review_days(spark, sf):
    days = A.reviews(spark, sf).select(F.to_date("ts").alias("day"))
    return S.with_days(days, spark.range(1).select(F.lit("2024-01-15").cast("date").alias("day")), "day")


@query(oracle("vocabulary", "SELECT id, row_number() OVER (PARTITION BY lang ORDER BY created_at DESC, id) AS place FROM vocabulary"))
def sort_date(spark, sf):
    v = A.vocabulary(spark, sf)
    return running(v, ["lang"], [-F.floor(F.col("created_at") / K.DAY_MS)], S.sort_columns("date"), "place").select("id", "place")


@query(oracle("vocabulary", "SELECT id, row_number() OVER (PARTITION BY lang ORDER BY leitner_box DESC, id) AS place FROM vocabulary"))
def sort_box_down(spark, sf):
    v = A.vocabulary(spark, sf)
    return running(v, ["lang"], [-F.col("leitner_box"), F.substring("original", 1, 2)], S.sort_columns("box", S.toggled(S.DIRECTIONS["box"])), "place").select("id", "place")


@query(oracle("features", "SELECT lang, tok, level, row_number() OVER (PARTITION BY lang ORDER BY round(eta, 6), tok) AS place FROM features"))
def difficulty_dump(spark, sf):
    eta = F.round("eta", 6)
    return running(A.features(A.tokens(spark, sf)), ["lang"], [F.floor(eta * 100)], [eta, F.col("tok")], "place").select("lang", "tok", "level", "place")


@query(None)
def practice_round(spark, sf):
    return S.practice_round(A.vocabulary(spark, sf), 42).select("id", "leitner_box", "last_reviewed")


_CODES = "['en', 'de', 'xx', NULL, 'fr', 'pl']"


@query(f"""SELECT user_id AS owner, n AS native, CASE WHEN l IN ('en', 'de', 'fr', 'pl') THEN l WHEN l IS NOT NULL THEN 'en' WHEN n <> 'en' THEN 'en' ELSE 'de' END AS learning, CASE user_id % 4 WHEN 0 THEN 'translation' WHEN 1 THEN 'original' ELSE 'either' END AS side, CASE WHEN user_id % 3 = 0 THEN 'B1' ELSE 'A2' END AS level, CASE WHEN user_id % 7 = 0 THEN 10 ELSE 20 END AS cards
FROM (SELECT user_id, CASE WHEN a IN ('en', 'de', 'fr', 'pl') THEN a ELSE CASE WHEN a IS NULL THEN 'fr' ELSE 'en' END END AS n, l FROM (SELECT DISTINCT user_id, {_CODES}[user_id % 6 + 1] AS a, {_CODES}[user_id // 6 % 6 + 1] AS l FROM events))""")
def settings_in_use(spark, sf):
    u, codes = F.col("user_id"), F.array(*map(F.lit, ("en", "de", "xx", None, "fr", "pl")))
    side = F.when(u % 4 == 0, "native-to-learning").when(u % 4 == 1, "learning-to-native").when(u % 4 == 2, "random")
    stored = A.table(spark, sf, "events").select("user_id").distinct().select(u.alias("owner"), F.get(codes, (u % 6).cast("int")).alias("native"), F.get(codes, (F.floor(u / 6) % 6).cast("int")).alias("learning"), side.alias("direction"), F.when(u % 3 == 0, "B1").alias("level"), F.when(u % 7 == 0, "10").alias("cards"))
    return S.settings_in_use(stored, device="fr")


@query("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' WHEN 'es' THEN 'Español' ELSE lang END AS name, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS english, CASE lang WHEN 'en' THEN '🇬🇧' WHEN 'de' THEN '🇩🇪' WHEN 'fr' THEN '🇫🇷' WHEN 'es' THEN '🇪🇸' ELSE '' END AS flag, count(*) AS n FROM documents GROUP BY lang")
def language_names(spark, sf):
    lang = F.col("lang")
    n = A.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", lex.language_name(lang).alias("name"), lex.language_name(lang, english=True).alias("english"), lex.language_flag(lang).alias("flag"), "n")


@query(r"SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:5], ' ') || '…' AS title FROM documents")
def image_titles(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", lex.image_title(F.col("text")).alias("title"))


@query("SELECT doc_id, lang || ':' || coalesce(nullif(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: '0123456789abcdefghijklmnopqrstuvwxyz'[((h // (36 ** i)::BIGINT) % 36)::INTEGER + 1]), ''), '0'), ''), '0') AS key FROM (SELECT doc_id, lang, list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 33 + b) % 4294967296) AS h FROM documents)")
def text_keys(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", E.text_key(F.col("text"), F.col("lang")).alias("key"))


@query(r"SELECT doc_id, len(s) AS segments, len(list_filter(s, lambda x: regexp_matches(x, '\p{L}'))) AS words, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS chars FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’]\p{L}+)*|[^\p{L}\p{N}]+') AS s FROM documents)")
def display_segments(spark, sf):
    s = M.segments(A.table(spark, sf, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if("is_word").alias("words"), F.sum(F.length("segment")).alias("chars"))


@query(oracle("vocabulary", r", runs AS (SELECT doc_id, w, (sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w))::INTEGER AS start FROM (SELECT doc_id, unnest(s) AS w, unnest(range(len(s))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS s FROM documents))) SELECT v.content_id, start, start + length(w) AS end, v.id AS vocab_id FROM runs JOIN vocabulary v ON v.content_id = runs.doc_id AND v.original = lower(runs.w) WHERE length(v.original) >= 2").replace("AS end,", 'AS "end",'))
def highlights(spark, sf):
    """Where a content's own words stand in it (each is one word, so none overlap)."""
    terms = A.vocabulary(spark, sf, levels=False).select("content_id", F.col("id").alias("vocab_id"), F.col("pos").alias("ordinal"), F.col("original").alias("term"))
    return M.highlights(A.contents(spark, sf).select("id", F.col("original_text").alias("text")), terms)


@query(r"SELECT doc_id, len(list_intersect(a, b)) / len(a) AS overlap FROM (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text[1:length(text) // 2]), '\s+')) AS a, list_distinct(regexp_split_to_array(lower(text[length(text) // 2 + 1:]), '\s+')) AS b FROM documents)")
def half_overlap(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    return A.table(spark, sf, "documents").select("doc_id", article.word_overlap(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))).alias("overlap"))


@query(oracle("tokens", "SELECT doc_id, pos::INTEGER AS ordinal, tok AS item FROM tokens"))
def chunks_in_order(spark, sf):
    return E.in_order(A.word_parts(spark, sf, 100).withColumnRenamed("w", "items"), ["doc_id"], "part", "items")


_TERMS = "SELECT content_id AS doc_id, lang, original, word_type AS type, row_number() OVER (PARTITION BY content_id ORDER BY pos) - 1 AS ordinal, pos, level FROM vocabulary"
_SENT_TERMS = f""", natives AS (SELECT unnest(['de', 'en']) AS native), terms AS ({_TERMS}), got AS (SELECT *, ordinal // 50 AS batch, doc_id % 3 = 0 AND pos % 7 = 0 AS gone FROM terms, natives),
sizes AS (SELECT doc_id, native, batch, bool_or(gone) AS short FROM got GROUP BY ALL), made AS (SELECT got.*, CASE WHEN gone THEN '' WHEN short AND ordinal % 5 = 0 THEN '' ELSE original || '-' || native END AS translation FROM got JOIN sizes USING (doc_id, native, batch))
"""


def _terms(spark, sf):
    """(terms of each document, recorded translations into two languages: of some documents answers are missing, some lack their original)."""
    v = A.vocabulary(spark, sf).select(F.col("content_id").alias("doc_id"), "lang", "original", F.col("word_type").alias("type"), "pos", "level")
    # A document's terms are few enough to be ranked together; written, for phases and answers read them several times.
    terms = stored(v.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long") - 1), "terms")
    each = E.batched(terms.select("doc_id", "ordinal", "original", "pos", F.explode(F.array(F.lit("de"), F.lit("en"))).alias("native")))
    given = each.where("not (doc_id % 3 = 0 and pos % 7 = 0)")
    place = F.row_number().over(_by("doc_id", "native", "batch")) - 1
    return terms, given.select("doc_id", "native", "batch", place.alias("at"), F.when(F.col("ordinal") % 5 != 0, F.col("original")).alias("original"), F.concat("original", F.lit("-"), "native").alias("translation"))


def _by(*group: str):
    return Window.partitionBy(*group).orderBy("at")


@query(oracle("vocabulary", "").rstrip() + _SENT_TERMS + "SELECT doc_id, native, ordinal, original, translation FROM made")
def translate_terms(spark, sf):
    terms, answers = _terms(spark, sf)
    each = terms.join(answers.select("doc_id", "native").distinct().unionAll(terms.select("doc_id", F.explode(F.array(F.lit("de"), F.lit("en"))).alias("native"))).distinct(), "doc_id")
    return E.translated(each, answers, ["doc_id", "native"]).select("doc_id", "native", "ordinal", "original", "translation")


@query(oracle("vocabulary", "").rstrip() + _SENT_TERMS + "SELECT doc_id, native, ordinal, original, CASE WHEN native = 'de' AND type = 'noun' AND translation <> '' THEN upper(replace(translation, 'ß', 'ss')[1]) || replace(translation, 'ß', 'ss')[2:] ELSE replace(translation, 'ß', 'ss') END AS translation, type, CASE WHEN length(original) % 2 = 0 THEN level ELSE 'B1' END AS level FROM made WHERE EXISTS (SELECT 1 FROM got g WHERE g.doc_id = made.doc_id AND NOT g.gone)")
def two_phase(spark, sf):
    terms, answers = _terms(spark, sf)
    cards = terms.where(F.length("original") % 2 == 0).select("lang", "original", "level")
    plain = lambda df, c: df.withColumn(c, F.replace(c, F.lit("ß"), F.lit("ss")))
    return E.two_phase(terms.select("doc_id", "lang", "ordinal", "original", "type"), plain(answers, "translation"), cards)


@query(oracle("vocabulary", "SELECT id, original AS original, CASE pos % 5 WHEN 0 THEN '' WHEN 4 THEN '' ELSE 't' END AS translation, CASE pos % 5 WHEN 1 THEN 'A2' ELSE 'B1' END AS level, CASE pos % 5 WHEN 2 THEN 'noun' ELSE 'other' END AS type FROM vocabulary"))
def object_answers(spark, sf):
    """Answers for single words: without an object, whole, without fields, in prose, cut off."""
    m, o = F.col("pos") % 5, F.col("original")
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    answer = F.when(m == 0, "none").when(m == 1, say('{"original": "', o, '", "translation": "t", "level": "A2"}')).when(m == 2, '{"translation": "t", "type": "noun"}').when(m == 3, say('Here: {"original": "', o, '",\n "translation": "t"} so')).otherwise('{"translation": "t')
    got = A.vocabulary(spark, sf).select("id", E.object_of(answer, o).alias("a"))
    return got.select("id", "a.*")


@query(oracle("tokens", "SELECT doc_id, tok AS word, CASE WHEN length(tok) <= 20 THEN floor((length(tok) + 0.25) * 10 + 0.5) / 10 END AS rating, CASE length(tok) % 4 WHEN 1 THEN 'A1' WHEN 2 THEN 'C2' END AS level FROM (SELECT DISTINCT doc_id, tok FROM tokens) WHERE length(tok) < 20 OR length(tok) % 4 IN (1, 2)"))
def rating_maps(spark, sf):
    """Ratings and levels of a document's words, as answers give them: objects in prose, some values out of range."""
    w = A.word_parts(spark, sf, 1 << 30).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("w")))).alias("w"))
    of = lambda value: F.concat(F.lit("Sure! "), F.to_json(F.map_from_entries(F.transform("w", lambda t: F.struct(t.alias("tok"), value(t).alias("v"))))), F.lit(" Done."))
    level = lambda t: F.element_at(F.array(F.lit("high"), F.lit(" a1"), F.lit("C2"), F.lit("D1")), (F.length(t) % 4 + 1).cast("int"))
    a = w.select("doc_id", of(lambda t: (F.length(t) + 0.25).cast("string")).alias("r"), of(level).alias("l"))
    return a.select("doc_id", F.explode_outer(E.rated(F.col("r"), F.col("l"))).alias("word", "v")).where("word is not null").select("doc_id", "word", "v.rating", "v.level")
