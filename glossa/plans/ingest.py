"""Queries of page and scan cleaning, gates, truncation and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import article as R
from glossa.functions import constants as K
from glossa.functions import lex
from glossa.functions import text as X
from glossa.operators import adapters as A
from glossa.operators import extract as E
from glossa.operators import ingest as I
from glossa.operators import mainpart as M
from glossa.plans.base import query

_NOISE = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _t in X.NOISE_TAGS:
    _NOISE = rf"regexp_replace(regexp_replace({_NOISE}, '<{_t}\b[^>]*>.*?</{_t}>', '', 'gsi'), '<{_t}\b[^>]*/?>', '', 'gsi')"
_PLAIN = rf"trim(regexp_replace(regexp_replace({_NOISE}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_NOISE} AS html FROM pages")
def strip_tags(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.strip_noise(F.col("html")).alias("html"))


@query(f"SELECT page_id, length({_PLAIN}) AS n_chars, length({_PLAIN}) >= 200 AS dense FROM pages")
def text_density(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select("page_id", F.length(X.plain(F.col("html"))).cast("long").alias("n_chars"), X.dense_enough(F.col("html")).alias("dense"))


@query(None)
def article_clean(spark, sf):
    return I.article(A.spread(A.table(spark, sf, "pages"))).select("page_id", "article")


_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _post(table: str, key: str) -> str:
    """The clean-up of articles over column text, a step at a time."""
    same = lambda n: " AND ".join([f"len(w) % {n} = 0", *(f"w[1:len(w) // {n}] = w[len(w) // {n} * {i} + 1:len(w) // {n} * {i + 1}]" for i in range(1, n))])
    once = rf"list_transform(string_split(text, chr(10)), lambda line: list_transform([regexp_split_to_array({_TRIM('line')}, '\s+')], lambda w: CASE WHEN {same(3)} THEN array_to_string(w[1:len(w) // 3], ' ') WHEN {same(2)} THEN array_to_string(w[1:len(w) // 2], ' ') ELSE line END)[1])"
    words = lambda x: rf"list_distinct(regexp_split_to_array(lower({x}), '\s+'))"
    steps = [
        rf"SELECT {key}, regexp_replace(regexp_replace(regexp_replace({_TRIM('text')}, '\n{{3,}}', e'\n\n', 'g'), '[^\S\n]+', ' ', 'g'), '(?m)^ | $', '', 'g') AS text FROM {table}",
        rf"SELECT {key}, regexp_replace(array_to_string(p[coalesce(nullif(list_position(list_transform(p, lambda x: x = '' OR length(x) >= 30 OR regexp_matches(x, '[.!?:,;]')), true), 0), len(p)):], e'\n\n'), '\A\n+', '') AS text FROM (SELECT {key}, regexp_split_to_array(text, '\n+') AS p FROM s0)",
        *(rf"SELECT {key}, regexp_replace(text, '{p}', '') AS text FROM s{i}" for i, p in enumerate((r"\A(?:\d{1,2}:\d{2}\n+)+", R.NAMED_DATE.replace("(?iu)", "(?i)"), R.ISO_DATE, R.NUMBER_DATE.replace("(?iu)", "(?i)"), R.CALL.replace("(?iu)", "(?i)"), R.PRINTED.replace("(?iu)", "(?i)")), 1)),
        rf"SELECT {key}, array_to_string({once}, chr(10)) AS text FROM s7",
        rf"SELECT {key}, CASE WHEN len(p) >= 2 AND length(p[1]) > 20 AND (starts_with(p[2], p[1]) OR len(list_intersect({words('p[1]')}, {words('p[2]')})) / len({words('p[1]')}) > 0.8) THEN array_to_string(p[2:], e'\n\n') ELSE text END AS text FROM (SELECT {key}, text, regexp_split_to_array(text, '\n\n+') AS p FROM s8)",
    ]
    return "WITH " + ",\n".join(f"s{i} AS ({s})" for i, s in enumerate(steps)) + f"\nSELECT {key}, " + _TRIM(r"regexp_replace(text, '\n{3,}', e'\n\n', 'g')") + " AS text FROM s9"


@query(_post("documents", "doc_id"))
def article_post(spark, sf):
    return R.cleaned(A.spread(A.table(spark, sf, "documents").select("doc_id", "text")), "text")


_ANSWER = r"(CASE WHEN doc_id % 3 = 0 THEN 'TITLE: ' || regexp_replace(text[1:20], '[-\s]+', ' ', 'g') || e'\n---\n' ELSE '' END) || CASE WHEN doc_id % 7 = 0 THEN 'NO_ARTICLE_CONTENT' ELSE text END"
_HEAD = _TRIM(rf"regexp_replace({_TRIM("answer[1:strpos(answer, '---') - 1]")}, '(?i)^TITLE:\s*', '')")


@query(rf"""SELECT doc_id, CASE WHEN cut > 0 AND head <> '' THEN head ELSE 'https://a.b/' || doc_id END AS title, NOT contains(answer, 'NO_ARTICLE_CONTENT') AND length({_TRIM("CASE WHEN cut > 0 THEN answer[cut + 3:] ELSE answer END")}) >= 50 AS ok
FROM (SELECT doc_id, answer, strpos(answer, '---') AS cut, {_HEAD} AS head FROM (SELECT doc_id, {_ANSWER} AS answer FROM documents))""")
def article_answers(spark, sf):
    """Answers about pages: some with a title line, some without, some that say that there is no article."""
    d = A.table(spark, sf, "documents")
    m, url = F.col("doc_id"), F.concat(F.lit("https://a.b/"), F.col("doc_id").cast("string"))
    head = F.when(m % 3 == 0, F.concat(F.lit("TITLE: "), F.regexp_replace(F.substring("text", 1, 20), r"[-\s]+", " "), F.lit("\n---\n"))).otherwise("")
    answer = F.concat(head, F.when(m % 7 == 0, "NO_ARTICLE_CONTENT").otherwise(F.col("text")))
    p = d.select("doc_id", R.parsed_answer(answer, url).alias("p"))
    return p.select("doc_id", "p.title", "p.ok")


@query("SELECT doc_id, length(text) < 100 OR len(regexp_extract_all(text, '[{}();:#.]')) / length(text) > 0.05 AS code FROM documents")
def code_like(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.code_like(F.col("text")).alias("code"))


_T = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT doc_id, CASE WHEN length(t) < 20 THEN 'short' WHEN len(w) < 3 THEN 'few words' WHEN list_max(list_transform(w, lambda x: length(x))) < 5 THEN 'fragments'
 WHEN len(regexp_extract_all(t, '\p{{L}}')) / length(regexp_replace(t, '\s', '', 'g')) < 0.4 THEN 'symbols' WHEN list_sum(list_transform(w, lambda x: length(x))) / len(w) < 2.5 AND len(w) > 5 THEN 'garbled' END AS reason
FROM (SELECT doc_id, {_T} AS t, list_filter(list_transform(regexp_split_to_array({_T}, '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '') AS w FROM documents)""")
def ocr_valid(spark, sf):
    return A.spread(A.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.ocr_reason(F.col("text")).alias("reason"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) <> 1 AND (s = '' OR NOT regexp_matches(s, '^[\d\p{P}\p{S}\s]+$'))), chr(10)), '\n{3,}', e'\n\n', 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def ocr_lines(spark, sf):
    return A.spread(A.table(spark, sf, "documents")).select("doc_id", X.clean_lines(F.col("text")).alias("text"))


#: Runs of line ends are put between marks, so what is left of them are single ones.
_RUNS = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(\n{2,})', chr(1) || '\1' || chr(2), 'g')"
_SINGLE = rf"regexp_replace(regexp_replace({_RUNS}, '^\n', ' '), '([^\n\x01])\n', '\1 ', 'g')"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_SINGLE}, '[\x01\x02]', '', 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def join_wraps(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", X.join_wraps(F.col("text")).alias("text"))


def _cut(limit: int) -> str:
    return rf"""SELECT doc_id, CASE WHEN length(text) <= {limit} THEN text WHEN e > 0 THEN regexp_replace(text[1:e + CASE WHEN regexp_matches(text[e + 1], '^["''»)\]]$') THEN 1 ELSE 0 END], '\s+$', '')
 WHEN regexp_matches(text[{limit + 1}:], '\s') THEN regexp_replace(text[1:{limit} + length(regexp_extract(text[{limit + 1}:], '^(\S*)', 1))], '\s+$', '') ELSE text END AS text
FROM (SELECT doc_id, text, length(regexp_extract(text[1:{limit}], '^(.*[.!?…])', 1, 's')) AS e FROM documents)"""


@query(_cut(K.BASIC_LIMIT))
def truncate_sentence(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.truncated(F.col("text"), K.BASIC_LIMIT).alias("text"))


@query(_cut(K.PRO_LIMIT))
def truncate_pro(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.truncated(F.col("text"), K.PRO_LIMIT).alias("text"))


@query(None)
def chunk_text(spark, sf):
    return A.spread(A.table(spark, sf, "documents")).select("doc_id", F.posexplode(I.chunk(2500)("text")).alias("ordinal", "chunk"))


@query(None)
def garbage_lines(spark, sf):
    d = A.spread(A.table(spark, sf, "documents"))
    known = A.word_counts(A.tokens(spark, sf)).where("c >= 3").select(F.col("tok").alias("word"))
    return I.garbage_free(d, known)


@query(None)
def ocr_pipeline(spark, sf):
    known = A.word_counts(A.tokens(spark, sf)).where("c >= 3").select(F.col("tok").alias("word"))
    return I.scanned(A.spread(A.table(spark, sf, "documents")), known)


_HELD = "doc_id % 5 = 0"
_LETTERS = lambda x: rf"' ' || trim(lower(regexp_replace({x}, '[^\p{{L}}]+', ' ', 'g'))) || ' '"
_NEAREST = rf"""WITH p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(gram)) AS place FROM (SELECT lang, unnest(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2])) AS gram FROM (SELECT lang, {_LETTERS("text")} AS s FROM documents WHERE NOT {_HELD})) GROUP BY lang, gram QUALIFY place <= {I.PROFILE}),
g AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, encode(gram)) AS seat FROM (SELECT doc_id, unnest(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2])) AS gram FROM (SELECT doc_id, {_LETTERS("text[1:500]")} AS s FROM documents WHERE length(regexp_replace(text[1:500], '[^\p{{L}}]', '', 'g')) >= {I.LEAST_LETTERS})) GROUP BY doc_id, gram),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT doc_id, lang, (sum(least({I.PROFILE}, abs(seat - place))) + (n - count(*)) * {I.PROFILE})::DOUBLE / (n * {I.PROFILE}) AS d FROM g JOIN p USING (gram) JOIN n USING (doc_id) GROUP BY doc_id, lang, n),
b AS (SELECT doc_id, lang AS detected, d FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1 AND d <= {I.FURTHEST})
"""


def _detected(spark, sf):
    """Languages of all documents by profiles that the held-out fifth has no part in."""
    d = A.spread(A.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return d, I.detect_language(d, I.trigram_profiles(d.where(f"not {_HELD}")))


@query(_NEAREST + "SELECT doc_id, lang, detected FROM documents JOIN b USING (doc_id) WHERE detected <> lang")
def language_mismatch(spark, sf):
    """Documents whose detected language is another than their own."""
    d, found = _detected(spark, sf)
    return I.mismatched(found.join(d.select("doc_id", "lang"), "doc_id"), "detected", "lang").select("doc_id", "lang", "detected")


@query(_NEAREST + f"SELECT doc_id, detected, round(d, 9) AS distance, {_HELD} AS held_out FROM documents LEFT JOIN b USING (doc_id)")
def lang_detect(spark, sf):
    return _detected(spark, sf)[1].select("doc_id", "detected", F.round("distance", 9).alias("distance"), F.expr(_HELD).alias("held_out"))


@query(_NEAREST + f"SELECT lang, count(*) AS n, count(*) FILTER (detected = lang) AS right, count(*) FILTER (detected IS NULL) AS unknown FROM documents LEFT JOIN b USING (doc_id) WHERE {_HELD} GROUP BY lang")
def language_accuracy(spark, sf):
    """How many held-out documents of each language are told right, and how many are left open."""
    d, found = _detected(spark, sf)
    met = d.where(_HELD).select("doc_id", "lang").join(found, "doc_id")
    return met.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("detected") == F.col("lang")).alias("right"), F.count_if(F.col("detected").isNull()).alias("unknown"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN CASE WHEN doc_id % 2 = 0 THEN 'no' END WHEN 'fr' THEN 'fr' ELSE 'no' END AS code FROM documents")
def language_codes(spark, sf):
    """Codes of three letters, some of them of languages that are not in use, as those of two."""
    given = F.when(F.col("lang") == "en", " ENG ").when(F.col("lang") == "de", F.when(F.col("doc_id") % 2 == 0, "nno").otherwise("isl")).when(F.col("lang") == "fr", "fr").otherwise("nob")
    return A.table(spark, sf, "documents").select("doc_id", I.two_letters(given).alias("code"))


@query(None)
def main_articles(spark, sf):
    """Main parts of pages, told by their blocks alone: article elements count as any other."""
    p = A.spread(A.table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "(?i)(</?)article", "$1div").alias("html")))
    return M.main_articles(p).select("page_id", "article")


@query(r"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'link' WHEN doc_id % 4 = 1 THEN 'image' WHEN regexp_matches(t, '^\s*https?://\S+\s*$') THEN 'link' ELSE 'text' END AS route FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'https://example.com/' || doc_id ELSE text END AS t FROM documents)")
def share_route(spark, sf):
    m = F.col("doc_id") % 4
    url, image = F.when(m == 0, "https://example.com"), F.when(m == 1, "file.png")
    text = F.when(m == 2, F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", I.route(url, image, text).alias("route"))


@query(r"SELECT doc_id, regexp_replace(text[1:50], '^\s+|\s+$', '', 'g') || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS title FROM documents")
def title_fallback(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", lex.title(F.col("text")).alias("title"))


#: Recorded answers: a document's words, 500 to an answer, as JSON in prose; a third of the answers is cut off.
def _answers(spark, sf):
    t = A.word_parts(spark, sf, 500)
    item = lambda w, i: F.to_json(F.struct(w.alias("original"), F.reverse(w).alias("translation"), F.when((F.col("part") * 500 + i) % 3 != 0, "noun").alias("type")))
    a = t.select("doc_id", "part", F.concat(F.lit("Here you are:\n["), F.array_join(F.transform("w", item), ","), F.lit("]")).alias("answer"))
    return a.withColumn("answer", F.when(F.col("doc_id") % 3 == 0, F.substring("answer", F.lit(1), F.length("answer") - 9)).otherwise(F.col("answer")))


@query(A.oracle("tokens", "SELECT doc_id, part, (pos - 500 * part)::INTEGER AS ordinal, tok AS original, reverse(tok) AS translation, '' AS level, CASE WHEN pos % 3 <> 0 THEN 'noun' ELSE 'other' END AS type FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id, part) AS last FROM (SELECT *, pos // 500 AS part FROM tokens)) WHERE doc_id % 3 <> 0 OR pos < last"))
def json_parse_repair(spark, sf):
    return E.parsed(_answers(spark, sf)).select("doc_id", "part", "ordinal", "original", "translation", "level", "type")


@query(A.oracle("vocabulary", "SELECT id, form FROM (SELECT id, unnest([CASE WHEN pos % 4 <> 3 OR length(original) >= 3 THEN original END, CASE pos % 4 WHEN 0 THEN reverse(original) WHEN 3 THEN 'große ' || original END, CASE WHEN pos % 4 = 3 THEN 'große' END]) AS form FROM vocabulary) WHERE form IS NOT NULL"))
def source_forms_codec(spark, sf):
    """Forms of cards as JSON; those that are cut off, empty or missing fall back to the search terms of the card."""
    m, o = F.col("pos") % 4, F.col("original")
    forms = F.to_json(F.array(o, F.reverse(o)))
    said = F.when(m == 0, forms).when(m == 1, F.substring(forms, F.lit(1), F.length(forms) - 2)).when(m == 2, F.lit("[]"))
    card = F.when(m == 3, F.concat(F.lit("der große "), o)).otherwise(o)
    return A.vocabulary(spark, sf).select("id", F.explode(lex.source_forms(said, card)).alias("form"))
