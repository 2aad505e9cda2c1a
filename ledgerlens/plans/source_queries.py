"""Queries on listings, encodings, list dialects, normal forms, lemmas, headings and page triage as reports have them, and their SQL.

The test tables hold none of what these look for; it is put into their texts the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import attributes, pages, sections
from ..sources import files, lexicons
from .inputs import FILES_SQL, PAGES_SQL, quoted, report_pages, sql_in, sql_list, table
from .inputs import files as report_files
from .section_queries import _HEADED_SQL, _headed

_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
_STOPS = ["des", "von", "mit", "pour"]


# --- normal forms and lemmas

_WIDE = ("abcdefABC", "ａｂｃｄｅｆＡＢＣ")


def _wide_words(spark, sf):
    """Texts as some PDF files give them: with full-width letters and ligatures, which the normal form undoes."""
    own = F.replace(F.translate("text", *_WIDE), F.lit("fi"), F.lit("ﬁ"))
    return table(spark, sf, "documents").select(F.explode(T.tone_tokens(F.coalesce(own, F.lit("")), _STOPS)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_WIDE_SQL = f"SELECT word, count(*) AS n FROM (SELECT lower(unnest(string_split_regex(coalesce(text, ''), '\\s+'))) AS word FROM documents) WHERE regexp_full_match(word, '\\p{{L}}{{3,}}') AND word NOT IN {sql_in(_STOPS)} GROUP BY word"
_LEMMAS = {"inoran": "inor", "ononst": "onon", "these": "this", "the": "a"}


def _lemmas(spark, sf):
    own = T.index_tokens("text", _STOPS, _LEMMAS)
    return table(spark, sf, "documents").select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_LEMMAS_SQL = f"""SELECT CASE w {' '.join(f'WHEN {quoted(a)} THEN {quoted(b)}' for a, b in _LEMMAS.items())} ELSE w END AS word, count(*) AS n
FROM (SELECT unnest(string_split_regex(regexp_replace(lower(regexp_replace(coalesce(text, ''), 'http\\S+|www\\S+', ' ', 'g')), '[^a-z\\s]', ' ', 'g'), '\\s+')) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN {sql_in(_STOPS)} GROUP BY 1"""


# --- encodings and lists


def _decoded(spark, sf):
    """The bytes of each text, of one that is no UTF-8, and of one in Latin letters of one byte, in the four ways of reading them."""
    own = table(spark, sf, "documents").select("doc_id", "text", F.encode("text", "UTF-8").alias("bytes"))
    broken, latin = F.concat("bytes", F.lit(bytes([0xFF]))), F.encode(F.concat(F.lit("é "), F.col("doc_id").cast("string")), "ISO-8859-1")
    D = files.DECODERS
    made = {"kept": D["ignore"](broken), "replaced": D["replace"](broken), "strict": D["strict"](F.col("bytes"))}
    return own.select("doc_id", *(F.md5(v.cast("binary")).alias(k) for k, v in made.items()), D["cascade"](latin).alias("latin"))


def _values(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split(F.concat(F.lit("#!head\n ; note\n"), F.coalesce("text", F.lit(""))), "\n")).alias("value"))


_VALUES = "(SELECT unnest(string_split('#!head' || chr(10) || ' ; note' || chr(10) || coalesce(text, ''), chr(10))) AS v FROM documents)"
_BARE = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"


def _numeric_flags(spark, sf):
    k = F.col("p_partkey")
    flag = F.when(k % 2 == 0, "2009").when(k % 3 == 0, "0.0").when(k % 5 == 0, "x").otherwise("")
    rows = table(spark, sf, "part").select(F.translate("p_brand", "#0123456789", "xabcdefghij").alias("Word"), flag.alias("Positive"), F.when(k % 7 == 0, "-1").otherwise("0").alias("Negative"))
    return lexicons.master_words(rows, {"Positive": "Positive", "Negative": "Negative"}, numeric=True)


_BRAND = "lower(translate(p_brand, '#0123456789', 'xabcdefghij'))"


# --- headings

_STRUCTURE = {"principles": [("6", "Environment")], "sections": [("A", "General")], "keywords": ["Parameter", "Balance"]}
_BANK = sections.pattern_bank(_STRUCTURE)
_BANK_NAME = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted('(?i)' + p)}) THEN {quoted(k)}" for k, p in _BANK.items()) + " END"


def _titles(spark, sf):
    found = F.concat(T.numbered_titles(F.col("text"), "Principle", r"\d+"), T.numbered_titles(F.col("text"), "Section", "[A-C]"))
    return _headed(spark, sf).select("doc_id", "page_num", F.inline(found))


def _titles_sql() -> str:
    one = lambda w, n: f"SELECT doc_id, page_num, unnest(regexp_extract_all(text, '(?i){w}\\s*({n})\\s*[:\\-]\\s*([^\\n]+)', 1)) AS number, unnest(regexp_extract_all(text, '(?i){w}\\s*({n})\\s*[:\\-]\\s*([^\\n]+)', 2)) AS t FROM p"
    both = f"{one('Principle', chr(92) + 'd+')} UNION ALL {one('Section', '[A-C]')}"
    return f"WITH p AS ({_HEADED_SQL}) SELECT doc_id, page_num, number, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS title FROM ({both})"


def _profiles(spark, sf):
    """Each document's pages as a template: what its pages of the form are like."""
    t = F.col("text")
    own = _headed(spark, sf).select("doc_id", "page_num", t.rlike(r"(?i)Principle\s*[1-9]").alias("p"), t.rlike(r"(?i)Section\s*[ABC]").alias("s"), F.size(T.lines_with(t, ["indicator", "parameter", "disclosure", "response"])).alias("keywords"))
    return own.groupBy("doc_id").agg(F.count_if(F.col("p") | F.col("s")).alias("template_pages"), F.bool_or("p").alias("has_principles"), F.bool_or("s").alias("has_sections"), F.sum("keywords").alias("keywords"))


_PROFILES_SQL = f"""SELECT doc_id, count(*) FILTER (WHERE p OR s) AS template_pages, bool_or(p) AS has_principles, bool_or(s) AS has_sections, sum(k)::BIGINT AS keywords FROM
(SELECT doc_id, regexp_matches(text, '(?i)Principle\\s*[1-9]') AS p, regexp_matches(text, '(?i)Section\\s*[ABC]') AS s, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'indicator|parameter|disclosure|response'))) AS k FROM ({_HEADED_SQL})) GROUP BY doc_id"""


# --- triage at the reference's thresholds, with tables and recognised text


def _reports(spark, sf):
    """Some pages are mostly numbers, with a table; some are nearly empty, with text that was recognised; some are both."""
    k = F.col("doc_id") + 3 * F.col("page_num")
    own = report_pages(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    cell = lambda c: F.array(F.lit(" Total "), F.lit(None).cast("string"), c)
    tables = F.when(k % 14 == 0, F.array(F.array(cell(F.col("doc_id").cast("string")), cell(F.lit(""))))).otherwise(F.array().cast("array<array<array<string>>>"))
    text = F.when(k % 7 == 0, F.concat(F.lit("2024 17 385 "), F.col("page_num").cast("string"))).when(k % 5 == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))
    return own.select("doc_id", "page_num", text.alias("text"), tables.alias("tables"), F.when(k % 10 == 0, F.substring("text", 1, 70)).alias("ocr"))


_FIN = "|".join(f"(?:{p})" for p in V.FINANCIAL_PATTERNS)
_SOLID = "length(translate(text, ' ' || chr(10), ''))"
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TRIAGE_SQL = f"""WITH r AS (SELECT doc_id, page_num, doc_id + 3 * page_num AS k, coalesce(text, '') AS t FROM ({PAGES_SQL})),
p AS (SELECT doc_id, page_num, CASE WHEN k % 7 = 0 THEN '2024 17 385 ' || page_num WHEN k % 5 = 0 THEN substring(t, 1, 20) ELSE t END AS text, CASE WHEN k % 14 = 0 THEN 'Total ' || doc_id || ' Total' END AS tab, CASE WHEN k % 10 = 0 THEN substring(t, 1, 70) ELSE '' END AS ocr FROM r),
a AS (SELECT *, CASE WHEN regexp_matches(lower(substring(text, 1, 800)), {quoted(_FIN)}) THEN 'financial' WHEN {_SOLID} > 0 AND len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / nullif({_SOLID}, 0) > 0.28 THEN 'table'
    WHEN length({_STRIP.format('text')}) < 80 THEN CASE WHEN length({_STRIP.format('ocr')}) > 50 THEN 'ocr' ELSE 'short' END ELSE 'text' END AS action FROM p)
SELECT doc_id, page_num, action, CASE action WHEN 'text' THEN text WHEN 'ocr' THEN ocr WHEN 'table' THEN tab END AS page_text FROM a"""


# --- years of incorporation

_PHRASES = [(3, "Year of Incorporation : 19"), (4, "Incorporated in 20"), (5, "Date of Incorporation. the 3rd of May, 18")]


def _founded(spark, sf):
    k, phrase = F.col("doc_id"), F.lit("")
    for n, p in reversed(_PHRASES):
        phrase = F.when(k % n == 0, F.concat(F.lit(p), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("\n"))).otherwise(phrase)
    own = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), phrase).alias("text"))
    return attributes.incorporation(own, F.col("doc_id").cast("string"))


_FOUNDED_TEXT = f"SELECT doc_id, coalesce(text, '') || chr(10) || CASE {' '.join(f'WHEN doc_id % {n} = 0 THEN {quoted(p)} || lpad((doc_id % 100)::VARCHAR, 2, {quoted(chr(48))}) || chr(10)' for n, p in _PHRASES)} ELSE '' END AS text FROM documents"
_FOUNDED_SQL = f"""SELECT doc_id::VARCHAR AS "Company Name", coalesce({", ".join(f"nullif(regexp_extract(text, {quoted('(?i)' + p)}, 1), '')" for p in V.INCORPORATION_PATTERNS)}, 'Not Found') AS "Year of Incorporation" FROM ({_FOUNDED_TEXT})"""


def _made_names(spark, sf):
    c = F.concat("source", F.lit("_BRSR_2024-25.pdf"))
    return report_files(spark, sf).select("doc_id", N.without(c, "_BRSR_2024-25.pdf").alias("company"), N.cleaned(F.col("file_name")).alias("cleaned"))


QUERIES = {
    "normal_form_words": (_wide_words, _WIDE_SQL),
    "lemma_words": (_lemmas, _LEMMAS_SQL),
    "listed_files": (lambda s, d: files.listing(s, d, "parquet").select("file_name"), f"SELECT unnest({sql_list([f'{t}.parquet' for t in _TABLES])}) AS file_name"),
    "listed_both_cases": (
        lambda s, d: files.ending(files.listing(s, d, "parquet", recursive=True, both_cases=True), "s.parquet").select("file_name"),
        f"SELECT unnest({sql_list([f'{t}.parquet' for t in _TABLES if t.endswith('s')])}) AS file_name",
    ),
    "decoded_texts": (_decoded, "SELECT doc_id, md5(text) AS kept, md5(text || chr(65533)) AS replaced, md5(text) AS strict, 'é ' || doc_id AS latin FROM documents"),
    "lexicon_stopwords": (lambda s, d: lexicons.words_of(_values(s, d), **lexicons.DIALECTS["stopwords"]), f"SELECT DISTINCT lower({_BARE}) AS word FROM {_VALUES} WHERE NOT starts_with({_BARE}, ';') AND {_BARE} <> ''"),
    "lexicon_inline": (lambda s, d: lexicons.words_of(_values(s, d), **lexicons.DIALECTS["inline"]), f"SELECT DISTINCT lower({_BARE}) AS word FROM {_VALUES} WHERE NOT starts_with(v, '#') AND {_BARE} <> ''"),
    "numeric_flags": (
        _numeric_flags,
        f"SELECT DISTINCT 'Positive' AS category, {_BRAND} AS word FROM part WHERE p_partkey % 2 = 0 AND regexp_full_match({_BRAND}, '\\p{{L}}+') UNION ALL SELECT DISTINCT 'Negative', {_BRAND} FROM part WHERE p_partkey % 7 = 0 AND regexp_full_match({_BRAND}, '\\p{{L}}+')",
    ),
    "heading_titles": (_titles, _titles_sql()),
    "template_profiles": (_profiles, _PROFILES_SQL),
    "template_bank": (
        lambda s, d: sections.typed_pages(_headed(s, d), _BANK).select("doc_id", "page_num", "strong"),
        f"""SELECT doc_id, page_num, coalesce(CASE WHEN contains(text, 'BRSR') OR contains(text, 'Business Responsibility and Sustainability') OR contains(text, 'BRR') OR contains(text, 'Business Responsibility Report') THEN CASE WHEN contains(text, 'BRSR') OR contains(text, 'Sustainability') THEN 'BRSR' ELSE 'BRR' END END,
        CASE WHEN contains(name, 'BRSR') THEN 'BRSR' WHEN contains(name, 'BRR') THEN 'BRR' END) AS strong FROM (SELECT *, {_BANK_NAME} AS name FROM ({_HEADED_SQL}))""",
    ),
    "report_triage": (lambda s, d: pages.triage(_reports(s, d)).select("doc_id", "page_num", "action", "page_text"), _TRIAGE_SQL),
    "incorporation_years": (_founded, _FOUNDED_SQL),
    "made_names": (_made_names, f"SELECT doc_id, source AS company, regexp_replace(file_name, '\\.[^.]*$', '') || '_cleaned.txt' AS cleaned FROM ({FILES_SQL})"),
}
