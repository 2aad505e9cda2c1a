"""Queries on tone metrics and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vocabulary as V
from ..functions.text import tone_tokens, without_stopwords
from ..operators import tone
from .inputs import ESG_WORDS, FILES_SQL, LEXICON, files, sql_in, table

_STOPS = [*V.REPORT_STOPWORDS, *LEXICON["Stop"]]


def _tone(spark, sf):
    return tone.tone_metrics(files(spark, sf), LEXICON, ESG_WORDS, name=F.concat_ws("#", N.stem(F.col("file_name")), F.col("doc_id").cast("string")))


def _short(spark, sf):
    return tone.short_tone(files(spark, sf), LEXICON, N.first_part(F.col("file_name")), N.first_year(F.col("file_name")), F.concat_ws("#", F.col("file_name"), F.col("doc_id").cast("string")))


def _category_counts(spark, sf):
    lexicon = spark.createDataFrame([(k, w) for k, v in LEXICON.items() for w in v], "category string, word string")
    return tone.category_counts(table(spark, sf, "documents"), lexicon, "doc_id", tone_tokens("text", ()))


def _stopword_clean(spark, sf):
    text, before, after = without_stopwords("text", LEXICON["Stop"])
    return table(spark, sf, "documents").select("doc_id", text.alias("cleaned"), before.alias("n_before"), after.alias("n_after"))


def _describe(spark, sf):
    return tone.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


#: The six ASCII spaces and the Unicode ones, in RE2's dialect.
_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TOKENS = f"string_split_regex(coalesce(text, ''), '{_SPACE}')"
_CLEAN = f"list_filter(list_transform({_TOKENS}, lambda x: lower(x)), lambda x: regexp_full_match(x, '\\p{{L}}{{3,}}') AND x NOT IN {sql_in(_STOPS)})"
_N = ", ".join(f"count(*) FILTER (WHERE t IN {sql_in(LEXICON[c])}) AS \"LM_{c}\"" for c in V.TONE_CATEGORIES)
_R = lambda a, b, d: f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END, {d})"

TONE_SQL = f"""
WITH f AS ({FILES_SQL}),
d AS (SELECT regexp_replace(file_name, '\\.[^.]*$', '') || '#' || doc_id AS filename, {_CLEAN} AS w FROM f),
e AS (SELECT filename, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
n AS (SELECT filename, count(*) AS total, count(DISTINCT t) AS uniq, sum(length(t)) AS letters, count(*) FILTER (WHERE t IN {sql_in(ESG_WORDS)}) AS esg, {_N} FROM e GROUP BY filename),
k AS (SELECT filename, t, count(*) AS c, min(i) AS i FROM e GROUP BY filename, t),
r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY c DESC, i) AS rk FROM k),
top AS (SELECT filename, string_agg(t || ':' || c, ' | ' ORDER BY rk) AS top FROM r WHERE rk <= 20 GROUP BY filename),
z AS (SELECT d.filename, coalesce(total, 0) AS total, coalesce(uniq, 0) AS uniq, coalesce(letters, 0) AS letters, coalesce(esg, 0) AS esg, coalesce(top, '') AS top, {", ".join(f'coalesce("LM_{c}", 0) AS "LM_{c}"' for c in V.TONE_CATEGORIES)} FROM d LEFT JOIN n USING (filename) LEFT JOIN top USING (filename))
SELECT filename, total AS total_words, uniq AS unique_words, {_R('uniq', 'total', 4)} AS type_token_ratio, {_R('letters', 'total', 4)} AS avg_word_length,
    {_R('"LM_Positive" - "LM_Negative"', 'total', 6)} AS net_tone, round(("LM_Positive" - "LM_Negative")::DOUBLE / ("LM_Positive" + "LM_Negative" + 1), 6) AS sentiment_score,
    {_R('"LM_Positive"', '"LM_Positive" + "LM_Negative"', 4)} AS polarity_ratio, esg AS esg_count, round(CASE WHEN total = 0 THEN 0.0 ELSE esg::DOUBLE / total END * 1000, 4) AS esg_density,
    {_R('"LM_Uncertainty"', 'total', 6)} AS uncertainty_ratio, {_R('"LM_Litigious"', 'total', 6)} AS litigiousness_ratio, {_R('"LM_Constraining"', 'total', 6)} AS constraining_ratio,
    {_R('"LM_Strong" - "LM_Weak"', 'total', 6)} AS modal_strength_ratio, {_R('"LM_Complexity"', 'total', 6)} AS complexity_ratio,
    {_R('"LM_Positive" + "LM_Negative" + "LM_Uncertainty" + "LM_Strong" + "LM_Weak" + "LM_Constraining"', 'total', 6)} AS content_richness, top AS top_20_words, {", ".join(f'"LM_{c}"' for c in V.TONE_CATEGORIES)} FROM z
"""

_LOOSE = f"list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '{_SPACE}'), lambda x: trim(x, '.,!?;:\"''()[]{{}}<>-–—')), lambda x: regexp_matches(x, '\\p{{L}}'))"
_KEPT = f"list_filter(w, lambda x: x NOT IN {sql_in(LEXICON['Stop'])})"
_SHORT = ", ".join(f'len(list_filter(k, lambda x: x IN {sql_in(LEXICON[c])})) AS "{v}"' for c, v in tone.SHORT_COLUMNS.items())
SHORT_SQL = f"""
SELECT "Company", "Year", "File_Name", len(w) AS "Total_Words_Raw", len(k) AS "Total_Words_Clean", "Positive_Words", "Negative_Words", "Positive_Words" - "Negative_Words" AS "Net_Tone",
    {_R('"Positive_Words"', '"Positive_Words" + "Negative_Words"', 4)} AS "Tone_Ratio", "Complexity_Words", "Constraining_Words", "Litigious_Words", "Strong_Modal_Words", "Weak_Modal_Words", "Uncertainty_Words"
FROM (SELECT *, {_SHORT} FROM (SELECT *, {_KEPT} AS k FROM (SELECT split_part(replace(file_name, '.txt', ''), '_', 1) AS "Company",
    coalesce(nullif(regexp_extract(' ' || translate(replace(file_name, '.txt', ''), '_-', '  ') || ' ', '\\s(\\d{{4}})\\s', 1), ''), 'Unknown') AS "Year", file_name || '#' || doc_id AS "File_Name", {_LOOSE} AS w FROM ({FILES_SQL}))))
"""
SUMMARY_SQL = f"""SELECT "Company", {", ".join(f'round(avg("{c}"), 2) AS "Avg_{c}"' for c in tone.AVERAGED)}, count(*) AS "Number_of_Files" FROM ({SHORT_SQL}) GROUP BY "Company" """

QUERIES = {
    "tone_metrics": (_tone, TONE_SQL),
    "short_tone": (_short, SHORT_SQL),
    "company_summary": (lambda s, d: tone.company_summary(_short(s, d)), SUMMARY_SQL),
    "top_companies": (lambda s, d: tone.top_companies(tone.company_summary(_short(s, d))), f'SELECT "Company", "Avg_Net_Tone", "Number_of_Files" FROM ({SUMMARY_SQL}) ORDER BY "Avg_Net_Tone" DESC, "Company" LIMIT 5'),
    "category_counts": (
        _category_counts,
        f"""WITH l(category, word) AS (VALUES {", ".join(f"('{k}', '{w}')" for k, v in LEXICON.items() for w in v)}),
        e AS (SELECT doc_id, unnest(list_filter(list_transform({_TOKENS}, lambda x: lower(x)), lambda x: regexp_full_match(x, '\\p{{L}}{{3,}}'))) AS word FROM documents)
        SELECT doc_id, category, count(*) AS n FROM e JOIN l USING (word) GROUP BY ALL""",
    ),
    "stopword_clean": (
        _stopword_clean,
        f"""WITH t AS (SELECT doc_id, list_filter({_TOKENS}, lambda x: x <> '') AS w FROM documents), k AS (SELECT doc_id, w, list_filter(w, lambda x: lower(x) NOT IN {sql_in(LEXICON['Stop'])}) AS k FROM t)
        SELECT doc_id, array_to_string(k, ' ') AS cleaned, len(w) AS n_before, len(k) AS n_after FROM k""",
    ),
    "describe_lineitem": (
        _describe,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM lineitem"""
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ),
    ),
}
