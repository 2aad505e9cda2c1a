"""Queries on the severity index, on attributes of companies, on word lists, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import first_rows, missing_from, yes_no
from ..functions.text import index_tokens, tokens
from ..operators import attributes, severity, tone
from ..sources import files, lexicons, sinks
from ..sources.staging import staged
from ..streaming import ingest
from .inputs import ESG_WORDS, POLARITY, quoted, sql_in, sql_list, table

_STOPS = sorted({*V.ENGLISH_STOPWORDS, *V.INDEX_STOPWORDS})
#: Fixed value: the terms of the reference's vocabulary.
_MOST = 10_000


def _words():
    return index_tokens("text", _STOPS)


def _counts(spark, sf):
    return severity.term_counts(table(spark, sf, "documents"), _words())


def _terms(spark, sf):
    return severity.vocabulary(_counts(spark, sf), table(spark, sf, "documents").count(), most=_MOST)


def _weights(spark, sf):
    counts = staged(_counts(spark, sf))  # read for the vocabulary, the weights and their lengths
    terms = severity.vocabulary(counts, table(spark, sf, "documents").count(), most=_MOST)
    return severity.tfidf(counts, terms).select("doc_id", "term", F.round("weight", 9).alias("weight"))


def _index(spark, sf):
    return severity.severity_index(table(spark, sf, "documents"), POLARITY, F.col("source"), F.col("doc_id").cast("string"), topics=ESG_WORDS)


_T = f"""w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(coalesce(text, ''), 'http\\S+|www\\S+', ' ', 'g')), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3 AND x NOT IN {sql_in(_STOPS)}) AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)"""


_VOCABULARY = f"""v AS (SELECT term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS c FROM tf GROUP BY term), n WHERE df >= CASE WHEN n >= 4 THEN 2 ELSE 1 END AND df <= 0.95 * n ORDER BY c DESC, term LIMIT {_MOST})"""
_HIT = " OR ".join(f"contains(term, {quoted(w)})" for w in ESG_WORDS)
_SCORE = f"""WITH {_T}, {_VOCABULARY},
h AS (SELECT *, ({_HIT}) AS hit FROM v), a AS (SELECT coalesce(bool_or(hit), false) AS any_hit FROM h),
r AS (SELECT doc_id, sum(CASE WHEN hit OR NOT any_hit THEN tf * idf ELSE 0 END) / sqrt(sum((tf * idf) ** 2)) AS score FROM tf JOIN h USING (term), a GROUP BY doc_id),
score AS (SELECT doc_id, coalesce(score, 0.0) AS score FROM documents LEFT JOIN r USING (doc_id))"""
_POL = "(VALUES " + ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, p, s in POLARITY) + ") l(word, p, s)"
_SENT = f"""m AS (SELECT doc_id, sum(p) / count(*) AS p, sum(s) / count(*) AS s FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS word FROM documents) JOIN {_POL} USING (word) GROUP BY doc_id),
sent AS (SELECT doc_id, source, round(coalesce(p, 0), 6) AS sentiment_polarity, round(coalesce(s, 0), 6) AS sentiment_subjectivity FROM documents LEFT JOIN m USING (doc_id))"""
_Z = lambda c: f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END"
_MM = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
_INDEX = f"""{_SCORE}, {_SENT}, z AS (SELECT *, {_Z('sentiment_polarity')} - ({_Z('score')}) AS ix, {_MM('score')} AS ms, {_MM('sentiment_polarity')} AS mp FROM sent JOIN score USING (doc_id))
SELECT source AS company, doc_id::VARCHAR AS file, round(ix, 6) AS esgsi, round(ms, 6) AS normalized_sustainability_score, round(mp, 6) AS normalized_sentiment_score, sentiment_polarity, sentiment_subjectivity,
    round(score, 6) AS sustainability_score_raw, CASE WHEN ix > 0 THEN 'Potential ESGwashing' ELSE 'Likely Genuine' END AS label FROM z"""

_YEARS = [r"(\d{4})-\d\d", r"in (\d{4})", r"(\d{4})"]


def _web_pages(spark, sf):
    """customers as tickers, each with a page that tells sector and industry in one of three ways, or nothing, or with an error code."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    own = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey") % 5
    peer = F.concat(F.lit('<section id="peer-comparison"><div class="company-info">Sector: '), "r_name", F.lit("\nIndustry: "), "n_name", F.lit("</div></section>"))
    plain = F.concat(F.lit("<p>Sector : "), "r_name", F.lit("\n</p><p>Industry &nbsp; "), "n_name", F.lit("</p>"))
    rows = F.concat(F.lit("<table><tr><td>Sector</td><td>"), "r_name", F.lit("</td></tr><tr><td>Industry</td><td>"), "n_name", F.lit("</td></tr></table>"))
    body = F.when(k == 0, peer).when(k == 1, plain).when(k == 2, rows).otherwise("<p>nothing</p>")
    html = F.concat(F.lit('<html><body><h1 class="company">'), "c_name", F.lit(" </h1>"), body, F.lit("</body></html>"))
    code = F.when(F.col("c_custkey") % 11 == 0, 404).when(F.col("c_custkey") % 13 == 0, 500).otherwise(200)
    symbol = F.when(F.col("c_custkey") % 50 == 3, "tcs").otherwise(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")))
    return own.select(symbol.alias("ticker"), code.alias("status_code"), html.alias("html"))


_WEB = """SELECT upper(trim(CASE WHEN c_custkey % 50 = 3 THEN 'tcs' ELSE 'c' || c_custkey END)) AS ticker, CASE WHEN c_custkey % 11 = 0 THEN 404 WHEN c_custkey % 13 = 0 THEN 500 ELSE 200 END AS code, c_custkey % 5 AS k, c_name, n_name, r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_INDUSTRY = f"""SELECT ticker, CASE WHEN code = 200 THEN c_name ELSE 'Not Found' END AS company_name, CASE WHEN code = 200 AND k < 3 THEN r_name ELSE 'Not Found' END AS sector, CASE WHEN code = 200 AND k < 3 THEN n_name ELSE 'Not Found' END AS industry,
    'Not Found' AS sub_industry, CASE WHEN code = 404 THEN 'Company not found' WHEN code <> 200 THEN 'HTTP Error: ' || code WHEN k < 3 THEN 'Found' ELSE 'No industry data found' END AS status FROM ({_WEB})"""


def _master(spark, sf):
    """part as a master table of words with flags as text."""
    p = table(spark, sf, "part")
    flag = lambda n: F.when(F.col("p_partkey") % n == 0, "2009").when(F.col("p_partkey") % 3 == 0, "0").otherwise("")
    word = F.concat(F.translate("p_brand", "#0123456789", "xabcdefghij"), F.when(F.col("p_partkey") % 7 == 0, "1").otherwise(""))
    return p.select(word.alias("Word"), flag(2).alias("positive"), flag(5).alias("LM_Negative_flag"))


def _lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("value"))


def _without_stopwords(spark, sf):
    """The stoplist as a relation: a broadcast anti-join, the way to go for lists that are data."""
    words = table(spark, sf, "documents").select(F.explode(tokens(F.lower(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(F.broadcast(spark.createDataFrame([(w,) for w in _STOPS], "word string")), "word", "left_anti")


def _esg_terms(spark, sf):
    """The terms of the three pillars, and the words of part names as a fourth list that overlaps with nothing or something."""
    pillars = [spark.createDataFrame([(t,) for t in terms], "word string") for terms in (V.ENVIRONMENTAL_TERMS, V.SOCIAL_TERMS, V.GOVERNANCE_TERMS)]
    return lexicons.union_of([*pillars, table(spark, sf, "part").select(F.explode(tokens("p_name")).alias("word"))])


def _event_windows(spark, sf):
    """events as a stream, counted by windows of six hours until what is there has been read."""
    name = f"event_windows_{uuid.uuid4().hex}"
    like = table(spark, sf, "events")
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    by = ingest.windowed(stream, "ts", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"), width="6 hours", late="30 days")
    by.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "vocabulary": (_terms, f"WITH {_T}, {_VOCABULARY} SELECT * FROM v"),
    "tfidf": (_weights, f"WITH {_T}, {_VOCABULARY}, r AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN v USING (term)) SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 9) AS weight FROM r"),
    "sustainability_scores": (lambda s, d: severity.sustainability_scores(table(s, d, "documents"), _words(), ESG_WORDS).select("doc_id", F.round("score", 9).alias("score")), f"{_SCORE} SELECT doc_id, round(score, 9) AS score FROM score"),
    "sentiment": (
        lambda s, d: table(s, d, "documents").select("doc_id", *(c.alias(k) for c, k in zip(severity.sentiment(F.coalesce("text", F.lit("")), POLARITY), ("polarity", "subjectivity"), strict=True))),
        f"WITH {_SENT} SELECT doc_id, sentiment_polarity AS polarity, sentiment_subjectivity AS subjectivity FROM sent",
    ),
    "severity_index": (_index, _INDEX),
    "severity_labels": (lambda s, d: _index(s, d).groupBy("label").agg(F.count("*").alias("n")), f"SELECT label, count(*) AS n FROM ({_INDEX}) GROUP BY label"),
    "describe_index": (
        lambda s, d: tone.describe(_index(s, d), ["esgsi", "sustainability_score_raw"]),
        f"WITH x AS ({_INDEX}) "
        + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM x""" for c in ("esgsi", "sustainability_score_raw")),
    ),
    "normalise_prices": (
        lambda s, d: severity.normalised(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("x")), ["x"]).select("p_partkey", F.round("x_minmax", 9).alias("x_minmax"), F.round("x_z", 9).alias("x_z")),
        f"SELECT p_partkey, round({_MM('p_retailprice')}, 9) AS x_minmax, round({_Z('p_retailprice')}, 9) AS x_z FROM part",
    ),
    "year_cascade": (
        lambda s, d: attributes.incorporation(table(s, d, "documents"), F.col("doc_id").cast("string"), patterns=_YEARS),
        f"""SELECT doc_id::VARCHAR AS "Company Name", coalesce({", ".join(f"nullif(regexp_extract(coalesce(text, ''), {quoted('(?i)' + p)}, 1), '')" for p in _YEARS)}, 'Not Found') AS "Year of Incorporation" FROM documents""",
    ),
    "incorporation_counts": (
        lambda s, d: attributes.incorporation_counts(attributes.incorporation(table(s, d, "documents"), F.col("source"), patterns=_YEARS)),
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE y <> 'Not Found') AS found, count(*) FILTER (WHERE regexp_full_match(y, '\\d{{4}}')) AS found_years, count(*) FILTER (WHERE y = 'Not Found') AS not_found
        FROM (SELECT coalesce({", ".join(f"nullif(regexp_extract(coalesce(text, ''), {quoted('(?i)' + p)}, 1), '')" for p in _YEARS)}, 'Not Found') AS y FROM documents)""",
    ),
    "industry": (lambda s, d: attributes.industry(_web_pages(s, d)), _INDUSTRY),
    "industry_pages": (
        lambda s, d: attributes.industry(table(s, d, "pages").select(F.col("page_id").cast("string").alias("ticker"), F.lit(200).alias("status_code"), "html")).groupBy("company_name", "status").agg(F.count("*").alias("n")),
        "SELECT 'Not Found' AS company_name, 'No industry data found' AS status, count(*) AS n FROM pages",
    ),
    "industry_fallback": (
        lambda s, d: attributes.with_fallback(attributes.industry(_web_pages(s, d))),
        f"""WITH i AS ({_INDUSTRY}), f(ticker, c, s, n) AS (VALUES {", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in V.FALLBACK_COMPANIES)})
        SELECT * FROM i WHERE status = 'Found' UNION ALL SELECT i.ticker, f.c, f.s, f.n, NULL, CASE WHEN f.ticker IS NULL THEN 'Not in fallback database' ELSE 'Found (Fallback)' END FROM i LEFT JOIN f USING (ticker) WHERE status <> 'Found'""",
    ),
    "industry_counts": (
        lambda s, d: attributes.industry_counts(attributes.industry(_web_pages(s, d))),
        f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Found') AS found, count(*) FILTER (WHERE status <> 'Found') AS not_found, round(count(*) FILTER (WHERE status = 'Found')::DOUBLE / count(*) * 100, 1) AS success_rate FROM ({_INDUSTRY})",
    ),
    "lexicon_lines": (
        lambda s, d: lexicons.words_of(_lines(s, d), **lexicons.DIALECTS["category"]),
        r"SELECT DISTINCT w AS word FROM (SELECT lower(regexp_extract(v, '^\s*(\S+)', 1)) AS w FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS v FROM documents) WHERE NOT starts_with(trim(v), ';')) WHERE regexp_full_match(w, '\p{L}+')",
    ),
    "lexicon_whole_lines": (
        lambda s, d: lexicons.words_of(_lines(s, d), **lexicons.DIALECTS["list"]),
        r"SELECT DISTINCT lower(regexp_replace(v, '^\s+|\s+$', '', 'g')) AS word FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS v FROM documents) WHERE NOT starts_with(v, ';') AND NOT starts_with(v, '#') AND regexp_replace(v, '^\s+|\s+$', '', 'g') <> ''",
    ),
    "master_lexicon": (
        lambda s, d: lexicons.master_words(_master(s, d), {"Positive": "Positive", "Negative": "Negative"}),
        """WITH m AS (SELECT lower(translate(p_brand, '#0123456789', 'xabcdefghij') || CASE WHEN p_partkey % 7 = 0 THEN '1' ELSE '' END) AS word, p_partkey AS k FROM part)
        SELECT DISTINCT 'Positive' AS category, word FROM m WHERE k % 2 = 0 AND regexp_full_match(word, '\\p{L}+') UNION ALL SELECT DISTINCT 'Negative', word FROM m WHERE k % 5 = 0 AND regexp_full_match(word, '\\p{L}+')""",
    ),
    "merged_lexicon": (
        lambda s, d: lexicons.merge(lexicons.master_words(_master(s, d), {"Positive": "Positive"}), s.createDataFrame([("Positive", w) for w in ESG_WORDS], "category string, word string")),
        f"""SELECT 'Positive' AS category, lower(translate(p_brand, '#0123456789', 'xabcdefghij')) AS word FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AND regexp_full_match(lower(translate(p_brand, '#0123456789', 'xabcdefghij')), '\\p{{L}}+') UNION SELECT 'Positive', unnest({sql_list(ESG_WORDS)})""",
    ),
    "column_widths": (
        lambda s, d: sinks.column_widths(table(s, d, "nation").withColumn("n_name", F.repeat("n_name", 4))),
        "SELECT 'n_nationkey' AS \"column\", least(greatest(max(length(n_nationkey::VARCHAR)), 11) + 2, 50)::INT AS width FROM nation UNION ALL SELECT 'n_name', least(greatest(max(length(repeat(n_name, 4))), 6) + 2, 50)::INT FROM nation UNION ALL SELECT 'n_regionkey', least(greatest(max(length(n_regionkey::VARCHAR)), 11) + 2, 50)::INT FROM nation",
    ),
    "labelled_documents": (
        lambda s, d: table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", yes_no(F.col("quality") == 1).alias("status")),
        "SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'Not Found' WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS status FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "event_status": (
        lambda s, d: table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high")),
        "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY ALL",
    ),
    "esg_terms": (
        _esg_terms,
        f"SELECT DISTINCT word FROM (SELECT unnest({sql_list([*V.ENVIRONMENTAL_TERMS, *V.SOCIAL_TERMS, *V.GOVERNANCE_TERMS])}) AS word UNION ALL SELECT lower(unnest(string_split_regex(p_name, '\\s+'))) FROM part) WHERE word <> ''",
    ),
    "words_without_stopwords": (_without_stopwords, f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS word FROM documents) WHERE word <> '' AND word NOT IN {sql_in(_STOPS)} GROUP BY word"),
    "unlabelled_documents": (
        lambda s, d: missing_from(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id"),
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "first_unlabelled": (
        lambda s, d: first_rows(missing_from(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id"), "doc_id"),
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10",
    ),
    "page_texts": (
        lambda s, d: files.whole_text(table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("page_num"), "text"), end=" "),
        "SELECT conv_id::VARCHAR AS path, coalesce(string_agg(text || ' ', '' ORDER BY turn) FILTER (WHERE text <> ''), '') AS text FROM conversations GROUP BY conv_id",
    ),
    "event_windows": (_event_windows, "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
}
