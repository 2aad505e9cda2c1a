"""Queries on pages, sections and file names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import naming, pages, sections
from .inputs import FILES_SQL, PAGES_SQL, files, quoted, report_pages, sql_in, table

#: Headings that are put before the text of some pages, so that detectors have something to find.
_HEADINGS = [(5, "Principle 6: Environment. Parameter "), (7, "BRSR Section A - General Disclosures "), (11, "Business Responsibility Report "), (13, "Balance Sheet ")]


def _headed(spark, sf):
    own = report_pages(spark, sf)
    k = F.col("doc_id") + F.col("page_num") * F.col("page_num")
    head = F.lit("")
    for n, h in reversed(_HEADINGS):
        head = F.when(k % n == 0, F.lit(h)).otherwise(head)
    return own.withColumn("text", F.concat(head, F.coalesce("text", F.lit(""))))


_HEADED_SQL = f"SELECT doc_id, page_num, CASE {' '.join(f'WHEN (doc_id + page_num * page_num) % {n} = 0 THEN {quoted(h)}' for n, h in _HEADINGS)} ELSE '' END || coalesce(text, '') AS text, width, height FROM ({PAGES_SQL})"

_FIN = "|".join(f"(?:{p})" for p in V.FINANCIAL_PATTERNS)
_DENSE, _SHORT = 0.002, 80
_STRIP = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TRIAGE_SQL = f"""SELECT doc_id, page_num, text, CASE WHEN regexp_matches(lower(substring(text, 1, 800)), {quoted(_FIN)}) THEN 'financial'
    WHEN length(translate(text, ' ' || chr(10), '')) > 0 AND len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / nullif(length(translate(text, ' ' || chr(10), '')), 0) > {_DENSE} THEN 'table'
    WHEN length({_STRIP}) < {_SHORT} THEN 'short' ELSE 'text' END AS action FROM ({_HEADED_SQL})"""


def _triaged(spark, sf):
    return pages.triage(_headed(spark, sf), share=_DENSE, short=_SHORT)


_BOILER = "text"
for _p in V.BOILERPLATE_PATTERNS:
    _BOILER = f"regexp_replace({_BOILER}, {quoted('(?im)' + _p)}, ' ', 'g')"
_CLEAN = "regexp_replace(regexp_replace(text, '(\\w)-\\s*\\n\\s*(\\w)', '\\1\\2', 'g'), '([a-z])\\n([a-z])', '\\1 \\2', 'g')"
_CLEAN = _BOILER.replace("text", _CLEAN, 1)
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g')"
_CLEAN = f"regexp_replace(lower(regexp_replace({_CLEAN}, '[^\\x00-\\x7F]+', ' ', 'g')), '[^a-z\\s]', ' ', 'g')"
_TOKENS = f"list_filter(string_split_regex({_CLEAN}, '\\s+'), lambda x: length(x) >= 3 AND x NOT IN {sql_in([*V.ENGLISH_STOPWORDS, *V.DOMAIN_STOPWORDS])})"

_HITS = r"(?i)\bthe\b"
_ISLANDS = """h AS (SELECT doc_id, page_num, page_num - row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS g FROM (SELECT DISTINCT doc_id, page_num FROM hits)),
r AS (SELECT doc_id, g, count(*) AS n FROM h GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT doc_id, g FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) = 1),
block AS (SELECT h.doc_id, page_num FROM h LEFT JOIN b ON h.doc_id = b.doc_id WHERE b.doc_id IS NULL OR h.g = b.g)"""
_NEAR = """near AS (SELECT DISTINCT doc_id, page_num + d AS page_num FROM block, (VALUES (-1), (0), (1)) v(d)),
sizes AS (SELECT doc_id, max(page_num) + 1 AS n_pages FROM p GROUP BY doc_id),
context AS (SELECT doc_id, page_num::INT AS page_num FROM near JOIN sizes USING (doc_id) WHERE page_num >= 0 AND page_num < n_pages)"""

_BANK = sections.pattern_bank()
_NAME = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted('(?i)' + p)}) THEN {quoted(k)}" for k, p in _BANK.items()) + " END"
_TYPED = f"""p AS (SELECT doc_id, page_num, text, {_NAME} AS name FROM ({_HEADED_SQL})),
t AS (SELECT doc_id, page_num, name,
    regexp_matches(text, '(?i)Principle\\s*[1-9][:\\s-]') AS numbered, regexp_matches(text, '(?i)Section\\s*[ABC][:\\s-]') AS section,
    contains(text, 'BRSR') OR contains(text, 'Business Responsibility and Sustainability') OR contains(text, 'BRR') OR contains(text, 'Business Responsibility Report') AS literal,
    contains(text, 'BRSR') OR contains(text, 'Sustainability') AS sus, contains(text, 'Sustainability') OR contains(text, 'ESG') AS esg,
    (contains(text, 'Parameter') OR contains(text, 'Disclosure') OR contains(text, 'Response') OR contains(text, 'Page Reference')) AND regexp_matches(text, 'Principle [1-9]') AS tab FROM p),
y AS (SELECT doc_id, page_num, name IS NOT NULL OR numbered OR section OR literal OR tab AS hit,
    coalesce(CASE WHEN literal THEN CASE WHEN sus THEN 'BRSR' ELSE 'BRR' END END, CASE WHEN contains(name, 'BRSR') THEN 'BRSR' WHEN contains(name, 'BRR') THEN 'BRR' END) AS strong,
    CASE WHEN numbered THEN CASE WHEN esg THEN 'BRSR' ELSE 'BRR' END END AS weak FROM t),
hits AS (SELECT doc_id, page_num FROM y WHERE hit),
types AS (SELECT doc_id, coalesce(arg_max(strong, page_num) FILTER (WHERE strong IS NOT NULL), arg_min(weak, page_num) FILTER (WHERE weak IS NOT NULL), 'BRSR') AS report_type FROM y WHERE hit GROUP BY doc_id)"""


def _status(spark, sf):
    found, _ = sections.extract(_headed(spark, sf))
    own = files(spark, sf)
    return sections.extraction_status(own, found, N.company(F.col("file_name")), N.year(F.col("file_name")))


_STATUS_SQL = f"""WITH {_TYPED}, {_ISLANDS},
f AS (SELECT doc_id, file_name, regexp_replace(regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '(?i)_Annual[_\\s]Report.*$', ''), '_\\d{{4}}-\\d{{2}}$', '') AS company,
    coalesce(nullif(regexp_extract(file_name, '(\\d{{4}}-\\d{{2}})', 1), ''), nullif(regexp_extract(file_name, '(\\d{{4}})', 1), ''), 'Unknown') AS year FROM ({FILES_SQL})),
x AS (SELECT doc_id, report_type, count(*) AS n FROM types JOIN block USING (doc_id) GROUP BY ALL)
SELECT company AS "Company Name", year AS "Year", file_name AS "Original File", coalesce(report_type, 'None') AS "Report Type", coalesce(n, 0) AS "Pages Extracted",
    CASE WHEN n IS NULL THEN 'Not Found' ELSE 'Success' END AS "Extraction Status", CASE WHEN n IS NULL THEN 'N/A' ELSE company || '_' || report_type || '_' || year || '.pdf' END AS "Output File",
    CASE WHEN n IS NULL THEN 'No' ELSE 'Yes' END AS "BRSR/BRR Found" FROM f LEFT JOIN x USING (doc_id)"""

_FRAMES = {"the": r"\bthe\b", "digits": r"\d\d", "license": "licen[cs]e"}


def _frames(spark, sf):
    return sections.first_frames(table(spark, sf, "documents").select("doc_id", F.lit(0).alias("page_num"), "text"), _FRAMES)


def _names(spark, sf):
    c = F.col("name")
    own = files(spark, sf).select("doc_id", F.concat("source", F.lit("_"), "file_name").alias("name"))
    made = {"stem": N.stem(c), "suffix": N.suffix(c), "no_prefix": N.drop_prefix(c), "no_stem_prefix": N.drop_stem_prefix(c), "safe": N.safe(F.concat(c, F.lit("<a:b>?"))), "company": N.company(c), "year": N.year(c), "first_part": N.first_part(c), "first_year": N.first_year(c), "ticker": N.ticker(F.concat(F.lit(" "), N.first_part(c), F.lit(" ")))}
    return own.select("doc_id", *(v.alias(k) for k, v in made.items()))


def _copies(spark, sf):
    own = table(spark, sf, "documents").select(F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("/"), "source", F.lit(".txt")).alias("path"), F.concat("source", F.lit(".txt")).alias("file_name"))
    return naming.copy_plan(own)


QUERIES = {
    "page_predicates": (
        lambda s, d: _headed(s, d).select("doc_id", "page_num", pages.is_financial(F.col("text")).alias("financial"), pages.is_dense(F.col("text"), _DENSE).alias("dense"), pages.is_landscape(F.col("width"), F.col("height")).alias("landscape"), pages.is_short(F.col("text")).alias("short")),
        f"""SELECT doc_id, page_num, regexp_matches(lower(substring(text, 1, 800)), {quoted(_FIN)}) AS financial,
        CASE WHEN length(translate(text, ' ' || chr(10), '')) = 0 THEN false ELSE len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / length(translate(text, ' ' || chr(10), '')) > {_DENSE} END AS dense, width > height AS landscape, length({_STRIP}) < 80 AS short FROM ({_HEADED_SQL})""",
    ),
    "page_triage": (lambda s, d: _triaged(s, d).select("doc_id", "page_num", "action", F.coalesce(F.length("page_text"), F.lit(0)).alias("kept_chars")), f"SELECT doc_id, page_num, action, CASE WHEN action = 'text' THEN length(text) ELSE 0 END::INT AS kept_chars FROM ({_TRIAGE_SQL})"),
    "document_text": (
        lambda s, d: pages.document_text(_triaged(s, d)).select("doc_id", "text", F.to_json("skipped_pages").alias("skipped_pages")),
        f"""SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_num) FILTER (WHERE action = 'text'), '') AS text,
        '[' || coalesce(string_agg((page_num + 1)::VARCHAR, ',' ORDER BY page_num) FILTER (WHERE action <> 'text'), '') || ']' AS skipped_pages FROM ({_TRIAGE_SQL}) GROUP BY doc_id""",
    ),
    "clean_text": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(T.clean_tokens("text"), " ").alias("cleaned")),
        f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS cleaned FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    ),
    "conversion_log": (
        lambda s, d: pages.conversion_log(_triaged(s, d)),
        f"""WITH d AS (SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_num) FILTER (WHERE action = 'text'), '') AS text,
        '[' || coalesce(string_agg((page_num + 1)::VARCHAR, ',' ORDER BY page_num) FILTER (WHERE action <> 'text'), '') || ']' AS skipped_pages FROM ({_TRIAGE_SQL}) GROUP BY doc_id),
        c AS (SELECT doc_id, skipped_pages, {_TOKENS} AS w FROM d)
        SELECT doc_id::VARCHAR AS filename, CASE WHEN len(w) > 0 THEN 'success' ELSE 'empty' END AS status, len(w) AS total_tokens, skipped_pages, doc_id || '.txt' AS output_file, NULL::VARCHAR AS error, array_to_string(w, ' ') AS cleaned FROM c""",
    ),
    "section_pages": (
        lambda s, d: sections.with_neighbours(_headed(s, d).filter(sections.page_matches(F.col("text"))).select("doc_id", "page_num"), sections.page_counts(_headed(s, d))),
        f"""WITH p AS ({_HEADED_SQL}), block AS (SELECT doc_id, page_num FROM p WHERE regexp_matches(text, {quoted('(?i)' + '|'.join(f'(?:{x})' for x in V.SECTION_PATTERNS.values()))})
        OR contains(text, 'Principle') AND (contains(text, 'Page') OR contains(text, 'Parameter')) OR contains(text, 'BRSR') AND (contains(text, 'Table') OR contains(text, 'Indicator'))), {_NEAR} SELECT * FROM context""",
    ),
    "largest_block": (
        lambda s, d: sections.largest_block(report_pages(s, d).filter(F.col("text").rlike(_HITS))),
        f"WITH hits AS (SELECT doc_id, page_num FROM ({PAGES_SQL}) WHERE regexp_matches(text, {quoted(_HITS)})), {_ISLANDS} SELECT * FROM block",
    ),
    "block_context": (
        lambda s, d: sections.with_neighbours(sections.largest_block(report_pages(s, d).filter(F.col("text").rlike("ou"))), sections.page_counts(report_pages(s, d))),
        f"WITH p AS ({PAGES_SQL}), hits AS (SELECT doc_id, page_num FROM p WHERE regexp_matches(text, 'ou')), {_ISLANDS}, {_NEAR} SELECT * FROM context",
    ),
    "typed_pages": (lambda s, d: sections.typed_pages(_headed(s, d)), f"WITH {_TYPED} SELECT * FROM y"),
    "report_types": (lambda s, d: sections.report_types(sections.typed_pages(_headed(s, d))), f"WITH {_TYPED} SELECT * FROM types"),
    "extraction_status": (_status, _STATUS_SQL),
    "extracted_pages": (lambda s, d: sections.extract(_headed(s, d))[1], f"WITH {_TYPED}, {_ISLANDS}, {_NEAR} SELECT * FROM context"),
    "status_summary": (lambda s, d: sections.status_summary(_status(s, d)), f"""SELECT "Year", "Report Type", count("BRSR/BRR Found") AS "Total Files", count(*) FILTER (WHERE "Extraction Status" = 'Success') AS "Successful" FROM ({_STATUS_SQL}) GROUP BY 1, 2"""),
    "status_by_year": (lambda s, d: sections.status_by_year(_status(s, d)), f"""SELECT "Year", count(*) FILTER (WHERE "BRSR/BRR Found" = 'Yes') AS "Found", count(*) FILTER (WHERE "Extraction Status" = 'Success') AS "Success" FROM ({_STATUS_SQL}) GROUP BY 1"""),
    "status_by_type": (lambda s, d: sections.status_by_type(_status(s, d)), f"""SELECT "Report Type", count(*) AS n FROM ({_STATUS_SQL}) WHERE "BRSR/BRR Found" = 'Yes' GROUP BY 1"""),
    "status_totals": (
        lambda s, d: sections.status_totals(_status(s, d)),
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE "BRSR/BRR Found" = 'Yes') AS found, count(*) FILTER (WHERE "BRSR/BRR Found" <> 'Yes') AS missing, count(*) FILTER (WHERE "Extraction Status" = 'Success') AS success,
        round(100.0::DOUBLE * count(*) FILTER (WHERE "BRSR/BRR Found" = 'Yes') / count(*), 1) AS percent FROM ({_STATUS_SQL})""",
    ),
    "missing_reports": (lambda s, d: _status(s, d).filter(F.col("BRSR/BRR Found") == "No").select("Company Name", "Year", "Original File"), f"""SELECT "Company Name", "Year", "Original File" FROM ({_STATUS_SQL}) WHERE "BRSR/BRR Found" = 'No'"""),
    "first_frames": (
        _frames,
        "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), e AS (SELECT doc_id, a, unnest(a) AS x, unnest(range(len(a))) AS i FROM l), m AS ("
        + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, min(i) AS line FROM e WHERE regexp_matches(x, {quoted('(?i)' + p)}) GROUP BY doc_id" for k, p in _FRAMES.items())
        + ") SELECT doc_id, pattern, line::INT AS line, array_to_string(a[greatest(line - 10, 0) + 1:line + 20], chr(10)) AS context FROM m JOIN l USING (doc_id)",
    ),
    "file_names": (
        _names,
        f"""SELECT doc_id, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '(\\.[^.]*)$', 1) AS suffix, regexp_replace(name, '^[^_]*_', '') AS no_prefix,
        regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^[^_]*_', '') || regexp_extract(name, '(\\.[^.]*)$', 1) AS no_stem_prefix, regexp_replace(name || '<a:b>?', '[<>:"/\\\\|?*]', '_', 'g') AS safe,
        regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '(?i)_Annual[_\\s]Report.*$', ''), '_\\d{{4}}-\\d{{2}}$', '') AS company,
        coalesce(nullif(regexp_extract(name, '(\\d{{4}}-\\d{{2}})', 1), ''), nullif(regexp_extract(name, '(\\d{{4}})', 1), ''), 'Unknown') AS year, split_part(replace(name, '.txt', ''), '_', 1) AS first_part,
        coalesce(nullif(regexp_extract(' ' || translate(replace(name, '.txt', ''), '_-', '  ') || ' ', '\\s(\\d{{4}})\\s', 1), ''), 'Unknown') AS first_year, upper(split_part(replace(name, '.txt', ''), '_', 1)) AS ticker
        FROM (SELECT doc_id, source || '_' || file_name AS name FROM ({FILES_SQL}))""",
    ),
    "copy_plan": (
        _copies,
        "SELECT path, CASE WHEN n = 0 THEN source || '.txt' ELSE source || '_' || n || '.txt' END AS dest_name FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS n FROM (SELECT source, 'in/' || lpad(doc_id::VARCHAR, 9, '0') || '/' || source || '.txt' AS path FROM documents))",
    ),
}
