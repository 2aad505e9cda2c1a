r"""Line deduplication over overlapping three-line windows.

The lines of a text that hold a word are taken three at a time, each window starting a line later. A window found
elsewhere before, in the order of (doc_id, line), is a later occurrence, and its lines go; what later windows cover is merged, so that
a long repeated passage goes as a whole. Lines without a word are no part of windows and stay, and so do the three lines of
a first occurrence that a later one in the same text overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small, staged, table

WIDTH = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(text: Column) -> Column:
    """(at, line) of the lines that hold a word."""
    return F.filter(F.transform(lines(text), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: s["line"].rlike(HAS_WORD))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, _t (hash of the text), k (number of the window) and h1, h2, 128 bits of the window's hash."""
    filled = docs.select("doc_id", F.xxhash64("text").alias("_t"), _filled(F.col("text")).alias("own")).filter(F.size("own") >= WIDTH)
    each = F.transform(F.col("own"), lambda s: F.struct(F.xxhash64(s["line"]).alias("a"), F.xxhash64(F.lit(7), s["line"]).alias("b")))
    hashed = filled.select("doc_id", "_t", each.alias("own"))
    of = lambda k, half: F.xxhash64(*(F.get(F.col("own"), k + i)[half] for i in range(WIDTH)))
    made = F.transform(F.sequence(F.lit(0), F.size("own") - WIDTH), lambda k: F.struct(k.alias("k"), of(k, "a").alias("h1"), of(k, "b").alias("h2")))
    return hashed.select("doc_id", "_t", F.inline(made))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, _t and gone: the numbers (among the lines that hold a word) of the lines that go. Repeated rows are one document; null doc_ids come first."""
    every = staged(windows(docs))
    # counts of long numbers are hashed, not sorted; only what repeats is put in order
    often = staged(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    again = staged(every.join(small(often, 200_000), ["h1", "h2"]))
    discard(every), discard(often)
    at = F.struct("doc_id", "_t", "k")
    first = again.groupBy("h1", "h2").agg(F.min(at).alias("first"))
    later = again.join(first, ["h1", "h2"]).filter(at != F.col("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_t") == F.col("first._t"))
    start = F.when(same, F.greatest(F.col("k"), F.col("first.k") + WIDTH)).otherwise(F.col("k"))
    spans = later.select("doc_id", "_t", F.struct(start.alias("a"), (F.col("k") + WIDTH - 1).alias("b")).alias("span"))
    merged = spans.groupBy("doc_id", "_t").agg(F.collect_set("span").alias("spans"))
    return merged.select("doc_id", "_t", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"])))).alias("gone"))


def _light(gone: DataFrame, rows: int = 50_000, numbers: int = 1_000_000) -> DataFrame:
    """A staged table of lines that go, marked for broadcast if it has at most that many rows and numbers: then no text is shuffled."""
    n, m = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    return F.broadcast(gone) if n <= rows and m <= numbers else gone


def dedup_lines(docs: DataFrame, count: bool = True) -> DataFrame:
    """docs (doc_id, text and any others) with the lines of later occurrences removed from text, and, on demand, n_lines, n_removed long, which
    replace columns of these names.

    A null text stays null and an empty one empty; a text of fewer than three lines with a word has no window and stays as
    it is; a text all of whose lines go becomes empty, its row stays; rows that repeat one doc_id and text count as one document, and
    all change alike; a null doc_id comes before all others; where docs has n_chars, it follows the text; an empty table gives an empty result.
    """
    own = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.col("text").alias("_text"))
    gone = _light(staged(repeated(docs)))
    both = own.join(gone, own["_id"].eqNullSafe(gone["doc_id"]) & (own["_h"] == gone["_t"]), "left")
    n = both.select("_row", "_text", "gone", F.when(F.col("gone").isNotNull(), lines(F.col("_text"))).alias("all"), F.when(F.col("gone").isNotNull(), _filled(F.col("_text"))).alias("full"))
    dropped = F.transform("gone", lambda k: F.get(F.col("full"), k)["at"])
    n = n.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("all") - 1), dropped))
    n = n.withColumn("text", F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get(F.col("all"), i)), "\n")))
    counts = {} if not count else {"n_lines": F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns if c not in counts]
    return n.select(*kept, *(v.alias(k) for k, v in counts.items()))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: What op8_line_dedup returns, in DuckDB's SQL, on whole lines instead of their hashes (rows of one doc_id are taken to be one document).
OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
f AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.k, a.line || chr(10) || b.line || chr(10) || c.line AS win FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN f c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
o AS (SELECT *, first_value(doc_id) OVER x AS d0, first_value(k) OVER x AS k0 FROM w WINDOW x AS (PARTITION BY win ORDER BY doc_id, k)),
s AS (SELECT doc_id, CASE WHEN d0 = doc_id THEN greatest(k, k0 + 3) ELSE k END AS a, k + 2 AS b FROM o WHERE d0 <> doc_id OR k0 <> k),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM s),
h AS (SELECT f.doc_id, f.pos FROM f JOIN g USING (doc_id, k)),
r AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE h.pos IS NULL) AS text, count(h.pos) AS n_removed, count(*) AS n_lines FROM l LEFT JOIN h ON l.doc_id = h.doc_id AND l.pos = h.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, (CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END)::BIGINT AS n_lines, n_removed::BIGINT AS n_removed FROM documents d JOIN r USING (doc_id)
"""
