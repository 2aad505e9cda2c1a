"""Mixing sources to target word counts by Pareto order sampling.

A source's target is its share by weight of the wanted total, at most `cap` times its size; what exceeds the cap is
shared again by weight. As every share is min(weight * level, cap), the level follows from one running sum over the
sources in the order in which they reach their caps.

A document is taken e = target / size times on average (weighed by `weight`, if there is one). Its whole part is
certain; the rest, p, is drawn by Pareto order sampling: documents are ranked by (u / (1 - u)) / (p / (1 - p)) with
u uniform, and the first are taken until the source's words come nearest to its target. Ranks are found by counting
words by source and slice of the rank's range, so that only the slice that holds the cut is put in order, and
a hot source is never brought into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, staged, table

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 20240607
SLICES = 4096


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform in (0, 1): 52 bits of the MD5 of seed and doc_id, or of the text where there is no doc_id."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over sources, not documents
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    by_cap = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    open_ = F.col("level") < F.col("most") / F.col("w")
    s = s.withColumn("level", F.max(F.when(open_, F.col("level"))).over(every))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("w") * F.col("level")), F.col("most")).alias("target"))


def sized(docs: DataFrame, weight: str | None = None, seed: int = SEED) -> DataFrame:
    return docs.withColumns({"size": n_words("text"), "_u": draw(F.col("doc_id"), F.col("text"), seed), "_w": F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))})


def _ranked(rows: DataFrame, of: DataFrame, cap: float) -> DataFrame:
    """rows with their source's columns, whole copies and _v, the rank's place in [0, 1]."""
    r = rows.join(of, rows["source"].eqNullSafe(of["_source"])).drop("_source")
    e = F.least(F.lit(cap), F.coalesce(F.col("target") * F.col("_w") / F.nullif(F.col("_weighed"), F.lit(0.0)), F.lit(0.0)))
    r = r.withColumn("_e", e).withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    return r.withColumn("_v", F.when(F.col("_p") > 0, q / (1 + q)))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows: source, size, _u, _w. One row per source: _source, source_size, target, _weighed, and _cut, the last _v that is drawn."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_w") * F.col("size")).alias("_weighed"))
    given = targets(totals.select("source", "source_size"), weights, share, cap)
    of = staged(given.join(totals.select(F.col("source").alias("_source"), "_weighed"), given["source"].eqNullSafe(F.col("_source"))).select("_source", "source_size", "target", "_weighed"))
    ranked = _ranked(rows, of, cap).withColumn("_slice", F.least(F.floor(F.col("_v") * SLICES), F.lit(SLICES - 1)))
    counts = staged(ranked.groupBy("source", "target", "_slice").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("_whole") * F.col("size")).alias("sure")))
    by_source = Window.partitionBy("source")
    upto = F.coalesce(F.sum("words").over(by_source.orderBy(F.col("_slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cum = counts.withColumn("rest", F.col("target") - F.sum("sure").over(by_source)).withColumn("before", upto)
    edge = cum.filter("_slice is not null and before <= rest").groupBy("source").agg(F.max("_slice").alias("_slice"), F.max_by("before", "_slice").alias("before"), F.max("rest").alias("rest"))
    edge = edge.select(F.col("source").alias("_s"), F.col("_slice").alias("_edge"), "before", "rest")
    inside = ranked.join(edge, ranked["source"].eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_edge")))
    # rows of one _v, which are copies of one row, are taken or left together
    ties = inside.groupBy("source", "_v").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("_v")) + F.col("before")
    drawn = ties.withColumn("run", run).groupBy("source", "rest").agg(F.max(F.when(F.col("run") - F.col("size") / 2 <= F.col("rest"), F.col("_v"))).alias("in"))
    # where no row of the slice is drawn, all of the slices before are
    first = edge.select(F.col("_s"), (F.col("_edge") / F.lit(float(SLICES))).alias("low"))
    cuts = first.join(drawn.select(F.col("source").alias("_d"), "in"), F.col("_s").eqNullSafe(F.col("_d")), "left")
    return staged(of.join(cuts.select("_s", "low", "in"), F.col("_source").eqNullSafe(F.col("_s")), "left").select(*of.columns, "low", "in"))


def copies(rows: DataFrame, of: DataFrame, cap: float = CAP) -> DataFrame:
    """rows (of `sized`) with source_size, target and copies long."""
    r = _ranked(rows, of, cap)
    extra = F.coalesce((F.col("_v") < F.col("low")) | (F.col("_v") <= F.col("in")), F.lit(False))
    return r.withColumn("copies", F.col("_whole") + extra.cast("long")).drop("_e", "_whole", "_p", "_v", "_u", "_w", "_weighed", "low", "in")


def mix(docs: DataFrame, weight: str | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text, source. One row per row: doc_id, source, size, source_size, target, copies and taken = copies * size.

    Null and empty texts have size 0 and add nothing; a null source is a source, the last one; repeated rows (one doc_id)
    share one draw; null doc_ids are drawn by text; with no words at all every target is 0; an empty table gives an
    empty result. Columns other than these are neither read nor returned.
    """
    rows = staged(sized(docs, weight, seed).select("doc_id", "source", "size", "_u", "_w"))
    out = copies(rows, plan(rows, weights, share, cap), cap)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it; a row that it doesn't take goes. All columns stay."""
    cap, weight, seed = how.get("cap", CAP), how.get("weight"), how.get("seed", SEED)
    rows = staged(sized(docs, weight, seed).select("source", "size", "_u", "_w"))
    of = plan(rows, how.get("weights", WEIGHTS), how.get("share", SHARE), cap)
    inner = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source", *([weight] if weight else []))
    taken = copies(sized(inner, weight, seed), of, cap).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: What op9_mix_sources returns, in DuckDB's SQL.
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM documents),
s0 AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [{', '.join(f'{w}.0' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w, source_size * {CAP} AS most FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ()) * {SHARE} - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT *, max(CASE WHEN lv < most / w THEN lv END) OVER () AS level FROM s2),
s AS (SELECT source, source_size, coalesce(least(most, w * level), most)::DOUBLE AS target FROM s3),
e AS (SELECT d.*, source_size, target, least({CAP}::DOUBLE, coalesce(target / nullif(source_size, 0), 0)) AS e FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, floor(e) AS whole, e - floor(e) AS p, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM e),
t AS (SELECT source, q, sum(size) AS size FROM p WHERE q IS NOT NULL GROUP BY source, q),
r AS (SELECT source, q, size, sum(size) OVER (PARTITION BY source ORDER BY q) AS run FROM t),
o AS (SELECT source, max(target) - sum(whole * size) AS rest FROM p GROUP BY source),
c AS (SELECT r.source, max(q) FILTER (WHERE run - size / 2 <= rest) AS cut FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source GROUP BY r.source),
z AS (SELECT p.*, (whole + CASE WHEN q <= cut THEN 1 ELSE 0 END)::BIGINT AS copies FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken, copies FROM z
"""
