"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Tokens are summed by source and hash bucket; a running sum finds the bucket in which a source's budget
ends; only that bucket is cut finer, level after level. Rows are then filtered by comparing their hash
with their source's threshold: no sort of rows, and a larger budget takes a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Histogram levels and bits per level: 2^30 hash cells per source in the end.
LEVELS, BITS = 3, 10
#: Sources by code point weigh so, repeating.
WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources(key, source_size) with the double `target`: 150 % of all sizes shared by weight, none above
    twice its source's size, the excess reshared by weight (the level that a sorted running sum gives).

    One row a source goes through one task; no row of the corpus does.
    """
    every = Window.partitionBy()
    ordered = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int")).cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    s = ordered.withColumns({"all_size": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "s0": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w0": F.coalesce(F.sum("w").over(before), F.lit(0))})
    s = s.withColumn("capped", 4 * F.col("source_size") * (F.col("all_w") - F.col("w0")) <= F.col("w") * (3 * F.col("all_size") - 4 * F.col("s0")))
    s = s.withColumns({"num": 3 * F.col("all_size") - 4 * F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(every), "den": 2 * F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)})
    open_target = (F.col("num") * F.col("w")).cast("double") / F.col("den").cast("double")
    return s.select("key", "source_size", F.when(F.col("capped"), (2 * F.col("source_size")).cast("double")).otherwise(open_target).alias("target"))


def described(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """docs with _key (its source, null last), _size (words) and _h, a hash of doc_id and text of LEVELS * BITS bits."""
    i, t, s = (F.col(f"`{c}`") for c in (doc_id, text, source))
    md5 = F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(t, F.lit(""))))
    return docs.withColumns({
        "_key": F.when(s.isNull(), "1").otherwise(F.concat(F.lit("0"), s)),
        "_size": F.coalesce(F.regexp_count(t, F.lit(shared.WORD)), F.lit(0)).cast("long"),
        "_h": F.shiftright(F.conv(F.substring(md5, 1, 8), 16, 10).cast("long"), 32 - LEVELS * BITS),
    })


def thresholds(rows: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, int]:
    """Of rows(_key, _size, _h), per source: source_size, target, full (times that all its rows are taken) and at:
    rows with a hash below it are taken once more. And the number of sources."""
    goal = targets(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("_size").alias("source_size")), weights).withColumnRenamed("key", "_key")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    cut = shared.written(goal.withColumns({"full": full, "at": F.lit(0).cast("long")}).withColumn("left", F.col("target") - F.col("full") * F.col("source_size")))
    n_sources = cut.count()
    for level in range(LEVELS):
        shift, last = (LEVELS - 1 - level) * BITS, level == LEVELS - 1
        inside = rows.join(shared.small(cut.select("_key", "at"), n_sources), "_key").where(F.shiftright("_h", shift + BITS) == F.shiftright("at", shift + BITS))
        histogram = inside.groupBy("_key", F.shiftright("_h", shift).alias("cell")).agg(F.sum("_size").alias("n"))
        upto = Window.partitionBy("_key").orderBy("cell")
        running = histogram.withColumn("upto", F.sum("n").over(upto)).join(shared.small(cut.select("_key", "left"), n_sources), "_key")
        fits = F.col("upto") <= F.col("left")
        if last:  # the last cell goes in if that comes nearer
            fits = fits | ((F.col("upto") - F.col("left")) < (F.col("left") - F.col("upto") + F.col("n")))
        ends = running.groupBy("_key").agg(F.min(F.when(~fits, F.col("cell"))).alias("cell"), F.max(F.when(fits, F.col("upto"))).alias("used"))
        prefix = F.shiftright(F.col("at"), shift + BITS)
        at = F.when(F.col("left") <= 0, F.shiftleft(prefix, shift + BITS)).otherwise(F.coalesce(F.shiftleft(F.col("cell"), shift), F.shiftleft(prefix + 1, shift + BITS)))
        cut = shared.written(cut.join(ends, "_key", "left").select("_key", "source_size", "target", "full", at.alias("at"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
    return cut.drop("left"), n_sources


def times() -> Column:
    """How often a row is taken."""
    return F.col("full") + (F.col("_h") < F.col("at")).cast("long")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target (its source's words), taken (words the mix takes).

    A row is taken floor(target / source_size) times, and once more if its hash lies under its source's
    threshold. The hash is of doc_id and text, so reruns agree; rows equal in both go together.
    Null text: size 0. Null source: a source of its own, after the others. Empty table: no rows. Other
    columns are not read, whatever their names.
    """
    rows = described(shared.columns(docs, doc_id=doc_id, t=text, s=source), "doc_id", "t", "s")
    rows = shared.written(rows.select("doc_id", "_key", "_size", "_h"))
    cut, n = thresholds(rows, weights)
    return rows.join(shared.small(cut, n), "_key").select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * times()).alias("taken"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns. Texts aren't moved.

    Null and empty texts have size 0 and go with their hash, a null source is one of its own, very long texts count
    whole, rows that repeat doc_id and text go together. An empty table gives no rows; columns may have any
    names."""
    plain, new = shared.renamed(docs)
    rows = described(plain, new[doc_id], new[text], new[source])
    cut, n = thresholds(shared.written(rows.select("_key", "_size", "_h")), weights)
    taken = rows.join(shared.small(cut, n), "_key").withColumn("_times", times())
    copies = taken.where(F.col("_times") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return copies.select(*new.values()).toDF(*docs.columns)


#: The same mix in DuckDB SQL.
ORACLE = """
WITH RECURSIVE rows_ AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 8))::BIGINT >> 2) AS h
  FROM {docs}),
sources AS (
  SELECT key, sum(size)::BIGINT AS s, [3, 1, 2][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::BIGINT AS w FROM rows_ GROUP BY key),
-- rounds: a source above twice its size stops there, the rest is shared again
rounds AS (
  SELECT 0 AS k, []::VARCHAR[] AS capped
  UNION ALL
  SELECT k + 1, (SELECT list(x.key ORDER BY x.key) FROM sources x, (
      SELECT 3 * (SELECT sum(s) FROM sources) - 4 * coalesce(sum(s) FILTER (list_contains(r.capped, key)), 0) AS num,
             2 * sum(w) FILTER (NOT list_contains(r.capped, key)) AS den FROM sources) y
    WHERE list_contains(r.capped, x.key) OR 2 * x.s * y.den <= y.num * x.w)
  FROM rounds r WHERE k < (SELECT count(*) FROM sources)),
final AS (SELECT coalesce(capped, []) AS capped FROM rounds ORDER BY k DESC LIMIT 1),
goal AS (
  SELECT key, s, CASE WHEN list_contains(capped, key) THEN (2 * s)::DOUBLE
      ELSE ((3 * (SELECT sum(s) FROM sources) - 4 * (SELECT coalesce(sum(s), 0) FROM sources, final f WHERE list_contains(f.capped, key))) * w)::DOUBLE
           / (2 * (SELECT sum(w) FROM sources, final f WHERE NOT list_contains(f.capped, key)))::DOUBLE END AS target
  FROM sources, final),
share AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS full_ FROM goal),
cells AS (
  SELECT key, h, sum(n) OVER (PARTITION BY key ORDER BY h) AS upto, n
  FROM (SELECT key, h, sum(size)::BIGINT AS n FROM rows_ GROUP BY key, h)),
cuts AS (
  SELECT key, s, target, full_, min(h) FILTER (NOT fits) AS cut_h FROM (
    SELECT c.key, g.s, g.target, g.full_, c.h, left_ > 0 AND (upto <= left_ OR upto - left_ < left_ - (upto - n)) AS fits
    FROM cells c JOIN (SELECT *, target - full_ * s AS left_ FROM share) g USING (key))
  GROUP BY ALL)
SELECT doc_id, size, s AS source_size, target, size * (full_ + CASE WHEN cut_h IS NULL OR h < cut_h THEN 1 ELSE 0 END)::BIGINT AS taken
FROM rows_ JOIN cuts USING (key)
"""
