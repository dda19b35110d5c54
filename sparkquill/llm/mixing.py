"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket; the bucket in which a source's budget runs out is refined, and only
that one, until it holds a single hash value; the mix is then the filter `hash < threshold`, without a sort of the
documents. A target above the source's size means whole repeats of the source plus a threshold for the rest, so the
thresholds of growing budgets are nested. The hash depends on the id alone: reruns agree.

Sources rank by code point, null last, and get `weights` in turn. Targets are water-filled: none goes above
`max_repeats` times its source's size, and the excess is shared again by weight. Null text has size 0; an empty table
gives an empty result; rows with the same id and source are taken together; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, own, save, text_of

BITS, STEP = 60, 12
#: Up to so many sources their thresholds are broadcast (under 10 MB); beyond, Spark's skew-aware join is left to choose.
BROADCAST_SOURCES = 100_000


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank from 0 by source, null last, without gathering all sources in one task."""
    order = F.col("source").asc_nulls_last()
    parts = save(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    row = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("row", row).join(F.broadcast(before), "part").withColumn("rank", F.col("row") + F.coalesce("before", F.lit(0))).select("key", "source_size", "rank")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row. share: of all sizes, what the mix shall hold."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = own(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = save(rows.select("doc_id", "source", key.alias("key"), F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"), hashed.alias("hash")), "mix-sizes")

    sources = _ranked(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = save(sources.select("key", "source_size", weight.alias("weight")), "mix-weights")
    level, few = _level(sources, share, max_repeats)
    target = F.round(F.least(max_repeats * F.col("source_size").cast("double"), level * F.col("weight")), 6)
    repeats = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    state = sources.select("key", "source_size", target.alias("target"), repeats.alias("repeats")).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    thresholds = _thresholds(sized, state, few)

    copies = F.col("repeats") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    joined = sized.join(_small(thresholds, few), "key")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def _level(sources: DataFrame, share: float, max_repeats: int) -> tuple[float, bool]:
    """The words per unit of weight of all sources below their limit, from one-row aggregates; and whether sources are few."""
    n, total, free = sources.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    total, capped = share * (total or 0), 0.0
    while True:
        level = max(total - capped, 0.0) / free if free else 0.0
        at_limit = max_repeats * F.col("source_size") <= level * F.col("weight")
        now, left = sources.agg(F.sum(F.when(at_limit, max_repeats * F.col("source_size").cast("double"))), F.sum(F.when(~at_limit, F.col("weight")))).first()
        if (now or 0.0) == capped or not left:
            return (level if left else float("inf") if total else 0.0), n <= BROADCAST_SOURCES
        capped, free = now, left


def _thresholds(sized: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Adds threshold: the sizes of the source's documents with a smaller hash come nearest to `rest`."""
    state = save(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("threshold", F.when(F.col("rest") > 0, None).otherwise(F.lit(0).cast("long"))), "mix-state")
    for used in range(0, BITS, STEP):
        shift = BITS - used - STEP
        wanted = state.where("threshold is null").select("key", "prefix", "below", "rest")
        inside = sized.join(_small(wanted, few), "key").where(F.shiftright("hash", shift + STEP) == F.col("prefix"))
        buckets = inside.groupBy("key", "below", "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        up_to = Window.partitionBy("key").orderBy("bucket")  # at most 4,096 rows
        cut = buckets.withColumn("upto", F.col("below") + F.sum("s").over(up_to)).where("upto >= rest")
        cut = cut.groupBy("key").agg(F.min_by(F.struct("bucket", "s", "lo", "hi", "upto", "rest"), "bucket").alias("c")).select("key", "c.*")
        before = F.col("upto") - F.col("s")
        nearest = F.col("lo") + F.when(2 * (F.col("rest") - before) > F.col("s"), 1).otherwise(0)
        cut = cut.select("key", F.col("bucket").alias("p"), before.alias("b"), F.when(F.col("lo") == F.col("hi"), nearest).alias("t"))
        new = state.join(cut, "key", "left").select(*[c for c in state.columns if c not in ("prefix", "below", "threshold")], F.coalesce("p", "prefix").alias("prefix"), F.coalesce("b", "below").alias("below"), F.coalesce("threshold", "t").alias("threshold"))
        state, old = save(new, "mix-state"), state
        drop(old)
        if not state.where("threshold is null").limit(1).count():
            break
    return state.select("key", "source_size", "target", "repeats", "threshold")


ORACLE = f"""
WITH sized AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
src AS (SELECT k, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY CASE WHEN k = '' THEN 1 ELSE 0 END, k) - 1 AS r FROM sized GROUP BY k),
w AS (SELECT k, s, CAST(r % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * s AS cap FROM src),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w DESC, k DESC) AS free, (SELECT sum(s) FROM w) AS total FROM w),
l AS (SELECT max((total - capped) / free) AS level FROM o),
t AS (SELECT k, s, round(least(cap, coalesce(level, 0) * w), 6) AS target FROM w, l),
g AS (SELECT k, h, sum(size) AS sz FROM sized GROUP BY k, h),
b AS (SELECT k, h, sz, coalesce(sum(sz) OVER (PARTITION BY k ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM g)
SELECT doc_id, size, s AS source_size, target,
    CAST(size * (CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END + CASE WHEN s > 0 AND 2 * (target - floor(target / s) * s) > 2 * bef + sz THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN t USING (k) JOIN b USING (k, h)
"""
