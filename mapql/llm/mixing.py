"""Mixing sources to target weights by exponential keys (Efraimidis-Spirakis), in DataFrame operations only.

Each row gets the key ``-ln(u) / quality`` with ``u`` a uniform number made from a hash of its id, so a rerun
agrees. Ordered by that key, the rows of a source are a weighted sample without replacement. Sizes are
prefix-summed in that order: the source's target is filled by complete epochs first (every row whole), and the
rest by the rows whose prefix sum fits, the row that crosses the line giving only what is left.

The prefix sums don't gather a source in one task. Rows are dealt into ranges of the key whose number follows
the source's row count, sums of the ranges are prefix-summed (rows of that table: ranges, not documents), and
within a range a window runs over its rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapql.runtime import cut

#: Words as in the contract.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&|*!]"
CYCLE = (5, 2, 1)
#: A target stops at so many times the size of its source.
CAP = 3
#: Rows that one range of keys holds on average.
RANGE_ROWS = 20_000


#: A table of at most so many rows (each under 100 bytes) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), the same in every run: the first 52 bits of an MD5 of the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("mix"), *parts)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def plainness(text: Column, size: Column) -> Column:
    """A quality weight from 0.1 to 1 that falls with the symbols in a text, for corpora without a better one."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(size, F.lit(1)))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, which is cut already, marked for a broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_rows, mean_key), a row for each source, with ``target`` added.

    Shares of all words go by weight; one above ``cap`` times its source's size is held there, and the excess is
    reshared by weight until none is above. In the order of size over weight the held sources come first, so the
    fixed point is found by one pass: the first source whose cap isn't under the level that the words and weights
    from it on give sets the level for all from there on.
    """
    all_of = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    x = x.withColumn("weight", F.element_at(weights, (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int")))
    x = x.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = W.orderBy("ratio", "rank")
    held = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    x = x.withColumn("level", (F.sum("source_size").over(all_of).cast("double") - held) / weight_from)
    x = x.withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(all_of))
    free = F.col("first").isNotNull() & (F.struct("ratio", "rank") >= F.struct("first.ratio", "first.rank"))
    x = x.withColumn("target", F.when(free, F.col("weight") * F.col("first.level")).otherwise(F.col("most")))
    return x.select("source", "source_size", "n_rows", "mean_key", "target")


def mix_sources(docs: DataFrame, quality: Column | None = None, cycle: tuple[float, ...] = CYCLE, cap: int = CAP, range_rows: int = RANGE_ROWS) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, taken.

    ``docs`` needs doc_id, text and source; other columns are not read. ``quality`` is a positive weight of each
    row (null: 1, below 1e-6: 1e-6); without it ``plainness`` is taken. ``taken`` is in words, repeats counted.

    Defined for odd rows: a null or empty text has size 0 and nothing of it is taken; rows of a null source form
    a source of their own, last in order; a row without an id is told apart by its text; rows that repeat an id
    share a key and stay separate rows; an empty table gives an empty table.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    weight = F.coalesce((plainness(F.col("text"), size) if quality is None else quality).cast("double"), F.lit(1.0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    key = -F.log(uniform(name)) / F.greatest(weight, F.lit(1e-6))
    keys = cut(docs.select("doc_id", "source", size.alias("size"), key.alias("key")))

    # partial sums meet, so a hot source moves a row for each task
    by_source = keys.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"), F.avg("key").alias("mean_key"))
    plan = cut(targets(by_source, cycle, cap)).withColumnRenamed("source", "s")
    d = keys.join(bounded(plan), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    # the distribution function of an exponential variable with the source's mean deals its keys evenly
    ranges = F.ceil(F.col("n_rows") / F.lit(range_rows))
    share = F.lit(1.0) - F.exp(-F.col("key") / F.greatest(F.col("mean_key"), F.lit(1e-300)))
    d = d.withColumn("range", F.least(ranges - 1, F.floor(share * ranges)).cast("long")).drop("n_rows", "mean_key")
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sums = cut(sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before")))
    d = d.join(bounded(sums), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")), "left").drop("s", "r")

    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    goal = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), goal - epochs * F.col("source_size") - start))
    taken = (epochs * F.col("size") + part).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


#: The same mix in DuckDB, with the level found by trying each source as the first that is not held.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / greatest(CASE WHEN text IS NULL THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * len(regexp_extract_all(text, '[#$%&|*!]')) / greatest(size, 1)) END, 1e-6::DOUBLE) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(source_size * 3 AS DOUBLE) AS most FROM s
), l AS (
  SELECT *, most / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT ratio AS f_ratio, rank AS f_rank, level AS f_level FROM l WHERE ratio >= level ORDER BY ratio, rank LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN f_level IS NOT NULL AND (ratio, rank) >= (f_ratio, f_rank) THEN weight * f_level ELSE most END AS target
  FROM l LEFT JOIN f ON true
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN goal // source_size * size + greatest(0, least(size, goal % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
