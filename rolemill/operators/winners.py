"""First-wins rules without windows over whole groups.

A window partitioned by a key sorts the whole group in one task, which a hot key
does not survive. Here the winner of a group is an aggregate (partial sums on
the map side, one small row per key after the shuffle), and rows meet their
verdict again by the unique row number, which spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEQ = "row_seq"
RANGE_ROWS = 1 << 16


def first_rows(df: DataFrame, *keys: str, seq: str = SEQ) -> DataFrame:
    """Row number of the first row per key; rows with a null key take no part."""
    filled = df
    for key in keys:
        filled = filled.filter(F.col(key).isNotNull())
    return filled.groupBy(*keys).agg(F.min(seq).alias(seq))


def mark(df: DataFrame, rows: DataFrame, flag: str, seq: str = SEQ) -> DataFrame:
    """Add a flag that is true for the row numbers in ``rows``."""
    hits = rows.select(seq).withColumn(flag, F.lit(True))
    return df.join(hits, seq, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def keep_first(df: DataFrame, key: str, seq: str = SEQ, keep_blank: bool = True) -> DataFrame:
    """First row per key; rows without a key all stay, or all go."""
    marked = mark(df, first_rows(df, key, seq=seq), "_first", seq)
    kept = F.col("_first") | F.col(key).isNull() if keep_blank else F.col("_first")
    return marked.filter(kept).drop("_first")


def best_rows(df: DataFrame, keys: list[str], score: str, seq: str = SEQ) -> DataFrame:
    """Row number of the highest score per key, ties to the lowest row number."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(seq)).alias("back"))).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, (-F.col("best.back")).alias(seq))


def positions(df: DataFrame, keys: list[str], seq: str = SEQ, out: str = "pos") -> DataFrame:
    """1-based position inside each group in row order, without one task per group.

    The unique row number is cut into ranges of 65,536, so a (group, range) cell
    has a bounded size whatever the group's size. Only the per-range counts are
    summed along the group.
    """
    ranged = df.withColumn("_range", F.floor(F.col(seq) / RANGE_ROWS))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_range").orderBy(seq)
    numbered = ranged.withColumn("_at", F.row_number().over(inside))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_range"]]
    joined = numbered.alias("a").join(offsets.alias("b"), _all(same), "left")
    columns = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*columns, (F.col("b._before") + F.col("a._at")).alias(out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def attach_group(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left-join one row per key onto the rows, safe for hot keys; a null key has none.

    Both sides are joined by the key and its hash. Aggregated groups are dealt by the key alone, so
    either side gets an exchange of its own for this join, and where a key is hot Spark splits its
    rows over tasks. Small groups are broadcast if Spark measures them so.
    """
    values = [c for c in groups.columns if c != key]
    right = groups.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"), *values)
    joined = df.join(right, (F.col(key) == F.col("_key")) & (F.xxhash64(F.col(key)) == F.col("_hash")), "left")
    return joined.select(*df.columns, *values)


def unique_rows(df: DataFrame, key: str, seq: str = SEQ) -> DataFrame:
    """Row numbers of keys that occur exactly once."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias(seq))
    return counted.filter(F.col("_n") == 1).select(seq)
