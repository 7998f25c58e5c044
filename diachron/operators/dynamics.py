"""Speed and acceleration of shares between years, percentile caps and colours."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Light and full end of each colour ramp.
SPEED = (((255, 205, 210), (211, 47, 47)), ((187, 222, 251), (21, 101, 194)))
ACCEL = (((255, 224, 178), (245, 124, 0)), ((200, 230, 201), (46, 125, 50)))


def log2fc(c1: Column, t1: Column, c0: Column, t0: Column) -> Column:
    return F.log2(((c1 + 0.5) / t1) / ((c0 + 0.5) / t0))


def _years(counts: DataFrame, keys: list[str], years: list[int]) -> DataFrame:
    """One row per key with the count of each year (0 if absent) and the years' totals: one pass, no join per year."""
    n = [F.sum(F.when(F.col("year") == y, F.col("n")).otherwise(0)).alias(f"c{i}") for i, y in enumerate(years)]
    wide = counts.where(F.col("year").isin(years)).groupBy(*keys).agg(*n)
    totals = counts.where(F.col("year").isin(years)).agg(*[F.sum(F.when(F.col("year") == y, F.col("n")).otherwise(0)).cast("double").alias(f"t{i}") for i, y in enumerate(years)])
    return wide.crossJoin(F.broadcast(totals))  # totals: one row


def speed(counts: DataFrame, keys: list[str], year: int, before: int) -> DataFrame:
    """``counts`` (year, keys, n) -> log2 fold change of shares between two years."""
    w = _years(counts, keys, [year, before])
    return w.select(*keys, F.col("c0").alias("n1"), F.col("c1").alias("n0"), log2fc(F.col("c0"), F.col("t0"), F.col("c1"), F.col("t1")).alias("speed"))


def accel(counts: DataFrame, keys: list[str], year: int) -> DataFrame:
    """Second difference of shares over three years."""
    w = _years(counts, keys, [year, year - 1, year - 2])
    return w.select(*keys, (F.col("c0") / F.col("t0") - 2 * F.col("c1") / F.col("t1") + F.col("c2") / F.col("t2")).alias("accel"))


def endpoint_counts(edge_list: DataFrame, df: DataFrame) -> DataFrame:
    """Full-graph variant: an edge's count in a year is the sum of its ends' document frequencies."""
    names = edge_list.select("a", "b").distinct()
    ends = names.select("a", "b", F.explode(F.array("a", "b")).alias("phrase"))
    return ends.join(df, "phrase").groupBy("year", "a", "b").agg(F.sum("df").alias("n"))


def percentile_exclusive(values: DataFrame, column: str, q: int = 95, by: list[str] | None = None) -> DataFrame:
    """The exclusive percentile (it extrapolates on small samples) from two ranked values per group, ``cap``.

    Only the rows at the two ranks it needs leave the window; a single value is its own
    percentile.
    """
    keys = by or []
    counted = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("v"))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("only"))
    ranked = counted.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("v")))
    joined = ranked.join(F.broadcast(sizes), keys) if keys else ranked.crossJoin(F.broadcast(sizes))
    m = F.col("n") + 1
    j = F.greatest(F.lit(1), F.least(F.floor(q * m / 100), F.col("n") - 1))
    cells = joined.withColumn("j", j).withColumn("d", q * m - 100 * F.col("j")).where((F.col("rn") == F.col("j")) | (F.col("rn") == F.col("j") + 1))
    value = F.sum(F.when(F.col("rn") == F.col("j"), F.col("v") * (100 - F.col("d"))).otherwise(F.col("v") * F.col("d"))) / 100
    return cells.groupBy(*keys).agg(F.when(F.max("n") == 1, F.min("only")).otherwise(value).alias("cap"))


def ramp(v: Column, up: Column, down: Column, colours: tuple) -> Column:
    """Hex colour of a signed value: light at zero, full at the cap of its sign; channels are truncated."""
    def side(t: Column, ends: tuple) -> Column:
        channel = lambda k: (F.lit(float(ends[0][k])) + (ends[1][k] - ends[0][k]) * t).cast("int")
        return F.format_string("#%02x%02x%02x", channel(0), channel(1), channel(2))

    t_up = F.when(up > 0, F.least(F.lit(1.0), v / up)).otherwise(0.0)
    t_down = F.when(down > 0, F.least(F.lit(1.0), -v / down)).otherwise(0.0)
    return F.when(v >= 0, side(t_up, colours[0])).otherwise(side(t_down, colours[1]))


def adaptive_max(nodes: Column, edge_count: Column, largest: float = 40.0) -> Column:
    n = F.greatest(nodes + edge_count, F.lit(1))
    return F.greatest(F.lit(6.0), F.least(F.lit(largest), largest * F.sqrt(1500.0 / n)))


def node_size(df: Column, low: Column, high: Column, least: float, most: Column) -> Column:
    return F.when(low == high, most * 0.4).otherwise(least + (most - least) * (df - low) / (high - low))


def edge_width(w: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, 1.5).otherwise(0.5 + 4.5 * (w - low) / (high - low))


def edge_width_saturating(w: Column) -> Column:
    return 1.0 + 4.0 * F.least(F.lit(1.0), w / 200.0)
