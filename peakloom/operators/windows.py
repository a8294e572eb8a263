"""Runs and islands: windows over ordered rows of a group."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], order: list[Column], breaks: Column, out: str = "run") -> DataFrame:
    """Numbers runs inside each group: ``breaks`` tells, from window functions over the order, whether a row opens one."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__open", F.when(breaks, 1).otherwise(0)).withColumn(out, F.sum("__open").over(w)).drop("__open")


def longest_run(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Length of each group's longest run of values that grow by exactly 1; an equal neighbour breaks a run."""
    w = W.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(w)
    own = rows.select(*keys, value).withColumn("__gap", gap).withColumn("__n", F.row_number().over(w))
    own = own.withColumn("run", F.sum(F.when(F.coalesce(F.col("__gap"), F.lit(0)) == 1, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("__len")).groupBy(*keys).agg(F.max("__len").alias(out))


def bounds(rows: DataFrame, value: str, ranges: int) -> list[float]:
    """At most ``ranges`` - 1 bounds that cut ``value`` into ranges of about as many rows each: approximate quantiles."""
    if ranges < 2:
        return []
    found = rows.select(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], max(1000, 10 * ranges))).head()
    return sorted({float(x) for x in (found[0] or [])})


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are at or below ``value``: a binary search, so many cuts cost little."""
    if not cuts:
        return F.lit(0)
    steps = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))])
    table = F.lit(cuts)
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(cuts)) & (F.element_at(table, F.least(n + s, F.lit(len(cuts)))) <= value), n + s).otherwise(n))


#: Rows up to which quantiles are one exact aggregation, whose task holds every distinct value.
EXACT_ROWS = 1_000_000


def quantiles(rows: DataFrame, value: Column | str, shares: list[float]) -> list[float | None]:
    """Exact interpolated quantiles (a median is share 0.5); None without values.  Nulls and NaN are left out.

    Beyond ``EXACT_ROWS`` no task holds all values: an approximate quantile on either side brackets each wanted rank, rows
    below the bracket are counted, and only the few distinct values inside are put in order."""
    own = rows.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    n = own.count()
    if n <= EXACT_ROWS:
        found = own.agg(F.percentile("__v", F.lit([float(s) for s in shares]))).head()[0]
        return [None] * len(shares) if found is None else [float(x) for x in found]
    slack, out = 5e-4, []
    for share in shares:
        low, high = own.select(F.percentile_approx("__v", [max(0.0, share - slack), min(1.0, share + slack)], 10_000)).head()[0]
        place = share * (n - 1)
        first, last = int(place), min(n - 1, int(place) + 1)
        before = own.where(F.col("__v") < low).count()
        inside = own.where(F.col("__v").between(low, high)).groupBy("__v").agg(F.count(F.lit(1)).alias("c")).withColumn("z", F.sum("c").over(W.orderBy("__v")))
        wanted = [float(inside.where(F.col("z") > rank - before).agg(F.min("__v")).head()[0]) for rank in sorted({first, last})]
        out.append(wanted[0] + (wanted[-1] - wanted[0]) * (place - first))
    return out


def weighted_quantiles(rows: DataFrame, value: str, weight: str, shares: list[float]) -> list[float | None]:
    """``quantiles`` of rows that stand for ``weight`` equal ones each (a whole number above 0).

    Beyond ``EXACT_ROWS`` rows a wanted rank is closed in on by passes over 1000 ranges each, until one holds few enough."""
    own = rows.select(F.col(value).cast("double").alias("__v"), F.col(weight).cast("long").alias("__w")).where("__v IS NOT NULL AND NOT isnan(__v)")
    n, total, low, high = own.agg(F.count(F.lit(1)), F.sum("__w"), F.min("__v"), F.max("__v")).head()
    if not n:
        return [None] * len(shares)
    if n <= EXACT_ROWS:
        return [float(x) for x in own.agg(F.percentile("__v", F.lit([float(s) for s in shares]), F.col("__w"))).head()[0]]

    def at(rank: int) -> float:
        """The value of rank ``rank``, counted from 0."""
        part, left, a, b = own, rank, low, high
        while a < b:
            step = F.least(F.lit(999), F.floor((F.col("__v") - a) / ((b - a) / 1000))).cast("int")
            found = part.groupBy(step.alias("s")).agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b")).orderBy("s").collect()
            for r in found:
                if left < r["w"]:
                    break
                left -= r["w"]
            part, a, b = part.where(F.col("__v").between(r["a"], r["b"])), r["a"], r["b"]
            if r["n"] <= EXACT_ROWS and a < b:
                few = part.groupBy("__v").agg(F.sum("__w").alias("c")).withColumn("z", F.sum("c").over(W.orderBy("__v")))
                return float(few.where(F.col("z") > left).agg(F.min("__v")).head()[0])
        return a

    out = []
    for share in shares:
        place = share * (total - 1)
        first, last = int(place), min(total - 1, int(place) + 1)
        x = at(first)
        out.append(x + ((at(last) if last > first else x) - x) * (place - first))
    return out


def shared_checkpoints(spark: SparkSession) -> None:
    """Names a checkpoint folder where none is set: that of the session's settings, else one of the warehouse, which a
    cluster shares; a temporary one only if driver and executors are one local process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="peakloom-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_peakloom"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
