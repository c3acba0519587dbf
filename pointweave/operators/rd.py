"""Rate-distortion curves and their Bjontegaard comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(points: DataFrame) -> DataFrame:
    return points.where(~F.isnan("metric") & (F.abs("metric") < float("inf")))


def lossless(points: DataFrame) -> DataFrame:
    """(cloud, method, lossless_rate, finite): the least rate of a curve's points without any error, and how many others it
    has; a curve of lossless points alone has 0, one without any no rate."""
    ends = points.groupBy("cloud", "method").agg(F.min(F.when(F.col("metric") == float("inf"), F.col("rate"))).alias("lossless_rate"))
    n = finite(points).groupBy("cloud", "method").agg(F.count("*").alias("finite"))
    return ends.join(n, ["cloud", "method"], "left").withColumn("finite", F.coalesce("finite", F.lit(0).cast("long")))


#: A cubic's coefficients.
ORDER = 4


def cubics(points: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    """(by, low, high, a0..a2, b1, b2, c0..c3): the least squares cubic of each group's points, as c0 + c1 p1 + c2 p2 + c3 p3
    with the polynomials p1 = x - a0, p2 = (x - a1) p1 - b1, p3 = (x - a2) p2 - b2 p1, which are orthogonal on the points:
    each coefficient is a quotient of two sums, and none is solved for. A group of fewer than four different x has no c3."""
    w = Window.partitionBy(*by)
    over = lambda c: F.sum(c).over(w)
    col, square = F.col, lambda p: F.col(p) * F.col(p)
    rows = points.select(*by, x.alias("x"), y.alias("y"))
    rows = rows.withColumns({"a0": F.avg("x").over(w), "c0": F.avg("y").over(w), "n": F.count("*").over(w)}).withColumn("p1", col("x") - col("a0"))
    rows = rows.withColumns({"s1": over(square("p1")), "u1": over(col("x") * square("p1")), "v1": over(col("y") * col("p1"))})
    rows = rows.withColumns({"a1": F.try_divide("u1", "s1"), "b1": col("s1") / col("n")}).withColumn("p2", (col("x") - col("a1")) * col("p1") - col("b1"))
    rows = rows.withColumns({"s2": over(square("p2")), "u2": over(col("x") * square("p2")), "v2": over(col("y") * col("p2"))})
    rows = rows.withColumns({"a2": F.try_divide("u2", "s2"), "b2": F.try_divide("s2", "s1")}).withColumn("p3", (col("x") - col("a2")) * col("p2") - col("b2") * col("p1"))
    same = ["a0", "a1", "a2", "b1", "b2", "c0", "s1", "s2", "v1", "v2"]
    out = rows.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count_distinct("x").alias("places"), *(F.max(c).alias(c) for c in same), F.sum(square("p3")).alias("s3"), F.sum(col("y") * col("p3")).alias("v3"))
    c = {f"c{i}": F.try_divide(f"v{i}", f"s{i}") for i in (1, 2, 3)}
    c["c3"] = F.when(col("places") >= ORDER, c["c3"])
    return out.withColumns(c).select(*by, "low", "high", "a0", "a1", "a2", "b1", "b2", *(f"c{i}" for i in range(ORDER)))


def mean_of(p: str, low: Column, high: Column) -> Column:
    """The mean of a cubic (columns with the prefix p) between two ends: its integral in closed form, as Simpson's rule is
    exact for cubics."""

    def at(x: Column) -> Column:
        c = lambda n: F.col(p + n)
        p1 = x - c("a0")
        p2 = (x - c("a1")) * p1 - c("b1")
        return c("c0") + c("c1") * p1 + c("c2") * p2 + c("c3") * ((x - c("a2")) * p2 - c("b2") * p1)

    return (at(low) + 4 * at((low + high) / 2) + at(high)) / 6


def gaps(points: DataFrame, anchor: str, by: list[str]) -> DataFrame:
    """(by, method, gap): the mean of each method's cubic y(x) less that of its group's anchor, over the x that both cover;
    null where that is one point or a curve has too few."""
    fits = cubics(points, F.col("x"), F.col("y"), [*by, "method"])
    columns = [c for c in fits.columns if c not in (*by, "method")]
    base = fits.where(F.col("method") == anchor).select(*by, *(F.col(c).alias(f"a_{c}") for c in columns))
    both = fits.where(F.col("method") != anchor).select(*by, "method", *(F.col(c).alias(f"m_{c}") for c in columns)).join(base, by)
    both = both.withColumns({"low": F.greatest("a_low", "m_low"), "high": F.least("a_high", "m_high")})
    low, high = F.col("low"), F.col("high")
    return both.select(*by, "method", F.when(low != high, mean_of("m_", low, high) - mean_of("a_", low, high)).alias("gap"))


def compared(points: DataFrame, anchor: str, by: list[str] = ["cloud"]) -> DataFrame:  # noqa: B006
    """(by, method, bd_rate, bd_snr) of each method against the anchor: the mean gap of log rates as a percentage (its
    exponent 200 at most), and of metrics, 0 where curves share one rate alone. Points without a finite metric or a positive
    rate are left out; curves of fewer than four different points have no comparison."""
    log = F.log(F.col("rate"))
    # each curve both ways: log rates over metrics, and metrics over log rates
    ways = F.array(F.struct(F.lit("rate").alias("way"), F.col("metric").alias("x"), log.alias("y")), F.struct(F.lit("snr").alias("way"), log.alias("x"), F.col("metric").alias("y")))
    rows = finite(points).where("rate > 0").select(*by, "method", F.explode(ways).alias("w")).select(*by, "method", "w.*")
    of = lambda way: F.max(F.when(F.col("way") == way, F.col("gap")))
    found = gaps(rows, anchor, [*by, "way"]).groupBy(*by, "method").agg(of("rate").alias("g"), of("snr").alias("s"))
    rate = (F.exp(F.when(F.col("g") > 200, 200.0).otherwise(F.col("g"))) - 1) * 100
    return found.select(*by, "method", rate.alias("bd_rate"), F.when(F.col("g").isNotNull(), F.coalesce("s", F.lit(0.0))).otherwise(F.col("s")).alias("bd_snr"))
