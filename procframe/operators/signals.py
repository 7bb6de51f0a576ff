"""Signals in long form: models, differences, quantisation, statistics and residuals as DataFrame plans.

Positions come from a window over one series in time order (a sort that spills, nothing is held); ranges of groups come
from a small aggregate that is joined back, so no group is gathered; the rest are partial aggregates. Each query has its
definition a second time as SQL for another engine (ORACLES), written from the definition and not from the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compression import residual, residual_statistics

Query = Callable[[SparkSession, str], DataFrame]
#: Groups up to which their ranges are broadcast; beyond, a shuffled join.
BROADCAST_GROUPS = 100_000
CONSTANT, FLAT = 1e-15, 1e-10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, n, value) of each user's events in time order."""
    mine = Window.partitionBy("user_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ordered = F.row_number().over(mine.orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("series_id"), (ordered - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(mine).alias("n"), "value")


def unit_position(pos: Column, n: Column) -> Column:
    return F.when(n > 1, pos.cast("double") / (n - 1)).otherwise(0.0)


def linear_fits(series: DataFrame) -> DataFrame:
    """(series_id, n, slope, intercept, variance, error, cost) by least squares; a constant has degree 0 and no error."""
    x = unit_position(F.col("pos"), F.col("n"))
    sums = series.withColumn("x", x).groupBy("series_id").agg(F.max("n").alias("n"), F.regr_slope("value", "x").alias("a"), F.avg("value").alias("mean"), F.avg("x").alias("mx"), F.regr_r2("value", "x").alias("r2"), F.var_pop("value").alias("variance"))
    flat = F.col("variance") < CONSTANT
    slope = F.when(flat, 0.0).otherwise(F.col("a"))
    return sums.where("n > 1").select("series_id", "n", slope.alias("slope"), (F.col("mean") - slope * F.col("mx")).alias("intercept"), "variance", F.when(flat, 0.0).otherwise(1 - F.col("r2")).alias("error"), F.when(flat, 40).otherwise(48).alias("cost"))


def deltas(series: DataFrame) -> DataFrame:
    before = F.lag("value", 1, 0.0).over(Window.partitionBy("series_id").orderBy("pos"))
    return series.withColumn("delta", F.col("value") - before)


def undeltas(encoded: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return encoded.withColumn("value", F.sum("delta").over(so_far))


def with_range(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with lo and scale of their group (scale 1 for a range below FLAT): an aggregate, joined back null-safely."""
    ranges = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ranges = ranges.select(F.col(group).alias("__group"), "lo", F.when(F.col("hi") - F.col("lo") < FLAT, 1.0).otherwise(F.col("hi") - F.col("lo")).alias("scale"))
    small = ranges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(ranges) if small else ranges, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def level(value: Column, lo: Column, scale: Column, bits: int, rounding: str = "half_away") -> Column:
    part = (value - lo) / scale * (2**bits - 1)
    return {"half_away": F.round(part), "half_even": F.rint(part), "truncate": F.floor(part)}[rounding].cast("long")


def unlevel(q: Column, lo: Column, scale: Column, bits: int) -> Column:
    return q.cast("double") / (2**bits - 1) * scale + lo


def histogram_entropy(rows: DataFrame, group: str, value: str, bins: int = 256) -> DataFrame:
    """(group, entropy) in bits of `bins` equal bins over each group's range; 0 for a constant group."""
    spread = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    each = rows.join(spread, group)
    part = F.when(F.col("hi") - F.col("lo") < FLAT, F.lit(0)).otherwise(F.floor((F.col(value) - F.col("lo")) * (bins - 1) / (F.col("hi") - F.col("lo"))))
    counted = each.groupBy(group, part.alias("bin")).agg((F.count(F.lit(1)) / F.max("n")).alias("p"))
    return counted.groupBy(group).agg((F.sum(F.col("p") * F.log2("p")) * -1 + 0.0).alias("entropy"))


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_range(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("v")), "l_returnflag", "v")


def _quantised(bits: int, rounding: str = "half_away") -> Query:
    return lambda spark, sf_dir: _lineitem(spark, sf_dir).select("l_returnflag", "l_orderkey", "l_linenumber", level(F.col("v"), F.col("lo"), F.col("scale"), bits, rounding).alias("q"))


def _dequantised(bits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = level(F.col("v"), F.col("lo"), F.col("scale"), bits)
        return _lineitem(spark, sf_dir).select("l_returnflag", "l_orderkey", "l_linenumber", F.round(unlevel(q, F.col("lo"), F.col("scale"), bits), 4).alias("value"))

    return run


def quant_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("v") - unlevel(level(F.col("v"), F.col("lo"), F.col("scale"), 8), F.col("lo"), F.col("scale"), 8)
    stats = _lineitem(spark, sf_dir).withColumn("e", e).groupBy("l_returnflag").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.max("scale").alias("scale"))
    return stats.select("l_returnflag", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"), F.round(F.log10(F.col("scale") / F.sqrt("mse")) * 20, 4).alias("psnr"))


def fit_linear_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = linear_fits(user_series(spark, sf_dir))
    return f.select(F.col("series_id").alias("user_id"), "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("error", 6).alias("error"), "cost", F.round(F.col("n") * 4.0 / F.col("cost"), 6).alias("ratio"))


def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(user_series(spark, sf_dir)).select(F.col("series_id").alias("user_id"), F.col("pos").alias("i"), F.round("delta", 6).alias("delta"))


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undeltas(deltas(user_series(spark, sf_dir)).drop("value")).select(F.col("series_id").alias("user_id"), F.col("pos").alias("i"), F.round("value", 4).alias("value"))


def amplitude_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("dc"), F.round((F.max("value") - F.min("value")) / 2, 6).alias("amplitude"), F.round(F.var_pop("value"), 6).alias("variance"))


def signal_entropy256(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "value")
    constant = events.select((-F.col("user_id") - 1).alias("user_id"), F.lit(3.14).alias("value"))  # a constant series beside each
    return histogram_entropy(events.union(constant), "user_id", "value").select("user_id", F.round("entropy", 6).alias("entropy"))


def line_values(series: DataFrame) -> DataFrame:
    """(series_id, pos, value) of each series' straight line."""
    fits = linear_fits(series).select("series_id", "slope", "intercept")
    return series.join(fits, "series_id").select("series_id", "pos", (F.col("slope") * unit_position(F.col("pos"), F.col("n")) + F.col("intercept")).alias("value"))


def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = user_series(spark, sf_dir).where("n > 1")
    r = residual_statistics(series, residual(series, line_values(series)))
    rounded = [F.round(c, 5).alias(c) for c in ("min", "max", "std", "rmse", "mae", "relative_rmse", "psnr", "sparsity")]
    return r.select(F.col("series_id").alias("user_id"), "n", *rounded, "raw_size", "method")


def zero_crossings(series: DataFrame) -> DataFrame:
    """(series_id, n, crossings, frequency) by the mean gap of changes of sign around the mean; two at least."""
    mine = Window.partitionBy("series_id")
    centred = series.select("series_id", "pos", "n", F.round(F.col("value") - F.avg("value").over(mine), 9).alias("c"))
    turned = centred.withColumn("p", F.lag("c").over(mine.orderBy("pos"))).where((F.col("p") < 0) != (F.col("c") < 0))
    found = turned.groupBy("series_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("crossings"), F.min("pos").alias("first"), F.max("pos").alias("last")).where("crossings > 1")
    return found.select("series_id", "n", "crossings", (F.col("n") * (F.col("crossings") - 1) / (2 * (F.col("last") - F.col("first")))).alias("frequency"))


def zero_crossing_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zero_crossings(user_series(spark, sf_dir))
    return found.select(F.col("series_id").alias("user_id"), "n", "crossings", F.round("frequency", 6).alias("frequency"))


def dft_magnitudes(spark: SparkSession, sf_dir: str, bins: int = 32) -> DataFrame:
    """Magnitudes of each embedding's first frequencies, computed within its row: sums over the vector, no join or shuffle."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))

    def part(wave: Callable[[Column], Column], k: Column) -> Column:
        return F.aggregate(F.transform("v", lambda v, i: v * wave(k * i * (2 * 3.141592653589793) / F.size("v"))), F.lit(0.0), lambda a, b: a + b)

    rows = vectors.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("k"))
    re, im = part(F.cos, F.col("k")), part(F.sin, F.col("k"))
    return rows.select("vec_id", "k", F.round(F.sqrt(re * re + im * im), 5).alias("magnitude"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (fit_linear_by_user, delta_encode, delta_decode, quant_error_stats, amplitude_by_user, signal_entropy256, residual_stats, zero_crossing_freq, dft_magnitudes)}
QUERIES |= {"quantize8": _quantised(8), "quantize16": _quantised(16), "quantize12_half_even": _quantised(12, "half_even"), "quantize8_truncate": _quantised(8, "truncate"), "dequantize8": _dequantised(8), "dequantize16": _dequantised(16)}

_SERIES = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events"
_SUMS = f"""SELECT user_id, n::DOUBLE AS n, sum(x) AS sx, sum(value) AS sy, sum(x * x) AS sxx, sum(x * value) AS sxy, sum(value * value) AS syy, avg(value) AS mean, var_pop(value) AS var
    FROM (SELECT *, i / (n - 1)::DOUBLE AS x FROM ({_SERIES}) WHERE n > 1) GROUP BY user_id, n"""
_LINE = f"""SELECT user_id, n, CASE WHEN var < 1e-15 THEN 0 ELSE slope END AS slope, CASE WHEN var < 1e-15 THEN mean ELSE (sy - slope * sx) / n END AS intercept, var
    FROM (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM ({_SUMS}))"""
_MISSED = f"SELECT s.user_id, s.i, s.n, s.value, l.slope, l.intercept, l.var, s.value - (l.intercept + l.slope * s.i / (s.n - 1)) AS r FROM ({_SERIES}) s JOIN ({_LINE}) l USING (user_id)"
_PRICES = "SELECT l.*, lo, CASE WHEN hi - lo < 1e-10 THEN 1 ELSE hi - lo END AS scale FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS v FROM lineitem) l JOIN (SELECT l_returnflag AS g, min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem GROUP BY 1) ON l_returnflag IS NOT DISTINCT FROM g"
ORACLES: dict[str, str] = {
    "fit_linear_by_user": f"""
        SELECT m.user_id, count(*) AS n, round(any_value(slope), 6) AS slope, round(any_value(intercept), 6) AS intercept,
               round(CASE WHEN any_value(var) < 1e-15 THEN 0 ELSE avg(r * r) / any_value(var) END, 6) AS error, CASE WHEN any_value(var) < 1e-15 THEN 40 ELSE 48 END::INT AS cost,
               round(4.0::DOUBLE * count(*) / CASE WHEN any_value(var) < 1e-15 THEN 40 ELSE 48 END, 6) AS ratio FROM ({_MISSED}) m GROUP BY m.user_id""",
    "delta_encode": f"SELECT a.user_id, a.i, round(a.value - coalesce(b.value, 0), 6) AS delta FROM ({_SERIES}) a LEFT JOIN ({_SERIES}) b ON a.user_id = b.user_id AND a.i = b.i + 1",
    "delta_decode": f"SELECT user_id, i, round(value, 4) AS value FROM ({_SERIES})",
    **{f"quantize{b}": f"SELECT l_returnflag, l_orderkey, l_linenumber, floor((v - lo) / scale * {2**b - 1} + 0.5)::BIGINT AS q FROM ({_PRICES})" for b in (8, 16)},
    "quantize12_half_even": f"SELECT l_returnflag, l_orderkey, l_linenumber, round_even((v - lo) / scale * 4095, 0)::BIGINT AS q FROM ({_PRICES})",
    "quantize8_truncate": f"SELECT l_returnflag, l_orderkey, l_linenumber, trunc((v - lo) / scale * 255)::BIGINT AS q FROM ({_PRICES})",
    **{f"dequantize{b}": f"SELECT l_returnflag, l_orderkey, l_linenumber, round(floor((v - lo) / scale * {2**b - 1} + 0.5) * scale / {2**b - 1} + lo, 4) AS value FROM ({_PRICES})" for b in (8, 16)},
    "quant_error_stats": f"""
        SELECT l_returnflag, round(avg(e ** 2), 4) AS mse, round(avg(abs(e)), 4) AS mae, round(10 * log10(max(scale) ** 2 / avg(e ** 2)), 4) AS psnr
        FROM (SELECT l_returnflag, scale, v - lo - floor((v - lo) / scale * 255 + 0.5) * scale / 255 AS e FROM ({_PRICES})) GROUP BY l_returnflag""",
    "amplitude_by_user": "SELECT user_id, round(sum(value) / count(value), 6) AS dc, round(0.5::DOUBLE * (max(value) - min(value)), 6) AS amplitude, round(stddev_pop(value) ** 2, 6) AS variance FROM events GROUP BY user_id",
    "signal_entropy256": """
        SELECT user_id, round(log2(sum(c)::DOUBLE) - sum(c * log2(c::DOUBLE)) / sum(c), 6) AS entropy FROM (
            SELECT user_id, bin, count(*)::DOUBLE AS c FROM (
                SELECT e.user_id, floor((value - lo) * 255 / nullif(hi - lo, 0)) AS bin FROM events e JOIN (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id) r USING (user_id)
            ) GROUP BY user_id, bin) GROUP BY user_id
        UNION ALL SELECT DISTINCT -user_id - 1, 0.0::DOUBLE FROM events""",
    "residual_stats": f"""
        SELECT user_id, n, round("min", 5) AS "min", round("max", 5) AS "max", round(std, 5) AS std, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(rel, 5) AS relative_rmse, round(psnr, 5) AS psnr, round(sparsity, 5) AS sparsity, 4 * n AS raw_size,
               CASE WHEN rel < 0.001 THEN 'lzma' WHEN rel < 0.01 THEN 'zlib' WHEN sparsity > 0.5 THEN 'delta' ELSE 'quantized' END AS method FROM (
            SELECT *, CASE WHEN span > 1e-10 THEN rmse / span ELSE 0 END AS rel, CASE WHEN span > 1e-10 AND rmse > 0 THEN -20 * log10(rmse / span) ELSE 'inf'::DOUBLE END AS psnr FROM (
                SELECT user_id, count(*) AS n, min(r) AS "min", max(r) AS "max", any_value(s) AS std, sqrt(sum(r * r) / count(*)) AS rmse, sum(abs(r)) / count(*) AS mae, max(value) - min(value) AS span, avg((abs(r) < 0.1 * s)::INT) AS sparsity
                FROM (SELECT *, stddev_pop(r) OVER (PARTITION BY user_id) AS s FROM ({_MISSED})) GROUP BY user_id))""",
    "zero_crossing_freq": f"""
        WITH c AS (SELECT s.user_id, i, n, round(value - mean, 9) < 0 AS below FROM ({_SERIES}) s JOIN (SELECT user_id, avg(value) AS mean FROM events GROUP BY user_id) USING (user_id)),
             t AS (SELECT b.* FROM c a JOIN c b ON a.user_id = b.user_id AND b.i = a.i + 1 AND a.below <> b.below),
             g AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM t)
        SELECT user_id, max(n) AS n, count(*) AS crossings, round(max(n) / (2 * avg(gap)), 6) AS frequency FROM g GROUP BY user_id HAVING count(*) > 1""",
    "dft_magnitudes": """
        SELECT vec_id, k, round(sqrt(sum(v * cos(a)) ** 2 + sum(v * sin(a)) ** 2), 5) AS magnitude FROM (
            SELECT vec_id, v, k, 2 * pi() * ((k * i) % n) / n AS a FROM (SELECT vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), (SELECT range AS k FROM range(32))
        ) GROUP BY vec_id, k""",
}
