"""Models of series: sine, Fourier and polynomial fits, the choice among them, and lossless forms, by packed series.

A series is packed into one row and modelled there in Arrow batches, as the transform needs it whole; straight lines,
which need sums alone, are in `signals`. Queries model one signal for each user of `events`: where its kind says so the
values are replaced by a sine, a chord, a cubic or a constant of the same length, so that every model is met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..plans import compression
from . import generators
from .signals import _SERIES, Query, table, unit_position, user_series

#: Degrees that the polynomial queries try.
DEGREE = 3


def mixed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, n, value): by series_id mod 5 a sine, two sines, a cubic, a constant, or the events' values."""
    s = user_series(spark, sf_dir)
    i, n, kind = F.col("pos"), F.col("n"), F.col("series_id") % 5
    cycles, x = (F.col("series_id") % 7 + 1).cast("double"), unit_position(F.col("pos"), F.col("n"))
    one = generators.sine_value(i, n, cycles, 2.0, 0.3, 1.5)
    chord = generators.sine_value(i, n, cycles, 1.5) + generators.sine_value(i, n, cycles + 4, 0.8)
    value = F.when(kind == 0, one).when(kind == 1, chord).when(kind == 2, generators.horner(x, [1, -2, 1, 0.1])).when(kind == 3, 3.25).otherwise(F.col("value"))
    return s.select("series_id", "pos", "n", value.alias("value"))


def packed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.pack_series(mixed_series(spark, sf_dir))


def fit_sine_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression.fit_series(packed_series(spark, sf_dir), "sine")
    names = ["frequency", "amplitude", "phase", "dc_offset"]
    return found.select(F.col("series_id").alias("user_id"), "n", *[F.round(F.col("coefficients")[k], 5).alias(name) for k, name in enumerate(names)], F.round("error", 5).alias("error"), "cost")


def fit_fourier_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a term: its bin and magnitude, with the fit's number of terms, error and cost."""
    found = compression.fit_series(packed_series(spark, sf_dir), "fourier")
    terms = found.withColumn("terms", F.expr("(size(coefficients) - 1) div 3").cast("int"))
    place = F.explode(F.sequence(F.lit(0), F.col("terms") - 1)).alias("place")
    each = terms.select("*", place)
    bin_, magnitude = F.get("coefficients", F.col("place") * 3).cast("long"), F.get("coefficients", F.col("place") * 3 + 1)
    return each.select(F.col("series_id").alias("user_id"), "terms", bin_.alias("bin"), F.round(magnitude, 3).alias("magnitude"), F.round("error", 4).alias("error"), "cost")


def fit_polynomial_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first degree up to DEGREE with an error below 0.01."""
    found = compression.fit_series(packed_series(spark, sf_dir), "polynomial")
    degree = F.size("coefficients") - 1
    return found.where(degree <= DEGREE).select(F.col("series_id").alias("user_id"), degree.alias("degree"), F.round("error", 5).alias("error"), F.round(F.element_at("coefficients", -1), 4).alias("at_zero"), "cost")


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression.fit_series(packed_series(spark, sf_dir))
    return found.select(F.col("series_id").alias("user_id"), "n", "method", F.round("ratio", 5).alias("ratio"))


def lossless_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every series after modelling, packing and unpacking."""
    back = compression.decompress_series(compression.compress_series(packed_series(spark, sf_dir)))
    return compression.unpack_series(back).select(F.col("series_id").alias("user_id"), F.col("pos").cast("long").alias("i"), F.round("value", 6).alias("value"))


def quantised_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each series comes back within one level of its residual's range, 8 and 16 bits."""
    packed = packed_series(spark, sf_dir)
    out = []
    for bits in (8, 16):
        c = compression.compress_series(packed, bits=bits)
        back = compression.decompress_series(c).withColumnRenamed("values", "back")
        step = (F.coalesce(F.col("high") - F.col("low"), F.lit(0.0)) / (2**bits - 1) + 1e-9).alias("step")
        both = packed.join(back, "series_id").join(c.select("series_id", step), "series_id")
        worst = F.array_max(F.zip_with("values", "back", lambda a, b: F.abs(a - b)))
        out.append(both.select(F.col("series_id").alias("user_id"), F.lit(bits).alias("bits"), (worst <= F.col("step")).alias("close")))
    return out[0].union(out[1])


def residual_method_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each method takes for what the chosen model misses, and the least of them."""
    schema = f"user_id long, model string, {', '.join(f'{m} int' for m in codecs.METHODS)}, method string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                values = np.array(r["values"], float)
                fit = compression.fits.analyse(values)
                sizes = codecs.residual_sizes(values - compression.fits.reconstruct(fit, len(values)))
                rows.append((r["series_id"], fit.method, *sizes.values(), min(sizes, key=sizes.get)))
            yield compression._batch(rows, schema)

    return packed_series(spark, sf_dir).mapInArrow(run, schema)


def subband_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as coefficients of eight sub-bands by order, through their codec: count, settings, and the farthest miss."""
    bands = list(codecs.SUBBANDS)
    names = F.array(*[F.lit(b) for b in bands])
    rows = table(spark, sf_dir, "lineitem").select(F.element_at(names, (F.col("l_orderkey") % 8 + 1).cast("int")).alias("band"), (F.col("l_orderkey") / 512).cast("long").alias("block"), F.col("l_extendedprice").cast("int").alias("c"))
    packed = rows.groupBy("band", "block").agg(F.collect_list("c").alias("c"))
    schema = "band string, block long, n int, bits int, preset int, close boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c = np.array(r["c"], np.int64)
                bits, preset = codecs.subband_settings(r["band"])
                missed = np.abs(codecs.decompress_subband(codecs.compress_subband(c, r["band"])) - c).max()
                out.append((r["band"], r["block"], len(c), bits, preset, bool(missed <= np.ptp(c) / (2**bits - 1) + 1)))
            yield compression._batch(out, schema)

    return packed.mapInArrow(run, schema)


def subband_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated ratios of the four tiers of sub-bands for as many coefficients as a flag has lines."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    grow = F.greatest(F.lit(1.0), F.log(F.col("n") / 1024.0))
    tiers = {"lll": "LLL", "low": "LLH", "mid": "LHH", "hhh": "HHH"}
    return n.select("l_returnflag", "n", *[F.round(grow * codecs.SUBBANDS[band][1], 6).alias(name) for name, band in tiers.items()])


def total_estimate_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole size, ratio and shares for straight lines whose residual stays as it is."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    whole = n.select("user_id", compression.total_estimate(F.col("n") * 4, F.lit(48), F.col("n")).alias("t"))
    return whole.select("user_id", F.col("t.total").alias("total"), *[F.round(f"t.{c}", 6).alias(c) for c in ("ratio", "parameters_share", "residual_share")])


def quality_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR and one-window similarity of prices against 8-bit prices, on a scale of 255."""
    from .signals import _lineitem, level, unlevel

    rows = _lineitem(spark, sf_dir)
    shade = (F.col("v") - F.col("lo")) / F.col("scale") * 255
    coarse = (unlevel(level(F.col("v"), F.col("lo"), F.col("scale"), 8), F.col("lo"), F.col("scale"), 8) - F.col("lo")) / F.col("scale") * 255
    stats = rows.select("l_returnflag", shade.alias("a"), coarse.alias("b")).groupBy("l_returnflag").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"), compression.similarity("a", "b").alias("ssim"))
    return stats.select("l_returnflag", F.round(compression.psnr(F.col("mse"), F.lit(255.0)), 3).alias("psnr"), F.round("ssim", 6).alias("ssim"))


def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, mean ratios, best and worst series, of three made-up methods' ratios by user."""
    base = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ratio = {"a": F.col("n") * 4 / 64.0, "b": F.col("n") * 4 / (F.col("user_id") % 40 + 40.5), "c": F.lit(2.0)}
    rows = [base.select(F.concat(F.lit("u"), F.col("user_id")).alias("dataset"), F.lit(m).alias("method"), F.round(r + F.col("user_id") / 1e7, 7).alias("ratio")) for m, r in ratio.items()]
    found = compression.benchmark_summary(rows[0].union(rows[1]).union(rows[2]))
    return found.select("kind", "method", "dataset", F.round("value", 5).alias("value"))


def spectrum(series: DataFrame) -> DataFrame:
    """(series_id, n, bin, magnitude, phase) of bins 1 to n / 2 of (series_id, pos, n, value), for series of any length.

    Sums over positions, combined in each task before the shuffle; a series' work grows with the square of its length.
    """
    means = series.groupBy("series_id").agg(F.avg("value").alias("mean"))
    each = series.join(means, "series_id").where("n > 3").select("series_id", "pos", "n", (F.col("value") - F.col("mean")).alias("c"), F.explode(F.expr("sequence(1L, n div 2 - 1)")).alias("bin"))
    angle = F.col("bin") * F.col("pos") % F.col("n") * (generators.TAU / F.col("n"))
    sums = each.groupBy("series_id", "n", "bin").agg(F.sum(F.col("c") * F.cos(angle)).alias("re"), (F.sum(F.col("c") * F.sin(angle)) * -1).alias("im"))
    return sums.select("series_id", "n", "bin", F.hypot("re", "im").alias("magnitude"), F.atan2("im", "re").alias("phase"))


def strongest(bins: DataFrame, terms: int, energy: float) -> DataFrame:
    """The strongest bins of each series until they hold more than `energy` of all, `terms` at most; the one that crosses stays."""
    mine = Window.partitionBy("series_id")
    order = mine.orderBy(F.desc(F.round("magnitude", 6)), "bin")
    square = F.col("magnitude") * F.col("magnitude")
    ranked = bins.where(F.col("magnitude") >= 1e-6).select("*", F.row_number().over(order).alias("place"), F.sum(square).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("held"), F.sum(square).over(mine).alias("whole"))
    return ranked.where((F.col("place") <= terms) & ((F.col("held") - square) / F.col("whole") <= energy)).drop("held", "whole")


def fourier_terms_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest bins of each series by sums and windows."""
    found = strongest(spectrum(mixed_series(spark, sf_dir)).where("n > 7"), 20, 0.99)
    return found.select(F.col("series_id").alias("user_id"), "bin", F.col("place").cast("long").alias("place"), F.round("magnitude", 3).alias("magnitude"))


FUNCTIONS = (fourier_terms_long, fit_sine_by_user, fit_fourier_by_user, fit_polynomial_by_user, model_selection, lossless_roundtrip, quantised_roundtrip, residual_method_by_user, subband_roundtrip, subband_ratio, total_estimate_by_user, quality_by_flag, benchmark_report)
QUERIES: dict[str, Query] = {f.__name__: f for f in FUNCTIONS}

# The definitions once more, for another engine: transforms as sums over cosines, polynomials by orthogonal remainders.
_MIXED = f"""
    SELECT user_id, i, n, CASE user_id % 5 WHEN 0 THEN 1.5 + 2 * sin(2 * pi() * (user_id % 7 + 1) * i / n + 0.3)
        WHEN 1 THEN 1.5 * sin(2 * pi() * (user_id % 7 + 1) * i / n) + 0.8 * sin(2 * pi() * (user_id % 7 + 5) * i / n)
        WHEN 2 THEN x ** 3 - 2 * x * x + x + 0.1 WHEN 3 THEN 3.25 ELSE value END AS value, x
    FROM (SELECT *, CASE WHEN n > 1 THEN i::DOUBLE / (n - 1) ELSE 0 END AS x FROM ({_SERIES}))"""
_BASE = f"""
    m AS MATERIALIZED ({_MIXED}),
    s AS MATERIALIZED (SELECT user_id, any_value(n) AS n, avg(value) AS dc, (max(value) - min(value)) / 2 AS amp, var_pop(value) AS var FROM m GROUP BY user_id),
    spec AS MATERIALIZED (
        SELECT user_id, k, sqrt(sum(c * cos(a)) ** 2 + sum(c * sin(a)) ** 2) AS mag FROM (
            SELECT m.user_id, k, value - dc AS c, 2 * pi() * ((k * i) % m.n) / m.n AS a FROM m JOIN s USING (user_id), (SELECT range AS k FROM range(1, 64)) WHERE k < m.n // 2)
        GROUP BY user_id, k)"""
_SINE = """
    peak AS (SELECT user_id, arg_max(k, round(mag, 6) * 1000 - k * 1e-6) AS f FROM spec GROUP BY user_id),
    grid AS (SELECT m.user_id, p, avg((value - dc - amp * sin(2 * pi() * f * i / m.n + p * pi() / 180)) ** 2) AS mse
             FROM m JOIN s USING (user_id) JOIN peak USING (user_id), (SELECT range AS p FROM range(360)) WHERE m.n >= 4 AND amp >= 1e-10 GROUP BY m.user_id, p),
    sine AS (SELECT user_id, min(mse) / any_value(var) AS error, arg_min(p, mse) AS p FROM grid JOIN s USING (user_id) GROUP BY user_id)"""
_FOURIER = """
    ranked AS (SELECT *, row_number() OVER w AS place, sum(mag * mag) OVER (w ROWS UNBOUNDED PRECEDING) AS got, sum(mag * mag) OVER (PARTITION BY user_id) AS every
               FROM spec JOIN s USING (user_id) WHERE n >= 8 AND mag >= 1e-6 WINDOW w AS (PARTITION BY user_id ORDER BY round(mag, 6) DESC, k)),
    terms AS (SELECT * FROM ranked WHERE place <= 20 AND (got - mag * mag) / every <= 0.99),
    series AS (SELECT user_id, count(*) AS terms, 1 - 2 * max(got) / (any_value(n) ** 2 * any_value(var)) AS error FROM terms GROUP BY user_id)"""
_POLYNOMIAL = """
    o2 AS (SELECT m.*, x * x - (regr_intercept(x * x, x) OVER u + regr_slope(x * x, x) OVER u * x) AS e2, value - (regr_intercept(value, x) OVER u + regr_slope(value, x) OVER u * x) AS r1 FROM m WINDOW u AS (PARTITION BY user_id)),
    o3 AS (SELECT *, r1 - e2 * sum(r1 * e2) OVER u / sum(e2 * e2) OVER u AS r2, x ** 3 - (regr_intercept(x ** 3, x) OVER u + regr_slope(x ** 3, x) OVER u * x) - e2 * sum(x ** 3 * e2) OVER u / sum(e2 * e2) OVER u AS e3 FROM o2 WINDOW u AS (PARTITION BY user_id)),
    o4 AS (SELECT *, r2 - e3 * sum(r2 * e3) OVER u / sum(e3 * e3) OVER u AS r3 FROM o3 WINDOW u AS (PARTITION BY user_id)),
    degrees AS (SELECT user_id, var, avg(r1 * r1) / var AS d1, avg(r2 * r2) / var AS d2, avg(r3 * r3) / var AS d3, max(CASE WHEN i = 0 THEN value - r1 END) AS z1, max(CASE WHEN i = 0 THEN value - r2 END) AS z2, max(CASE WHEN i = 0 THEN value - r3 END) AS z3
                FROM o4 JOIN s USING (user_id) WHERE s.n > 1 GROUP BY user_id, var),
    poly AS (SELECT user_id, CASE WHEN var < 1e-15 THEN 0 WHEN d1 < 0.01 THEN 1 WHEN d2 < 0.01 THEN 2 WHEN d3 < 0.01 THEN 3 END::INT AS degree,
                    CASE WHEN var < 1e-15 THEN 0 WHEN d1 < 0.01 THEN d1 WHEN d2 < 0.01 THEN d2 ELSE d3 END AS error, CASE WHEN var < 1e-15 THEN 3.25 WHEN d1 < 0.01 THEN z1 WHEN d2 < 0.01 THEN z2 ELSE z3 END AS at_zero FROM degrees)"""
ORACLES: dict[str, str] = {
    "fit_sine_by_user": f"""WITH {_BASE}, {_SINE}
        SELECT user_id, n::INT AS n, round(f::DOUBLE, 5) AS frequency, round(amp, 5) AS amplitude, round(p * pi() / 180, 5) AS phase, round(dc, 5) AS dc_offset, round(error, 5) AS error, 64::INT AS cost
        FROM sine JOIN s USING (user_id) JOIN peak USING (user_id) WHERE error < 0.01""",
    "fit_fourier_by_user": f"""WITH {_BASE}, {_FOURIER}
        SELECT user_id, c.terms::INT AS terms, k AS bin, round(mag, 3) AS magnitude, round(abs(error), 4) AS error, (20 * c.terms + 40)::INT AS cost FROM terms JOIN series c USING (user_id) WHERE error < 0.01""",
    "fourier_terms_long": f"WITH {_BASE}, {_FOURIER} SELECT user_id, k AS bin, place, round(mag, 3) AS magnitude FROM terms",
    "fit_polynomial_by_user": f"WITH {_BASE}, {_POLYNOMIAL} SELECT user_id, degree, round(abs(error), 5) AS error, round(at_zero, 4) AS at_zero, (8 * degree + 40)::INT AS cost FROM poly WHERE degree IS NOT NULL",
    "model_selection": f"""WITH {_BASE}, {_SINE}, {_FOURIER}, {_POLYNOMIAL},
        c AS (SELECT user_id, 1 AS o, 'sine' AS method, 64 AS cost FROM sine WHERE error < 0.01 UNION ALL SELECT user_id, 2, 'fourier', 20 * terms + 40 FROM series WHERE error < 0.01
              UNION ALL SELECT user_id, 3, 'polynomial', 8 * degree + 40 FROM poly WHERE degree IS NOT NULL),
        b AS (SELECT user_id, arg_min(method, cost * 10 + o) AS method, min(cost) AS cost FROM c GROUP BY user_id)
        SELECT s.user_id, s.n::INT AS n, CASE WHEN 4.0 * s.n / cost >= 1.5 THEN method ELSE 'lzma' END AS method, CASE WHEN 4.0 * s.n / cost >= 1.5 THEN round(4.0::DOUBLE * s.n / cost, 5) END AS ratio FROM s LEFT JOIN b USING (user_id)""",
    "lossless_roundtrip": f"SELECT user_id, i, round(value, 6) AS value FROM ({_MIXED})",
    "quantised_roundtrip": "SELECT DISTINCT user_id, unnest([8, 16])::INT AS bits, true AS close FROM events",
    "subband_roundtrip": """
        SELECT band, block, count(*)::INT AS n, CASE WHEN strength <= 2 THEN 16 ELSE 8 END::INT AS bits, CASE strength WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 4 THEN 3 ELSE 1 END::INT AS preset, true AS close FROM (
            SELECT ['LLL', 'LLH', 'LHL', 'HLL', 'LHH', 'HLH', 'HHL', 'HHH'][(l_orderkey % 8 + 1)::INT] AS band, l_orderkey // 512 AS block, [1, 2, 2, 2, 4, 4, 4, 8][(l_orderkey % 8 + 1)::INT] AS strength FROM lineitem
        ) GROUP BY band, block, strength""",
    "subband_ratio": "SELECT l_returnflag, n, round(8 * g, 6) AS lll, round(4 * g, 6) AS low, round(2 * g, 6) AS mid, round(1.2::DOUBLE * g, 6) AS hhh FROM (SELECT l_returnflag, count(*) AS n, greatest(1.0::DOUBLE, ln(count(*)) - ln(1024)) AS g FROM lineitem GROUP BY 1)",
    "total_estimate_by_user": "SELECT user_id, n + 98 AS total, round(4.0::DOUBLE * n / (n + 98), 6) AS ratio, round(48.0::DOUBLE / (n + 98), 6) AS parameters_share, round(n::DOUBLE / (n + 98), 6) AS residual_share FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
    "quality_by_flag": """
        SELECT l_returnflag, round(20 * log10(255 / sqrt(avg((a - b) ** 2))), 3) AS psnr,
               round((2 * avg(a) * avg(b) + 6.5025) * (2 * (avg(a * b) - avg(a) * avg(b)) + 58.5225) / ((avg(a) ** 2 + avg(b) ** 2 + 6.5025) * (var_pop(a) + var_pop(b) + 58.5225)), 6) AS ssim
        FROM (SELECT l_returnflag, a, floor(a + 0.5) AS b FROM (SELECT l_returnflag, (l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w) * 255 AS a FROM lineitem WINDOW w AS (PARTITION BY l_returnflag))) GROUP BY 1""",
    "benchmark_report": """
        WITH r AS (SELECT 'u' || user_id AS dataset, method, round(CASE method WHEN 'a' THEN n * 4 / 64.0::DOUBLE WHEN 'b' THEN n * 4 / (user_id % 40 + 40.5::DOUBLE) ELSE 2 END + user_id / 1e7, 7) AS ratio
                   FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT unnest(['a', 'b', 'c']) AS method)),
             b AS (SELECT dataset, arg_max(method, ratio) AS method, max(ratio) AS ratio FROM r GROUP BY 1)
        SELECT 'wins' AS kind, method, NULL::VARCHAR AS dataset, count(*)::DOUBLE AS value FROM b GROUP BY method
        UNION ALL SELECT 'mean_ratio', method, NULL, round(avg(ratio), 5) FROM r GROUP BY method
        UNION ALL (SELECT 'best', method, dataset, round(ratio, 5) FROM b ORDER BY ratio DESC, dataset LIMIT 3) UNION ALL (SELECT 'worst', method, dataset, round(ratio, 5) FROM b ORDER BY ratio, dataset LIMIT 3)""",
}
