"""Whole series to models and back: analysis, lossless or quantised residuals, statistics and advice.

A packed series is a row (series_id, values array<double>); a long one has rows (series_id, pos, value). `pack_series`
and `unpack_series` go from one to the other. Fits that need the whole spectrum take one packed series at a time in Arrow
batches, so one series must fit a worker; rows are independent and nothing is shuffled. What sums can express (statistics,
straight lines) stays an aggregate over the long form, for series of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, fits

FIT = "series_id long, n int, method string, coefficients array<double>, error double, cost int, ratio double"
PACKED = f"{FIT}, residual binary, residual_bits int, low double, high double, lossless boolean"
SIGNIFICANT = 1e-10
#: Bytes that a container takes besides parameters and residual.
CONTAINER = 50


def pack_series(long: DataFrame) -> DataFrame:
    """(series_id, values) of (series_id, pos, value), ordered by pos. A series comes into one row."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return long.groupBy("series_id").agg(F.transform(rows, lambda r: r["value"].cast("double")).alias("values"))


def unpack_series(packed: DataFrame) -> DataFrame:
    return packed.select("series_id", F.posexplode("values").alias("pos", "value"))


def _values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield key, np.array(x.as_py() or [], float)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _row(key: int, values: np.ndarray, fit: fits.Fit, itemsize: int) -> tuple:
    return key, len(values), fit.method, fit.coefficients, fit.error, fit.cost, len(values) * itemsize / fit.cost if fit.cost else None


def fit_series(packed: DataFrame, method: str = "best", variant: str = "peak", itemsize: int = 4, max_error: float = fits.MAX_ERROR) -> DataFrame:
    """The fit of each series. method: best (the choice among all, lzma where none pays), sine, fourier or polynomial.

    With one method, a series that it can't fit has no row.
    """
    one = {"sine": lambda x: fits.fit_sine(x, variant), "fourier": fits.fit_fourier, "polynomial": lambda x: fits.fit_polynomial(x, variant="first" if variant == "peak" else "best")}
    find = one.get(method, lambda x: fits.analyse(x, variant, itemsize, max_error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_row(key, x, fit, itemsize) for key, x in _values(batch) if (fit := find(x)) is not None], FIT)

    return packed.select(F.col("series_id").cast("long"), F.col("values").cast("array<double>")).mapInArrow(run, FIT)


def compress_values(values: np.ndarray, lossless: bool = True, bits: int | None = None, max_error: float = fits.MAX_ERROR) -> tuple:
    """(fit, residual, bits, low, high, lossless): a model, and what it misses as doubles or as 8- or 16-bit levels."""
    if bits not in (None, 8, 16):
        raise ValueError("bits must be 8, 16 or None")
    fit = fits.analyse(values, itemsize=4, max_error=max_error)
    if fit.method == "lzma":
        return fit, codecs.lzma_compress(values.astype("<f8").tobytes()), None, None, None, True
    missed = values - fits.reconstruct(fit, len(values))
    if not lossless:
        return fit, None, None, None, None, False
    if np.abs(missed).max(initial=0) <= SIGNIFICANT:
        return fit, None, None, None, None, True
    if bits is None:
        return fit, codecs.lzma_compress(missed.astype("<f8").tobytes()), None, None, None, True
    levels, low, scale = codecs.quantise(missed, bits, "truncate")
    return fit, codecs.lzma_compress(levels.tobytes()), bits, low, low + scale, False


def decompress_values(fit: fits.Fit, n: int, residual: bytes | None, bits: int | None = None, low: float | None = None, high: float | None = None) -> np.ndarray:
    raw = codecs.lzma_decompress(residual) if residual is not None else None
    if fit.method == "lzma":
        return np.zeros(n) if raw is None else np.frombuffer(raw, "<f8", n)
    made = fits.reconstruct(fit, n)
    if raw is None:
        return made
    return made + (np.frombuffer(raw, "<f8", n) if bits is None else codecs.dequantise(np.frombuffer(raw, f"<u{bits // 8}", n), bits, low, high - low))


def compress_series(packed: DataFrame, lossless: bool = True, bits: int | None = None, max_error: float = fits.MAX_ERROR) -> DataFrame:
    """PACKED rows: each series as a model, with a residual if `lossless` (doubles, or levels of 8 or 16 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, x in _values(batch):
                fit, *rest = compress_values(x, lossless, bits, max_error)
                rows.append((*_row(key, x, fit, 4), *rest))
            yield _batch(rows, PACKED)

    return packed.select(F.col("series_id").cast("long"), F.col("values").cast("array<double>")).mapInArrow(run, PACKED)


def decompress_series(compressed: DataFrame) -> DataFrame:
    """(series_id, values) of PACKED rows."""
    schema = "series_id long, values array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["series_id"], decompress_values(fits.Fit(r["method"], r["coefficients"]), r["n"], r["residual"], r["residual_bits"], r["low"], r["high"])) for r in batch.to_pylist()]
            yield _batch(rows, schema)

    return compressed.select("series_id", "n", "method", "coefficients", "residual", "residual_bits", "low", "high").mapInArrow(run, schema)


def with_totals(compressed: DataFrame, itemsize: int = 4) -> DataFrame:
    """PACKED rows with has_residual, total_size (parameters and residual) and effective_ratio."""
    total = F.col("cost") + F.coalesce(F.octet_length("residual"), F.lit(0))
    ratio = F.when(total > 0, F.col("n") * F.lit(float(itemsize)) / total)
    return compressed.withColumn("has_residual", F.col("residual").isNotNull()).withColumn("total_size", total).withColumn("effective_ratio", ratio)


def residual(original: DataFrame, generated: DataFrame) -> DataFrame:
    """(series_id, pos, value): original less generated, both (series_id, pos, value); a place that one side lacks is an error."""
    a, b = original.select("series_id", "pos", F.col("value").alias("a")), generated.select("series_id", "pos", F.col("value").alias("b"))
    both = a.join(b, ["series_id", "pos"], "full")
    lacking = F.raise_error(F.lit("the series differ in shape"))
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.select("series_id", "pos", F.when(present, F.col("a") - F.col("b")).otherwise(lacking.cast("double")).alias("value"))


def add_residual(generated: DataFrame, missed: DataFrame, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """(series_id, pos, value): generated plus residual; for whole numbers in a range rounded half to even and cut to it."""
    total = F.col("g") + F.coalesce("r", F.lit(0.0))
    if lowest is not None and highest is not None:
        total = F.greatest(F.lit(float(lowest)), F.least(F.lit(float(highest)), F.rint(total)))
    left = generated.select("series_id", "pos", F.col("value").alias("g"))
    return left.join(missed.select("series_id", "pos", F.col("value").alias("r")), ["series_id", "pos"], "left").select("series_id", "pos", total.alias("value"))


def advice(relative_rmse: Column, sparsity: Column) -> Column:
    """The method that fits a residual by rule."""
    return F.when(relative_rmse < 0.001, "lzma").when(relative_rmse < 0.01, "zlib").when(sparsity > 0.5, "delta").otherwise("quantized")


def residual_statistics(original: DataFrame, missed: DataFrame) -> DataFrame:
    """Statistics of a residual by series: range, mean, spread, errors, PSNR, sparsity, raw size and the advised method.

    Two aggregates by series: the second needs the spread of the first, which comes back by a join on the series.
    """
    r = F.col("value")
    basic = missed.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(r).alias("min"), F.max(r).alias("max"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae")
    ).withColumn("rmse", F.sqrt("mse"))
    ranges = original.groupBy("series_id").agg((F.max("value") - F.min("value")).alias("range"))
    sparse = missed.join(basic.select("series_id", "std"), "series_id").groupBy("series_id").agg(F.avg((F.abs("value") < F.col("std") * 0.1).cast("double")).alias("sparsity"))
    all_ = basic.join(ranges, "series_id").join(sparse, "series_id")
    wide = F.col("range") > 1e-10
    all_ = all_.withColumn("relative_rmse", F.when(wide, F.col("rmse") / F.col("range")).otherwise(0.0))
    all_ = all_.withColumn("psnr", F.when(wide & (F.col("rmse") > 0), F.log10(F.col("range") / F.col("rmse")) * 20).otherwise(float("inf")))
    return all_.withColumn("raw_size", F.col("n") * 4).withColumn("method", advice(F.col("relative_rmse"), F.col("sparsity")))


def total_estimate(original: Column, parameters: Column, rest: Column) -> Column:
    """Whole size, ratio and shares of parameters and residual."""
    total = (parameters + rest + CONTAINER).cast("double")
    return F.struct((parameters + rest + CONTAINER).alias("total"), (original / total).alias("ratio"), (parameters / total).alias("parameters_share"), (rest / total).alias("residual_share"))


def psnr(mse: Column, peak: Column) -> Column:
    return F.when(mse > 0, F.log10(peak * peak / mse) * 10).otherwise(float("inf"))


def similarity(a: str, b: str, peak: float = 255.0) -> Column:
    """Structural similarity of two columns as one window: an aggregate of means, variances and covariance."""
    one, two = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ma, mb = F.avg(a), F.avg(b)
    return (ma * mb * 2 + one) * (F.covar_pop(a, b) * 2 + two) / ((ma * ma + mb * mb + one) * (F.var_pop(a) + F.var_pop(b) + two))


def benchmark_summary(results: DataFrame, top: int = 3) -> DataFrame:
    """(dataset, kind, method, ratio) of results (dataset, method, ratio): win counts, mean ratios, best and worst datasets."""
    best = results.groupBy("dataset").agg(F.max_by("method", "ratio").alias("method"), F.max("ratio").alias("ratio"))
    wins = best.groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("wins").alias("kind"), "method", F.lit(None).cast("string").alias("dataset"), "value")
    means = results.groupBy("method").agg(F.avg("ratio").alias("value")).select(F.lit("mean_ratio").alias("kind"), "method", F.lit(None).cast("string").alias("dataset"), "value")
    ends = [best.orderBy(order, "dataset").limit(top).select(F.lit(kind).alias("kind"), "method", "dataset", F.col("ratio").alias("value")) for kind, order in (("best", F.desc("ratio")), ("worst", F.asc("ratio")))]
    return wins.union(means).union(ends[0]).union(ends[1])


