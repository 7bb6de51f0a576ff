"""The engine's functions under SQL names: scalar and grouped-aggregate UDFs in Arrow batches, and table functions.

After `register(spark)` SQL has
  pf_compress(values), pf_residual_size(values, method), pf_entropy(binary)      scalars
  pf_fit_sine(value), pf_fit_fourier(value), pf_fit_polynomial(value)            aggregates of one group's values, JSON
  pf_sine(n, frequency, amplitude, phase, offset), pf_polynomial(n, coefficients), pf_perlin(width, height, seed, scale, octaves)
                                                                                 tables
Aggregates take the values in the order in which they come; order a subquery by the series' position first.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import codecs, fits, media

#: Rows that a table function makes at most in one call; larger signals are for procframe.operators.generators.
MOST = 10_000_000


def _entropy(data: bytes) -> float:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum()) + 0.0


def _each(f: Callable, kind: str) -> Callable:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, kind)


def _fit(find: Callable[[np.ndarray], fits.Fit | None]) -> Callable:
    def run(values: pd.Series) -> str:
        found = find(values.to_numpy(float))
        return "null" if found is None else json.dumps(vars(found))

    run.__annotations__ = {"values": pd.Series, "return": str}
    return F.pandas_udf(run, "string")


def _sizes(values: pd.Series, method: pd.Series) -> pd.Series:
    return pd.Series([len(codecs.compress_residual(np.array(v, float), m).payload) for v, m in zip(values, method, strict=True)])


class Sine:
    def eval(self, n: int, frequency: float, amplitude: float, phase: float, offset: float):
        _held(n)
        yield from enumerate(fits.sine(n, frequency, amplitude, phase, offset).tolist())


class Polynomial:
    def eval(self, n: int, coefficients: list):
        _held(n)
        yield from enumerate(fits.polynomial(n, coefficients).tolist())


class Perlin:
    def eval(self, width: int, height: int, seed: int, scale: float, octaves: int):
        _held(width * height)
        made = media.perlin(width, height, seed, scale, octaves)
        for y in range(height):
            for x in range(width):
                yield y, x, float(made[y, x])


def _held(n: int) -> None:
    if not 0 < n <= MOST:
        raise ValueError(f"n must be 1 to {MOST}")


def register(spark: SparkSession) -> None:
    from ..sources import archive

    scalars = {"pf_compress": _each(lambda x: archive.compress(np.array(x, float)), "binary"), "pf_entropy": _each(_entropy, "double"), "pf_residual_size": F.pandas_udf(_sizes, "long")}
    groups = {"pf_fit_sine": _fit(fits.fit_sine), "pf_fit_fourier": _fit(fits.fit_fourier), "pf_fit_polynomial": _fit(fits.fit_polynomial)}
    for name, f in {**scalars, **groups}.items():
        spark.udf.register(name, f)
    for name, kind, schema in (("pf_sine", Sine, "i int, value double"), ("pf_polynomial", Polynomial, "i int, value double"), ("pf_perlin", Perlin, "y int, x int, value double")):
        spark.udtf.register(name, F.udtf(kind, returnType=schema))
