"""Generators by name: each type or condition has one function (seed, parameters, shape) -> values.

Conditions are parameters that are true; they are looked at before the type. Own generators are added with `register`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from . import fits, media

Generator = Callable[[int, dict, tuple[int, ...]], np.ndarray]
TYPES: dict[str, Generator] = {}
CONDITIONS: dict[str, Generator] = {}
#: Largest length of one dimension.
MAX_DIMENSION = 10_000_000


def register(kind: str, condition: bool = False) -> Callable[[Generator], Generator]:
    """Decorator: the generator of a type, or of a condition."""

    def keep(f: Generator) -> Generator:
        (CONDITIONS if condition else TYPES)[kind] = f
        return f

    return keep


def validate_shape(shape: Sequence[int]) -> tuple[int, ...]:
    if not isinstance(shape, (list, tuple)) or not shape or not all(isinstance(d, int) and not isinstance(d, bool) and 0 < d <= MAX_DIMENSION for d in shape):
        raise ValueError(f"no valid shape: {shape!r}")
    return tuple(shape)


def generate(kind: str, seed: int, parameters: dict, shape: Sequence[int]) -> np.ndarray:
    """Values of a generator, in its shape. A type may be spelled with its class in front of it."""
    shape = validate_shape(shape)
    found = next((f for condition, f in CONDITIONS.items() if parameters.get(condition)), None) or TYPES.get(kind.rsplit(".", 1)[-1].lower())
    if found is None:
        raise ValueError(f"unknown generator {kind!r}")
    return np.asarray(found(seed, parameters, shape)).reshape(shape)


def _count(shape: tuple[int, ...]) -> int:
    return int(np.prod(shape, dtype=np.int64))


@register("is_simple_sine", condition=True)
@register("wave_function")
def _sine(seed: int, p: dict, shape: tuple[int, ...]) -> np.ndarray:
    return fits.sine(_count(shape), p.get("frequency", 1.0), p.get("amplitude", 1.0), p.get("phase", 0.0), p.get("dc_offset", 0.0))


@register("fourier")
def _fourier(seed: int, p: dict, shape: tuple[int, ...]) -> np.ndarray:
    return fits.fourier_series(_count(shape), [tuple(c) for c in p.get("coefficients", [])], p.get("dc_offset", 0.0))


@register("polynomial")
def _polynomial(seed: int, p: dict, shape: tuple[int, ...]) -> np.ndarray:
    return fits.polynomial(_count(shape), p.get("coefficients", [0]))


@register("perlin_noise")
def _perlin(seed: int, p: dict, shape: tuple[int, ...]) -> np.ndarray:
    height, width = (1, shape[0]) if len(shape) == 1 else (shape[0], _count(shape[1:]))
    return media.perlin(width, height, seed, p.get("scale", 10.0), p.get("octaves", 4), p.get("persistence", 0.5), p.get("lacunarity", 2.0))
