"""Hashes and palettes of pictures that have landed as arrays of pixels, row by row, already at the size that a rule wants."""

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge of a hash's square of bits, and levels of a colour in a palette.
EDGE, LEVELS = 8, 4
#: What counts as background: all colours above, all below, or all so close together; and the pixels that must be left.
BRIGHT, DARK, GREY, LEAST_PIXELS = 235, 20, 18, 50


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _hex(bits: Column) -> Column:
    """Bits (an array of booleans, four for each digit) as lower-case hex."""

    def digits(ones: Column) -> Column:
        digit = lambda i: F.lower(F.hex((ones[i * 4] * 8 + ones[i * 4 + 1] * 4 + ones[i * 4 + 2] * 2 + ones[i * 4 + 3]).cast("long")))
        return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(ones) / 4).cast("int") - 1), digit), "")

    return _let(F.transform(bits, lambda b: b.cast("int")), digits)


def _whole(pixels: Column, size: int, value: Column) -> Column:
    """value where the picture has just so many pixels and none is null, else null."""
    return F.when((F.size(pixels) == size) & ~F.exists(pixels, lambda p: p.isNull()), value)


def average_hash(pixels: Column, edge: int = EDGE) -> Column:
    """Which of edge x edge grey pixels are no darker than their mean. Pictures of another size have none."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p) / F.size(pixels)
    return _whole(pixels, edge * edge, _hex(_let(mean, lambda m: F.transform(pixels, lambda p: p >= m))))


def gradient_hash(pixels: Column, width: int = EDGE + 1, height: int = EDGE) -> Column:
    """Which pixels of height rows are brighter than their left neighbour: width - 1 bits a row."""
    at = F.array(*(F.lit(r * width + c) for r in range(height) for c in range(1, width)))
    return _whole(pixels, width * height, _hex(F.transform(at, lambda i: F.get(pixels, i) > F.get(pixels, i - 1))))


def cosines(edge: int, rows: int = EDGE) -> list[list[float]]:
    """The first rows of the orthonormal cosine transform of a line of edge pixels."""
    return [[math.sqrt((1 if k == 0 else 2) / edge) * math.cos(math.pi * (2 * i + 1) * k / (2 * edge)) for i in range(edge)] for k in range(rows)]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def perceptual_hash(pixels: Column, edge: int = 32) -> Column:
    """Which of the 8 x 8 lowest frequencies of an edge x edge grey picture exceed their median, the mean brightness aside."""
    basis = F.array(*(F.array(*map(F.lit, row)) for row in cosines(edge)))
    lines = F.transform(F.sequence(F.lit(0), F.lit(edge - 1)), lambda r: F.slice(pixels, r * edge + 1, edge))
    across = F.transform(lines, lambda line: F.transform(basis, lambda b: _dot(b, line)))  # edge rows of 8
    turned = _let(across, lambda rows: F.transform(F.sequence(F.lit(0), F.lit(EDGE - 1)), lambda c: F.transform(rows, lambda row: row[c])))
    low = _let(turned, lambda columns: F.flatten(F.transform(basis, lambda b: F.transform(columns, lambda column: _dot(b, column)))))
    over = lambda v: _let(F.array_sort(F.slice(v, 2, EDGE * EDGE - 1))[(EDGE * EDGE - 2) // 2], lambda median: F.transform(v, lambda x: x > median))
    bits = _let(low, over)
    return _whole(pixels, edge * edge, _hex(bits))


def palette(pixels: Column) -> Column:
    """Shares of 64 colours among pixels (array of struct<r, g, b>, 0 to 255), to 5 places. Background doesn't count, if enough else
    is left. A picture without pixels has none."""
    most, least = (lambda p, f=f: f(p["r"], p["g"], p["b"]) for f in (F.greatest, F.least))
    shown = F.filter(pixels, lambda p: ~((least(p) > BRIGHT) | (most(p) < DARK) | (most(p) - least(p) < GREY)))
    level = lambda v: F.floor(v * LEVELS / 256).cast("int")
    own = _let(shown, lambda left: F.transform(F.when(F.size(left) >= LEAST_PIXELS, left).otherwise(pixels), lambda p: level(p["r"]) * LEVELS**2 + level(p["g"]) * LEVELS + level(p["b"])))
    share = lambda bins, k: F.round(F.size(F.filter(bins, lambda x: x == k)) / F.size(F.array_compact(bins)), 5)
    return F.when(F.size(pixels) > 0, _let(own, lambda bins: F.transform(F.sequence(F.lit(0), F.lit(LEVELS**3 - 1)), lambda k: share(bins, k))))
