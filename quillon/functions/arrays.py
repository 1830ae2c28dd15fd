"""Column functions over arrays of doubles: normalising, perturbing, surrogates, checks.

Positions count from 0. Empty arrays stay empty and nulls stay null throughout. Random choices follow
``md5(id|condition|seed|position)`` so that any engine can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.hashing import uniform



def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, even where the body uses it inside a lambda (a column named
    there would be computed again for every element)."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def pop_sd(x: Column) -> Column:
    """Population standard deviation, two passes."""
    squares = bind(mean(x), lambda m: total(F.transform(x, lambda v: (v - m) * (v - m))))
    return F.when(F.size(x) > 0, F.sqrt(squares / F.size(x)))


def spread(x: Column) -> Column:
    """Largest minus smallest value."""
    return F.array_max(x) - F.array_min(x)


def znorm(x: Column) -> Column:
    """Mean 0, population standard deviation 1; a constant series becomes zeros."""
    flat = F.transform(x, lambda v: F.lit(0.0))
    inner = F.struct(mean(x).alias("m"), pop_sd(x).alias("s"))
    scaled = bind(inner, lambda p: F.transform(x, lambda v: (v - p["m"]) / p["s"]))
    return F.when((F.size(x) == 0) | (spread(x) == 0), flat).otherwise(scaled)


def digest(x: Column) -> Column:
    """Order-sensitive exact checksum: sum of position times value in millionths."""
    terms = F.transform(x, lambda v, i: (i + 1).cast("long") * F.round(v * 1e6).cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, v: a + v)


def key_at(row_id: Column, condition: str, seed: int, i: Column) -> Column:
    return F.concat(row_id, F.lit(f"|{condition}|{seed}|"), i.cast("string"))


def hash_order(n: Column, row_id: Column, condition: str, seed: int) -> Column:
    """The positions 0..n-1 ordered by their hashes."""
    tagged = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(key_at(row_id, condition, seed, i)).alias("h"), i.alias("i"))
    )
    return F.when(n > 0, F.transform(F.array_sort(tagged), lambda s: s["i"])).when(n == 0, F.array().cast("array<int>"))


def take(x: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(x, i))


def permute(x: Column, row_id: Column, seed: int = 42) -> Column:
    """All positions permuted."""
    return take(x, hash_order(F.size(x), row_id, "sf_all", seed))


def permute_first_half(x: Column, row_id: Column, seed: int = 42) -> Column:
    """The first floor(L/2) positions permuted, the rest untouched."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.concat(take(x, hash_order(half, row_id, "sf_half", seed)), F.slice(x, half + 1, F.size(x) - half))


def swap_halves(x: Column) -> Column:
    """The second part before the first; floor(L/2) values move to the end."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.concat(F.slice(x, half + 1, F.size(x) - half), F.slice(x, F.lit(1), half))


def masked_positions(x: Column, row_id: Column, seed: int, ratio: float = 0.2) -> Column:
    """floor(ratio * L) positions chosen by hash."""
    return F.slice(hash_order(F.size(x), row_id, "masking", seed), F.lit(1), F.floor(F.size(x) * F.lit(ratio)).cast("int"))


def fill_at(x: Column, at: Column, value: Column) -> Column:
    """The series with the positions in ``at`` set to a value."""
    return F.transform(x, lambda v, i: F.when(F.array_contains(at, i), value).otherwise(v))


def mask(x: Column, row_id: Column, seed: int = 42, ratio: float = 0.2) -> Column:
    """Masked positions set to zero."""
    return bind(masked_positions(x, row_id, seed, ratio), lambda at: fill_at(x, at, F.lit(0.0)))


def mask_with_mean(x: Column, row_id: Column, seed: int = 42, ratio: float = 0.2) -> Column:
    """Masked positions set to the mean of the survivors, which keeps the mean of the filled series at theirs."""


    def filled(at: Column) -> Column:
        left = F.try_divide(total(F.filter(x, lambda v, i: ~F.array_contains(at, i))), F.size(x) - F.size(at))
        return bind(left, lambda fill: fill_at(x, at, fill))

    return bind(masked_positions(x, row_id, seed, ratio), filled)


def patches(x: Column, width: int) -> Column:
    """Blocks of ``width`` values; a shorter rest is the last block."""
    n = F.ceil(F.size(x) / width).cast("int")
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(x, b * width + 1, F.lit(width)))).when(
        F.size(x) == 0, F.array().cast("array<array<double>>")
    )


def permute_within_patches(x: Column, row_id: Column, width: int = 16, seed: int = 42) -> Column:
    """Values permuted inside each block of ``width``."""
    tagged = F.transform(
        x,
        lambda v, i: F.struct(
            F.floor(i / width).alias("b"), F.md5(key_at(row_id, "sf_within_patch", seed, i)).alias("h"), v.alias("v")
        ),
    )
    return F.transform(F.array_sort(tagged), lambda s: s["v"])


def permute_patches(x: Column, row_id: Column, width: int = 16, seed: int = 42) -> Column:
    """Whole blocks of ``width`` permuted."""
    blocks = patches(x, width)
    order = hash_order(F.size(blocks), row_id, "sf_across_patch", seed)
    return F.flatten(bind(blocks, lambda b: F.transform(order, lambda i: F.get(b, i))))


def resample(x: Column, row_id: Column, seed: int = 42) -> Column:
    """Values drawn with replacement."""
    n = F.size(x)
    return F.transform(x, lambda v, i: F.get(x, F.floor(uniform(key_at(row_id, "resample", seed, i)) * n).cast("int")))


def gaussian(x: Column, row_id: Column, seed: int = 42) -> Column:
    """Normal values matched to mean and population sd (Box-Muller over two hashes); a constant series passes through."""
    p = F.struct(mean(x).alias("m"), pop_sd(x).alias("s"))

    def draw(i: Column) -> Column:
        u = uniform(key_at(row_id, "gaussian_u", seed, i))
        v = uniform(key_at(row_id, "gaussian_v", seed, i))
        return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)

    drawn = bind(p, lambda q: F.transform(x, lambda v, i: q["m"] + q["s"] * draw(i)))
    return F.when(spread(x) == 0, x).otherwise(drawn)


def same_values(x: Column, y: Column) -> Column:
    """Whether two arrays hold the same values, each equally often."""
    return F.array_sort(x) == F.array_sort(y)


def quantise(z: Column, scale: float = 10.0, clip: float = 99.0) -> Column:
    """Values times ``scale``, rounded half to even and clipped, as ints."""
    return F.transform(z, lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.rint(v * scale))).cast("int"))


def serialise(z: Column, scale: float = 10.0, clip: float = 99.0) -> Column:
    return F.array_join(quantise(z, scale, clip), ",")


def pad(x: Column, length: Column) -> Column:
    """Zeros appended up to ``length``."""
    return F.concat(x, F.array_repeat(F.lit(0.0), (length - F.size(x)).cast("int")))


def pad_mask(x: Column, length: Column) -> Column:
    """True where a padded series has values of its own."""
    return F.transform(F.sequence(F.lit(0), length.cast("int") - 1), lambda i: i < F.size(x))


def resize(x: Column, m: int) -> Column:
    """Linear interpolation at ``m`` equidistant points."""
    n = F.size(x)

    def at(i: Column) -> Column:
        pos = i * (n - 1) / F.lit(float(m - 1))
        low = F.least(F.floor(pos).cast("int"), F.greatest(n - 2, F.lit(0)))
        frac = pos - low
        return F.get(x, low) * (1 - frac) + F.coalesce(F.get(x, low + 1), F.get(x, low)) * frac

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at))


def decimate(x: Column, m: int) -> Column:
    """Nearest original value at ``m`` equidistant points (half to even)."""
    n = F.size(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.get(x, F.rint(i * (n - 1) / F.lit(float(m - 1))).cast("int"))))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def max_gap(x: Column, y: Column) -> Column:
    """Largest absolute difference of two arrays of equal length."""
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)


def valid_block(x: Column, valid: Column) -> Column:
    """The last ``valid`` values of a right-aligned padded series."""
    return F.slice(x, F.size(x) - valid + 1, valid)


def with_block(x: Column, block: Column) -> Column:
    """The padding of ``x`` followed by another valid block of the same length."""
    return F.concat(F.slice(x, F.lit(1), F.size(x) - F.size(block)), block)


def finite(v: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(math.inf)), 0.0).otherwise(v)
