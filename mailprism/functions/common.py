"""Small column helpers: truthiness, rounding, seeded hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    A lambda evaluates what it captures for every element, so a costly outer value must be
    bound first. A one-element array gives it a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_nonempty(*values: Column | str) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    options = [F.nullif(as_column(v), F.lit("")) for v in values]
    return F.coalesce(*options, F.lit(""))


def round_half_even(value: Column | str, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    `bround` looks at the shortest decimal text of a double, so it calls 2.675 a tie; its
    binary value lies below. The product value*10^digits is split into a rounded part and
    its exact error, and the error decides when the rounded part ends in one half.
    """
    scale = float(10**digits)
    x = as_column(value)
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    product = x * F.lit(scale)
    error = (high * F.lit(scale) - product) + low * F.lit(scale)
    base = F.floor(product).cast("double")
    half = product - base
    odd = F.pmod(base, F.lit(2.0)) == 1.0
    up = (half > 0.5) | ((half == 0.5) & ((error > 0.0) | ((error == 0.0) & odd)))
    return F.when(up, base + 1.0).otherwise(base) / F.lit(scale)


def unit_hash(seed: int | str, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) that depends only on the seed and the keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_column(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def hash_index(size: int, seed: int | str, *keys: Column | str) -> Column:
    """Seeded pick of a zero-based index below `size`."""
    return F.floor(unit_hash(seed, *keys) * size).cast("int")


def pick(options: Sequence[str], seed: int | str, *keys: Column | str) -> Column:
    """Seeded pick from a fixed list of strings."""
    choices = F.array(*[F.lit(o) for o in options])
    return F.element_at(choices, hash_index(len(options), seed, *keys) + 1)


def iso_utc(value: Column | str) -> Column:
    """Timestamp as ISO-8601 text in UTC, microseconds kept.

    The session time zone must be UTC, which `local_session` sets.
    """
    return F.date_format(as_column(value), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
