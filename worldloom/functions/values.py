"""Column expressions over typed values spelled as JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Levels every VARIANT round trip masters.
_LEVELS = 200


def _spelled(texts: pa.Array) -> pa.Array:
    from worldloom.operators.nested import spellings

    return spellings(texts)


def canonical(value_json: Column | str) -> Column:
    """One spelling per typed value: field order, white space and escapes are normalised by a VARIANT round trip.

    The round trip gives up below some hundred levels, for every spelling of a value alike; those values are
    spelled by a hash from their structural index.  Only texts with enough brackets to be so deep travel there.
    Text that is no JSON keeps its own spelling behind a ``!``; null stays null.  Arrays keep their order, so
    lists and map entries compare in order.
    """
    v = F.col(value_json) if isinstance(value_json, str) else value_json
    deep = (F.length(v) >= 2 * _LEVELS) & (F.length(v) - F.length(F.translate(v, "[{", "")) >= _LEVELS)
    return F.coalesce(F.to_json(F.try_parse_json(v)), F.arrow_udf(_spelled, StringType())(F.when(deep, v)), F.concat(F.lit("!"), v))


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it: a lambda's variable is bound, not inlined."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _two_hashes(*parts: Column) -> Column:
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(97), *parts).alias("b"))


def value_hash(value_json: Column | str) -> Column:
    """Two independent 64-bit hashes of the canonical spelling; null stays distinguishable from every value."""
    return once(canonical(value_json), lambda c: F.when(c.isNotNull(), _two_hashes(c)))


def code_text(code: Column | str) -> Column:
    """A program as one string that keeps null, empty, null lines and line ends apart."""
    c = F.col(code) if isinstance(code, str) else code
    return F.to_json(F.struct(c.alias("c")))


def code_hash(code: Column | str) -> Column:
    """As ``value_hash``, of a program's lines; no program (null) stays null."""
    c = F.col(code) if isinstance(code, str) else code
    marked = F.transform(c, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("~")))
    return once(marked, lambda lines: F.when(lines.isNotNull(), _two_hashes(F.size(lines), lines)))


def double_of_bits(bits: Column | str) -> Column:
    """The number behind 16 hex digits of a binary64, by arithmetic on its fields; NaN and infinities included."""
    b = F.col(bits) if isinstance(bits, str) else bits
    hi = F.conv(F.substring(b, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(b, 9, 8), 16, 10).cast("bigint")
    exp = F.shiftright(hi, 20).bitwiseAND(0x7FF)
    frac = (hi.bitwiseAND(0xFFFFF) * F.lit(float(2**32)) + lo) / F.lit(float(2**52))
    sign = F.when(F.shiftright(hi, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    special = F.when(frac == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = sign * frac * F.pow(F.lit(2.0), F.lit(-1022.0))
    return F.when(exp == 0x7FF, special).when(exp == 0, small).otherwise(sign * (1 + frac) * F.pow(F.lit(2.0), (exp - 1023).cast("double")))


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Whether two numbers are close, as tolerant comparisons mean it; null where either is null."""
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
