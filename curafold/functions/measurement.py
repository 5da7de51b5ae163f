"""Reading messy source columns: name resolution, number parsing, source labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The number pattern, entity replacements and limit phrases must
# equal the specification for the parsed results to be right.
NUMBER_PATTERN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
SYMBOL_REPLACEMENTS = (("&gt;", ">"), ("&lt;", "<"), ("≥", ">="), ("≤", "<="))
LIMIT_PHRASES = (">", "<", "greater than", "less than", "more than")

DEFAULT_SOURCE = "Unknown"


def _squash(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch not in " _")


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """Find the column meant by one of ``candidates``.

    An exact match on squashed names wins, in candidate order; otherwise the
    first column (in table order) that contains, or is contained in, a candidate.
    """
    wanted = [_squash(c) for c in candidates]
    exact = {_squash(c): c for c in df.columns}
    for name in wanted:
        if name in exact:
            return exact[name]
    return next(
        (c for c in df.columns if any(w in _squash(c) or _squash(c) in w for w in wanted)),
        None,
    )


def require_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Project the resolved columns under their canonical names; a miss is an error."""
    found = {name: resolve_column(df, cands) for name, cands in wanted.items()}
    missing = [name for name, col in found.items() if col is None]
    if missing:
        raise ValueError(f"no column found for {missing}; available: {df.columns}")
    return df.select(*[F.col(f"`{col}`").alias(name) for name, col in found.items()])


def _unescaped(text: Column) -> Column:
    for old, new in SYMBOL_REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def parse_measurement(raw: Column) -> Column:
    """``struct(value, is_limit, note)``; ``value`` is the mean of every number found."""
    text = _unescaped(F.trim(raw.cast("string")))
    lowered = F.lower(text)
    is_limit = F.lit(False)
    for phrase in LIMIT_PHRASES:
        is_limit = is_limit | F.contains(lowered, F.lit(phrase))
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), 0), lambda m: m.cast("double")
    )
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)
    found = F.size(numbers) > 0
    missing = raw.isNull() | (text == "NaN")
    return F.struct(
        F.when(~missing & found, F.try_divide(total, F.size(numbers).cast("double"))).alias("value"),
        F.coalesce(is_limit, F.lit(False)).alias("is_limit"),
        F.when(missing, F.lit("missing"))
        .when(found, F.lit("ok"))
        .otherwise(F.lit("no_numeric"))
        .alias("note"),
    )


def normalize_source(
    raw: Column,
    exact: Mapping[str, str],
    contains: Mapping[str, str],
    default: str = DEFAULT_SOURCE,
) -> Column:
    """Map free-form source labels: exact codes first, then substrings, then ``default``."""
    text = F.lower(F.trim(raw.cast("string")))
    result = F.when(raw.isNull(), F.lit(default))
    for code, label in exact.items():
        result = result.when(text == code.lower(), F.lit(label))
    for part, label in contains.items():
        result = result.when(F.contains(text, F.lit(part.lower())), F.lit(label))
    return result.otherwise(F.lit(default))


def finite(value: Column) -> Column:
    """True for a non-null, non-NaN, non-infinite number; never NULL."""
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False)
    )


def strict_double(raw: Column) -> Column:
    """``struct(value, problem)``: ``problem`` is NULL only for a finite number."""
    value = F.trim(raw.cast("string")).try_cast("double")
    return F.struct(
        F.when(finite(value), value).alias("value"),
        F.when(raw.isNull(), F.lit("missing"))
        .when(value.isNull(), F.lit("not_numeric"))
        .when(~finite(value), F.lit("not_finite"))
        .alias("problem"),
    )


def sanitize(value: Column) -> Column:
    """NaN, infinities and numbers outside the float32 range become NULL."""
    limit = F.lit(3.4028234663852886e38)
    as_double = value.cast("double")
    return F.when(~F.isnan(as_double) & (F.abs(as_double) <= limit), as_double)
