"""Verdicts over per-row part lists and member sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def disallowed_members(members: Column, allowed: Sequence[str], reason: str) -> Column:
    """``reason:offender,offender`` in sorted order, or NULL when every member is allowed."""
    extra = F.array_sort(F.array_except(members, F.array(*[F.lit(a) for a in allowed])))
    return F.when(
        F.size(extra) > 0, F.concat(F.lit(reason + ":"), F.array_join(extra, ","))
    )


def part_sizes(parts: Column) -> Column:
    """Part lengths, largest first."""
    return F.sort_array(F.transform(parts, F.length), asc=False)


def has_dominant_part(sizes: Column, ratio: float = 0.5) -> Column:
    """False when the second largest part reaches ``ratio`` of the largest."""
    second_share = F.try_divide(
        F.try_element_at(sizes, F.lit(2)).cast("double"),
        F.try_element_at(sizes, F.lit(1)).cast("double"),
    )
    return ~F.coalesce(second_share >= ratio, F.lit(False))


def dominant_part(parts: Column) -> Column:
    """Longest part; among equally long ones the first in list order."""
    longest = F.array_max(F.transform(parts, F.length))
    return F.try_element_at(F.filter(parts, lambda p: F.length(p) == longest), F.lit(1))


def entity_validity(
    raw: Column,
    parsed_ok: Column,
    qualifying_parts: Column,
    members: Column,
    size: Column,
    required: str,
    allowed: Sequence[str],
    min_size: int,
    ratio: float = 0.5,
) -> Column:
    """First failing rule as a reason text, ``ok`` when the entity passes them all."""
    return (
        F.when(raw.isNull(), F.lit("missing"))
        .when(F.trim(raw) == "", F.lit("empty"))
        .when(~F.coalesce(parsed_ok, F.lit(False)), F.lit("unparsable"))
        .when(
            ~has_dominant_part(part_sizes(qualifying_parts), ratio),
            F.lit("several_comparable_parts"),
        )
        .when(
            ~F.coalesce(F.array_contains(members, required), F.lit(False)),
            F.lit("required_member_absent"),
        )
        .otherwise(
            F.coalesce(
                disallowed_members(members, allowed, "disallowed_members"),
                F.when(size < min_size, F.lit("too_small")),
                F.lit("ok"),
            )
        )
    )
