"""Operators that look into the future: kept apart from the causal ones."""

from __future__ import annotations

from typing import Any

from tidewheel.operators.joins import nearest_join
from tidewheel.operators.rowwise import shifted
from tidewheel.pipeline import Pipeline, Transform, operator


@operator
def future_join(right: Pipeline, key: Any = None, tolerance: Any = None, strict: bool = False, leftprefix: str | None = None, rightprefix: str | None = None, righttime: str | None = None, by_buckets: bool | int | None = None) -> Transform:
    """Append the earliest right row at or after each left row (after it, with ``strict``); the first wins among equal times."""
    return nearest_join(right, True, key, tolerance, strict, leftprefix, rightprefix, righttime, by_buckets)


@operator
def lead(offset: Any) -> Transform:
    """Move rows earlier in time; the upstream runs over the window moved later."""
    return shifted(offset, True, "a lead")
