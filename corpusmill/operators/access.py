"""Filters on the vector table and the category allow-lists behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the vector table that a filter may name directly; other keys look into the metadata.
_COLUMNS = ("category", "session_id", "filename")


def where_column(where: dict | None, metadata: str = "metadata") -> Column | None:
    """Translate a filter dictionary to a predicate; ``None`` means no restriction.

    A list of categories is a membership test and an empty list admits nothing. Keys without a
    column of their own compare the text of that metadata field.
    """
    if not where:
        return None
    if not isinstance(where, dict):
        raise ValueError(f"unsupported filter: {where!r}")
    if set(where) == {"$and"}:
        parts = [p for p in (where_column(w, metadata) for w in where["$and"] or []) if p is not None]
    else:
        parts = [_test(key, value, metadata) for key, value in where.items()]
    return reduce(lambda a, b: a & b, parts) if parts else None


def _test(key: str, value, metadata: str) -> Column:
    if key == "category" and isinstance(value, (list, tuple, set, frozenset)):
        return F.col("category").isin(sorted(value)) if value else F.lit(False)
    if key in _COLUMNS:
        return F.col(key) == F.lit(value)
    return F.get_json_object(F.col(metadata), f"$['{key}']") == F.lit(str(value))


def apply_where(df: DataFrame, where: dict | None, metadata: str = "metadata") -> DataFrame:
    predicate = where_column(where, metadata)
    return df if predicate is None else df.where(predicate)


def resolve_categories(category: str | None, allowed: list[str] | None, parity: bool = False):
    """(granted, filter): what a caller with allow-list ``allowed`` may search.

    ``None`` or a list holding ``*`` does not restrict. An empty list denies; with ``parity`` it
    does not restrict.
    """
    if allowed is not None and not allowed and not parity:
        return False, None
    if not allowed or "*" in allowed:
        return True, category
    if category:
        return category in allowed, category
    return True, list(allowed)


def allowed_categories(categories: Column, auth_enabled: bool = True) -> Column:
    """Allow-list of a user row: null when nothing is restricted."""
    if not auth_enabled:
        return F.lit(None).cast("array<string>")
    free = categories.isNull() | (F.size(categories) == 0) | F.array_contains(categories, "*")
    return F.when(~free, categories)


def can_see(categories: Column, category: Column) -> Column:
    """Whether a user row may see a category; no category means yes."""
    allowed = allowed_categories(categories)
    return category.isNull() | allowed.isNull() | F.array_contains(allowed, category)


def visible_sessions(sessions: DataFrame, username: str | None, is_admin: bool = False) -> DataFrame:
    """Admins see every session, others their own and those without an owner."""
    if is_admin:
        return sessions
    return sessions.where(F.col("owner").isNull() | (F.col("owner") == "") | (F.col("owner") == F.lit(username)))


def ordered_categories(categories: Column, order: list[str]) -> Column:
    """The known categories a user may see, in their fixed order."""
    known = F.array(*[F.lit(c) for c in order])
    allowed = allowed_categories(categories)
    return F.when(allowed.isNull(), known).otherwise(F.filter(known, lambda c: F.array_contains(allowed, c)))


def grantable(categories: Column, known: list[str]) -> Column:
    """Categories that can be given to a new user; nothing valid left means all known ones."""
    valid = F.array_intersect(categories, F.array(*[F.lit(c) for c in [*known, "*"]]))
    return F.when(F.size(valid) > 0, valid).otherwise(F.array(*[F.lit(c) for c in known]))
