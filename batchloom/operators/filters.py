"""Row filters. Each takes plain parameters and gives a predicate Column."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from batchloom import schemas
from batchloom.functions.timing import moment
from batchloom.operators.skew import skew_join

log = logging.getLogger(__name__)
SHORT_LIST = 1000


def status_is(value: str | None, strict: bool = True) -> Column | None:
    """Status equality. An unknown value is an error, or ignored when not ``strict``."""
    if not value:
        return None
    wanted = value if strict else value.lower()
    if wanted not in schemas.BATCH_STATUSES:
        if strict:
            raise ValueError(f"invalid status filter: {value}")
        log.warning("invalid status filter ignored: %s", value)
        return None
    return F.col("status") == wanted


def not_soft_deleted() -> Column:
    """Three-valued on purpose: a cancelled batch without a message is not kept."""
    return ~((F.col("status") == "cancelled") & F.col("error_message").like(f"%{schemas.SOFT_DELETE_MARK}%"))


def success_is(value: str | None) -> Column | None:
    """success / failed (also true / false); anything else filters nothing."""
    wanted = (value or "").lower()
    if wanted in ("success", "true"):
        return F.col("success")
    if wanted in ("failed", "false"):
        return ~F.col("success")
    return None


def failed_only(flag: bool = True) -> Column | None:
    return ~F.col("success") if flag else None


def created_from(start: Column | str | datetime | None) -> Column | None:
    return None if start is None else F.col("created_at") >= moment(start)


def created_until(end: Column | str | datetime | None) -> Column | None:
    return None if end is None else F.col("created_at") <= moment(end)


def has_store_name(flag: bool = True) -> Column | None:
    return F.col("store_name").isNotNull() if flag else None


def has_contact_value(flag: bool = True) -> Column | None:
    """Not null; an empty contact passes here."""
    return F.col("business_contact").isNotNull() if flag else None


def batch_id_in(ids: Sequence | None) -> Column | None:
    if ids is None:
        return None
    return F.col("batch_id").isin(list(ids))


def keep_batches(df: DataFrame, ids: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows of the batches in ``ids``, for lists of any length."""
    return skew_join(df, ids.select("batch_id").distinct(), ["batch_id"], "left_semi", spread)


def store_name_like(text: str | None) -> Column | None:
    """Contains, in any case; ``%`` and ``_`` in the text stay wildcards."""
    return None if text is None else F.col("store_name").ilike(f"%{text}%")


def store_image_is(value: str) -> Column | None:
    if value == "true":
        return F.col("store_image")
    if value == "false":
        return ~F.col("store_image")
    return None


def batch_id_matches(text: str | None) -> Column | None:
    """Equality for a whole UUID in any of its spellings, otherwise a part of the id's text in any case."""
    if not text:
        return None
    shown = F.col("batch_id").cast("string")
    try:
        return shown == str(uuid.UUID(text))
    except ValueError:
        return shown.ilike(f"%{text}%")


def contact_present(value: str) -> Column | None:
    contact = F.col("business_contact")
    if value == "true":
        return contact.isNotNull() & (contact != "")
    if value == "false":
        return contact.isNull() | (contact == "")
    return None


def compose(predicates: Iterable[Column | None]) -> Column | None:
    chosen = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, chosen) if chosen else None


def where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    both = compose(predicates)
    return df if both is None else df.filter(both)
