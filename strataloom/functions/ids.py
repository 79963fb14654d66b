"""Stable identifiers from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.numeric import as_col
from strataloom.functions.text import norm_label, strip


def stable_id(prefix: str, *parts) -> Column:
    """``prefix_`` and 16 hex digits of the SHA-1 of the parts joined with colons."""
    text = F.concat_ws(":", *[as_col(p).cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16))


def _low(c, default: str) -> Column:
    text = F.lower(strip(as_col(c)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def entity_id(kind, label) -> Column:
    return stable_id("ce", _low(kind, "entity"), F.lower(strip(as_col(label))))


def relation_id(source, relation, target, chunk_idx) -> Column:
    return stable_id("cr", source, _low(relation, "related_to"), target, chunk_idx)


def entity_id_2(kind, label) -> Column:
    """Second rule set: type and the squeezed label."""
    return stable_id("c", kind, norm_label_2(label))


def norm_label_2(label) -> Column:
    """Other characters vanish, blanks stay and are squeezed."""
    kept = F.regexp_replace(F.lower(as_col(label)), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def edge_key(source, relation, target) -> Column:
    return F.concat_ws("|", as_col(source), as_col(relation), as_col(target))


__all__ = ["edge_key", "entity_id", "entity_id_2", "norm_label", "norm_label_2", "relation_id", "stable_id"]
