"""Readable text of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numeric import as_col

# Elements dropped with their content.
DROPPED = ("script", "style", "nav", "footer", "header")
# The common named entities, ampersand last.
ENTITIES = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "amp": "&"}


def unescape(text: Column) -> Column:
    for name, plain in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(plain))
    return text


def page_text(c) -> Column:
    """Text between tags, one line per text run, trimmed, without dropped elements.

    Comments and dropped elements still separate the runs around them.
    """
    out = F.regexp_replace(as_col(c), r"(?s)<!--.*?-->", "<x>")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "<x>")
    runs = F.transform(F.split(out, r"<[^>]*>"), lambda t: F.regexp_replace(unescape(t), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.array_join(F.filter(runs, lambda t: t != ""), "\n")


def html_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, text, sha`` per page."""
    return pages.select(key, page_text(html).alias("text")).withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
