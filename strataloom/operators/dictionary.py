"""The data dictionary: upsert from profiles, search, reviews, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.numeric import as_col, count_if, first_match, ratio, rnd

# Life cycle states and the decisions that lead to them.
STATUSES = ("draft", "reviewed", "approved", "deprecated")
DECISIONS = {"approve": "approved", "approved": "approved", "review": "reviewed", "reviewed": "reviewed", "deprecate": "deprecated", "deprecated": "deprecated", "draft": "draft"}


def transition(status, changed) -> Column:
    """A changed label takes an approved entry back to reviewed, a reviewed one to draft."""
    s, c = as_col(status), as_col(changed)
    return first_match(((s == "approved") & c, "reviewed"), ((s == "reviewed") & c, "draft"), (s.isin(*STATUSES), s), other="draft")


def entries(profile: DataFrame, labelled: DataFrame, classed: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Dictionary entries of tables and columns: ``key, entry_type, table, column, label, definition, risk``."""
    width = profile.groupBy("table").agg(F.count("*").alias("n"))
    tables = classed.join(width, "table").select(
        F.col("table").alias("key"), F.lit("table").alias("entry_type"), "table", F.lit(None).cast("string").alias("column"), F.col("table_label").alias("label"),
        F.concat(F.col("table"), F.lit(" is a "), F.col("table_label"), F.lit(" table with "), F.col("n"), F.lit(" columns")).alias("definition"),
    )
    cols = profile.join(labelled.select("table", "column", "label"), ["table", "column"]).select(
        F.concat_ws(".", "table", "column").alias("key"), F.lit("column").alias("entry_type"), "table", "column", "label",
        F.concat(F.col("column"), F.lit(" of "), F.col("table"), F.lit(" holds "), F.col("label"), F.lit(" values")).alias("definition"),
    )
    out = tables.unionByName(cols)
    if flagged is None:
        return out
    risk = flagged.select(F.concat_ws(".", "table", "column").alias("key"), F.size("anomalies").alias("anomaly_count"))
    return out.join(risk, "key", "left").fillna(0, ["anomaly_count"])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries (``key, entry_type, label, status, version``) after a profile; ``change`` tells created, updated or kept."""
    o = old.select("key", F.col("entry_type").alias("_type"), F.col("label").alias("_label"), F.col("status").alias("_status"), F.col("version").alias("_version"))
    both = new.select("key", "entry_type", "label").join(o, "key", "full_outer")
    seen, had = F.col("label").isNotNull(), F.col("_label").isNotNull()
    changed = seen & had & (F.col("label") != F.col("_label"))
    return both.select(
        "key", F.coalesce("entry_type", "_type").alias("entry_type"), F.coalesce("label", "_label").alias("label"),
        F.when(seen, transition(F.coalesce("_status", F.lit("draft")), F.coalesce(changed, F.lit(False)))).otherwise(F.col("_status")).alias("status"),
        (F.coalesce("_version", F.lit(0)) + F.when(seen, 1).otherwise(0)).alias("version"),
        first_match((seen & had, "updated"), (seen, "created"), other="kept").alias("change"),
    )


def upsert_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entry_type").agg(
        *[count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "kept")], F.count("*").alias("total")
    )


def search(rows: DataFrame, query: str | None = None, status: str | None = None, table: str | None = None, limit: int = 200) -> DataFrame:
    """Entries by status, table and a text found in key, label or definition."""
    out = rows
    if status:
        out = out.where(F.lower("status") == status.strip().lower())
    if table:
        out = out.where(F.col("table") == table)
    if query:
        q = " ".join(query.strip().lower().split())
        hay = F.lower(F.concat_ws(" ", *[c for c in ("key", "label", "definition") if c in out.columns]))
        out = out.where(hay.contains(q))
    order = [F.desc("updated_at")] if "updated_at" in out.columns else []
    return out.orderBy(*order, "key").limit(limit)


def review(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries after reviews (``key, decision, decided_by``) and the history with before and after."""
    names = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    made = decisions.select("key", F.try_element_at(names, F.lower(F.trim("decision"))).alias("_to"), "decided_by").where("_to IS NOT NULL")
    joined = rows.join(made, "key", "left")
    hit = F.col("_to").isNotNull()
    after = joined.withColumn("_before", F.col("status")).withColumn("_old", F.col("version")).withColumn("status", F.coalesce("_to", "status")).withColumn(
        "version", F.col("version") + F.when(hit, 1).otherwise(0)
    )
    history = after.where(hit).select(
        "key", F.struct(F.col("_before").alias("status"), F.col("_old").alias("version")).alias("before"), F.struct("status", "version").alias("after"), "decided_by"
    )
    return after.drop("_to", "_before", "_old", "decided_by"), history


def metrics(rows: DataFrame) -> DataFrame:
    """Entries per type and status, with the approved share."""
    counts = [count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rows.groupBy("entry_type").agg(F.count("*").alias("entries"), *counts).withColumn("approved_pct", rnd(100.0 * ratio("approved", "entries"), 2))
