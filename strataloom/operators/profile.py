"""Column profiles, semantic labels, key prediction and table classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.numeric import band, count_if, first_match, flags, ratio, rnd
from strataloom.functions.text import strip
from strataloom.operators.stats import moments, numeric_columns, one_row_to_long

# Column-name patterns and labels, first match wins.
NAME_PATTERNS = (
    (r"(^|_)id$", "identifier"),
    (r"email", "email"),
    (r"name", "name"),
    (r"phone|mobile", "phone_number"),
    (r"date|time|timestamp", "datetime"),
    (r"amount|price|cost|total|revenue|budget", "monetary_value"),
    (r"status|state", "status"),
    (r"country|city|address|region", "location"),
    (r"rating|score|index", "score"),
    (r"type|format|category|platform", "category"),
    (r"url|website|link", "url"),
    (r"gender", "gender"),
    (r"age", "age"),
    (r"text|review|title|description|notes", "text_content"),
    (r"units|count|quantity|volume|capacity", "quantity"),
)

# Name tokens and their labels (second rule set).
TOKEN_HINTS = {
    "id": "identifier", "key": "identifier", "ref": "identifier", "code": "identifier",
    "name": "person_or_org_name", "email": "email", "mail": "email",
    "date": "temporal", "time": "temporal",
    "amount": "monetary", "price": "monetary", "cost": "monetary", "revenue": "monetary",
    "qty": "quantity", "count": "quantity",
    "city": "location", "country": "location", "address": "location",
}

# Value shapes, all cells must match.
VALUE_SHAPES = (
    ("numeric", r"^-?[0-9]+(\.[0-9]+)?$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
)


def cell_text(df: DataFrame, c: str) -> Column:
    """Cell as trimmed text; empty text counts as null."""
    text = F.col(c)
    if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(text)
    elif not isinstance(df.schema[c].dataType, T.StringType):
        return text.cast("string")
    return F.nullif(strip(text.cast("string")), F.lit(""))


def value_counts(df: DataFrame, cols=None) -> DataFrame:
    """``column, value, copies`` for every distinct non-null cell.

    The shared base of the exact profile: copies are combined before the
    shuffle, so a value that fills a third of the table moves as one row.
    """
    cols = list(cols or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell_text(df, c).alias("value")) for c in cols])
    return (
        df.select(F.explode(cells).alias("cell"))
        .where(F.col("cell.value").isNotNull())
        .groupBy("cell.column", "cell.value")
        .agg(F.count("*").alias("copies"))
    )


def _told_apart(df: DataFrame, c: str) -> list[Column]:
    """What tells cells of a column apart as their text does; numbers and times without being spelled out."""
    kind, cell = df.schema[c].dataType, F.col(c)
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType)):
        return [cell]
    if isinstance(kind, T.FractionalType):
        return [cell, F.when(cell == 0, cell.cast("string"))]  # grouping takes -0.0 for 0.0, text does not
    return [cell_text(df, c)]


def counts_by_column(df: DataFrame, cols=None) -> DataFrame:
    """The rows of :func:`value_counts`, columns of one type grouped together, and only distinct cells made text.

    Cells of all columns in one grouping are a row each with its column's name and a spelled-out value: on wide tables
    of numbers that is most of the work.
    """
    cols = list(df.columns if cols is None else cols)
    kinds: dict[str, list[str]] = {}
    for c in cols:
        keys = _told_apart(df, c)
        kinds.setdefault("text" if len(keys) == 1 and isinstance(df.select(keys[0]).schema[0].dataType, T.StringType) else df.schema[c].dataType.simpleString(), []).append(c)
    out = None
    for together in kinds.values():
        keys = [_told_apart(df, c) for c in together]
        names = [f"k{i}" for i in range(len(keys[0]))]
        cells = [F.struct(F.lit(i).alias("no"), *[k.alias(n) for k, n in zip(key, names, strict=True)]) for i, key in enumerate(keys)]
        rows = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*") if len(cells) > 1 else df.select(cells[0].alias("cell")).select("cell.*")
        held = rows.where("k0 IS NOT NULL").groupBy("no", *names).agg(F.count("*").alias("copies"))
        text = F.coalesce("k1", F.col("k0").cast("string")) if len(names) > 1 else F.col("k0").cast("string")
        one = held.select(F.get(F.array(*map(F.lit, together)), "no").alias("column"), text.alias("value"), "copies")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "column string, value string, copies long")


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    cols = list(cols or df.columns)
    aggs = [F.count(cell_text(df, c)).alias(f"filled__{i}") for i, c in enumerate(cols)]
    aggs += [F.count("*").alias(f"rows__{i}") for i, _ in enumerate(cols)]
    return one_row_to_long(df.agg(*aggs), cols, {"rows": "long", "filled": "long"}).withColumn(
        "nulls", F.col("rows") - F.col("filled")
    )


def columns(df: DataFrame, table: str, cols=None, exact: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """``table, column, rows, filled, nulls, null_pct, cardinality, uniqueness_ratio, duplicate_proxy``."""
    cols = list(cols or df.columns)
    if exact:
        counts = counts if counts is not None else counts_by_column(df, cols)
        distinct = counts.groupBy("column").agg(F.count("*").alias("cardinality"))
    else:
        row = df.agg(*[F.approx_count_distinct(cell_text(df, c), 0.01).alias(f"cardinality__{i}") for i, c in enumerate(cols)])
        distinct = one_row_to_long(row, cols, {"cardinality": "long"})
    return (
        null_counts(df, cols)
        .join(F.broadcast(distinct), "column", "left")
        .withColumn("cardinality", F.coalesce("cardinality", F.lit(0).cast("long")))
        .select(
            F.lit(table).alias("table"), "column", "rows", "filled", "nulls",
            F.when(F.col("rows") > 0, rnd(100.0 * ratio("nulls", "rows"), 2)).alias("null_pct"),
            "cardinality",
            ratio("cardinality", F.greatest(F.lit(1), F.col("filled"))).alias("uniqueness_ratio"),
            (F.col("filled") - F.col("cardinality")).alias("duplicate_proxy"),
        )
    )


def column_moments(df: DataFrame, table: str) -> DataFrame:
    """Rounded min, max, mean and population deviation of the numeric columns."""
    return moments(df, numeric_columns(df)).select(
        F.lit(table).alias("table"), "column",
        *[rnd(c, 6).alias(c) for c in ("min", "max", "mean", "std")],
    )


def tables(frames: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """``columns`` of every table; one pass per table, plans unioned."""
    out = None
    for name, df in frames.items():
        one = columns(df, name, exact=exact)
        out = one if out is None else out.unionByName(one)
    return out


def samples(df: DataFrame, keep: int = 20, width: int = 120, cols=None) -> DataFrame:
    """The ``keep`` smallest distinct values per column, cut to ``width`` characters.

    Smallest values make the sample repeatable. The per-group limit is applied
    before the shuffle, so no task sees a whole column.
    """
    cols = list(cols or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell_text(df, c).alias("value")) for c in cols])
    rank = F.row_number().over(W.partitionBy("column").orderBy("value"))
    return (
        df.select(F.explode(cells).alias("cell")).select("cell.*").where(F.col("value").isNotNull()).distinct()
        .withColumn("position", rank).where(F.col("position") <= keep)
        .select("column", "position", F.substring("value", 1, width).alias("value"))
    )


def top_values(counts: DataFrame, keep: int = 5) -> DataFrame:
    """Most common values per column; ties go to the smaller text."""
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("copies"), "value"))
    return counts.withColumn("position", rank).where(F.col("position") <= keep)


def cell_stats(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """Text-cell view: numeric when at least max(3, 60%) of the filled cells parse."""
    parsed = F.regexp_replace("value", ",", "").try_cast("double")
    parse = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(parsed.isNotNull(), F.col("copies"))), F.lit(0)).alias("parsed"))
    need = F.greatest(F.lit(3), F.floor(0.6 * F.greatest(F.lit(1), F.col("filled"))))
    return profile.join(F.broadcast(parse), "column", "left").select(
        "column", F.col("filled").alias("count"), "nulls", rnd(ratio("nulls", F.greatest(F.lit(1), F.col("rows")))).alias("null_rate"),
        "cardinality", F.coalesce("parsed", F.lit(0)).cast("long").alias("parsed"),
        (F.coalesce("parsed", F.lit(0)) >= need).alias("is_numeric"),
    )


def anomalies(profile: DataFrame, outlier_counts: DataFrame) -> DataFrame:
    """Flags per column as an array and as joined text."""
    joined = profile.join(F.broadcast(outlier_counts.select("column", "zscore_outliers")), "column", "left")
    found = flags(
        (ratio("nulls", "rows") >= 0.5, "high_null_rate"),
        ((F.col("filled") >= 5) & (F.col("uniqueness_ratio") <= 0.2), "low_sample_uniqueness"),
        (F.coalesce("zscore_outliers", F.lit(0)) > 0, "numeric_outliers"),
    )
    return joined.select("table", "column", found.alias("anomalies"), F.array_join(found, ",").alias("flags"))


def rollup(flagged: DataFrame) -> DataFrame:
    """Column count, high-risk columns and their ratio per table."""
    risky = count_if(F.size("anomalies") > 0)
    return flagged.groupBy("table").agg(
        F.count("*").alias("column_count"),
        risky.alias("high_risk_column_count"),
        rnd(ratio(risky, F.greatest(F.lit(1), F.count("*")))).alias("high_risk_ratio"),
    )


def label_by_name(c="column", strict: bool = False) -> tuple[Column, Column]:
    """(label, confidence) from a column name; ``strict`` matches whole words."""
    name = F.lower(F.col(c) if isinstance(c, str) else c)
    wrap = (lambda p: p if p.startswith("(^") else rf"(^|_)({p})($|_)") if strict else (lambda p: p)
    label = first_match(*[(name.rlike(wrap(p)), v) for p, v in NAME_PATTERNS], other="unknown")
    return label, F.when(label == "unknown", F.lit(0.35)).otherwise(F.lit(0.72))


def label_columns(catalog: DataFrame, strict: bool = False) -> DataFrame:
    label, confidence = label_by_name("column", strict)
    return catalog.withColumn("label", label).withColumn("confidence", confidence).withColumn("method", F.lit("heuristic"))


def infer_types(counts: DataFrame) -> DataFrame:
    """``column, datatype``: the first shape that every filled cell has."""
    whole = [F.bool_and(F.col("value").rlike(p)).alias(name) for name, p in VALUE_SHAPES]
    return counts.groupBy("column").agg(*whole).select(
        "column", first_match(*[(F.col(name), name) for name, _ in VALUE_SHAPES], other="text").alias("datatype")
    )


def label_by_tokens(typed: DataFrame) -> DataFrame:
    """Token hints first (0.78), then the value shape; needs ``column, datatype``."""
    hints = F.create_map(*[F.lit(x) for pair in TOKEN_HINTS.items() for x in pair])
    words = F.split(F.trim(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", " ")), " ")
    known = F.filter(words, lambda w: F.coalesce(F.array_contains(F.map_keys(hints), w), F.lit(False)))
    hint = F.try_element_at(hints, F.try_element_at(known, F.lit(1)))
    shape = F.col("datatype")
    by_shape = first_match((shape == "email", "email"), (shape == "date", "temporal"), (shape == "numeric", "quantity"), other="free_text")
    score = first_match((shape == "email", 0.82), (shape == "date", 0.80), (shape == "numeric", 0.55), other=0.40)
    return typed.withColumn("label", F.coalesce(hint, by_shape)).withColumn(
        "confidence", F.when(hint.isNotNull(), F.lit(0.78)).otherwise(score)
    )


def predict_keys(profile: DataFrame) -> DataFrame:
    """``table, column, kind, uniqueness, score``: one best PK per table and all FK candidates."""
    name = F.lower("column")
    unique = ratio("cardinality", "filled")
    pk = (F.col("filled") > 0) & (unique >= 0.98) & (F.col("filled") >= F.greatest(F.lit(1), F.floor(0.95 * F.col("rows"))))
    fk = (F.col("filled") > 0) & ~pk & name.rlike("(_id$|_ref$|_key$|_code$|key$)") & (unique < 0.9)
    score = F.when(pk, 0.6 + F.when(name.rlike("(^id$|_id$|key|code)"), F.lit(0.3)).otherwise(F.lit(0.0))).otherwise(F.lit(0.6))
    best = F.row_number().over(W.partitionBy("table", "kind").orderBy(F.desc("score"), "column"))
    return (
        profile.withColumn("kind", F.when(pk, "PK").when(fk, "FK"))
        .where(F.col("kind").isNotNull())
        .withColumn("score", rnd(score, 3))
        .withColumn("position", best)
        .where((F.col("kind") == "FK") | (F.col("position") == 1))
        .select("table", "column", "kind", rnd(unique, 3).alias("uniqueness"), "score")
    )


def classify_tables(labelled: DataFrame) -> DataFrame:
    """Table role from its name and column labels (first rule set)."""
    name = F.lower("table")
    ids, money = count_if(F.col("label") == "identifier"), count_if(F.col("label").isin("monetary_value", "datetime"))
    grouped = labelled.groupBy("table").agg(ids.alias("ids"), money.alias("facts"))
    rules = (
        (name.rlike("_dim$|^dim_"), "reference_dimension", 0.82),
        (name.rlike("_fact$|^fact_"), "transaction_fact", 0.82),
        (name.rlike("audit|history"), "audit_history", 0.80),
        (name.rlike("config|setting"), "configuration", 0.78),
        ((F.col("ids") >= 2) & (F.col("facts") > 0), "transaction_fact", 0.70),
    )
    return grouped.select(
        "table",
        first_match(*[(t, v) for t, v, _ in rules], other="unknown").alias("table_label"),
        first_match(*[(t, s) for t, _, s in rules], other=0.4).alias("table_confidence"),
    )


def classify_by_content(labelled: DataFrame) -> DataFrame:
    """Table class from column labels (second rule set)."""
    has = {k: count_if(F.col("label") == k) for k in ("monetary", "temporal", "identifier", "person_or_org_name")}
    grouped = labelled.groupBy("table").agg(*[v.alias(k) for k, v in has.items()])
    rules = (
        ((F.col("monetary") >= 1) & (F.col("temporal") >= 1), "transactional", 0.7),
        (F.col("identifier") >= 2, "reference/dimension", 0.65),
        (F.col("person_or_org_name") >= 1, "entity_master", 0.6),
    )
    return grouped.select(
        "table",
        first_match(*[(t, v) for t, v, _ in rules], other="generic").alias("table_label"),
        first_match(*[(t, s) for t, _, s in rules], other=0.4).alias("table_confidence"),
    )


def metadata(df: DataFrame, table: str) -> DataFrame:
    """Datatype, label, null share, cardinality, action and an audit struct per column."""
    counts = value_counts(df)
    typed = label_by_tokens(
        columns(df, table, counts=counts)
        .join(F.broadcast(infer_types(counts)), "column", "left")
        .withColumn("datatype", F.coalesce("datatype", F.lit("unknown")))
    )
    action = F.when(F.col("confidence") >= 0.6, "auto_accept").otherwise("review_required")
    return typed.select(
        "table", "column", "datatype", "label", "confidence", "null_pct", "cardinality", action.alias("action"),
        F.struct(
            F.struct(F.col("confidence").alias("score"), band("confidence", ((0.75, "high"), (0.45, "medium")), "low").alias("band")).alias("confidence"),
            F.struct(F.lit("metadata_intelligence").alias("scorer"), F.lit("metadata").alias("stage")).alias("trace"),
            F.struct(action.alias("action")).alias("policy"),
        ).alias("audit"),
    )


def accuracy(labelled: DataFrame, classed: DataFrame, evidence: DataFrame, edges: DataFrame, predicted: DataFrame, declared: DataFrame) -> DataFrame:
    """One row of accuracy proxies over labels, table classes, join evidence and graph edges.

    The key detection rate compares predicted with declared foreign keys.
    """
    conf = F.col("confidence")
    cols = labelled.agg(
        F.count("*").alias("column_count"), rnd(F.coalesce(F.avg(conf), F.lit(0.0))).alias("mean_confidence"),
        count_if(conf < 0.5).alias("low_band"), count_if((conf >= 0.5) & (conf < 0.75)).alias("medium_band"),
        count_if(conf >= 0.75).alias("high_band"),
    )
    tabs = classed.agg(F.count("*").alias("table_count"), rnd(F.coalesce(F.avg("table_confidence"), F.lit(0.0))).alias("table_mean_confidence"))
    ev = evidence.agg(
        F.count("*").alias("evidence_count"), count_if(F.col("overlap_pct") >= 0.7).alias("strong_evidence"),
        count_if(F.col("overlap_pct") < 0.35).alias("weak_evidence"),
    )
    kinds = edges.agg(*[count_if(F.upper("edge_type") == k).alias(k.lower()) for k in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    keys = ["table", "column"]
    fk = declared.select(*keys).distinct().join(predicted.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left").agg(
        F.count("*").alias("declared_fks"), F.count("hit").alias("detected_fks")
    )
    one = _side_by_side(cols, tabs, ev, kinds, fk)
    edge_total = F.greatest(F.lit(1), F.col("extracted") + F.col("inferred") + F.col("ambiguous"))
    high, strong = F.col("high_band"), F.col("strong_evidence")
    return one.select(
        "*",
        rnd(F.when(F.col("declared_fks") == 0, F.lit(1.0)).otherwise(ratio("detected_fks", "declared_fks"))).alias("fk_detection_rate"),
        rnd(ratio("strong_evidence", F.greatest(F.lit(1), F.col("evidence_count")))).alias("evidence_success_rate"),
        rnd(ratio(F.abs(high - strong), F.greatest(F.lit(1), high + strong))).alias("calibration_proxy_error"),
        rnd((F.col("ambiguous") + F.col("weak_evidence")) / edge_total).alias("high_risk_edge_ratio"),
        rnd(F.col("weak_evidence") / F.greatest(F.lit(1), F.col("evidence_count"))).alias("contradiction_ratio"),
    )


def _side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Join one-row aggregates on a constant key (each side is a single row)."""
    out = None
    for df in one_row_frames:
        df = df.withColumn("one", F.lit(1))
        out = df if out is None else out.join(F.broadcast(df), "one")
    return out.drop("one")


side_by_side = _side_by_side


def corpus_profile(blocks: DataFrame) -> DataFrame:
    """Block and row counts per source; needs ``source_id, kind``."""
    return blocks.groupBy("source_id").agg(
        count_if(F.col("kind") == "text").alias("text_block_count"), count_if(F.col("kind") == "row").alias("table_row_count")
    )
