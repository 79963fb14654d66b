"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong secrets are found by three patterns. Weak parts (an account name, a bare
mixed token, an endpoint) are no finding by themselves; an interval join within
one document reports them where the parts that complete a credential stand
within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import row_key
from strataloom.session import cut_lineage

REACH = 200  # code points between two parts of one credential

# The three base patterns and the least length of what they catch.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

WEAK_ACCESS = r"""(?i)(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i)https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])"""

#: kind, pattern, a cheap condition that every match implies
KINDS = (
    ("assign", ASSIGN, r"[:=]"),
    ("access", ACCESS, "AKIA"),
    ("hex", HEX, r"[0-9a-f]{16}"),
    ("link_access", WEAK_ACCESS, r"[:=]"),
    ("link_secret", WEAK_SECRET, r"[A-Za-z0-9+/_-]{20}"),
    ("link_endpoint", ENDPOINT, r"://|[0-9]\.[0-9]"),
)
BASE = ("assign", "access", "hex")
#: what each part can stand for in a credential
ROLES = {"assign": "secret", "hex": "secret", "access": "access", "link_access": "access", "link_secret": "secret", "link_endpoint": "endpoint"}
#: the roles that must be within reach of a weak part
NEEDS = {"link_access": ("secret",), "link_secret": ("access",), "link_endpoint": ("access", "secret")}


def _searched(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """The pieces of a text around the matches, and the matches."""
    pattern = rf"[0-9a-f]{{{LEAST['hex']},}}" if kind == "hex" else pattern  # runs are whole either way
    some = text.rlike(hint) if kind != "access" else text.contains(hint)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.struct(F.lit(kind).alias("kind"), F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"))
    return F.when(some & text.rlike(pattern), found)


def _kept(kind: str = "kind", hit: str = "hit") -> Column:
    size = F.when(F.col(kind) == "assign", F.length(F.regexp_extract(hit, ASSIGN, 2))).otherwise(F.length(hit))
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])
    return size >= F.coalesce(least[F.col(kind)], F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """One row per match, ``doc_id, key, kind, start, stop``, and one of null ``kind`` per document row.

    A match's place is the length of all pieces and matches before it, summed
    over the document's matches of that kind in order, so the work is linear in
    the number of matches.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    itself = F.struct(F.lit(None).cast("string").alias("kind"), F.array(F.lit("")).alias("gaps"), F.array(F.lit("")).alias("hits"))
    own = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), F.array(itself, *[_searched(text, *k) for k in KINDS]).alias("found"))
    each = own.select("doc_id", "key", F.explode("found").alias("f")).where("f IS NOT NULL")
    each = each.select("doc_id", "key", "f.kind", F.posexplode(F.arrays_zip("f.gaps", "f.hits")).alias("i", "part")).select(
        "doc_id", "key", "kind", "i", F.length("part.gaps").alias("gap"), F.col("part.hits").alias("hit")
    )
    return cut_lineage(each.where("hit IS NOT NULL").select("doc_id", "key", "kind", "i", "gap", F.length("hit").alias("size"), _kept().alias("kept")))


def spans(matches: DataFrame) -> DataFrame:
    """``doc_id, key, kind, start, stop`` of the matches that are long enough; equal rows of the input count once."""
    so_far = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    once = matches.where("kind IS NOT NULL").distinct()
    return once.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("kept").select(
        "doc_id", "key", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop"
    )


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts that are completed within ``reach`` code points of the same document.

    An interval join: parts are dealt to stretches of ``reach`` code points, a
    weak part also to the neighbouring ones, and met there; a stretch holds few
    parts, as a part has a least length.
    """
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    at = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))
    weak = parts.where(F.col("kind").isin(*NEEDS)).select("doc_id", "key", "kind", "start", "stop", at(F.col("start") - reach, F.col("stop") + reach).alias("stretch"))
    other = parts.select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("start").alias("from"), F.col("stop").alias("to"), roles[F.col("kind")].alias("role"),
        at(F.col("start"), F.col("stop")).alias("s"),
    )
    near = (F.col("from") - F.col("stop") <= reach) & (F.col("start") - F.col("to") <= reach)
    met = weak.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("stretch") == F.col("s")) & near)
    sides = {role: F.max((F.col("role") == role) & ((F.col("from") >= F.col("stop")) | (F.col("to") <= F.col("start")))) for role in ("access", "secret")}
    gathered = met.groupBy("doc_id", "key", "kind", "start", "stop").agg(*[flag.alias(role) for role, flag in sides.items()])
    complete = [(F.col("kind") == kind) & F.expr(" AND ".join(needed)) for kind, needed in NEEDS.items()]
    return gathered.where(complete[0] | complete[1] | complete[2]).select("doc_id", "key", "kind", "start", "stop")


def _joined(array: str) -> Column:
    """``kind:start:stop`` by start, then kind as listed."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs(doc_id, text)``.

    A null or empty text has no spans. Rows with one id and different texts are
    told apart by their text; equal rows are reported alike; a null id is an id.
    Other columns are not looked at. What overlaps a part does not complete it.
    """
    matches = scan(docs)
    rows = matches.where("kind IS NULL").select("doc_id", "key")
    parts = cut_lineage(spans(matches))
    every = parts.where(F.col("kind").isin(*BASE)).unionByName(link(parts, reach))
    listed = F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind"))
    gathered = every.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", listed.alias("listed"), "stop", "kind"))).alias("all"))
    base = F.filter("all", lambda x: x["listed"] <= len(BASE))
    shown = gathered.withColumn("base", base).select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), _joined("base").alias("base"), _joined("all").alias("all"),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) AS long)").alias(f"n_{kind}") for kind in BASE],
    )
    return rows.join(shown, rows["doc_id"].eqNullSafe(shown["d"]) & (rows["key"] == shown["k"]), "left").select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("all", F.lit("")).alias("spans"),
    )
