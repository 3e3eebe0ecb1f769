"""URL filters: a sort-merge range join of canonical keys.

A host's key is its labels in reverse, each closed by a full stop, so that the hosts a rule covers are the keys that
begin with the rule's key: an interval of the sorted keys, and rules nest. Rules and urls are sorted together and swept
once. The sweep keeps the stack of open rules, one slot for each depth (number of labels): a rule that starts takes the
slot of its depth, and a slot is popped where the key at hand no longer begins with what it holds. The url's open rules
are what is left in the slots; of those its path fits, the longest decides.

Null urls and urls without `://` have an empty host and path and fit no rule; no rule means `default`. Rules of equal
length are taken by the greater text. Rules with null host or path are left out. A slot holds the paths of one host, so the
paths that rules name for a single host must fit into a row; hosts may be any number. Urls are dealt by hash over
`lanes` sorted lanes, or over 64 and more of about `lane_rows` urls each, so that a hot host has no lane of its own and
lanes grow in number, not in length; the rules are copied into every lane. Extra columns, repeated rows and empty tables
need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

RULES = [
    # fixed values: verdict, host, path
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    literals = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {literals} AS t(verdict, host, path)")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(ascii_lower(authority), F.lit("")), F.coalesce(path, F.lit(""))


def rules_by_key(rules: DataFrame) -> DataFrame:
    """key, depth and the rules (size, host, path, verdict) of each host that has some."""
    usable = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    own = usable.select(host_key(ascii_lower(F.col("host"))).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("size"), ascii_lower(F.col("host")).alias("host"), "path", "verdict").alias("r"))
    return own.groupBy("key").agg(F.collect_set("r").alias("rules")).withColumn("depth", F.size(F.split("key", r"\.")) - 1)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", lanes: int | None = None, lane_rows: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    if lanes is None:
        lanes = max(64, -(-pages.count() // lane_rows))
    host, path = parts(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("lane", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(lanes)).cast("int")).withColumn("key", host_key(F.col("host")))
    starts = rules_by_key(rules)
    depths = [r["depth"] for r in starts.select("depth").distinct().collect()]  # at most the labels of a host, 127
    starts = starts.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = urls.withColumn("is_url", F.lit(1)).unionByName(starts.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("lane").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = lambda d: F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(sweep)
    met = both.withColumns({f"slot{d}": slot(d) for d in depths}).where("is_url = 1")
    held = F.array_compact(F.array(*[F.when(F.col("key").startswith(F.col(f"slot{d}.key")), F.col(f"slot{d}.rules")) for d in depths])) if depths else F.array().cast(ArrayType(starts.schema["rules"].dataType))
    fitting = F.filter(F.flatten(held), lambda r: F.col("path").startswith(r["path"]))
    best = met.withColumn("best", F.array_max(fitting))
    return best.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
