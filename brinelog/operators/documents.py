"""JSON documents of unknown shape as variants: flattened level by level, canonical text rebuilt from the bottom.

Every level of every document is one step of the same few joins, so the number of steps is the deepest nesting. A container's
children meet in one group: as many as one document holds. Flattening joins nothing; the joins of canonical text by document never broadcast: ids compress so well in a written
table that Spark would take millions of documents for a few megabytes.

What can't be read, null, and objects that repeat a key are null as a whole. Numbers are doubles, as the canonical text has them; a negative
zero loses its sign."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.written import saved


def lowered(told: Column) -> Column:
    """JSON text with its control characters' escapes in lower case."""
    lower = told
    for code in (11, 14, 15, *range(26, 32)):  # of the escapes without a letter of their own, those with a letter among their digits
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(F.contains(told, F.lit("\\u00")), lower).otherwise(told)


def quoted(text: Column) -> Column:
    told = F.to_json(F.array(text))
    return lowered(F.substring(told, F.lit(2), F.length(told) - 2))


@F.pandas_udf(T.StringType())
def long_number(x: pd.Series) -> pd.Series:
    """Twelve significant digits of numbers that have more, where the JVM would round a rounded text once more; null stays null."""
    return x.map(lambda v: None if v is None or pd.isna(v) else f"{v:.12g}")


def twelve_digits(x: Column, told: Column) -> Column:
    """A number's text of twelve significant digits, without zeros at its end, by exponent below 1e-4 and from 1e12; told: with exponent. Right
    for numbers that aren't rough."""
    power = F.substring_index(told, "e", -1).try_cast("int")
    digits = F.replace(F.substring_index(told, "e", 1), F.lit("."), F.lit(""))
    stripped = lambda whole, rest: F.concat(whole, F.when(F.rtrim(rest, F.lit("0")) == "", "").otherwise(F.concat(F.lit("."), F.rtrim(rest, F.lit("0")))))
    plain = F.when(power >= 0, stripped(F.substring(digits, F.lit(1), power + 1), F.substring(digits, power + 2, F.lit(12)))).otherwise(stripped(F.lit("0"), F.concat(F.repeat(F.lit("0"), -power - 1), digits)))
    tens = F.abs(power).cast("string")
    scientific = F.concat(stripped(F.substring(digits, 1, 1), F.substring(digits, 2, 12)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, F.concat(F.lit("0"), tens)).otherwise(tens))
    short = F.when((power < -4) | (power >= 12), scientific).otherwise(plain)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), short))


def rough(x: Column, told: Column) -> Column:
    """The number where its twelve digits aren't all of it, else null; numbers near the least have fewer digits of their own."""
    return F.when((x != 0) & ~((told.try_cast("double") == F.abs(x)) & (F.abs(x) > 1e-300)), x)


def levels(documents: DataFrame, own: str = "id", named: bool = True) -> list[DataFrame]:
    """Each level of documents (own, v): own, at (positions from the top), path, key, kind and, of containers, v and, where they are
    empty, text; of scalars, text (canonical); name, if named, is the key in quotes.

    No container is written out as text to see whether it is empty: a level would cost as much as everything below it."""
    spark = documents.sparkSession
    level = documents.select(own, F.array().cast("array<int>").alias("at"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), "v")
    found = []
    while True:
        shape, first = F.col("shape"), F.expr("try_variant_get(v, '$[0]', 'variant')")
        kind = F.when(F.startswith(shape, F.lit("OBJECT<")), "object").when(F.startswith(shape, F.lit("ARRAY<")), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
        hollow = F.when(shape == "OBJECT<>", "{}").when(F.startswith(shape, F.lit("ARRAY<")) & first.isNull(), "[]")
        level = level.withColumn("shape", F.schema_of_variant("v")).withColumns({"kind": kind, "hollow": hollow}).drop("shape").withColumn("number", F.when(F.col("kind") == "number", F.expr("try_variant_get(v, '$', 'double')")))
        word = F.expr("try_variant_get(v, '$', 'string')")
        scalar = F.when(F.col("kind") == "string", F.to_json(F.array(word))).when(F.col("kind") == "number", F.format_string("%.11e", F.abs("number"))).when(F.col("kind") == "boolean", word)
        name = {"name": F.when(F.col("key").isNotNull(), quoted(F.col("key")))} if named else {}
        level = level.withColumns({"scalar": scalar} | name).withColumn("rough", F.when(F.col("kind") == "number", rough(F.col("number"), F.col("scalar"))))
        level = saved(level, "level")  # written once, or each mention would be formatted again
        told = lowered(F.substring("scalar", F.lit(2), F.length("scalar") - 2))
        number = F.concat(F.lit('"'), twelve_digits(F.col("number"), F.col("scalar")), F.lit('"'))
        text = F.when(F.col("kind") == "string", told).when(F.col("kind") == "boolean", F.col("scalar")).when(F.col("kind") == "null", "null").when(F.col("kind") == "number", number).otherwise(F.col("hollow"))
        made, far = level.where("rough IS NULL").withColumn("text", text), level.where("rough IS NOT NULL")
        if not far.isEmpty():  # only these rows go to Python
            made = made.unionByName(far.withColumn("text", F.concat(F.lit('"'), long_number("rough"), F.lit('"'))))
        found.append(made)
        containers = level.where("kind IN ('object', 'array')")
        if containers.isEmpty():
            return found
        step = F.when(F.col("e_key").isNull(), F.concat(F.lit("["), F.col("e_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "e_key"))
        each = containers.select(own, "at", "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(own, "at", "path", F.col("pos").alias("e_pos"), F.col("key").alias("e_key"), F.col("value").alias("e_value"))
        level = each.select(own, F.concat("at", F.array("e_pos")).alias("at"), F.concat("path", step).alias("path"), F.col("e_key").alias("key"), F.col("e_value").alias("v"))


def read(rows: DataFrame, text: str) -> DataFrame:
    """The rows with an id of their own and their document as a variant, written once. Spark reads a document and passes over what
    follows it; within an array before the text's own digest it can't, so only whole texts count."""
    framed = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(',"'), F.sha2(text, 256), F.lit('"]')))
    whole = F.try_variant_get(framed, "$[1]", "string") == F.sha2(text, 256)
    return saved(rows.select("*", F.monotonically_increasing_id().alias("id"), F.when(whole, F.try_parse_json(text)).alias("v")), "documents")


def flattened(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, kind, value of every scalar and empty container of the documents that can be read."""
    return flattened_variants(read(rows.select(F.col(key).alias("key_of"), F.col(text).alias("text_of")), "text_of"), "key_of", "v").withColumnRenamed("key_of", key)


def flattened_variants(rows: DataFrame, key: str, variant: str) -> DataFrame:
    """The same of documents that are variants already. The key goes along, so that nothing is joined by document: a few documents with
    millions of values each would be as many tasks' sort."""
    whole = rows.select(F.col(key).alias("key_of"), F.col(variant).alias("v")).where("v IS NOT NULL")
    each = [p.where("kind NOT IN ('object', 'array') OR hollow IS NOT NULL").select("key_of", "path", "kind", F.coalesce("text", F.to_json("v")).alias("value")) for p in levels(whole, "key_of", named=False)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("key_of", key)


def canonical(rows: DataFrame, text: str, name: str = "canonical") -> DataFrame:
    """The rows with the canonical JSON of a text column: sorted keys, no spaces, numbers as text of twelve significant digits."""
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row_of"), F.col(text).alias("text_of"))
    whole = read(own, "text_of")
    parts = levels(whole.where("v IS NOT NULL").select("id", "v"))
    below = saved(parts[-1].select("id", "at", "key", "name", "text"), "texts")
    for part in reversed(parts[:-1]):
        inside = below.withColumn("pos", F.element_at("at", -1)).withColumn("at", F.slice("at", 1, F.size("at") - 1))
        members = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "name", "text")))), lambda m: F.concat(m["name"], F.lit(":"), m["text"])), ",")
        items = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isNull(), F.struct("pos", "text")))), lambda m: m["text"]), ",")
        grouped = inside.groupBy("id", "at").agg(members.alias("members"), items.alias("items"))
        met = part.select("id", "at", "key", "name", "kind", "text").join(grouped.hint("merge"), ["id", "at"], "left")
        made = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce("members", F.lit("")), F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce("items", F.lit("")), F.lit("]"))).otherwise(F.col("text"))
        below = saved(met.select("id", "at", "key", "name", made.alias("text")), "texts")
    return whole.join(below.select("id", F.col("text").alias("told")).hint("merge"), "id", "left").select("row_of.*", F.col("told").alias(name))
