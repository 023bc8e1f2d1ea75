"""Design tokens in JSON trees, as variants that are opened level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import once

#: Keys of a file's root that describe the file, and the deepest level that is opened.
ROOT_KEYS = ("$schema", "version", "name", "description")
MAX_DEPTH = 20


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _children(value: Column) -> Column:
    """(key, value) of the members of an object or a list; null for anything else."""
    members = F.transform(F.map_entries(_as(value, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    items = F.transform(_as(value, "array<variant>"), lambda v, k: F.struct(k.cast("string").alias("key"), v.alias("value")))
    return F.coalesce(members, items)


def _node(prefix: Column, key: Column, value: Column) -> Column:
    """What a member is: a token, with confidence; something to open, with a tree; or nothing (null)."""
    name = F.concat_ws(".", prefix, key)
    none = F.lit(None).cast("string")

    def one(tree: Column | None, text: Column, intent: Column, sure: float | None) -> Column:
        tree = F.lit(None).cast("variant") if tree is None else tree
        return F.struct(name.alias("name"), tree.alias("tree"), text.alias("value"), intent.alias("intent"), F.lit(sure).cast("double").alias("confidence"))

    def described(m: Column) -> Column:
        # A null under value or description counts as missing.
        first = lambda a, b: F.coalesce(_as(m[a], "string"), _as(m[b], "string"))
        return one(None, first("value", "$value"), first("description", "$description"), 1.0)

    def plain() -> Column:
        kind = F.schema_of_variant(value)
        leaf = (kind == "STRING") | kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        return F.when(leaf & (prefix.isNotNull() | ~key.isin(*ROOT_KEYS)), one(None, _as(value, "string"), none, 0.8))

    def opened(m: Column) -> Column:
        token = F.map_contains_key(m, "value") | F.map_contains_key(m, "$value")
        return F.when(m.isNotNull() & token, described(m)).when(m.isNotNull() | _as(value, "array<variant>").isNotNull(), one(value, none, none, None)).otherwise(plain())

    return once(_as(value, "map<string,variant>"), opened)


def flatten(files: DataFrame) -> DataFrame:
    """files (id, body): (id, name, value, intent, confidence) for every token: objects with value or $value are certain, bare strings and numbers less
    so. A body that isn't JSON, or names a key of an object twice, has none. Names are dotted paths, and their order is that of a file's tokens, as an object has none.

    Each level opens the trees that the one before left, beside the tokens found so far: one pass of a task over its rows, without a shuffle."""
    nodes = "array<struct<name:string,tree:variant,value:string,intent:string,confidence:double>>"

    def level(prefix: Column, tree: Column) -> Column:
        found = F.filter(F.transform(_children(tree), lambda e: _node(prefix, e["key"], e["value"])), lambda n: n.isNotNull())
        return F.coalesce(found, F.array().cast(nodes))

    rows = files.select("id", F.explode(level(F.lit(None).cast("string"), F.try_parse_json("body"))).alias("n"))
    for _ in range(MAX_DEPTH):
        deeper = F.when(F.col("n.tree").isNull(), F.array("n")).otherwise(level(F.col("n.name"), F.col("n.tree")))
        rows = rows.select("id", F.explode(deeper).alias("n"))
    return rows.filter("n.tree IS NULL").select("id", "n.name", "n.value", "n.intent", "n.confidence")
