"""JSON of unknown shape as VARIANT, walked level by level: one expression a row, nothing leaves the JVM.

Text that is no JSON, is nested too deeply for Spark's parser (some 1,000 levels) or is too large for
a VARIANT has no nodes. Members of an object come by name, as a VARIANT keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

_NODES = "array<struct<path: string, key: string, node: variant>>"


def members(node: Column) -> Column:
    """An object's members by name; null for anything else."""
    return F.try_variant_get(node, "$", "map<string, variant>")


def items(node: Column) -> Column:
    """An array's items; null for anything else."""
    return F.try_variant_get(node, "$", "array<variant>")


def objects(node: Column) -> Column:
    """The items of an array that are objects; null for anything but an array."""
    return F.filter(items(node), lambda x: members(x).isNotNull())


def text(node: Column) -> Column:
    """A plain value as text; null for JSON's null, arrays and objects."""
    return F.when(members(node).isNull() & items(node).isNull(), F.try_variant_get(node, "$", "string"))


def _below(parent: Column, first: bool) -> Column:
    path, node = parent["path"], parent["node"]
    under = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
    of_object = F.transform(F.map_entries(members(node)), lambda e: F.struct(F.concat(under, e["key"]).alias("path"), e["key"].alias("key"), e["value"].alias("node")))
    shown = F.slice(objects(node), 1, 1) if first else items(node)
    of_array = F.transform(shown, lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit("").alias("key"), x.alias("node")))
    return F.coalesce(of_object, of_array, F.array()).cast(_NODES)


def walk(document: Column, depth: int, first: bool = False) -> Column:
    """(path, key, node) of a document and all that is below it, up to so many levels, shallowest first; an array's items by number, or only its first object."""
    root = F.when(document.isNull(), F.array()).otherwise(F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("key"), document.alias("node")))).cast(_NODES)

    def level(state: Column, _: Column) -> Column:
        found = F.flatten(F.transform(state["last"], lambda n: _below(n, first)))
        return let(found, lambda f: F.struct(f.alias("last"), F.concat(state["seen"], f).alias("seen")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), let(root, lambda r: F.struct(r.alias("last"), r.alias("seen"))), level, lambda s: s["seen"])


def find(raw: Column, name: str, depth: int = 10) -> Column:
    """What a document has under a name wherever it is, as JSON text: the shallowest, then the first by path, that is not null."""
    found = F.filter(walk(F.try_parse_json(raw), depth), lambda n: (n["key"] == name) & ~F.is_variant_null(n["node"]))
    return F.to_json(F.get(found, 0)["node"])


def at(raw: Column, path: str) -> Column:
    """What a document has at a path such as a.b[0].c, as JSON text; null where there is nothing, or JSON's null."""
    node = F.try_variant_get(F.try_parse_json(raw), f"$.{path}" if path and not path.startswith("[") else f"${path}", "variant")
    return F.when(~F.is_variant_null(node), F.to_json(node))
