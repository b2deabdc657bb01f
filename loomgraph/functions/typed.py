"""Typed properties: a map from names to semi-structured values, so that numbers, truth values and lists stay what they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

PROPS = "map<string,variant>"
_LIST = "array<variant>"


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY<…>, OBJECT<…> and so on; VOID for a null inside the value, null for none."""
    return F.schema_of_variant(value)


def _is(value: Column, name: str) -> Column:
    return F.startswith(kind(value), F.lit(name))


def _scalar(value: Column) -> Column:
    return ~_is(value, "ARRAY") & ~_is(value, "OBJECT") & ~_is(value, "VOID")


def _cleaned(value: Column) -> Column:
    """One value, or null for what no property can hold. Texts lose white space at their ends and count only if some is left; objects go.

    Lists keep their scalars, in their order; nulls and objects in them go, and a list that has none left, or has lists of scalars in it, goes.
    """
    items = F.filter(F.try_variant_get(value, "$", _LIST), lambda x: x.isNotNull())
    scalars = F.filter(items, _scalar)
    nested = F.exists(items, lambda x: _is(x, "ARRAY") & F.exists(F.coalesce(F.try_variant_get(x, "$", _LIST), F.array().cast(_LIST)), _scalar))
    listed = F.when((F.size(scalars) > 0) & ~nested, F.to_variant_object(scalars))
    said = F.nullif(strip(F.try_variant_get(value, "$", "string")), F.lit("")).cast("variant")
    return F.when(kind(value) == "STRING", said).when(_is(value, "ARRAY"), listed).when(_scalar(value), value)


def scrubbed(props: Column) -> Column:
    """What of a property map can be kept; names lose white space at their ends, blank ones go. Of names that are then equal the one
    that sorted last stays, as a parsed object keeps no other order."""
    cells = F.transform(F.map_entries(props), lambda e: F.struct(strip(e["key"]).alias("key"), _cleaned(e["value"]).alias("value")))
    kept = F.filter(cells, lambda e: (e["key"] != "") & e["value"].isNotNull())
    later = lambda every, e, i: F.exists(F.slice(every, i + 2, F.size(every)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.get(F.transform(F.array(kept), lambda every: F.filter(every, lambda e, i: ~later(every, e, i))), F.lit(0)))


def from_json(json: Column) -> Column:
    """The members of a JSON object as scrubbed properties; none for what is no object."""
    return F.coalesce(scrubbed(F.try_variant_get(F.try_parse_json(json), "$", PROPS)), none())


def none() -> Column:
    return F.create_map().cast(PROPS)


def made(**given: Column) -> Column:
    """Properties of the given columns, each with its own type."""
    return scrubbed(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v.cast("variant"))]))


def texts(props: Column) -> Column:
    """All values as text: scalars as they are written, lists as JSON."""
    return F.transform_values(props, lambda k, v: v.cast("string"))
