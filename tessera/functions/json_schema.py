"""Validation of parsed JSON against a JSON schema that comes with it, in built-in functions, level by level to a bounded depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIRS = "array<struct<path:string,s:variant,v:variant>>"
_NO_TEXT = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it: plans stay small where columns are built from columns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_KINDS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


def kind(v: Column) -> Column:
    """object, array, string, boolean, null or number; of a variant."""
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.regexp_extract(F.schema_of_variant(v), f"^({'|'.join(_KINDS)})", 1)), F.lit("number"))


def _get(v: Column, name: str, as_: str) -> Column:
    return F.try_variant_get(v, f"$.{name}" if name else "$", as_)


def _text(v: Column, name: str) -> Column:
    """A keyword's value if it is a text; variants would give numbers as texts too."""
    return let(_get(v, name, "variant"), lambda x: F.when(x.isNotNull() & (kind(x) == "string"), F.try_variant_get(x, "$", "string")))


def _fails(p: Column) -> Column:
    """Names of the keywords that a value breaks on its own level."""
    return let(kind(p["v"]), lambda k: let(kind(p["s"]), lambda own: _broken(p["path"], p["s"], p["v"], k, own)))


def _broken(path: Column, s: Column, v: Column, k: Column, own: Column) -> Column:
    number, text = _get(v, "", "double"), _get(v, "", "string")
    whole = (k == "number") & (number == F.floor(number))
    wanted = F.coalesce(let(_text(s, "type"), lambda t: F.when(t.isNotNull(), F.array(t))), _get(s, "type", "array<string>"))
    typed = F.exists(wanted, lambda t: (t == k) | ((t == "integer") & whole))
    allowed = F.transform(_get(s, "enum", "array<variant>"), lambda x: F.to_json(x))
    const = _get(s, "const", "variant")
    members, listed = _get(v, "", "map<string,variant>"), _get(v, "", "array<variant>")
    needed = F.filter(_get(s, "required", _NO_TEXT), lambda n: ~F.map_contains_key(members, n))
    closed = _get(s, "additionalProperties", "variant")
    properties = F.coalesce(_get(s, "properties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    foreign = F.filter(F.map_keys(members), lambda n: ~F.map_contains_key(properties, n))
    limit = lambda name: _get(s, name, "double")
    rules = {
        "type": ~typed, "enum": ~F.array_contains(allowed, F.to_json(v)), "const": F.to_json(const) != F.to_json(v),
        "required": (k == "object") & (F.size(needed) > 0),
        "additionalProperties": (k == "object") & (kind(closed) == "boolean") & ~_get(s, "additionalProperties", "boolean") & (F.size(foreign) > 0),
        "minimum": (k == "number") & (number < limit("minimum")), "maximum": (k == "number") & (number > limit("maximum")),
        "minLength": (k == "string") & (F.length(text) < limit("minLength")), "maxLength": (k == "string") & (F.length(text) > limit("maxLength")),
        "minItems": (k == "array") & (F.size(listed) < limit("minItems")), "maxItems": (k == "array") & (F.size(listed) > limit("maxItems")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    named = F.transform(broken, lambda n: F.concat(path, F.lit(" "), n))
    none = F.array().cast(_NO_TEXT)
    simple = F.when((own == "boolean") & _get(s, "", "boolean"), none).otherwise(F.array(F.concat(path, F.lit(" schema"))))
    return F.when(own == "object", named).otherwise(simple)


def _children(p: Column) -> Column:
    """Pairs of the next level: members by the schema of their name, items by the one of all items."""
    s, v = p["s"], p["v"]
    properties, members = _get(s, "properties", "map<string,variant>"), _get(v, "", "map<string,variant>")
    entries = F.filter(F.map_entries(properties), lambda e: F.map_contains_key(members, e["key"]))
    by_name = F.transform(entries, lambda e: F.struct(F.concat_ws(".", p["path"], e["key"]).alias("path"), e["value"].alias("s"), members[e["key"]].alias("v")))
    items, listed = _get(s, "items", "variant"), _get(v, "", "array<variant>")
    by_place = F.transform(F.when(items.isNotNull(), listed), lambda x, i: F.struct(F.concat(p["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), items.alias("s"), x.alias("v")))
    none = F.array().cast(_PAIRS)
    is_ = lambda what: (kind(s) == "object") & (kind(v) == what)
    return F.concat(F.coalesce(F.when(is_("object"), by_name.cast(_PAIRS)), none), F.coalesce(F.when(is_("array"), by_place.cast(_PAIRS)), none))


def violations(schema: Column, value: Column, depth: int = 8) -> Column:
    """Sorted texts "place keyword" of what a JSON text breaks of a JSON schema, both as text; empty if it is valid, null if either is
    null.

    Keywords: type, enum, const, required, properties, additionalProperties false, items, minimum, maximum, minLength, maxLength,
    minItems, maxItems, and schemas that are true or false; others, patterns too, are not looked at. The value's place is $;
    a text that is no JSON breaks `json`, a schema that is neither an object nor true breaks `schema`, and what lies deeper
    than `depth` levels breaks `depth`.
    """
    def whole(s: Column, v: Column) -> Column:
        first = F.array(F.struct(F.lit("$").alias("path"), s.alias("s"), v.alias("v"))).cast(_PAIRS)
        start = F.struct(first.alias("now"), F.array().cast(_NO_TEXT).alias("found"))

        def level(state: Column, _: Column) -> Column:
            return F.struct(F.flatten(F.transform(state["now"], _children)).alias("now"), F.concat(state["found"], F.flatten(F.transform(state["now"], _fails))).alias("found"))

        deep = lambda state: F.concat(state["found"], F.transform(state["now"], lambda p: F.concat(p["path"], F.lit(" depth"))))
        found = F.array_sort(F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, level, deep)))
        return F.when(v.isNull(), F.array(F.lit("$ json"))).when(s.isNull(), F.array(F.lit("$ schema"))).otherwise(found)

    parsed = F.struct(F.try_parse_json(schema).alias("s"), F.try_parse_json(value).alias("v"))
    return F.when(schema.isNotNull() & value.isNotNull(), let(parsed, lambda x: whole(x["s"], x["v"])))
