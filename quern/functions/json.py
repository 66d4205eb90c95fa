"""JSON functions of the dialects on JSON text: edits at any path, merges, tests and parts.

A text is parsed into a variant, so types and nesting are kept; objects come out with keys in order. Paths
are lists of keys (str) and 0-based array places (int).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Path = Sequence[str | int]


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def normalized(text: Column) -> Column:
    """The same value with keys in order and no blanks (JSON_NORMALIZE, JSON_COMPACT, a cast to JSONB)."""
    return F.to_json(parsed(text))


def members(text: Column) -> Column:
    """map<string, variant> of an object; null for anything else."""
    return F.try_variant_get(parsed(text), "$", "map<string,variant>")


def elements(text: Column) -> Column:
    """array<variant> of an array; null for anything else."""
    return F.try_variant_get(parsed(text), "$", "array<variant>")


def element_texts(text: Column) -> Column:
    """The JSON text of each element (JSON_ARRAY_ELEMENTS)."""
    return F.transform(elements(text), lambda x: F.to_json(x))


def unquote(text: Column) -> Column:
    """A JSON string's characters; other JSON as it is (JSON_UNQUOTE, ->>); null for JSON null."""
    string = F.try_variant_get(parsed(text), "$", "string")
    return F.when(F.trim(text).startswith('"'), string).when(F.trim(text) != "null", normalized(text))


def quote(text: Column) -> Column:
    """Characters as a JSON string (JSON_QUOTE, TO_JSON of text)."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def get(text: Column, path: Path) -> Column:
    """The JSON text at a path, null if there is none (#>, JSON_EXTRACT_PATH, JSON_QUERY)."""
    for step in path:
        text = F.to_json(F.element_at(members(text), F.lit(step))) if isinstance(step, str) else F.to_json(F.try_element_at(elements(text), F.lit(step + 1)))
    return text


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is found once, however often body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def _value(text: Column) -> Column:
    """The variant of a JSON text; what is no JSON counts as null."""
    return F.when(text.isNotNull(), F.coalesce(parsed(text), F.parse_json(F.lit("null"))))


def _plain_numbers(text: Column) -> Column:
    """Whole numbers that were written with an exponent come out as such: 1e3 as 1000."""
    return F.when(text.contains(".0"), normalized(text)).otherwise(text)


def _edited(whole: Column, path: Path, new: Callable[[Column], Column]) -> Column:
    """edit of a variant; null if there is no object or array for the first step."""
    step, rest = path[0], path[1:]

    def inner(old: Column) -> Column:
        return F.when(old.isNotNull(), F.coalesce(_edited(old, rest, new), old)) if rest else new(old)

    def changed(found: Column) -> Column:
        others = F.map_filter(found, lambda k, _: k != step)
        return _bound(_bound(F.element_at(found, F.lit(step)), inner), lambda v: F.when(v.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(step), v))))

    if isinstance(step, str):
        return F.to_variant_object(_bound(F.try_variant_get(whole, "$", "map<string,variant>"), changed))
    found = F.try_variant_get(whole, "$", "array<variant>")
    return F.to_variant_object(F.array_compact(F.transform(found, lambda x, i: F.when(i == step, _bound(x, inner)).otherwise(x))))


def edit(text: Column, path: Path, new: Callable[[Column], Column]) -> Column:
    """text with new(old variant, null if missing), a variant, at a path; null from it takes the entry out. Missing
    parents and places beyond an array's end are left alone. The text is parsed once and its parts stay variants,
    so the work grows with the text and the path's length."""
    return F.coalesce(_bound(F.to_json(_edited(parsed(text), path, new)), _plain_numbers), text)


def array_of(texts: Column) -> Column:
    """A JSON array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def put(text: Column, path: Path, value: Column) -> Column:
    """JSON_SET, JSONB_SET: value (JSON text) at a path, added if missing."""
    return edit(text, path, lambda old: _value(value))


def insert(text: Column, path: Path, value: Column) -> Column:
    """JSON_INSERT: only where nothing is there yet."""
    return edit(text, path, lambda old: F.coalesce(old, _value(value)))


def replace(text: Column, path: Path, value: Column) -> Column:
    """JSON_REPLACE: only where something is there."""
    return edit(text, path, lambda old: F.when(old.isNotNull(), _value(value)))


def remove(text: Column, path: Path) -> Column:
    """JSON_REMOVE, #-."""
    return edit(text, path, lambda old: F.lit(None).cast("variant"))


def put_lax(text: Column, path: Path, value: Column) -> Column:
    """JSONB_SET_LAX: a null value becomes JSON null."""
    return put(text, path, F.coalesce(value, F.lit("null")))


def append(text: Column, path: Path, value: Column) -> Column:
    """JSON_ARRAY_APPEND: value at the end of the array at a path; a scalar becomes an array first."""

    def longer(old: Column) -> Column:
        all_of = F.coalesce(F.try_variant_get(old, "$", "array<variant>"), F.array(old))
        return F.to_variant_object(F.array_compact(F.concat(all_of, F.array(_value(value)))))

    return edit(text, path, longer) if path else F.when(text.isNull() | parsed(text).isNotNull(), F.to_json(_bound(parsed(text), longer)))


def array_insert(text: Column, path: Path, at: int, value: Column) -> Column:
    """JSON_ARRAY_INSERT, JSONB_INSERT: value before place `at` of the array at a path."""

    def spread(all_of: Column) -> Column:
        return F.array_compact(F.concat(F.slice(all_of, 1, F.lit(at)), F.array(_value(value)), F.slice(all_of, at + 1, F.greatest(F.size(all_of) - at, F.lit(0)))))

    def longer(old: Column) -> Column:
        return F.to_variant_object(_bound(F.try_variant_get(old, "$", "array<variant>"), spread))

    return edit(text, path, longer) if path else _bound(F.to_json(_bound(parsed(text), longer)), _plain_numbers)


def merge_patch(a: Column, b: Column) -> Column:
    """JSON_MERGE_PATCH of objects at the top level: keys of b win, its nulls take keys out."""
    new = F.map_filter(members(b), lambda k, v: ~F.is_variant_null(v))
    old = F.map_filter(members(a), lambda k, v: ~F.array_contains(F.map_keys(members(b)), k))
    return normalized(F.to_json(F.map_concat(old, new)))


def merge_preserve(a: Column, b: Column) -> Column:
    """JSON_MERGE_PRESERVE of objects of scalars: values of a common key become an array."""
    x, y = members(a), members(b)
    both = F.map_zip_with(x, y, lambda k, v, w: F.when(v.isNull(), F.to_json(w)).when(w.isNull(), F.to_json(v)).otherwise(array_of(F.array(F.to_json(v), F.to_json(w)))))
    return normalized(F.to_json(F.transform_values(both, lambda k, v: F.parse_json(v))))


def strip_nulls(text: Column) -> Column:
    """Without the members that are null, at the top level (JSON_STRIP_NULLS)."""
    return F.coalesce(normalized(F.to_json(F.map_filter(members(text), lambda k, v: ~F.is_variant_null(v)))), normalized(text))


def length(text: Column) -> Column:
    """Members or elements, 1 for a scalar (JSON_LENGTH)."""
    return F.when(parsed(text).isNotNull(), F.coalesce(F.size(F.when(members(text).isNotNull(), members(text))), F.size(F.when(elements(text).isNotNull(), elements(text))), F.lit(1)))


def equal(a: Column, b: Column) -> Column:
    """JSON_EQUALS."""
    return normalized(a) == normalized(b)


def has_key(text: Column, key: str) -> Column:
    """?: an object's key, or a string element of an array."""
    return F.coalesce(F.map_contains_key(members(text), F.lit(key)), F.array_contains(element_texts(text), quote(F.lit(key))), F.lit(False))


def has_any_key(text: Column, *keys: str) -> Column:
    """?|"""
    return F.array_max(F.array(*(has_key(text, k) for k in keys)))


def has_all_keys(text: Column, *keys: str) -> Column:
    """?&"""
    return F.array_min(F.array(*(has_key(text, k) for k in keys)))


def contains(a: Column, b: Column) -> Column:
    """a @> b, JSON_CONTAINS, for objects and arrays of values that are compared whole: each member of b is in a."""
    in_object = F.forall(F.map_entries(members(b)), lambda e: F.coalesce(F.to_json(F.element_at(members(a), e["key"])) == F.to_json(e["value"]), F.lit(False)))
    in_array = F.size(F.array_except(F.coalesce(element_texts(b), F.array(normalized(b))), element_texts(a))) == 0
    return F.coalesce(in_object, in_array, equal(a, b))


def overlaps(a: Column, b: Column) -> Column:
    """JSON_OVERLAPS: a common element, or a common member of objects."""
    same = F.exists(F.map_entries(members(b)), lambda e: F.coalesce(F.to_json(F.element_at(members(a), e["key"])) == F.to_json(e["value"]), F.lit(False)))
    return F.coalesce(same, F.arrays_overlap(element_texts(a), element_texts(b)), equal(a, b))


def intersect(a: Column, b: Column) -> Column:
    """The common elements (JSON_ARRAY_INTERSECT)."""
    return array_of(F.array_intersect(element_texts(a), element_texts(b)))


def pairs(text: Column) -> Column:
    """[key, value] of each member (JSON_OBJECT_TO_ARRAY)."""
    return array_of(F.transform(F.map_entries(members(text)), lambda e: array_of(F.array(quote(e["key"]), F.to_json(e["value"])))))


def only_keys(text: Column, keys: Column) -> Column:
    """An object's members whose key is in a list (JSON_OBJECT_FILTER_KEYS)."""
    return normalized(F.to_json(F.map_filter(members(text), lambda k, v: F.array_contains(keys, k))))


def depth_of_flat(text: Column) -> Column:
    """JSON_DEPTH of scalars, and of objects and arrays of scalars."""
    inner = F.coalesce(F.size(F.when(members(text).isNotNull(), members(text))), F.size(F.when(elements(text).isNotNull(), elements(text))))
    return F.when(inner.isNull() | (inner == 0), 1).otherwise(2)


def path_query_array(text: Column, path: Path, op: str | None = None, value: Column | None = None) -> Column:
    """JSONB_PATH_QUERY_ARRAY with `path[*] ? (@ op value)` over numbers, as an array of numbers."""
    found = F.transform(elements(get(text, path)), lambda v: F.try_variant_get(v, "$", "double"))
    found = F.filter(found, lambda x: x.isNotNull())
    if op is None:
        return found
    test = {"==": lambda x: x == value, ">": lambda x: x > value, ">=": lambda x: x >= value, "<": lambda x: x < value, "<=": lambda x: x <= value, "!=": lambda x: x != value}[op]
    return F.filter(found, test)


def path_exists(text: Column, path: Path, op: str | None = None, value: Column | None = None) -> Column:
    """JSONB_PATH_EXISTS, @?; JSONB_PATH_MATCH and @@ of `exists(...)`."""
    return F.coalesce(F.size(F.when(elements(get(text, path)).isNotNull(), path_query_array(text, path, op, value))) > 0, F.lit(False))


def search_one(text: Column, wanted: Column) -> Column:
    """The path of the first member, in order of keys, that is this string (JSON_SEARCH 'one')."""
    hit = F.filter(F.map_entries(members(text)), lambda e: F.to_json(e["value"]) == quote(wanted))
    return F.when(F.size(hit) > 0, F.concat(F.lit('"$.'), F.try_element_at(hit, F.lit(1))["key"], F.lit('"')))
