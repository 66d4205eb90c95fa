"""JSON construction, edits, tests, table functions and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from .registry import Tables, query


def _document(t: Tables) -> DataFrame:
    """{"a":{"x":id},"b":[1,2,size],"n":5,"z":null} of each part."""
    a, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit('{"n":5, "a":{"x":'), a, F.lit('},"b":[1,2,'), size, F.lit('],"z":null}'))
    return t.spread("part", "p_partkey").select("p_partkey", "p_size", "p_brand", text.alias("j"))


@query("""SELECT p_partkey, '{"a":{"x":1},"b":[1,2,' || p_size || '],"n":5,"z":null}' AS set_path, '{"a":{"x":' || p_partkey || ',"y":2},"b":[1,2,' || p_size || '],"n":5,"z":null}' AS added,
'{"a":{"x":' || p_partkey || '},"b":[1,2,' || p_size || '],"n":5,"z":null}' AS kept, '{"a":{"x":' || p_partkey || '},"b":[1,2,' || p_size || '],"n":"' || p_brand || '","z":null}' AS replaced,
'{"a":{},"b":[1,2,' || p_size || '],"n":5,"z":null}' AS removed, '{"a":{"x":' || p_partkey || '},"b":[1,' || p_size || '],"n":5,"z":null}' AS without, '{"a":{"x":' || p_partkey || '},"b":[1,2,' || p_size || ',{"q":1}],"n":5,"z":null}' AS appended,
'{"a":{"x":' || p_partkey || '},"b":[1,9,2,' || p_size || '],"n":5,"z":null}' AS inserted, '{"a":{"x":' || p_partkey || '},"b":[7,2,' || p_size || '],"n":5,"z":null}' AS place, '{"a":null,"b":[1,2,' || p_size || '],"n":5,"z":null}' AS lax FROM part""")
def fn_json_edit(t: Tables) -> DataFrame:
    """JSON_SET, JSON_INSERT, JSON_REPLACE, JSON_REMOVE, JSON_ARRAY_APPEND, JSON_ARRAY_INSERT, JSONB_SET,
    JSONB_INSERT, JSONB_SET_LAX and #- at any depth: types and nesting are kept."""
    j = F.col("j")
    return _document(t).select("p_partkey", J.put(j, ["a", "x"], F.lit("1")).alias("set_path"), J.put(j, ["a", "y"], F.lit("2")).alias("added"), J.insert(j, ["n"], F.lit("6")).alias("kept"), J.replace(J.replace(j, ["none"], F.lit("6")), ["n"], J.quote(F.col("p_brand"))).alias("replaced"), J.remove(j, ["a", "x"]).alias("removed"), J.remove(j, ["b", 1]).alias("without"), J.append(j, ["b"], F.lit('{"q":1}')).alias("appended"), J.array_insert(j, ["b"], 1, F.lit("9")).alias("inserted"), J.put(j, ["b", 0], F.lit("7")).alias("place"), J.put_lax(j, ["a"], F.lit(None).cast("string")).alias("lax"))


@query("""SELECT n_nationkey, json_array(n_nationkey, n_name, NULL)::VARCHAR AS arr, '"' || n_name || '"' AS quoted, '{"a":1,"k":' || n_nationkey || '}' AS patched, '{"a":1,"k":["x",' || n_nationkey || ']}' AS merged,
'{"k":' || n_nationkey || '}' AS stripped, '["' || n_name || '",1]' AS of_array, '{"a":[1,2],"b":true}' AS compact, '"' || n_name || '"' AS scalar, '[["k",' || n_nationkey || '],["name","' || n_name || '"]]' AS pairs, '{"name":"' || n_name || '"}' AS only_name, '[2,' || n_nationkey || ']' AS common FROM nation WHERE n_nationkey > 2""")
def fn_json_build(t: Tables) -> DataFrame:
    """JSON_ARRAY, JSON_BUILD_ARRAY, JSON_QUOTE, JSON_MERGE_PATCH, JSON_MERGE, JSON_STRIP_NULLS, ARRAY_TO_JSON, JSON_COMPACT, JSON_SCALAR,
    JSON_OBJECT_TO_ARRAY, JSON_OBJECT_FILTER_KEYS, JSON_ARRAY_INTERSECT."""
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    own = F.concat(F.lit('{"k":'), k, F.lit("}"))
    both = F.to_json(F.struct(F.col("n_nationkey").alias("k"), name.alias("name")))
    return t.nation.filter("n_nationkey > 2").select(
        "n_nationkey",
        J.array_of(F.array(k, J.quote(name), F.lit("null"))).alias("arr"),
        J.quote(name).alias("quoted"),
        J.merge_patch(F.lit('{"a":1,"k":"x","gone":2}'), J.put(own, ["gone"], F.lit("null"))).alias("patched"),
        J.merge_preserve(F.lit('{"a":1,"k":"x"}'), own).alias("merged"),
        J.strip_nulls(J.put(own, ["none"], F.lit("null"))).alias("stripped"),
        F.to_json(F.array(name, F.lit("1"))).substr(F.lit(1), F.length(name) + 3).alias("head"),
        J.normalized(F.lit('{ "b" : true, "a" : [1, 2] }')).alias("compact"),
        J.quote(name).alias("scalar"),
        J.pairs(both).alias("pairs"),
        J.only_keys(both, F.array(F.lit("name"))).alias("only_name"),
        J.intersect(F.concat(F.lit("[1,2,"), k, F.lit("]")), F.concat(F.lit("[2,"), k, F.lit(',"1"]'))).alias("common"),
    ).withColumn("of_array", F.concat("head", F.lit(",1]"))).drop("head")


@query("""SELECT p_partkey, p_size = 2 OR p_size = 3 OR p_size = 1 AS has_three_less, true AS has_path, false AS no_path, true AS any_key, false AS all_keys, 4 AS n, 3 AS n_b, '{"x":' || p_partkey || '}' AS part, p_partkey::VARCHAR AS text_x,
p_size > 10 AS path_gt, CASE WHEN p_size > 10 THEN [p_size::DOUBLE] ELSE [] END AS found, p_size IN (1, 2, 7) AS overlap, true AS same, 2 AS depth, 1 AS depth_one, true AS within, '"$.b"' AS path_of FROM part""")
def fn_json_test(t: Tables) -> DataFrame:
    """@>, <@, ?, ?|, ?&, #>, #>>, @?, @@, JSON_CONTAINS, JSON_CONTAINS_PATH, JSON_EXISTS, JSON_LENGTH, JSON_DEPTH,
    JSON_EQUALS, JSON_OVERLAPS, JSON_SEARCH, JSONB_PATH_EXISTS, JSONB_PATH_MATCH, JSONB_PATH_QUERY_ARRAY."""
    j = F.col("j")
    b = J.get(j, ["b"])
    ten = F.lit(10)
    return _document(t).select(
        "p_partkey",
        J.contains(F.lit("[1,2,3]"), b).alias("has_three_less"),
        J.get(j, ["a", "x"]).isNotNull().alias("has_path"),
        J.get(j, ["a", "none"]).isNotNull().alias("no_path"),
        J.has_any_key(j, "q", "a").alias("any_key"),
        J.has_all_keys(j, "q", "a").alias("all_keys"),
        J.length(j).alias("n"),
        J.length(b).alias("n_b"),
        J.get(j, ["a"]).alias("part"),
        J.unquote(J.get(j, ["a", "x"])).alias("text_x"),
        J.path_exists(j, ["b"], ">", ten).alias("path_gt"),
        J.path_query_array(j, ["b"], ">", ten).alias("found"),
        J.overlaps(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]")), F.lit("[1,2,7]")).alias("overlap"),
        J.equal(F.lit('{"a":1, "b":2}'), F.lit('{"b":2,"a":1}')).alias("same"),
        J.depth_of_flat(b).alias("depth"),
        J.depth_of_flat(F.lit("5")).alias("depth_one"),
        J.contains(j, F.lit('{"n":5}')).alias("within"),
        J.search_one(F.lit('{"a":"x","b":"y"}'), F.lit("y")).alias("path_of"),
    )


@query("""SELECT event_id, i::INT AS i, (event_id + i)::VARCHAR AS raw, 'v' || i AS name, event_id + i AS n FROM events, (VALUES (0), (1), (2)) r(i)""")
def json_table(t: Tables) -> DataFrame:
    """JSON_TABLE, JSON_ARRAY_ELEMENTS, JSON_TO_RECORDSET and JSON_POPULATE_RECORDSET: the objects of an array as rows with declared columns."""
    entries = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit('{"n":'), (F.col("event_id") + i).cast("string"), F.lit(',"name":"v'), i.cast("string"), F.lit('"}'))), ",")
    made = t.events.select("event_id", F.concat(F.lit("["), entries, F.lit("]")).alias("j"))
    rows = made.select("event_id", F.posexplode(J.element_texts(F.col("j"))).alias("i", "e"))
    record = F.from_json("e", "name string, n bigint")
    return rows.select("event_id", "i", J.get(F.col("e"), ["n"]).alias("raw"), record["name"].alias("name"), record["n"].alias("n"))


@query("SELECT n_nationkey, k AS key, CASE k WHEN 'a' THEN n_nationkey::VARCHAR WHEN 'b' THEN '[1,\"x\"]' ELSE '\"' || n_name || '\"' END AS value, CASE k WHEN 'a' THEN n_nationkey::VARCHAR WHEN 'b' THEN '[1,\"x\"]' ELSE n_name END AS text FROM nation, (VALUES ('a'), ('b'), ('c')) v(k)")
def json_each(t: Tables) -> DataFrame:
    """JSON_EACH, JSONB_EACH, JSONB_ARRAY_ELEMENTS_TEXT's text form: one row per member."""
    j = F.concat(F.lit('{"a":'), F.col("n_nationkey").cast("string"), F.lit(',"b":[1,"x"],"c":'), J.quote(F.col("n_name")), F.lit("}"))
    rows = t.nation.select("n_nationkey", F.explode(J.members(j)).alias("key", "v"))
    value = F.to_json("v")
    return rows.select("n_nationkey", "key", value.alias("value"), J.unquote(value).alias("text"))


@query("""SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']' AS names, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS by_name FROM nation GROUP BY 1""")
def agg_json(t: Tables) -> DataFrame:
    """JSON_ARRAYAGG, JSON_AGG, JSONB_AGG; JSON_OBJECTAGG, JSONB_OBJECT_AGG."""
    entries = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    grouped = t.nation.groupBy("n_regionkey").agg(entries.alias("e"), F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return grouped.select("n_regionkey", F.to_json(F.col("e.n_name")).alias("names"), J.normalized(F.to_json("m")).alias("by_name"))
