"""Full-text search, and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as Q
from ..functions import search as S
from .registry import Tables, query

_WORDS = "list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""WITH v AS (SELECT p_partkey, p_name || ' ' || p_type AS t, {_WORDS} AS w FROM part)
SELECT p_partkey, list_sort(list_distinct(w)) AS lexemes, len(list_distinct(w))::INT AS n, list_has_all(w, ['small', 'ring']) AS plain, contains(' ' || array_to_string(w, ' ') || ' ', ' small ring ') AS phrase,
list_contains(w, 'ring') AND NOT list_contains(w, 'small') AS web, list_sort(list_filter(list_distinct(w), lambda x: x NOT IN ('ring', 'small'))) AS deleted, 3 AS nodes, len(list_filter(w, lambda x: x IN ('ring', 'small')))::INT AS hits, list_position(w, 'ring')::INT AS first_ring, regexp_replace(t, '(?i)\\b(ring|small)\\b', '<b>\\1</b>', 'g') AS headline FROM v""")
def fts_match(t: Tables) -> DataFrame:
    """TO_TSVECTOR, TSVECTOR_TO_ARRAY, ARRAY_TO_TSVECTOR, STRIP, TS_DELETE, PLAINTO_TSQUERY, TO_TSQUERY, PHRASETO_TSQUERY, TSQUERY_PHRASE,
    WEBSEARCH_TO_TSQUERY, NUMNODE, TS_HEADLINE, @@, MATCH AGAINST."""
    text = F.concat("p_name", F.lit(" "), "p_type")
    made = t.part.select("p_partkey", text.alias("t"), S.to_tsvector(text).alias("v"))
    v, both = F.col("v"), S.plain_query("Small & ring")
    return made.select(
        "p_partkey",
        S.lexemes(v).alias("lexemes"),
        F.size(S.from_lexemes(S.lexemes(v))).alias("n"),
        S.matches(v, both).alias("plain"),
        S.matches_phrase(v, both).alias("phrase"),
        S.matches_web(v, "ring -small").alias("web"),
        S.lexemes(S.delete(v, "ring", "small")).alias("deleted"),
        F.lit(S.numnode(both)).alias("nodes"),
        S.occurrences(v, both).alias("hits"),
        F.coalesce(F.try_element_at(v, F.lit("ring"))[0], F.lit(None)).alias("first_ring"),
        S.headline(F.col("t"), ["ring", "small"]).alias("headline"),
    )


@query(f"SELECT word, count(DISTINCT p_partkey) AS ndoc, count(*) AS nentry FROM (SELECT p_partkey, unnest({_WORDS}) AS word FROM part) GROUP BY word")
def fts_stat(t: Tables) -> DataFrame:
    """TS_STAT, TS_PARSE: documents and entries of each lexeme."""
    words = t.part.select("p_partkey", F.explode(S.to_tsvector(F.concat("p_name", F.lit(" "), "p_type"))).alias("word", "at"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("ndoc"), F.sum(F.size("at")).alias("nentry"))


@query("SELECT c_custkey, c_acctbal AS x, c_nationkey::DOUBLE AS y, 1.5::DOUBLE AS z, NULL::DOUBLE AS m, 4326 AS srid, 2.5::DOUBLE AS only_m FROM customer")
def fn_points(t: Tables) -> DataFrame:
    """ST_MAKEPOINT, ST_MAKEPOINTM, ST_POINT, ST_SETSRID, ST_SRID, ST_X, ST_Y, ST_Z, ST_M."""
    p = S.make_point(F.col("c_acctbal"), F.col("c_nationkey"), F.lit(1.5), srid=4326)
    measured = S.make_point(F.lit(0), F.lit(0), m=F.lit(2.5))
    return t.customer.select("c_custkey", p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["m"].alias("m"), p["srid"].alias("srid"), measured["m"].alias("only_m"))


@query("SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || '-' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS initcap FROM customer")
def fn_initcap(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", Q.initial_upper(F.concat("c_mktsegment", F.lit("-"), "c_mktsegment")).alias("initcap"))
