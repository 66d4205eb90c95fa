"""Full-text search of PostgreSQL and MariaDB with built-in functions, and points of PostGIS.

A tsvector is map<lexeme, positions>; lexemes are runs of letters and digits in lower case (the configuration
`simple`, without stems and stop words). A query is a list of lexemes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """TS_PARSE: the tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def to_tsvector(text: Column) -> Column:
    """TO_TSVECTOR: positions from 1."""
    words = parse(text)
    places = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i")))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(words)), lambda w: F.struct(w, F.transform(F.filter(places, lambda p: p["w"] == w), lambda p: p["i"]))))


def lexemes(vector: Column) -> Column:
    """TSVECTOR_TO_ARRAY."""
    return F.map_keys(vector)


def from_lexemes(words: Column) -> Column:
    """ARRAY_TO_TSVECTOR, and STRIP: without positions."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(words)), lambda w: F.struct(w, F.array().cast("array<int>"))))


def delete(vector: Column, *words: str) -> Column:
    """TS_DELETE."""
    return F.map_filter(vector, lambda w, _: ~w.isin(*words))


def plain_query(text: str) -> list[str]:
    """PLAINTO_TSQUERY, TO_TSQUERY of words joined by &."""
    return [w for w in text.lower().replace("&", " ").split() if w]


def matches(vector: Column, query: list[str]) -> Column:
    """vector @@ query, MATCH ... AGAINST in boolean mode with + before each word: all lexemes are there."""
    return F.size(F.array_except(F.array(*map(F.lit, query)), F.map_keys(vector))) == 0


def matches_phrase(vector: Column, query: list[str]) -> Column:
    """@@ PHRASETO_TSQUERY, TSQUERY_PHRASE: the lexemes follow one another."""
    begins = F.coalesce(F.element_at(vector, F.lit(query[0])), F.array().cast("array<int>"))

    def before(word: str, step: int) -> Column:
        return F.transform(F.coalesce(F.element_at(vector, F.lit(word)), F.array().cast("array<int>")), lambda i: i - step)

    for step, word in enumerate(query[1:], 1):
        begins = F.array_intersect(begins, before(word, step))
    return F.size(begins) > 0


def matches_web(vector: Column, text: str) -> Column:
    """@@ WEBSEARCH_TO_TSQUERY of words, those after a minus left out."""
    words = text.lower().split()
    wanted, unwanted = [w for w in words if w[0] != "-"], [w[1:] for w in words if w[0] == "-"]
    found = matches(vector, wanted)
    for w in unwanted:
        found = found & ~F.map_contains_key(vector, F.lit(w))
    return found


def numnode(query: list[str]) -> int:
    """NUMNODE: lexemes and the operators between them."""
    return max(0, 2 * len(query) - 1)


def occurrences(vector: Column, query: list[str]) -> Column:
    """How often lexemes of the query occur, by which results can be ranked."""
    found = F.transform_values(F.map_filter(vector, lambda w, _: w.isin(*query)), lambda w, at: F.size(at))
    return F.aggregate(F.map_values(found), F.lit(0), lambda n, x: n + x)


def headline(text: Column, query: list[str]) -> Column:
    """TS_HEADLINE of the whole text: matches between <b> and </b>."""
    return F.regexp_replace(text, rf"(?i)\b({'|'.join(query)})\b", "<b>$1</b>")


def make_point(x: Column, y: Column, z: Column | None = None, m: Column | None = None, srid: int = 0) -> Column:
    """ST_MAKEPOINT, ST_MAKEPOINTM, ST_POINT, ST_SETSRID: a struct of x, y, z, m, srid, whose fields ST_X, ST_Y, ST_Z, ST_M and ST_SRID name."""
    none = F.lit(None).cast("double")
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (none if z is None else z.cast("double")).alias("z"), (none if m is None else m.cast("double")).alias("m"), F.lit(srid).alias("srid"))
