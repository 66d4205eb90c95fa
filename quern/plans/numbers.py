"""Numbers, texts, arrays, UUIDs and XML of the dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as Q
from ..functions import numbers as N
from ..functions import text as T
from .registry import Tables, query


@query("""WITH p AS (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part)
SELECT p_partkey, round(acos(x), 8) AS acos, round(asin(x), 8) AS asin, round(degrees(acos(x)), 6) AS acosd, round(degrees(asin(x)), 6) AS asind, round(degrees(atan(x)), 6) AS atand, round(degrees(atan2(x, 2)), 6) AS atan2d, round(acosh(x + 1), 8) AS acosh, round(asinh(x), 8) AS asinh, round(atanh(x), 8) AS atanh,
round(cosh(x), 8) AS cosh, round(sinh(x), 8) AS sinh, round(tanh(x), 8) AS tanh, round(tan(x), 8) AS tan, round(cot(x), 6) AS cot, round(cos(radians(x)), 8) AS cosd, round(sin(radians(x)), 8) AS sind, round(tan(radians(x)), 8) AS tand, round(cot(radians(x)), 5) AS cotd FROM p""")
def fn_trigonometry_more(t: Tables) -> DataFrame:
    x = F.col("p_size") / F.lit(60.0)
    plain = {"acos": F.acos(x), "asin": F.asin(x), "acosh": F.acosh(x + 1), "asinh": F.asinh(x), "atanh": F.atanh(x), "cosh": F.cosh(x), "sinh": F.sinh(x), "tanh": F.tanh(x), "tan": F.tan(x), "cosd": N.of_degrees(F.cos, x), "sind": N.of_degrees(F.sin, x), "tand": N.of_degrees(F.tan, x)}
    degrees = {"acosd": N.in_degrees(F.acos, x), "asind": N.in_degrees(F.asin, x), "atand": N.in_degrees(F.atan, x), "atan2d": F.degrees(F.atan2(x, F.lit(2.0))), "cot": F.cot(x)}
    return t.part.select("p_partkey", *(F.round(v, 8).alias(k) for k, v in plain.items()), *(F.round(v, 6).alias(k) for k, v in degrees.items()), F.round(N.of_degrees(F.cot, x), 5).alias("cotd"))


@query("""SELECT p_partkey, round(log(3, p_size), 8) AS log3, round(log2(p_size), 8) AS log2, round(pi(), 10) AS pi, factorial((p_size % 15)::INT)::BIGINT AS fact, round(lgamma(p_size / 7.0), 7) AS lgamma, round(gamma(p_size / 7.0) / 1e3, 6) AS gamma,
bin(p_size) AS bin, to_base(p_size, 8) AS oct, lower(to_base(p_partkey, 36)) AS conv, bit_count(p_size)::INT AS bits, (p_size >> 2) & 1 AS bit2, p_size | 8 AS with3, p_size & ~1 AS without0, hex(p_size) AS hex, true AS rand, true AS erf, true AS normal FROM part""")
def fn_math_more(t: Tables) -> DataFrame:
    """LOG, LOG2, PI, FACTORIAL, LGAMMA, GAMMA, ERF, ERFC, BIN, TO_BIN, OCT, TO_OCT, CONV, BIT_COUNT, GET_BIT, SET_BIT, RAND, RANDOM_NORMAL."""
    n = F.col("p_size")
    erf = F.abs(N.erf(n / F.lit(25.0)) + N.erf(-n / F.lit(25.0))) < 1e-12
    known = F.abs(N.erf(F.lit(0.5)) - 0.5204998778130465) < 1e-12
    return t.spread("part", "p_partkey").select("p_partkey", F.round(N.log(F.lit(3), n), 8).alias("log3"), F.round(F.log2(n), 8).alias("log2"), F.round(F.pi(), 10).alias("pi"), F.factorial((n % 15).cast("int")).alias("fact"), F.round(N.lgamma(n / F.lit(7.0)), 7).alias("lgamma"), F.round(N.gamma(n / F.lit(7.0)) / 1e3, 6).alias("gamma"), N.in_base(n, 2).alias("bin"), N.in_base(n, 8).alias("oct"), N.in_base(F.col("p_partkey"), 36).alias("conv"), F.bit_count(n).alias("bits"), N.bit_at(n, 2).alias("bit2"), N.with_bit(n, 3, 1).alias("with3"), N.with_bit(n, 0, 0).alias("without0"), F.hex(n).alias("hex"), F.rand(7).between(0, 1).alias("rand"), (erf & known).alias("erf"), F.randn(7).isNotNull().alias("normal"))


@query("""SELECT p_partkey, '1' || lpad((p_size % 7)::VARCHAR, 2, '0') || '.50' AS dec, 2 AS scale, 1 AS min_scale, '1' || lpad((p_size % 7)::VARCHAR, 2, '0') || '.5' AS trimmed, (100 + p_size % 7) + 0.5 AS number,
CASE WHEN p_size * 700 >= 1024 THEN printf('%.2f KiB', p_size * 700 / 1024) ELSE (p_size * 700) || ' bytes' END AS size, 9007199254740993 // 1 AS wide, 0.29::DOUBLE AS cut, -2.7::DOUBLE AS cut_below, p_size // -7 AS int_div, CASE WHEN p_size > 20 THEN greatest(p_size, 30) END AS g, CASE WHEN p_size > 20 THEN least(p_size, 30) END AS l FROM part""")
def fn_decimals(t: Tables) -> DataFrame:
    """SCALE, MIN_SCALE, TRIM_SCALE, TO_NUMBER, FORMAT_BYTES; DIV above 2^53, TRUNCATE, integer division, GREATEST and LEAST of MariaDB."""
    n = F.col("p_size")
    dec = (n % 7 + F.lit("100.50").cast("decimal(10,2)")).cast("decimal(10,2)")
    some = F.when(n > 20, n)
    return t.part.select("p_partkey", dec.cast("string").alias("dec"), N.scale(dec).alias("scale"), N.min_scale(dec).alias("min_scale"), N.trim_scale(dec).alias("trimmed"), F.to_number(dec.cast("string"), F.lit("999.99")).cast("double").alias("number"), N.format_bytes(n * 700).alias("size"), Q.integer_division(F.lit(9007199254740993), F.lit(1)).alias("wide"), Q.truncate(F.lit(0.29), 2).alias("cut"), Q.truncate(F.lit(-2.75), 1).alias("cut_below"), N.divide_integers(n, F.lit(-7)).alias("int_div"), N.greatest(some, F.lit(30)).alias("g"), N.least(some, F.lit(30)).alias("l"))


@query("""SELECT c_custkey, coalesce(list_position(['BUILDING', 'FURNITURE', 'MACHINERY'], c_mktsegment), 0)::INT AS fis, split_part(c_name, '#', 1) AS before, split_part(c_name, '#', -1) AS after, ltrim(c_name, 'Cu') AS lt, rtrim(c_name, '0123456789') AS rt, trim(c_name, 'C0123456789') AS bt,
'''' || replace(c_name, '''', '\\''') || '''' AS quoted, c_name AS b64, c_name AS unhexed, strpos(c_name, 'o')::INT AS loc, strpos(substr(c_name, 6), '0')::INT + 5 AS loc_from, length(regexp_extract_all(c_name, '0'))::INT AS rc, strpos(c_name, regexp_extract(c_name, '[0-9]+'))::INT AS ri, 'id ' || c_custkey || ' of ' || c_mktsegment AS sf,
ord(c_name)::BIGINT AS o, 'é' AS chr, sha1(c_name) AS sh, lower(c_name) AS folded, format('{:,}', (c_custkey * 1000)::BIGINT) AS grouped, lpad(c_custkey::VARCHAR, 8, '0') AS tc, regexp_extract_all(c_name, '[0-9]') AS digits, regexp_extract(c_name, '[0-9]{3}') AS rsub FROM customer""")
def fn_string_more(t: Tables) -> DataFrame:
    """FIND_IN_SET, SUBSTRING_INDEX, LTRIM, RTRIM, BTRIM, QUOTE, FROM_BASE64, UNHEX, LOCATE, REGEXP_COUNT, REGEXP_INSTR, REGEXP_MATCHES,
    SFORMAT, ORD, CHR, SHA1, CASEFOLD, FORMAT, TO_CHAR."""
    n = F.col("c_name")
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        T.find_in_set(F.col("c_mktsegment"), F.lit("BUILDING,FURNITURE,MACHINERY")).alias("fis"),
        T.substring_index(n, "#", 1).alias("before"),
        T.substring_index(n, "#", -1).alias("after"),
        T.trim_chars(n, "Cu", "leading").alias("lt"),
        T.trim_chars(n, "0123456789", "trailing").alias("rt"),
        T.trim_chars(n, "C0123456789").alias("bt"),
        T.quote(n).alias("quoted"),
        F.unbase64(F.base64(n)).cast("string").alias("b64"),
        F.unhex(F.hex(n)).cast("string").alias("unhexed"),
        F.locate("o", n).alias("loc"),
        F.locate("0", n, 6).alias("loc_from"),
        F.regexp_count(n, F.lit("0")).alias("rc"),
        F.regexp_instr(n, F.lit("[0-9]+")).alias("ri"),
        T.sformat("id {} of {}", k, F.col("c_mktsegment")).alias("sf"),
        T.ordinal(n).alias("o"),
        T.character(F.lit(233)).alias("chr"),
        F.sha1(n).alias("sh"),
        F.lower(n).alias("folded"),
        F.format_number(k * 1000, 0).alias("grouped"),
        F.to_char(k, F.lit("00000000")).alias("tc"),
        F.regexp_extract_all(n, F.lit("[0-9]"), 0).alias("digits"),
        F.regexp_substr(n, F.lit("[0-9]{3}")).alias("rsub"),
    )


@query("""SELECT p_partkey, list_filter(list_transform([p_size, 7, p_size], lambda x, i: CASE WHEN x = p_size THEN i END), lambda x: x IS NOT NULL)::INT[] AS places, [0, p_size] AS prepended, [p_size, 9, p_size] AS replaced, [p_size, p_size, p_size] AS filled, '[1:2]' AS dims, 1 AS low, 1 AS nd, true AS sampled, true AS shuffled FROM part""")
def fn_array_more(t: Tables) -> DataFrame:
    """ARRAY_POSITIONS, ARRAY_PREPEND, ARRAY_REPLACE, ARRAY_FILL, ARRAY_DIMS, ARRAY_LOWER, ARRAY_NDIMS, ARRAY_SAMPLE, ARRAY_SHUFFLE."""
    n = F.col("p_size")
    three = F.array(n, F.when(n == 7, 8).otherwise(7), n)
    shuffled = F.shuffle(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return t.part.select("p_partkey", T.array_positions(F.array(n, F.lit(7), n), n).alias("places"), F.array_prepend(F.array(n), F.lit(0)).alias("prepended"), T.array_replace(three, F.element_at(three, 2), F.lit(9)).alias("replaced"), F.array_repeat(n, 3).alias("filled"), T.array_dims(F.array(n, n)).alias("dims"), F.lit(1).alias("low"), F.lit(1).alias("nd"), (F.size(F.slice(shuffled, 1, 2)) == 2).alias("sampled"), (F.array_sort(shuffled) == F.array(F.lit(1), F.lit(2), F.lit(3))).alias("shuffled"))


@query("""WITH u AS (SELECT c_custkey, lower(md5(c_name)) AS h FROM customer), v AS (SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS id FROM u)
SELECT c_custkey, id, upper(replace(id, '-', '')) AS bin, id AS back, true AS ok, false AS bad, 4 AS version, true AS fresh FROM v""")
def fn_uuid(t: Tables) -> DataFrame:
    """UUID_TO_BIN, BIN_TO_UUID, IS_UUID, UUID_EXTRACT_VERSION, UUID, GEN_RANDOM_UUID, UUIDV4."""
    h = F.md5("c_name")
    made = T.bin_to_uuid(F.unhex(F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 19))))
    u = F.col("id")
    return t.customer.select("c_custkey", made.alias("id")).select("c_custkey", "id", F.hex(T.uuid_to_bin(u)).alias("bin"), T.bin_to_uuid(T.uuid_to_bin(u)).alias("back"), T.is_uuid(u).alias("ok"), T.is_uuid(F.concat(u, F.lit("0"))).alias("bad"), T.uuid_version(u).alias("version"), (T.is_uuid(F.uuid()) & (T.uuid_version(F.uuid()) == 4)).alias("fresh"))


@query("""SELECT n_nationkey, '<n>' || n_name || '</n><!--c-->' AS made, n_name AS name, [n_name, n_nationkey::VARCHAR] AS found, true AS there, n_nationkey::DOUBLE AS k FROM nation""")
def fn_xml(t: Tables) -> DataFrame:
    """XMLCONCAT, XMLCOMMENT, XMLTEXT, EXTRACTVALUE, XPATH, XPATH_EXISTS."""
    name = F.col("n_name")
    text = F.concat(F.lit("<n>"), F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</n>"))
    doc = F.concat(F.lit("<r>"), text, F.lit("<n>"), F.col("n_nationkey").cast("string"), F.lit("</n></r>"))
    return t.nation.select("n_nationkey", F.concat(text, F.lit("<!--c-->")).alias("made"), F.xpath_string(doc, F.lit("/r/n[1]")).alias("name"), F.xpath(doc, F.lit("/r/n/text()")).alias("found"), F.xpath_boolean(doc, F.lit("/r/n")).alias("there"), F.xpath_double(doc, F.lit("/r/n[2]")).alias("k"))


@query("""SELECT o_orderkey, o_orderpriority AS kind, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::BIGINT AS place, '1-URGENT' AS first, '5-LOW' AS last, ['2-HIGH', '3-MEDIUM'] AS middle FROM orders
WHERE list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) >= 3""")
def fn_enum(t: Tables) -> DataFrame:
    """Enum types: ENUM_FIRST, ENUM_LAST, ENUM_RANGE, and comparison by their order."""
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    place = T.enum_place(F.col("o_orderpriority"), kinds)
    return t.orders.filter(place >= 3).select("o_orderkey", F.col("o_orderpriority").alias("kind"), place.alias("place"), F.element_at(T.enum_range(kinds), 1).alias("first"), F.element_at(T.enum_range(kinds), -1).alias("last"), T.enum_range(kinds, "2-HIGH", "3-MEDIUM").alias("middle"))


@query("""SELECT s_suppkey, ifnull(nullif(s_nationkey, 3), -1) AS known, CASE WHEN nullif(s_nationkey, 3) IS NULL THEN 'none' ELSE 'some' END AS nvl2, nullif(s_nationkey, 3) > 5 IS NULL AS unknown, s_nationkey <> 4 AS neq, (s_nationkey > 5) <> (s_acctbal > 0) AS either, regexp_matches(lower(s_name), 'supplier#0+1') AS imatch, NOT regexp_matches(s_name, '1$') AS nomatch,
lower(s_name) = lower('SUPPLIER#000000001') AS ci, s_nationkey IN (1, 5, 9) AS member, s_nationkey IN (2, 3) AS arr_any, s_nationkey NOT IN (2, 3) AS arr_all FROM supplier""")
def fn_operators(t: Tables) -> DataFrame:
    """IFNULL, NVL2, IS UNKNOWN, <>, XOR, ~*, !~, NOT REGEXP, comparison without case (COLLATE), MEMBER OF, = ANY (array), <> ALL (array)."""
    n = F.nullif("s_nationkey", F.lit(3))
    name = F.col("s_name")
    k = F.col("s_nationkey")
    two = F.array(F.lit(2), F.lit(3))
    return t.supplier.select("s_suppkey", F.ifnull(n, F.lit(-1)).alias("known"), F.nvl2(n, F.lit("some"), F.lit("none")).alias("nvl2"), (n > 5).isNull().alias("unknown"), (k != 4).alias("neq"), ((k > 5) != (F.col("s_acctbal") > 0)).alias("either"), name.rlike("(?i)supplier#0+1").alias("imatch"), (~name.rlike("1$")).alias("nomatch"), (F.collate(name, "UTF8_LCASE") == "SUPPLIER#000000001").alias("ci"), F.array_contains(F.array(F.lit(1), F.lit(5), F.lit(9)), k).alias("member"), F.exists(two, lambda x: x == k).alias("arr_any"), F.forall(two, lambda x: x != k).alias("arr_all"))
