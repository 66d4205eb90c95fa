"""Edge cases of relational operators, functions, files and streams."""

import math

import pytest
from pyspark.sql import functions as F

from quern import functions as Q
from quern import plans
from quern.functions import json as J
from quern.functions import numbers as N
from quern.operators import relational as R
from quern.sources.files import copy_from, copy_to
from quern.streaming import file_stream, tumbling_counts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_quantified_on_nulls_and_nothing(spark):
    df = frame(spark, [(1,), (5,), (None,)], "v int")
    empty, holes = frame(spark, [], "x int"), frame(spark, [(2,), (None,)], "x int")
    assert R.compare_all(df, "v", ">", empty, "x").count() == 3
    assert R.compare_any(df, "v", ">", empty, "x").count() == 0
    assert R.compare_all(df, "v", ">", holes, "x").count() == 0
    assert [x.v for x in R.compare_any(df, "v", ">", holes, "x").collect()] == [5]


def test_limit_with_ties(spark):
    df = frame(spark, [(1, 3), (2, 3), (3, 2), (4, None), (5, 1)], "k int, v int")
    assert sorted(x.k for x in R.limit_with_ties(df, 1, "v", descending=True).collect()) == [1, 2]
    assert sorted(x.k for x in R.limit_with_ties(df, 2, "v").collect()) == [3, 5]
    assert R.limit_with_ties(df.filter("k > 9"), 2, "v").count() == 0


def test_changes(spark):
    old, new = frame(spark, [(1, "a"), (2, "b")], "k int, v string"), frame(spark, [(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, R.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    holes = frame(spark, [(1, None), (2, "x")], "k int, v string")
    assert [x.k for x in R.delete(holes, F.col("v") == "x").collect()] == [1]
    assert sorted(map(str, R.update(holes, F.col("v") == "x", {"v": F.lit("y")}).collect())) == ["Row(k=1, v=None)", "Row(k=2, v='y')"]


def test_not_in_and_equal_any(spark):
    df = frame(spark, [(1,), (5,), (None,)], "v int")
    one_three, holes, empty = frame(spark, [(1,), (3,)], "x int"), frame(spark, [(2,), (None,)], "x int"), frame(spark, [], "x int")
    assert [x.v for x in R.compare_any(df, "v", "=", one_three, "x").collect()] == [1]
    assert [x.v for x in R.compare_all(df, "v", "<>", one_three, "x").collect()] == [5]
    assert R.compare_all(df, "v", "<>", holes, "x").count() == 0 and R.compare_all(df, "v", "<>", empty, "x").count() == 3
    assert sorted(x.v for x in R.compare_any(df, "v", "<>", one_three, "x").collect()) == [1, 5]
    assert R.compare_all(df, "v", "=", one_three, "x").count() == 0


def test_conflicts_of_repeated_and_null_keys(spark):
    old = frame(spark, [(1, "a")], "k int, v string")
    new = frame(spark, [(2, "x"), (2, "y"), (None, "n"), (None, "m"), (1, "b")], "k int, v string")
    rows = lambda df: sorted(map(str, (tuple(x) for x in df.collect())))
    assert rows(R.upsert(old, new, ["k"])) == sorted(map(str, [(1, "b"), (2, "y"), (None, "m"), (None, "n")]))
    assert rows(R.insert_ignore(old, new, ["k"])) == sorted(map(str, [(1, "a"), (2, "x"), (None, "m"), (None, "n")]))


def test_functions(spark):
    df = frame(spark, [("o'neil mc-donald", -2.75, None)], "s string, x double, n string")
    row = df.select(Q.initial_upper(F.col("s")), Q.truncate(F.col("x"), 1), Q.field(F.col("n"), "a"), Q.number_to_ip(F.lit(3232235777)), Q.safe_divide(F.lit(1.0), F.lit(0.0)), Q.months_between_whole(F.lit("2024-01-31").cast("date"), F.lit("2024-02-29").cast("date"))).first()
    assert tuple(row) == ("O'Neil Mc-Donald", -2.7, 0, "192.168.1.1", None, 0)


def test_dialect_functions(spark):
    assert Q.date_pattern("%Y-day %j, %%it's") == "yyyy'-day 'DDD', %it''s'"
    df = frame(spark, [("2024-02-30", "01:02:03", -3725, '{"b":"1"}'), (None, "x", None, None)], "d string, t string, n int, j string")
    row, blank = df.select(Q.str_to_date(F.col("d"), "%Y-%m-%d"), Q.time_to_seconds(F.col("t")), Q.seconds_to_time(F.col("n")), Q.json_put(F.col("j"), "a", F.lit(2)), Q.width_bucket(F.lit(5.0), 0, 5, 5)).collect()
    assert tuple(row) == (None, 3723, "-01:02:05", '{"a":2,"b":"1"}', 6)
    assert tuple(blank)[:4] == (None,) * 4


def test_copy(spark, tmp_path):
    df = frame(spark, [(1, 'a "quoted", text'), (2, None), (3, "x;y")], "k int, v string")
    copy_to(df, str(tmp_path / "out"), delimiter=";", null="\\N")
    back = copy_from(spark, str(tmp_path / "out"), df.schema, delimiter=";", null="\\N")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    counts = tumbling_counts(file_stream(spark, str(tmp_path / "in"), events.schema), late="3650 days")
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


def test_rounded_epoch(spark):
    stamps = ["1970-01-01 00:00:00.499999", "1970-01-01 00:00:00.5", "1970-01-01 00:00:00.500001", "1970-01-01 00:00:01.5", "1969-12-31 23:59:59.3", "1969-12-31 23:59:58.5", None]
    df = frame(spark, [(i, s) for i, s in enumerate(stamps)], "i int, s string")
    found = df.select("i", Q.rounded_epoch(F.col("s").cast("timestamp_ntz")).alias("e")).orderBy("i").collect()
    assert [x.e for x in found] == [0, 0, 1, 2, -1, -2, None]


@pytest.mark.parametrize("name", ["fn_json_edit", "fn_math_more"])
def test_work_of_a_small_file_is_spread(spark, name):
    assert plans.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_json_edit_parses_once(spark):
    df = frame(spark, [('{"a":{"b":{"c":{"d":[1,{"e":null}]}}},"z":1e3}', "2"), ("[1]", "2"), ("no", "2"), (None, "2")], "j string, v string")
    j, v = F.col("j"), F.col("v")
    path = ["a", "b", "c", "d", 1, "e"]

    def parses(text):
        plan = df.select(text)._jdf.queryExecution().optimizedPlan().toString()
        return plan.lower().count("parsejson")

    assert 0 < parses(J.put(j, path, v)) <= parses(J.put(j, ["a"], v)) + 2
    found = df.select(J.put(j, path, v), J.insert(j, path, v), J.remove(j, path), J.append(j, path[:-2], v), J.put(j, ["z"], F.lit("no"))).collect()
    before = '{"a":{"b":{"c":{"d":[1,%s]}}},"z":1000}'
    assert tuple(found[0]) == (before % '{"e":2}', before % '{"e":null}', before % "{}", before % '{"e":null},2', before.replace("1000", "null") % '{"e":null}')
    assert [tuple(x) for x in found[1:]] == [("[1]",) * 5, ("no",) * 5, (None,) * 5]


def test_erf(spark):
    xs = [k / 64 for k in range(-450, 451)] + [1e-20, 1e300, math.inf]
    found = frame(spark, [(x,) for x in xs], "x double").select("x", N.erf(F.col("x")).alias("e")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in found) < 1e-15
