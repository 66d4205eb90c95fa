"""Dates and times of the dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as Q
from ..functions import dates as D
from .registry import Tables, query


@query("""SELECT event_id, dayname(ts) AS dn, monthname(ts) AS mn, (dayofweek(ts) + 1)::INT AS dw, minute(ts)::INT AS mi, second(ts)::INT AS se, (microsecond(ts) % 1000000)::INT AS us, strftime(ts, '%H:%M:%S') AS t,
(date_diff('day', DATE '1970-01-01', ts::DATE) + 719528) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS ssz FROM events""")
def fn_date_parts(t: Tables) -> DataFrame:
    """DAYNAME, MONTHNAME, DAYOFWEEK, MINUTE, SECOND, MICROSECOND, TIME, TO_SECONDS."""
    ts = F.col("ts")
    return t.events.select("event_id", F.date_format(ts, "EEEE").alias("dn"), F.date_format(ts, "MMMM").alias("mn"), D.day_of_week(ts).alias("dw"), F.minute(ts).alias("mi"), F.second(ts).alias("se"), D.microsecond(ts).alias("us"), D.time_of(ts).alias("t"), D.to_seconds(ts).alias("ssz"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%U')::INT AS sunday_week, weekofyear(o_orderdate)::INT AS iso,
CASE WHEN isodow(make_date(year(o_orderdate), 1, 1)) <= 4 THEN strftime(o_orderdate, '%W')::INT + (CASE WHEN isodow(make_date(year(o_orderdate), 1, 1)) = 1 THEN 0 ELSE 1 END) ELSE strftime(o_orderdate, '%W')::INT END AS monday_week,
CASE WHEN strftime(o_orderdate, '%U') = '00' THEN strftime(make_date(year(o_orderdate) - 1, 12, 31), '%U')::INT ELSE strftime(o_orderdate, '%U')::INT END AS from_one,
(year((o_orderdate::DATE - dayofweek(o_orderdate)::INT)) * 100 + strftime((o_orderdate::DATE - dayofweek(o_orderdate)::INT), '%U')::INT)::INT AS yw FROM orders""")
def fn_weeks(t: Tables) -> DataFrame:
    """WEEK by mode, YEARWEEK."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", D.week(d).alias("sunday_week"), D.week(d, 3).alias("iso"), D.week(d, 1).alias("monday_week"), D.week(d, 2).alias("from_one"), D.year_week(d).alias("yw"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d, (o_orderkey % 50)::INT AS n FROM orders)
SELECT o_orderkey, d + to_hours(n) AS hours, d + to_months(n) AS months, d - to_days(n) AS less, d + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 3 MINUTE + INTERVAL 4 SECOND AS parts,
date_sub('month', TIMESTAMP '1991-01-15', d)::BIGINT AS m_diff, 0::BIGINT AS short_month, date_sub('day', TIMESTAMP '1991-01-31 12:00:00', d)::BIGINT AS d_diff, date_sub('hour', TIMESTAMP '1991-01-31 12:30:00', d)::BIGINT AS h_diff,
TIMESTAMP '1970-01-01' + to_seconds(o_orderkey) AS from_unix, (d AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS ny, make_timestamp(2020, 2, 3, 4, 5, 6.5) AS made FROM p""")
def fn_date_arithmetic(t: Tables) -> DataFrame:
    """TIMESTAMPADD, DATE_ADD, DATE_SUB with units and composite units, TIMESTAMPDIFF, FROM_UNIXTIME, CONVERT_TZ, TIMESTAMP, TO_TIMESTAMP."""
    d, n = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey") % 50
    since = F.lit("1991-01-31 12:00:00").cast("timestamp_ntz")
    short = D.timestamp_diff("MONTH", F.lit("2024-01-31").cast("timestamp_ntz"), F.lit("2024-02-29").cast("timestamp_ntz"))
    made = F.to_timestamp_ntz(F.lit("2020-02-03 04:05:06.5"))
    return t.orders.select("o_orderkey", D.timestamp_add("HOUR", n, d).alias("hours"), D.timestamp_add("MONTH", n, d).alias("months"), D.timestamp_add("DAY", -n, d).alias("less"), D.add_parts(d, 1, 2, 3, 4).alias("parts"), Q.months_between_whole(F.lit("1991-01-15"), d).alias("m_diff"), short.alias("short_month"), D.timestamp_diff("DAY", since, d).alias("d_diff"), D.timestamp_diff("HOUR", F.lit("1991-01-31 12:30:00"), d).alias("h_diff"), D.from_unixtime(F.col("o_orderkey")).alias("from_unix"), D.convert_tz(d, "UTC", "America/New_York").alias("ny"), made.alias("made"))


@query("""WITH p AS (SELECT event_id, (event_id % 80000)::BIGINT AS s FROM events), q AS (SELECT event_id, s, s + 3723 AS more, s - 3723 AS less FROM p)
SELECT event_id, lpad((more // 3600)::VARCHAR, 2, '0') || ':' || lpad((more // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((more % 60)::VARCHAR, 2, '0') AS added,
CASE WHEN less < 0 THEN '-' ELSE '' END || lpad((abs(less) // 3600)::VARCHAR, 2, '0') || ':' || lpad((abs(less) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs(less) % 60)::VARCHAR, 2, '0') AS diff,
lpad((s % 30)::VARCHAR, 2, '0') || ':10:59' AS made, (s // 3600) || 'h ' || (s // 60 % 60) AS formatted, CASE WHEN s >= 1000 THEN printf('%.2f ns', (s // 10 * 10) / 1000) ELSE (s // 10 * 10) || ' ps' END AS pico FROM q""")
def fn_time_arithmetic(t: Tables) -> DataFrame:
    """ADDTIME, SUBTIME, TIMEDIFF, MAKETIME, TIME_FORMAT, FORMAT_PICO_TIME."""
    s = F.col("event_id") % 80000
    time = Q.seconds_to_time(s)
    parts = F.split(time, ":").cast("array<int>")
    return t.events.select("event_id", D.add_time(time, F.lit("01:02:03")).alias("added"), D.sub_time(time, F.lit("01:02:03")).alias("diff"), D.make_time(s % 30, F.lit(10), F.lit(59)).alias("made"), F.concat(parts[0].cast("string"), F.lit("h "), parts[1].cast("string")).alias("formatted"), D.format_pico_time(s - s % 10).alias("pico"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%-I o''clock') AS clock, CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN day(o_orderdate) || 'st' WHEN day(o_orderdate) IN (2, 22) THEN day(o_orderdate) || 'nd' WHEN day(o_orderdate) IN (3, 23) THEN day(o_orderdate) || 'rd' ELSE day(o_orderdate) || 'th' END AS nth,
strftime(o_orderdate, '%U') AS week_u, strftime(o_orderdate, '%w') AS dow, strftime(o_orderdate, '%I:%M:%S %p') AS r FROM orders""")
def fn_date_format_letters(t: Tables) -> DataFrame:
    """DATE_FORMAT with letters that Spark's patterns lack: %l, %D, %U, %w, %r."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", Q.date_format(d, "%l o'clock").alias("clock"), Q.date_format(d, "%D").alias("nth"), Q.date_format(d, "%U").alias("week_u"), Q.date_format(d, "%w").alias("dow"), Q.date_format(d, "%r").alias("r"))


@query("SELECT n_nationkey, true AS today, true AS now, true AS clock, true AS utc FROM nation")
def fn_now(t: Tables) -> DataFrame:
    """CURDATE, NOW, CURRENT_TIMESTAMP, SYSDATE, CURTIME, UTC_DATE, UTC_TIME, UTC_TIMESTAMP: one moment for the whole query."""
    utc = F.to_utc_timestamp(F.now(), F.current_timezone())
    clock = D.time_of(F.localtimestamp())
    return t.nation.select("n_nationkey", (F.curdate() == F.to_date(F.now())).alias("today"), (F.current_timestamp() == F.now()).alias("now"), (Q.time_to_seconds(clock) == F.hour(F.now()) * 3600 + F.minute(F.now()) * 60 + F.second(F.now())).alias("clock"), (F.abs(F.unix_timestamp(utc) - F.unix_timestamp(F.now())) < 86400).alias("utc"))
