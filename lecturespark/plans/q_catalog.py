"""Catalogue, schedule and media source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import courses
from ..sources import catalog
from . import inputs  # noqa: F401
from .registry import define_input, query

define_input("catalog_json", """
SELECT o_orderkey AS course_id,
       concat('{"title":"t","sub_list":{"', CAST(year(o_orderdate) AS STRING), '":{"', CAST(month(o_orderdate) AS STRING),
              '":{"', CAST(day(o_orderdate) AS STRING), '":[{"id":', CAST(o_orderkey AS STRING),
              ',"sub_title":"part ', CAST(o_custkey AS STRING), '","playback_status":',
              CASE WHEN o_orderstatus = 'P' THEN '"0"' WHEN o_orderstatus = 'O' THEN '1' ELSE '"1"' END,
              ',"duration":', CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '-5' END,
              ',"duration_sec":', CAST(o_custkey AS STRING), '},5,null,{"id":""},{"sub_title":"no id"},{"id":0},',
              '{"id":"x', CAST(o_custkey AS STRING), '","duration":"77"}],"39":[]',
              CASE WHEN o_orderkey % 7 = 0 THEN ',"40":"text"},"43":[1],"42":{}},"yy":{"1":{"2":[{"id":"bad"}]}},"8":"no","7":null}}' ELSE '},"42":{}},"7":null}}' END) AS detail
FROM {orders}""")

# A month document per customer and half of its rows: some too long, some with odd items.
define_input("schedule_json", """
SELECT c_nationkey AS account_id, c_custkey AS month_id,
       CASE WHEN c_custkey % 31 = 0 THEN 'garbage' WHEN c_custkey % 37 = 0 THEN '{"code":200,"list":"x"}' ELSE
       concat('{"code":', CASE WHEN c_custkey % 29 = 0 THEN '500' ELSE '0' END, ',"list":[7,{"course":null},', CASE WHEN c_custkey % 13 = 0 THEN repeat('{"course":[]},', 30) ELSE '' END,
              '{"course":[', CASE WHEN c_custkey % 17 = 0 THEN repeat('{"id":1},', 1000) ELSE '' END,
              '{"id":', CAST(c_custkey % 50 AS STRING), ',"title":"T', CAST(c_custkey AS STRING),
              '","realname":"', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END,
              '","lecturer_name":"L", "kkxy_name":"", "dept_name":"D', CAST(c_nationkey AS STRING),
              '","term":"2024","sub_id":"s', CAST(c_custkey % 7 AS STRING), '","sub_duration":"',
              CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE CAST(c_custkey AS STRING) END,
              '"}]},{"course":[{"course_id":"c', CAST(c_custkey % 9 AS STRING), '","title":null},{"title":"none"},3]}]}') END AS doc
FROM {customer}""", spread=True)

define_input("media_json", """
SELECT page_id,
       CASE page_id % 7
         WHEN 0 THEN concat('{"video_list":{"a":{"preview_url":"', url, '"},"b":{"preview_url":"https://m.example.com/V', CAST(page_id AS STRING), '.MP4?k=1"}},"now":5}')
         WHEN 1 THEN concat('{"video_list":{"a":7},"playurl":{"now":"https://x.example.com/now.mp4","1":"https://x.example.com/', CAST(page_id AS STRING), '.mp4#t"}}')
         WHEN 2 THEN concat('{"content":{"playback":{"url":"https://y.example.com/', CAST(page_id AS STRING), '.mp4"}}}')
         WHEN 3 THEN '{"content":{"playback":{"url":"https://y.example.com/list.m3u8"}}}'
         WHEN 4 THEN '{"playurl":{"now":"https://x.example.com/now.mp4"}}'
         WHEN 5 THEN '{}' ELSE 'no json' END AS info,
       CASE WHEN page_id % 2 = 0 THEN concat('{"data":{"content":{"playback":{"url":"https://z.example.com/', CAST(page_id AS STRING), '.mp4"}}}}')
            ELSE '{"data":null}' END AS detail
FROM {pages}""")

define_input("course_details", """
SELECT c_nationkey AS account_id, concat(CASE WHEN c_custkey % 50 < 30 THEN '' ELSE 'x' END, CAST(c_custkey % 50 AS STRING)) AS course_id,
       CASE WHEN c_nationkey % 4 = 0 THEN 500 WHEN max(c_custkey) % 3 = 0 THEN 403 ELSE 0 END AS code,
       concat('detail ', min(c_name)) AS title
FROM {customer} GROUP BY c_nationkey, c_custkey % 50""")

# Accepted schedule rows, stated from the base columns.
DUCK_SCHEDULE = """months AS (
  SELECT *, CASE WHEN c_custkey % 31 = 0 THEN 'not_json' WHEN c_custkey % 37 = 0 THEN 'bad_list' WHEN c_custkey % 29 = 0 THEN 'bad_code'
                 WHEN c_custkey % 13 = 0 THEN 'too_many_days' WHEN c_custkey % 17 = 0 THEN 'too_many_rows' ELSE 'ok' END AS month_status,
         CAST(CASE WHEN c_custkey % 17 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS more FROM customer),
listed AS (SELECT * FROM months WHERE month_status NOT IN ('not_json', 'bad_list')),
sched_all AS (
  SELECT c_nationkey AS account_id, c_custkey AS month_id, more AS pos, CAST(c_custkey % 50 AS VARCHAR) AS course_id,
         'T' || CAST(c_custkey AS VARCHAR) AS title, CASE WHEN c_custkey % 3 = 0 THEN 'L' ELSE c_mktsegment END AS teacher,
         'D' || CAST(c_nationkey AS VARCHAR) AS department, '2024' AS term,
         's' || CAST(c_custkey % 7 AS VARCHAR) AS sub_id,
         CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE CAST(c_custkey AS DOUBLE) END AS duration, month_status
  FROM listed
  UNION ALL
  SELECT c_nationkey, c_custkey, more + 1, 'c' || CAST(c_custkey % 9 AS VARCHAR), '', '', '', '', '', 0.0, month_status FROM listed
  UNION ALL
  SELECT c_nationkey, c_custkey, unnest(range(0, 1000)), '1', '', '', '', '', '', 0.0, month_status FROM listed WHERE more > 0),
sched AS (SELECT * EXCLUDE (month_status) FROM sched_all WHERE month_status = 'ok')"""


def all_rows(load):
    return catalog.flatten_schedule(load("schedule_json"), ["account_id", "month_id"])


def schedule(load):
    """The rows of accepted months."""
    return all_rows(load).where("month_status = 'ok'").drop("month_status")


def candidates(load):
    return courses.course_first_seen(schedule(load), ["account_id"], ["month_id", "pos"])


@query("catalog_flatten", """
SELECT o_orderkey AS course_id, CAST(o_orderkey AS VARCHAR) AS sub_id, 'part ' || CAST(o_custkey AS VARCHAR) AS sub_title,
       '' AS lecturer_name, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus <> 'P' AS has_playback,
       CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS duration_seconds, NULL AS problem
FROM orders WHERE o_orderkey <> 0
UNION ALL
SELECT o_orderkey, 'x' || CAST(o_custkey AS VARCHAR), '', '', strftime(o_orderdate, '%Y-%m-%d'), false, 77, NULL FROM orders
UNION ALL
SELECT o_orderkey, 'bad', '', '', NULL, false, 0, 'bad_date' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL
SELECT o_orderkey, NULL, NULL, NULL, CASE p WHEN 'bad_items' THEN strftime(o_orderdate, '%Y-%m-40') END, NULL, NULL, p
FROM orders, (VALUES ('bad_items'), ('bad_days'), ('bad_months')) AS t(p) WHERE o_orderkey % 7 = 0""")
def _(load):
    return catalog.flatten_catalog(load("catalog_json"))


@query("schedule_flatten", f"WITH {DUCK_SCHEDULE} SELECT * FROM sched_all")
def _(load):
    return all_rows(load)


@query("schedule_guard", f"""
WITH {DUCK_SCHEDULE}
SELECT c_nationkey AS account_id, c_custkey AS month_id,
       CASE WHEN month_status IN ('not_json', 'bad_list') THEN 0 ELSE more + 3 END AS rows, month_status
FROM months""")
def _(load):
    return catalog.schedule_status(load("schedule_json"), ["account_id", "month_id"])


@query("month_grid", """
SELECT o_orderkey, strftime(unnest(generate_series(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH,
                            date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS month
FROM orders""")
def _(load):
    anchors = load("orders").select("o_orderkey", F.to_date("o_orderdate").alias("anchor"))
    return catalog.month_grid(anchors).drop("anchor")


@query("pick_media_url", """
SELECT page_id, CASE
  WHEN page_id % 7 = 0 THEN 'https://m.example.com/V' || CAST(page_id AS VARCHAR) || '.MP4?k=1'
  WHEN page_id % 7 = 1 THEN 'https://x.example.com/' || CAST(page_id AS VARCHAR) || '.mp4#t'
  WHEN page_id % 7 = 2 THEN 'https://y.example.com/' || CAST(page_id AS VARCHAR) || '.mp4'
  WHEN page_id % 7 IN (4, 5, 6) AND page_id % 2 = 0 THEN 'https://z.example.com/' || CAST(page_id AS VARCHAR) || '.mp4'
  END AS media_url FROM pages""")
def _(load):
    return catalog.pick_media_url(load("media_json"), ["page_id"])


@query("course_first_seen", f"""
WITH {DUCK_SCHEDULE}
SELECT account_id, course_id, title, teacher, department, term FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, course_id ORDER BY month_id, pos) AS r FROM sched) WHERE r = 1""")
def _(load):
    return candidates(load)


@query("course_limit", f"""
WITH {DUCK_SCHEDULE}
SELECT account_id, count(DISTINCT course_id) AS courses,
       CASE WHEN count(DISTINCT course_id) > 100 THEN 'too_many_courses' ELSE 'ok' END AS status
FROM sched GROUP BY account_id""")
def _(load):
    return courses.course_limit(candidates(load), ["account_id"])


@query("override_durations", f"""
WITH {DUCK_SCHEDULE},
d AS (SELECT account_id, course_id, sub_id, arg_max(duration, month_id) AS seconds FROM sched
      WHERE sub_id <> '' AND duration > 0 GROUP BY ALL)
SELECT l.account_id, l.course_id, l.sub_id, l.lecture_id, coalesce(d.seconds, l.duration_seconds) AS duration_seconds
FROM (SELECT o_custkey % 25 AS account_id, CAST(o_custkey % 60 AS VARCHAR) AS course_id,
             's' || CAST(o_orderkey % 9 AS VARCHAR) AS sub_id, o_orderkey AS lecture_id,
             CAST(o_orderkey % 1000 AS DOUBLE) AS duration_seconds FROM orders) l
LEFT JOIN d ON d.account_id = l.account_id AND d.course_id = l.course_id AND d.sub_id = l.sub_id""")
def _(load):
    text = lambda c: c.cast("string")
    lectures = load("orders").select(
        (F.col("o_custkey") % 25).alias("account_id"), text(F.col("o_custkey") % 60).alias("course_id"),
        F.concat(F.lit("s"), text(F.col("o_orderkey") % 9)).alias("sub_id"), F.col("o_orderkey").alias("lecture_id"),
        (F.col("o_orderkey") % 1000).cast("double").alias("duration_seconds"))
    durations = courses.schedule_durations(schedule(load), ["account_id"], ["month_id", "pos"])
    return courses.override_durations(lectures, durations, ["account_id", "course_id", "sub_id"])


@query("verified_courses", f"""
WITH {DUCK_SCHEDULE},
c AS (SELECT account_id, course_id, arg_min(term, month_id * 10 + pos) AS term,
             arg_min(department, month_id * 10 + pos) AS department FROM sched GROUP BY ALL)
SELECT c.account_id, c.course_id, c.term, c.department, d.title, 'verified' AS authorization_state
FROM c JOIN $course_details d ON d.account_id = c.account_id AND d.course_id = c.course_id WHERE d.code IN (0, 200)""")
def _(load):
    return courses.verified_courses(candidates(load), load("course_details"), ["account_id"])


@query("verification_status", f"""
WITH {DUCK_SCHEDULE}
SELECT c.account_id, count(*) AS candidates, count(d.code) AS verified,
       CASE WHEN count(d.code) = 0 THEN 'platform_course_request_failed' ELSE 'ok' END AS status
FROM (SELECT DISTINCT account_id, course_id FROM sched) c
LEFT JOIN $course_details d ON d.account_id = c.account_id AND d.course_id = c.course_id AND d.code IN (0, 200)
GROUP BY c.account_id""")
def _(load):
    return courses.verification_status(candidates(load), load("course_details"), ["account_id"])
