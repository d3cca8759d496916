"""Course catalogues and schedules: nested JSON documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_json import field, truthy
from ..functions.text import col, digits, first_present, present

# Limits of one catalogue.
MAX_DAYS_PER_MONTH = 31
MAX_ROWS_PER_MONTH = 1000
MAX_COURSES = 100
MONTHS_BACK, MONTHS_AHEAD = 12, 1


def _children(node: Column) -> Column:
    """The entries of an object; null for anything else."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def _bad(node: Column, read: Column, name: str) -> Column:
    return F.when(read.isNull() & truthy(node), name)


def flatten_catalog(courses: DataFrame, keys: list[str] | None = None, column: str = "detail") -> DataFrame:
    """Lectures of course documents nested by year, month and day.

    Items that are no object or have no id are left out. A node that is set but of the wrong
    kind gives one row that names the ``problem``, a lecture under a year, month or day that
    is no number has the problem ``bad_date``, and everything beside them stays. A document
    that is no JSON object, or names one key twice, is one row with ``not_json``; null and
    empty ones give none. All explodes stay inside a row: the whole job is one narrow stage.
    """
    keys = keys or ["course_id"]
    read = courses.select(*keys, F.col(column).alias("_text"), F.try_variant_get(F.try_parse_json(column), "$", "STRUCT<sub_list: VARIANT>").alias("_root"))
    broken = F.when((F.col("_text") != "") & F.col("_root").isNull(), "not_json")
    read = read.select(*keys, broken.alias("_p"), F.col("_root.sub_list").alias("_v"))
    names = []
    # A level's entries are a column of their own before they are exploded, so that each node is read once.
    for name, problem in (("y", "bad_years"), ("m", "bad_months"), ("d", "bad_days")):
        read = read.select(*keys, *names, "_p", "_v", _children(F.col("_v")).alias("_c"))
        read = read.select(*keys, *names, F.coalesce("_p", _bad(F.col("_v"), F.col("_c"), problem)).alias("_p"), F.explode_outer("_c").alias(name, "_v"))
        names.append(name)
    # One reading of each item gives all its fields; other values than objects become null.
    item = ("ARRAY<STRUCT<id: VARIANT, sub_title: STRING, lecturer_name: STRING, playback_status: STRING, "
            "duration: BIGINT, duration_sec: BIGINT>>")
    days = read.select(*keys, *names, "_p", "_v", F.try_variant_get("_v", "$", item).alias("_c"))
    lectures = F.filter("_c", lambda r: r.isNotNull() & truthy(r["id"]))
    rows = days.select(*keys, *names, F.coalesce("_p", _bad(F.col("_v"), F.col("_c"), "bad_items")).alias("_p"), F.explode_outer(lectures).alias("_r"))
    rows = rows.where(F.col("_r").isNotNull() | F.col("_p").isNotNull())
    found = F.col("_r").isNotNull()
    text = lambda name: F.when(found, F.coalesce(F.col(f"_r.{name}"), F.lit("")))
    date = [digits(F.col(c).try_cast("int"), w) for c, w in (("y", 4), ("m", 2), ("d", 2))]
    dated = F.col("y").try_cast("int").isNotNull() & F.col("m").try_cast("int").isNotNull() & F.col("d").try_cast("int").isNotNull()
    return rows.select(
        *keys, F.try_variant_get("_r.id", "$", "string").alias("sub_id"), text("sub_title").alias("sub_title"),
        text("lecturer_name").alias("lecturer_name"), F.when(dated, F.concat_ws("-", *date)).alias("date"),
        F.when(found, text("playback_status") == "1").alias("has_playback"),
        F.when(found, F.greatest(F.lit(0), first_present("_r.duration", "_r.duration_sec")).cast("bigint")).alias("duration_seconds"),
        F.coalesce("_p", F.when(~dated, "bad_date")).alias("problem"),
    )


# All that is read of a month document, in one reading; values of other kinds become null.
COURSE_FIELDS = ("id", "course_id", "title", "realname", "lecturer_name", "kkxy_name", "school_name", "dept_name", "kkxy", "term_name", "term",
                 "sub_id", "sub_duration")
MONTH = f"STRUCT<code: DOUBLE, list: ARRAY<STRUCT<course: ARRAY<STRUCT<{', '.join(f'{c}: STRING' for c in COURSE_FIELDS)}>>>>>"


def _read_months(schedules: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Every month document with its course rows and ``month_status``."""
    parsed = schedules.select(*keys, F.try_parse_json(column).alias("_v"))
    read = parsed.select(*keys, "_v", F.try_variant_get("_v", "$", MONTH).alias("_m"))
    courses = F.filter(F.transform("_m.list", lambda d: d["course"]), lambda c: c.isNotNull())
    rows = F.coalesce(F.filter(F.flatten(courses), lambda r: r.isNotNull()), F.array())
    read = read.select(*keys, "_v", F.col("_m").isNull().alias("_broken"), "_m.code", F.col("_m.list").isNull().alias("_unlisted"), F.size("_m.list").alias("_days"), rows.alias("_rows"))
    listed = field(F.col("_v"), "list", "variant")
    status = (F.when(F.col("_broken"), "not_json")
              .when(~F.coalesce(F.col("code").isin(0.0, 200.0), F.lit(False)), "bad_code")
              .when(F.col("_unlisted") & truthy(listed), "bad_list")
              .when(F.col("_days") > MAX_DAYS_PER_MONTH, "too_many_days")
              .when(F.size("_rows") > MAX_ROWS_PER_MONTH, "too_many_rows").otherwise("ok"))
    return read.select(*keys, "_rows", status.alias("month_status"))


def schedule_status(schedules: DataFrame, keys: list[str], column: str = "doc") -> DataFrame:
    """Verdict of every month document, with the number of its course rows."""
    return _read_months(schedules, keys, column).select(*keys, F.size("_rows").cast("bigint").alias("rows"), "month_status")


def flatten_schedule(schedules: DataFrame, keys: list[str], column: str = "doc") -> DataFrame:
    """Course rows of all month documents, with their position in the month and its ``month_status``.

    No row is left out for the verdict on its month; the caller chooses.
    """
    # Verdict and rows come out of a generator: a caller's filter on the verdict is moved below the second one, so that refused months are not
    # exploded, but not below this one, where each place that names a document would parse it again.
    months = _read_months(schedules, keys, column).select(*keys, F.inline_outer(F.array(F.struct("month_status", "_rows"))))
    # The outer form: from the inner one the optimizer infers a filter on the array and parses each document again for it.
    rows = months.select(*keys, "month_status", F.posexplode_outer("_rows").alias("pos", "_r"))

    def pick(*options: str):
        return first_present(*[F.col(f"_r.{o}") for o in options], missing="")

    return rows.where("pos IS NOT NULL").select(
        *keys, F.col("pos").cast("bigint").alias("pos"),
        F.trim(pick("id", "course_id")).alias("course_id"),
        pick("title").alias("title"), pick("realname", "lecturer_name").alias("teacher"),
        pick("kkxy_name", "school_name", "dept_name", "kkxy").alias("department"),
        pick("term_name", "term").alias("term"), F.trim(pick("sub_id")).alias("sub_id"),
        F.greatest(F.lit(0.0), F.coalesce(pick("sub_duration").try_cast("double"), F.lit(0.0))).alias("duration"), "month_status",
    ).where("course_id <> ''")


def month_grid(anchors: DataFrame, column: str = "anchor") -> DataFrame:
    """The months a catalogue run asks for, around its anchor date."""
    first = F.trunc(column, "MM")
    months = F.sequence(F.add_months(first, -MONTHS_BACK), F.add_months(first, MONTHS_AHEAD), F.expr("INTERVAL 1 MONTH"))
    return anchors.withColumn("month", F.explode(months)).withColumn("month", F.date_format("month", "yyyy-MM"))


def _is_mp4(url):
    """Whether the path of the URL ends in .mp4, read without fetching anything."""
    path = F.regexp_extract(col(url), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*\z", "")
    return F.coalesce(F.lower(path).endswith(".mp4"), F.lit(False))


def pick_media_url(infos: DataFrame, keys: list[str], info: str = "info", detail: str = "detail") -> DataFrame:
    """The media file of a lecture: previews, play URLs, playback, then the detail."""
    playback = "content STRUCT<playback: STRUCT<url: STRING>>"
    parsed = infos.select(
        *keys, F.from_json(info, f"video_list MAP<STRING, STRING>, playurl MAP<STRING, STRING>, {playback}").alias("i"),
        F.from_json(detail, f"data STRUCT<{playback.replace('content ', 'content: ')}>").alias("d"))
    previews = F.transform(F.map_values("i.video_list"),
                           lambda v: F.from_json(v, "preview_url STRING")["preview_url"])
    plays = F.map_values(F.map_filter("i.playurl", lambda k, v: k != "now"))
    first = [F.get(F.filter(urls, lambda u: u.isNotNull() & _is_mp4(u)), F.lit(0)) for urls in (previews, plays)]
    url = F.coalesce(*first, present("i.content.playback.url", ""), present("d.data.content.playback.url", ""))
    return parsed.select(*keys, url.alias("_u")).select(*keys, F.when(_is_mp4("_u"), F.col("_u")).alias("media_url"))
