"""Timestamps of many written forms, precisions and zones, brought to one unambiguous form.

The written forms are one table of patterns; each rewrites a match to the same list of fields, so parsing stays inside
JVM expressions. Wall-clock times then meet the zone-offset intervals of their zone: an as-of join by zone and month
bucket. Two intervals that hold the local time mean it is ambiguous, none means it never occurred, one gives the offset.

Defined results: null, empty, void or unparsable text gives null, and so do days that are not in the calendar; a text
whose year lies outside `years` counts only where no other text of the row holds a date, and then gives a null moment
of the kind `outside`; rows repeat as they come in; other columns pass through untouched, whatever their names, but for
older ones named moment, moment_kind and moment_from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bounded import measured

# Month names and fixed-offset zone abbreviations (minutes east of UTC).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "NZST": 720, "NZDT": 780,
}

_MON = r"([A-Za-z]{3})[a-z]*\.?"
_WDAY = r"(?:[A-Za-z]{3,9},?\s+)?"
_TIME = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?"
_NAMED = "|".join(sorted(ZONE_MINUTES, key=lambda z: (-len(z), z)))
_ZONE = r"\s*\(?((?i:" + _NAMED + r")|[A-Za-z]{2,4}T|[+-]\d{1,2}(?::?\d{2})?)?\)?"
_DAY = r"(?:\s*\([月火水木金土日]\))?"

#: (pattern over the whole normalised text, template of era|year|month|day|order|hour|minute|second|am/pm|zone|epoch digits).
#: order r: the first two numbers are in the recorder's order and stand in the year and month fields, the third in the day field.
FORMS = [
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "|$1|$2|$3|||||||"),
    (r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _DAY + r"(?:(?:[T ]\s*)" + _TIME + r"(?:\s*([AaPp][Mm]))?" + _ZONE + ")?", "|$1|$3|$4||$5|$6|$7|$8|$9|"),
    (r"(\d{4})(\d{2})(\d{2})", "|$1|$2|$3|||||||"),
    (r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", "|$1|$2|$3||$4|$5|$6||Z|"),
    (r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?" + _ZONE, "|$1|$2|$3||$4|$5|$6||$7|"),
    (r"((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])([0-5]\d)", "|$1|$2|$3||$4|$5||||"),
    (r"(\d{9,10}|\d{12,13}|\d{15,16})", "||||||||||$1"),
    (r"(\d{4})[-/.](\d{1,2})", "|$1|$2||||||||"),
    (r"(平成|[Hh])?\s*(\d{1,4}|元)([年./-])\s*(\d{1,2})(?:月|(?<![年])[./-])\s*(\d{1,2})日?" + _DAY + r"(?:\s*(午前|午後)?\s*(\d{1,2})(?:時|:)(?:(\d{1,2})分?)?(?::?(\d{1,2})秒?)?" + _ZONE + ")?", "$1|$2|$4|$5|e|$7|$8|$9|$6|$10|"),
    (r"(平成|[Hh])?\s*(\d{1,4}|元)年\s*(\d{1,2})月(?:号)?", "$1|$2|$3||e||||||"),
    (r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _DAY + r"(?:(?:[T ,]\s*)" + _TIME + r"(?:\s*([AaPp][Mm]))?" + _ZONE + ")?", "|$1|$3|$4|r|$5|$6|$7|$8|$9|"),
    (_MON + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,?\s+" + _TIME + r"(?:\s*([AaPp][Mm]))?" + _ZONE + ")?", "|$3|$1|$2||$4|$5|$6|$7|$8|"),
    (_WDAY + r"(\d{1,2})[-\s/]" + _MON + r"[-\s/,]\s*(\d{4})(?:[:\s]\s*" + _TIME + r"(?:\s*([AaPp][Mm]))?" + _ZONE + ")?", "|$3|$2|$1||$4|$5|$6|$7|$8|"),
    (r"\[(\d{1,2})/" + _MON + r"/(\d{4}):" + _TIME + _ZONE + r"\]", "|$3|$2|$1||$4|$5|$6||$7|"),
    (r"[A-Za-z]{3,9},?\s+" + _MON + r"\s+(\d{1,2})\s+" + _TIME + r"(?:\s+([A-Z]{2,4}T|" + _NAMED + r"))?\s+(\d{4})", "|$7|$1|$2||$3|$4|$5||$6|"),
    (_MON + r",?\s+(\d{4})", "|$2|$1||||||||"),
]

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 −‐–"
_THIN = "".join(chr(c) for c in range(0x21, 0x7F)) + "  ---"


def plain(text: Column) -> Column:
    """Full-width digits, letters, signs and blanks in their ASCII forms, blanks at the ends off."""
    return F.trim(F.regexp_replace(F.translate(text, _WIDE, _THIN), "[​-‏﻿]", ""))


def fields(s: Column) -> Column:
    """array<string> of the fields of the first form that matches the whole of a text made `plain`, else null."""
    hits = [F.when(s.rlike(f"^(?:{p})$"), F.regexp_replace(s, f"^(?:{p})$", t)) for p, t in FORMS]
    return F.split(F.coalesce(*hits), r"\|", -1)


def _int(x: Column) -> Column:
    return F.when(F.length(x) > 0, x).try_cast("int")


def _offset_s(zone: Column) -> Column:
    """Seconds east of UTC of a written zone, null if none was written; an unknown name gives null."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(F.lpad(digits, 4, "0"), 1, 2)).try_cast("int")
    minutes = F.when(F.length(digits) <= 2, F.lit("0")).otherwise(F.substring(F.lpad(digits, 4, "0"), 3, 2)).try_cast("int")
    names = F.create_map(*[F.lit(v) for kv in ZONE_MINUTES.items() for v in kv])
    named = F.try_element_at(names, F.upper(zone)) * 60
    return F.when(zone.rlike("^[+-]"), sign * (hours * 3600 + minutes * 60)).otherwise(named)


def numbers(f: Column, day_order: Column) -> Column:
    """struct of the numbers that the `fields` of a text hold, the first two put in the recorder's order where needed."""
    at = lambda i: F.get(f, F.lit(i))
    a, b, c = at(1), at(2), at(3)
    short = (at(4) == "r") & (F.length(c) == 2)
    long = (at(4) == "r") & (F.length(c) == 4)
    y_text = F.when(short & (day_order == "ymd"), a).when(short | long, c).otherwise(a)
    m_text = F.when(long & (day_order == "dmy"), b).when(long, a).when(short & (day_order == "mdy"), a).otherwise(b)
    d_text = F.when(long & (day_order == "dmy"), a).when(long, b).when(short & (day_order == "mdy"), b).when(short & (day_order == "dmy"), a).otherwise(c)
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.struct(
        (F.length(at(0)) > 0).alias("era"),
        F.when(y_text == "元", F.lit(1)).otherwise(_int(y_text)).alias("year"),
        F.when(m_text.rlike("^[A-Za-z]"), F.nullif(F.array_position(names, F.lower(m_text)).cast("int"), F.lit(0))).otherwise(_int(m_text)).alias("month"),
        _int(d_text).alias("day"),
        (F.length(d_text) == 0).alias("no_day"),
        _int(at(5)).alias("hour"),
        F.coalesce(_int(at(6)), F.lit(0)).alias("minute"),
        F.coalesce(_int(at(7)), F.lit(0)).alias("second"),
        F.lower(at(8)).alias("half"),
        (F.length(at(9)) > 0).alias("has_zone"),
        at(9).alias("zone"),
        F.nullif(at(10), F.lit("")).alias("epoch"),
    )


def _full(n: Column) -> Column:
    """The numbers with eras, two-digit years, halves of the day and units of epoch counts worked out."""
    y, h, half, count = n["year"], n["hour"], n["half"], n["epoch"].try_cast("long")
    year = F.when(n["era"], y + 1988).when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    hour = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).when((half == "午後") & (h <= 12), h % 12 + 12).when((half == "午前") & (h == 12), 0).otherwise(h)
    digits = F.length(n["epoch"])
    return F.struct(
        F.try_make_timestamp(year, n["month"], F.when(n["no_day"], F.lit(1)).otherwise(n["day"]), F.lit(0), F.lit(0), F.lit(0)).cast("date").alias("first"),
        n["no_day"].alias("no_day"),
        hour.alias("hour"),
        n["minute"].alias("minute"),
        n["second"].alias("second"),
        n["has_zone"].alias("has_zone"),
        F.when(n["has_zone"], _offset_s(n["zone"])).cast("long").alias("offset_s"),
        F.when(digits >= 15, F.floor(count / 1_000_000)).when(digits >= 12, F.floor(count / 1000)).otherwise(count).cast("long").alias("epoch_s"),
    )


def parsed(n: Column, years: tuple[int, int]) -> Column:
    """struct<precision, written, local_s, offset_s, inside> of full numbers; null if they make no date.

    precision is month, day or time; local_s are the wall clock's seconds since 1970 read as if in UTC; offset_s is
    null where no zone was written; inside tells whether the year is one of `years`. Epoch counts have offset 0.
    """
    has_time = n["hour"].isNotNull()
    good_time = (n["hour"] <= 47) & (n["minute"] <= 59) & (n["second"] <= 60)
    good = n["first"].isNotNull() & (~has_time | good_time) & ~(n["no_day"] & has_time) & (~n["has_zone"] | n["offset_s"].isNotNull())
    wall = F.unix_date(n["first"]).cast("long") * 86400 + F.coalesce(n["hour"] * 3600 + n["minute"] * 60 + n["second"], F.lit(0))
    counted = F.struct(F.lit("time").alias("precision"), F.lit(None).cast("string").alias("written"), n["epoch_s"].alias("local_s"), F.lit(0).cast("long").alias("offset_s"), F.year(F.timestamp_seconds(n["epoch_s"])).between(*years).alias("inside"))
    dated = F.struct(
        F.when(has_time, "time").when(n["no_day"], "month").otherwise("day").alias("precision"),
        F.when(n["no_day"], F.date_format(n["first"], "yyyy-MM")).otherwise(F.date_format(n["first"], "yyyy-MM-dd")).alias("written"),
        wall.cast("long").alias("local_s"),
        n["offset_s"].alias("offset_s"),
        F.year(n["first"]).between(*years).alias("inside"),
    )
    is_count = n["epoch_s"].isNotNull()
    return F.when(is_count, counted).when(good, dated)


def zone_intervals(zones: DataFrame, zone: str, years: tuple[int, int]) -> DataFrame:
    """One row per zone and stretch of one offset: (zone, utc_from, utc_to, offset_s), seconds, from the JVM's zone rules.

    Days on whose ends the offset differs are opened into quarter hours, so every change is met exactly.
    """
    from pyspark.sql import Window

    lo, hi = f"{years[0] - 1}-12-01", f"{years[1] + 1}-02-01"
    off = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), F.col("_zone"))) - s
    named = zones.select(F.col(zone).alias("_zone")).where("_zone is not null").distinct()
    days = named.select("_zone", F.explode(F.sequence(F.unix_seconds(F.lit(lo).cast("timestamp")), F.unix_seconds(F.lit(hi).cast("timestamp")), F.lit(86400).cast("long"))).alias("s"))
    changed = days.where(off(F.col("s")) != off(F.col("s") + 86400))
    steps = changed.select("_zone", F.explode(F.sequence(F.col("s") + 900, F.col("s") + 86400, F.lit(900).cast("long"))).alias("s")).where(off(F.col("s")) != off(F.col("s") - 900))
    start = named.select("_zone", F.unix_seconds(F.lit(lo).cast("timestamp")).alias("s"))
    w = Window.partitionBy("_zone").orderBy("s")
    return start.union(steps).select(
        "_zone",
        F.col("s").alias("utc_from"),
        F.coalesce(F.lead("s").over(w), F.unix_seconds(F.lit(hi).cast("timestamp"))).alias("utc_to"),
        off(F.col("s")).alias("offset_s"),
    )


def exploded_intervals(intervals: DataFrame) -> DataFrame:
    """The intervals of each (zone, local month) as one sorted array; the stretch before a gap counts as in the gap's month."""
    day = 86400
    local = intervals.select("_zone", (F.col("utc_from") + F.col("offset_s")).alias("local_from"), (F.col("utc_to") + F.col("offset_s")).alias("local_to"), "offset_s")
    month = lambda s: F.trunc(F.timestamp_seconds(s).cast("date"), "month")
    spread = local.select("*", F.explode(F.sequence(month(F.col("local_from") - day), month(F.col("local_to") + day), F.expr("interval 1 month"))).alias("_month"))
    return spread.groupBy("_zone", "_month").agg(F.array_sort(F.collect_list(F.struct("local_from", "local_to", "offset_s"))).alias("_stretches"))


def normalised(
    df: DataFrame,
    texts: list[str],
    recorder: str,
    clocks: DataFrame,
    years: tuple[int, int] = (1900, 2100),
) -> DataFrame:
    """`df` with `moment` (yyyy-MM, yyyy-MM-dd or yyyy-MM-ddTHH:mm:ssZ), `moment_kind` and `moment_from`.

    The first of `texts` that holds a date counts. moment_kind says how the zone was found: written, direct, ambiguous
    (the earlier instant), nonexistent (the offset before the change), none (month or day only), outside (a date whose
    year is not one of `years`, which also bound the table of offsets; a null moment) or, without a known recorder, null
    with a null moment. clocks has (recorder, zone, day_order), one row each; a null recorder has none.
    """
    own = clocks.where(F.col("recorder").isNotNull()).groupBy("recorder").agg(F.min("zone").alias("_zone"), F.min("day_order").alias("_order"))
    stretches = measured(exploded_intervals(zone_intervals(own, "_zone", years)))
    # the row travels as one struct, so its own names cannot clash with those used here
    keep = [c for c in df.columns if c not in ("moment", "moment_kind", "moment_from")]
    names = [f"_t{i}" for i in range(len(texts))]
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), *[F.col(f"`{t}`").alias(n) for t, n in zip(texts, names)], F.col(f"`{recorder}`").alias("_by"))
    d = d.join(measured(own.withColumnRenamed("recorder", "_recorder")), F.col("_by") == F.col("_recorder"), "left")
    # each step is one higher-order call over the texts, so no step's expressions are repeated in the next
    each = F.transform(F.array(*[F.col(n) for n in names]), plain)
    each = F.transform(F.transform(each, fields), lambda f: numbers(f, F.col("_order")))
    each = F.transform(F.transform(each, _full), lambda n: parsed(n, years))
    d = d.withColumn("_each", each)
    held = F.array_position(F.transform("_each", lambda p: F.coalesce(p["inside"], F.lit(False))), True).cast("int")
    d = d.withColumn("_held", F.nullif(held, F.lit(0)))
    d = d.withColumn("_p", F.try_element_at("_each", F.col("_held")))
    d = d.withColumn("moment_from", F.try_element_at(F.array(*[F.lit(t) for t in texts]), F.col("_held")))
    open_ = (F.col("_p.precision") == "time") & F.col("_p.offset_s").isNull()
    d = d.withColumn("_m", F.when(open_, F.trunc(F.timestamp_seconds("_p.local_s").cast("date"), "month")))
    d = d.join(stretches.withColumnsRenamed({"_zone": "_z"}), (F.col("_z") == F.col("_zone")) & (F.col("_month") == F.col("_m")), "left")
    local = F.col("_p.local_s")
    inside = F.filter("_stretches", lambda i: (i["local_from"] <= local) & (local < i["local_to"]))
    before = F.filter("_stretches", lambda i: i["local_from"] <= local)
    offset = F.when(F.size(inside) > 0, F.array_max(F.transform(inside, lambda i: i["offset_s"]))).otherwise(F.element_at(before, -1)["offset_s"])
    utc = local - F.coalesce(F.col("_p.offset_s"), F.when(open_, offset))
    d = d.withColumn("moment", F.when(F.col("_p.precision") == "time", F.date_format(F.timestamp_seconds(utc), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("_p.written")))
    kind = (
        F.when(~open_ & (F.col("_p.precision") == "time"), "written")
        .when(F.col("_p.precision").isin("month", "day"), "none")
        .when(F.size(inside) > 1, "ambiguous")
        .when(F.size(inside) == 1, "direct")
        .when(F.size(before) > 0, "nonexistent")
        .when(F.col("_held").isNull() & F.exists("_each", lambda p: p.isNotNull()), "outside")
    )
    return d.withColumn("moment_kind", kind).select("_row.*", "moment", "moment_kind", "moment_from")
