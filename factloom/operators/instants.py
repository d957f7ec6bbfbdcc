"""Points in time written in many forms, as one instant in UTC.

Raw strings are gathered with the clock they were written by into a
dictionary of distinct values, each value is parsed once, the dictionary is
kept as a table that grows by what is new, and the instants are joined back
to the rows. All parsing is done by built-in expressions.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import stage, staging_path

#: English month names by their first three letters.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_MON = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\.?"
_DAY_NAME = r"(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*\.?,? +)?"
#: Heads of a value: pattern, and the groups that hold year, month, day (0: by the date order of the clock).
_YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?=T\d|$)"
_FIGURES = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?!\d)"
_DAY_MONTH = rf"^{_DAY_NAME}(\d{{1,2}})(?:ST|ND|RD|TH)?[ -]+{_MON},?[ -]+(\d{{4}})(?!\d)"
_MONTH_DAY = rf"^{_DAY_NAME}{_MON} +(\d{{1,2}})(?:ST|ND|RD|TH)?,? +(\d{{4}})(?!\d)"
_TIME = r"^[T ,]+(?:AT )?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? *([AP]\.?M\.?(?![A-Z]))? *(.*)$"
_TIME_COMPACT = r"^T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()()? *(.*)$"
_OFFSET = r"^(?:GMT|UTC)?([+-])(\d{2})(?::?(\d{2}))?(?: *\[[^\]]*\])?$"
_REGION = r"^\[?([A-Z_]+(?:/[A-Z0-9_+-]+)+)\]?$"
#: Years for which the abbreviations of a zone are gathered.
ABBREVIATION_YEARS = (1970, 2037)
#: A raw value is heavy from this share of all values on; so there are at most this many heavy ones, whatever the input.
HEAVY_VALUES = 128
#: Tasks over which the rows of heavy values are spread.
SALTS = 64
#: Setting that names a folder in which the dictionary is kept from run to run.
DICTIONARY_SETTING = "spark.factloom.instants.dir"


def zone_abbreviations(zones: list[str], years: tuple[int, int] = ABBREVIATION_YEARS) -> list[tuple[str, str, int]]:
    """(zone, abbreviation, offset in seconds) as the time zone database has them; the latest use of one wins."""
    found: dict[tuple[str, str], int] = {}
    for zone in sorted(set(zones)):
        try:
            info = zoneinfo.ZoneInfo(zone)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError):
            continue
        for year in range(years[0], years[1] + 1):
            for month in range(1, 13):
                at = dt.datetime(year, month, 15, 12, tzinfo=info)
                name, offset = at.tzname(), at.utcoffset()
                if name and offset is not None:
                    found[zone, name.upper()] = int(offset.total_seconds())
    return [(z, a, o) for (z, a), o in found.items()]


def _clock_columns(spark: SparkSession, zones: list[str]) -> tuple[Column, Column, Column]:
    """Expressions over the column zone: its abbreviations, and over a region's name: its proper spelling; valid zones."""
    known = sorted({z for z, _, _ in zone_abbreviations(zones, (2020, 2020))})
    pairs = [x for z, a, o in zone_abbreviations(known) for x in (F.lit(f"{z}|{a}"), F.lit(o))]
    abbreviations = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    names = [x for z in [*known, "UTC"] for x in (F.lit(z.upper()), F.lit(z))]
    return abbreviations, F.create_map(*names), F.array(*map(F.lit, [*known, "UTC"]))


def utc_micros(raw: Column, zone: Column, date_order: Column, spark: SparkSession, zones: list[str]) -> Column:
    """Microseconds since 1970 in UTC of a value, or null where it names no instant.

    A missing part of a time is 0 and digits beyond microseconds are dropped.
    A date without time is midnight UTC. A time without zone is on the clock
    ``zone``, which also tells what an abbreviation other than GMT and UTC
    means. Day and month in figures follow ``date_order`` (dmy or mdy; any
    other is read as dmy) unless the year comes first. Figures of ten digits are
    seconds and of thirteen milliseconds since 1970. A local time that occurs
    twice means the first, a skipped one is read with the offset before the
    change. Impossible dates and times name no instant.
    """
    abbreviations, proper, valid = _clock_columns(spark, zones)
    text = F.upper(F.btrim(F.regexp_replace(raw, r"[\s\p{Z}]+", " ")))

    def part(pattern: str, group: int, of: Column = text) -> Column:
        return F.regexp_extract(of, pattern, group)

    heads = [
        (_YEAR_FIRST, 1, 3, 4),
        (_COMPACT, 1, 2, 3),
        (_FIGURES, 4, 0, 0),
        (_DAY_MONTH, 3, 2, 1),
        (_MONTH_DAY, 3, 1, 2),
    ]
    mdy = F.lower(date_order) == "mdy"

    def number(c: Column) -> Column:
        return c.try_cast("int")

    def month_of(c: Column) -> Column:
        return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), c), F.lit(0)).cast("int")

    def choose(pick) -> Column:
        chain = None
        for head in heads:
            test, value = text.rlike(head[0]), pick(head)
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain

    def day_or_month(head: tuple, which: int) -> Column:
        pattern, group = head[0], head[which]
        if group == 0:
            first, second = number(part(pattern, 1)), number(part(pattern, 3))
            return F.when(mdy, first if which == 2 else second).otherwise(second if which == 2 else first)
        got = part(pattern, group)
        return month_of(got) if which == 2 and pattern in (_DAY_MONTH, _MONTH_DAY) else number(got)

    year = choose(lambda h: number(part(h[0], h[1])))
    month = choose(lambda h: day_or_month(h, 2))
    day = choose(lambda h: day_or_month(h, 3))
    tail = choose(lambda h: F.regexp_replace(text, h[0], ""))
    dated = F.struct(text.alias("text"), year.alias("y"), month.alias("m"), day.alias("d"), F.btrim(tail).alias("bare"), tail.alias("tail"))

    def timed(v: Column) -> Column:
        compact = v.getField("tail").rlike(r"^T\d{4}")
        plain = v.getField("tail").rlike(_TIME)
        get = lambda i, j: F.when(compact, part(_TIME_COMPACT, j, v.getField("tail"))).when(plain, part(_TIME, i, v.getField("tail")))
        half = F.substring(get(5, 5), 1, 1)
        hour = number(get(1, 1))
        hour = F.when(half == "", F.when(hour < 24, hour)).when(
            hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)
        )
        second = F.coalesce(number(F.nullif(get(3, 3), F.lit(""))), F.lit(0))
        micro = number(F.rpad(F.substring(get(4, 4), 1, 6), 6, "0"))
        return F.struct(
            v.alias("v"),
            (v.getField("bare") == "").alias("date_only"),
            hour.alias("h"),
            number(get(2, 2)).alias("mi"),
            F.when(second < 60, second).alias("s"),
            micro.alias("us"),
            F.btrim(get(6, 7)).alias("zone_text"),
        )

    def local(t: Column) -> Column:
        v = t.getField("v")
        zero = F.lit(0)
        seconds = F.when(t.getField("date_only"), zero).otherwise(t.getField("s"))
        return F.struct(
            t.alias("t"),
            F.try_make_timestamp_ntz(
                v.getField("y"),
                v.getField("m"),
                v.getField("d"),
                F.when(t.getField("date_only"), zero).otherwise(t.getField("h")),
                F.when(t.getField("date_only"), zero).otherwise(t.getField("mi")),
                seconds.cast("decimal(16,6)"),
            ).alias("at"),
        )

    def micros_of(ntz: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)

    def instant(x: Column) -> Column:
        t, at = x.getField("t"), x.getField("at")
        words = t.getField("zone_text")
        sign = F.when(part(_OFFSET, 1, words) == "-", -1).otherwise(1)
        minutes = F.coalesce(number(F.nullif(part(_OFFSET, 3, words), F.lit(""))), F.lit(0))
        offset = sign * (number(part(_OFFSET, 2, words)) * 3600 + minutes * 60)
        named = F.try_element_at(abbreviations, F.concat(zone, F.lit("|"), words))
        region = F.try_element_at(proper, part(_REGION, 1, words))
        clock = F.when(F.array_contains(valid, zone), zone)

        def on(z: Column) -> Column:
            return micros_of(F.convert_timezone(z, F.lit("UTC"), at))

        whole = (
            F.when(t.getField("date_only"), micros_of(at))
            .when(words.isin("Z", "UTC", "GMT", "UT"), micros_of(at))
            .when(words.rlike(_OFFSET), micros_of(at) - offset.cast("bigint") * 1_000_000)
            .when(words == "", on(clock))
            .when(named.isNotNull(), micros_of(at) - named.cast("bigint") * 1_000_000)
            .when(region.isNotNull(), on(region))
            .when(words.rlike(r"^[A-Z]{2,5}$"), on(clock))
        )
        return whole + F.coalesce(F.when(~t.getField("date_only"), t.getField("us")), F.lit(0))

    def bind(value: Column, f) -> Column:
        """Give ``value`` a name inside an expression, so that it's worked out once."""
        return F.element_at(F.transform(F.array(value), f), 1)

    epoch = text.rlike(r"^-?\d{9,10}$|^-?\d{12,13}$")
    scale = F.when(F.length(F.regexp_replace(text, "-", "")) > 11, F.lit(1_000)).otherwise(F.lit(1_000_000))
    return F.when(epoch, text.try_cast("bigint") * scale).otherwise(bind(bind(bind(dated, timed), local), instant))


class InstantDictionary:
    """A kept table of distinct (raw, zone, date_order) with their instant.

    ``path`` is a folder that all executors share; without one it is what the
    session names in ``spark.factloom.instants.dir``, and without that the
    dictionary lives as long as the driver. Each ``extend`` parses only values that it
    doesn't hold and appends them as one more batch. Values that name no
    instant are kept too, with a null, so that they aren't parsed again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or spark.conf.get(DICTIONARY_SETTING, None) or staging_path(spark, "instants")

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("raw string, zone string, date_order string, utc_us bigint").parquet(self.path)
        except AnalysisException:  # nothing was kept yet
            return None

    def extend(self, values: DataFrame, zones: list[str]) -> None:
        """Add the distinct ``values`` (raw, zone, date_order), nulls in zone or order included."""
        fresh = values.where(F.col("raw").isNotNull()).select(
            "raw", F.coalesce("zone", F.lit("")).alias("zone"), F.coalesce("date_order", F.lit("")).alias("date_order")
        ).distinct()
        if (known := self.read()) is not None:
            fresh = fresh.join(known.select("raw", "zone", "date_order"), ["raw", "zone", "date_order"], "left_anti")
        fresh.withColumn(
            "utc_us", utc_micros(F.col("raw"), F.col("zone"), F.col("date_order"), self.spark, zones)
        ).write.mode("append").parquet(self.path)


def normalise_instants(
    sources: list[tuple[str, DataFrame, str, list[str]]], clocks: DataFrame, path: str | None = None
) -> DataFrame:
    """One row for each value that names an instant.

    ``sources``: name, table with a ``collector_id``, id column, columns to
    read. ``clocks``: collector_id, zone_name, date_order. Rows whose clock is
    unknown or null keep the values that need none. Null and unusable values
    give no row. Repeated rows of an id with one value count once. Values are
    counted as they are gathered for the dictionary; those that hold a share
    of 1 / ``HEAVY_VALUES`` of all rows or more (so no more than that many) are
    broadcast with their instant, and their rows are spread over ``SALTS``
    tasks or, where they name no instant, dropped before the join.
    Result: source_table, record_id, field_name, utc_us.
    """
    spark = clocks.sparkSession
    clocks = clocks.select("collector_id", F.col("zone_name").alias("zone"), "date_order").dropDuplicates(["collector_id"])
    # The zones that exist are some six hundred; names of none of them are not collected.
    listed = clocks.select("zone").where(F.col("zone").isin(sorted(zoneinfo.available_timezones()))).distinct().collect()
    zones = [r.zone for r in listed]
    book = InstantDictionary(spark, path)
    rows = None
    for name, table, record, fields in sources:
        entries = F.explode(
            F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields))
        )
        one = (
            table.select(F.lit(name).alias("source_table"), F.col(record).cast("bigint").alias("record_id"), "collector_id", entries.alias("e"))
            .where(F.col("e.raw").isNotNull())
            .join(clocks, "collector_id", "left")
            .select(
                "source_table",
                "record_id",
                F.col("e.field_name").alias("field_name"),
                F.col("e.raw").alias("raw"),
                F.coalesce("zone", F.lit("")).alias("zone"),
                F.coalesce("date_order", F.lit("")).alias("date_order"),
            )
        )
        rows = one if rows is None else rows.unionByName(one)
    keys = ["raw", "zone", "date_order"]
    counted = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "instant-values")
    book.extend(counted, zones)
    known = book.read()
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy = counted.where(F.col("n") * HEAVY_VALUES >= total).select(*keys)
    heavy = known.join(F.broadcast(heavy), keys).select(*keys, F.col("utc_us").alias("heavy_us"), F.lit(True).alias("heavy"))
    usable = known.where(F.col("utc_us").isNotNull()).withColumn("salt", F.lit(0)).hint("merge")
    is_heavy = F.coalesce("heavy", F.lit(False))
    salt = F.when(is_heavy, 1 + F.pmod(F.xxhash64("source_table", "record_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    return (
        rows.join(F.broadcast(heavy), keys, "left")
        .where(~is_heavy | F.col("heavy_us").isNotNull())
        .withColumn("salt", salt)
        .join(usable, [*keys, "salt"], "left")
        .select("source_table", "record_id", "field_name", F.coalesce("heavy_us", "utc_us").alias("utc_us"))
        .where(F.col("utc_us").isNotNull())
        .distinct()
    )
