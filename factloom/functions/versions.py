"""Version strings as sortable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """A struct that sorts like the version.

    Numeric components compare as numbers and a missing one is 0; a release
    stands after its pre-releases, which order alpha, beta, rc and then by
    their number. Text without a leading number sorts first.
    """
    text = F.lower(F.btrim(version))
    numbers = F.regexp_replace(F.regexp_extract(text, r"^v?(\d+(?:\.\d+)*)", 1), r"(?:\.0+)+$", "")
    suffix = F.regexp_extract(text, r"^v?\d+(?:\.\d+)*[-._ ]*(alpha|a|beta|b|rc)", 1)
    number = F.regexp_extract(text, r"(?:alpha|a|beta|b|rc)[-._ ]*(\d+)", 1)
    return F.struct(
        F.transform(
            F.filter(F.split(numbers, r"\."), lambda x: x != ""), lambda x: x.try_cast("decimal(38,0)")
        ).alias("numbers"),
        F.when(suffix.isin("alpha", "a"), 0)
        .when(suffix.isin("beta", "b"), 1)
        .when(suffix == "rc", 2)
        .otherwise(3)
        .alias("stage"),
        F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("stage_number"),
    )
