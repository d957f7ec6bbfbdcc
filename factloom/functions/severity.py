"""Severity words and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, most severe first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Blanks around a word that carry no meaning.
BLANKS = " \t\r\n\u00a0"


def canonical_severity(severity: Column) -> Column:
    """Severity without regard to case and surrounding blanks; null and any other text is ``info``."""
    word = F.lower(F.btrim(severity, F.lit(BLANKS)))
    return F.when(word.isin(*SEVERITIES), word).otherwise(F.lit("info"))


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), canonical_severity(severity)).cast("int") - 1
