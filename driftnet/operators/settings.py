"""Settings are kept as text; here they get their types. A text that does not fit leaves the default as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the texts of a kind must be.
TRUE, FALSE = ["1", "t", "T", "TRUE", "true", "True"], ["0", "f", "F", "FALSE", "false", "False"]
LEVELS = ["debug", "info", "warn", "error"]
NANOSECONDS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
TERM = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"


def as_flag(text: Column) -> Column:
    return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)


def as_number(text: Column, least: int, most: int | None) -> Column:
    """An integer within bounds, else null."""
    n = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("long"))
    return F.when((n >= least) & (F.lit(True) if most is None else n <= most), n)


def as_nanoseconds(text: Column) -> Column:
    """The length of texts like "1h30m" or "-1.5s"; a number needs its unit, only 0 stands alone."""
    terms = lambda place: F.regexp_extract_all(text, F.lit(TERM), F.lit(place))
    unit = F.create_map(*[F.lit(x) for pair in NANOSECONDS.items() for x in pair])
    # decimals keep nine places exactly; beyond a long the text does not fit
    each = F.zip_with(terms(1), terms(2), lambda n, u: n.try_cast("decimal(28,9)") * F.element_at(unit, u).cast("decimal(14,0)"))
    total = F.aggregate(each, F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x).cast("decimal(38,9)"))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.rlike(r"^[+-]?0\z"), F.lit(0).cast("long")).when(text.rlike(rf"^[+-]?(?:{TERM})+\z"), F.floor(signed).try_cast("long"))


def as_lines(text: Column) -> Column:
    """Its lines without blanks around them, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda p: F.trim(p)), lambda p: p != "")


def as_level(text: Column) -> Column:
    return F.when(F.lower(text).isin(LEVELS), F.lower(text))


def coerce(settings: DataFrame, kinds: DataFrame) -> DataFrame:
    """key, kind, fits, flag, number, lines, level: the settings that have a kind, with the value in the column of the kind.

    kinds: key, kind (flag, number, duration, lines or level), least, most (bounds of a number; null for none). Unknown keys are left out; a value that is null or
    does not fit has fits = false and nulls, so that `F.coalesce` with a default keeps the default. A duration is a number of nanoseconds. Other columns
    of the settings are carried along; they may not have the names of these.
    """
    others = [c for c in settings.columns if c not in ("key", "value")]
    rows = settings.join(kinds.select("key", "kind", "least", "most"), "key")
    value, of = F.col("value"), lambda kind: F.col("kind") == kind
    whole = as_number(value, -(2**63), None)
    bounded = F.when((whole >= F.coalesce("least", whole)) & (whole <= F.coalesce("most", whole)), whole)
    typed = rows.select(
        *others, "key", "kind", F.when(of("flag"), as_flag(value)).alias("flag"), F.when(of("number"), bounded).when(of("duration"), as_nanoseconds(value)).alias("number"),
        F.when(of("lines"), as_lines(value)).alias("lines"), F.when(of("level"), as_level(value)).alias("level"),
    )
    return typed.withColumn("fits", F.col("number").isNotNull() | F.col("flag").isNotNull() | F.col("lines").isNotNull() | F.col("level").isNotNull())
