"""Column expressions that read clock text: dates, times, and the digits that survive in garbled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings

# The forms of dates and times that readings have.
DATE = r"(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{2,4})"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WORD_DATE = rf"(?i)({'|'.join(MONTHS)})[.,:\-]?\s*(\d{{1,2}})\s+(\d{{2,4}})"
TIME = r"(?i)(\d{1,2}):(\d{2})(?::\d{2})?\s*(AM|PM)?"
DAY_BEFORE_YEAR = r"(\d{1,2})\s*[/.\s\-]\s*([789]\d)(?!\d)"
MONTH_LEAD = r"(?<!\d)(\d{1,2})\s*/"
EVAL_DATE = r"(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{2})\b"
FRAME_NAME = r"frame_(\d+)\.bmp$"
READING_NAME = r"^b0*(\d+)_t0*(\d+)\.png"


def normalized(raw: Column) -> Column:
    """Runs of line ends and of spaces as one space each, and none at the ends."""
    one_line = F.when(raw.contains("\n") | raw.contains("\r"), F.regexp_replace(raw, r"[\n\r]+", " ")).otherwise(raw)
    return F.trim(F.when(one_line.contains("  "), F.regexp_replace(one_line, " +", " ")).otherwise(one_line))


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of digits of the first match as INT; null where there is none."""
    return _int(F.regexp_extract(text, pattern, group))


def _int(digits: Column) -> Column:
    """Digits or an empty string as INT; a cast that fails on the empty string is far dearer than this test."""
    return F.when(digits != "", digits.cast("int"))


def full_year(year: Column, pivot: int) -> Column:
    return F.when(year < 100, year + F.when(year >= pivot, 1900).otherwise(2000)).otherwise(year)


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _made(y: Column, mo: Column, d: Column, h: Column, mi: Column) -> Column:
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, F.lit(0).cast("decimal(16,6)"))


def with_reading(rows: DataFrame, raw: str = "raw", settings: Settings = DEFAULTS, cam_ts: str = "cam_ts", minute: str | None = "minute") -> DataFrame:
    """rows with what a reading says, in plain steps that whole-stage code compiles.

    cam_ts: its TIMESTAMP_NTZ, null without a plausible date; a time without meridian is midnight, an impossible one
    makes the whole reading null. minute: the minute of the day of a time with meridian in text without any form of
    date. Null and empty text has neither. Names that begin with __ are used inside.
    """
    col = F.col
    numeric, word = col("__num") != "", col("__word") != ""
    out = rows.withColumn("__flat", normalized(col(raw)))
    # Searches only where a cheap test finds what they need, that for a month's name only without a numeric date.
    found = lambda test, pattern: F.when(test, F.regexp_extract("__flat", pattern, 0)).otherwise("")
    out = out.withColumns({"__num": found(col("__flat").contains("/"), DATE), "__time": found(col("__flat").contains(":"), TIME)})
    out = out.withColumn("__word", found((col("__num") == "") & col("__flat").rlike("[A-Za-z]{3}"), WORD_DATE))
    n = F.split("__num", "/")
    out = out.withColumns(
        {
            **{f"__n{k}": F.when(numeric, F.trim(F.get(n, F.lit(k))).cast("int")) for k in range(3)},
            "__month": F.when(word, F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.left("__word", F.lit(3)))).cast("int")),
            **{f"__w{k}": F.when(word, _part(col("__word"), WORD_DATE, k + 1)) for k in (1, 2)},
            "__hour": _int(F.substring_index("__time", ":", 1)),
            "__mi": _int(F.substring(col("__time"), F.instr("__time", ":") + 1, F.lit(2))),
            "__mer": F.when(F.right("__time", F.lit(1)).rlike("[A-Za-z]"), F.upper(F.right("__time", F.lit(2)))).otherwise(""),
        }
    )
    hour = F.when((col("__mer") == "PM") & (col("__hour") != 12), col("__hour") + 12).when((col("__mer") == "AM") & (col("__hour") == 12), 0).otherwise(col("__hour"))
    out = out.withColumns(
        {
            "__dated": numeric | F.coalesce(col("__month") > 0, F.lit(False)),
            "__timed": col("__mer") != "",
            "__y": full_year(F.coalesce("__n2", "__w2"), settings.pivot),
            "__mo": F.coalesce("__n0", "__month"),
            "__d": F.coalesce("__n1", "__w1"),
            "__h": hour,
        }
    )
    ts = _made(col("__y"), col("__mo"), col("__d"), F.when(col("__timed"), col("__h")).otherwise(0), F.when(col("__timed"), col("__mi")).otherwise(0))
    made = [F.when(col("__dated") & col("__y").between(settings.first_year, settings.last_year), ts).alias(cam_ts)]
    if minute:
        of_day = ~col("__dated") & col("__timed") & col("__h").between(0, 23) & col("__mi").between(0, 59)
        made.append(F.when(of_day, col("__h") * 60 + col("__mi")).alias(minute))
    # A generator of one row: conditions on the result aren't pushed below it, where each would repeat all steps many times over.
    return out.select(*[col(f"`{c}`") for c in rows.columns if c not in (cam_ts, minute)], F.inline(F.array(F.struct(*made))))


def eval_date(raw: Column, settings: Settings = DEFAULTS) -> Column:
    """The evaluator's date: numeric form with a two-digit year, at midnight."""
    year = full_year(_part(raw, EVAL_DATE, 3), settings.eval_pivot)
    return F.when(raw.contains("/"), _made(year, _part(raw, EVAL_DATE, 1), _part(raw, EVAL_DATE, 2), F.lit(0), F.lit(0)))


def _lenient(raw: Column, pattern: str, most: int) -> Column:
    found = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), lambda s: F.when(s.cast("int") > most, F.right(s, F.lit(1)).cast("int")).otherwise(s.cast("int")))
    return F.array_distinct(F.filter(found, lambda n: n.between(1, most)))


def lenient_days(raw: Column) -> Column:
    """Days that stand before what may be a year; of an impossible one the last digit."""
    return _lenient(raw, DAY_BEFORE_YEAR, 31)


def lenient_months(raw: Column) -> Column:
    """Months that stand before a slash; of an impossible one the last digit."""
    return _lenient(raw, MONTH_LEAD, 12)


def gap_class(raw: Column, old: Column, new: Column) -> Column:
    """'old', 'new' or 'noise': whose date the digits of a garbled reading match in a field that tells the two apart."""

    def judged(x: Column) -> Column:
        def hit(of: Column) -> Column:
            return (F.array_contains(x["days"], F.day(of)) & (F.day(old) != F.day(new))) | (F.array_contains(x["months"], F.month(of)) & (F.month(old) != F.month(new)))

        return F.when(hit(new) & ~hit(old), "new").when(hit(old) & ~hit(new), "old").otherwise("noise")

    return _bound(F.struct(lenient_days(raw).alias("days"), lenient_months(raw).alias("months")), judged)


def frame_index(path: Column) -> Column:
    """Number of a frame's file name; any other name is an error."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(FRAME_NAME), F.regexp_extract(name, FRAME_NAME, 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a frame: "), path)).cast("int"))
