"""Text to value, all as built-in column expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens a CSV reader of the pandas family takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

#: Tried in order; day before month where a date doesn't begin with the year.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "dd-MM-yyyy",
)

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~c.isin(NA_TOKENS), c)


def to_number(c: Column | str) -> Column:
    """Text to double, NULL where it is not a plain number.

    The pattern comes first because a cast alone accepts Java suffixes ('1d', '1f').
    """
    c = _col(c).cast("string")
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def to_date_or_null(c: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    c = F.trim(_col(c))
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def clean_string(c: Column | str) -> Column:
    trimmed = F.trim(_col(c))
    return F.when(trimmed != "nan", trimmed)


def parse_weight(c: Column | str) -> Column:
    """Stones-pounds ('9-7') or pounds ('133') to pounds; anything else, or out of range, is NULL."""
    c = _col(c).cast("string")
    stones = F.regexp_extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("int")
    pounds = F.regexp_extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int")
    plain = F.regexp_extract(c, r"^\s*([+-]?\d+)\s*$", 1).try_cast("int")
    return F.coalesce(F.try_add(F.try_multiply(stones, F.lit(14)), pounds), plain)


def extract_class(c: Column | str) -> Column:
    """First run of digits as a number, 0 when there is none."""
    digits = F.regexp_extract(_col(c), r"(\d+)", 1).try_cast("double")
    return F.coalesce(digits, F.lit(0.0))


def parse_prize(c: Column | str) -> Column:
    """Money text to a number; junk and NULL are 0."""
    kept = F.regexp_replace(_col(c).cast("string"), r"[^0-9.]", "")
    return F.coalesce(to_number(kept), F.lit(0.0))


def parse_card_prize(c: Column | str) -> Column:
    """Card variant: drops currency signs and thousands commas only."""
    kept = F.regexp_replace(_col(c).cast("string"), "[€£,]", "")
    return F.coalesce(to_number(kept), F.lit(0.0))


def position_number(c: Column | str) -> Column:
    """Finishing position, NULL for PU, F, DSQ and the like."""
    return to_number(c).try_cast("int")


def beyond(raw: Column | str, num: Column | str, n: int) -> Column:
    """'Position after n', where a non-numeric position counts as after everybody."""
    raw, num = _col(raw), _col(num)
    return F.coalesce(num > n, raw.isNotNull())


def is_win(num: Column | str) -> Column:
    return F.coalesce((_col(num) == 1).cast("int"), F.lit(0))


def is_place(num: Column | str, places: int = 3) -> Column:
    return F.coalesce((_col(num) <= places).cast("int"), F.lit(0))
