"""Typing of the mixed text column ``value`` and time parts of a reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The texts that count as a number (sign, digits with single underscores
# between them, fraction, exponent, or nan / inf) and the two boolean texts.
NUMBER_TEXT = (
    r"^\s*[+-]?("
    r"(\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*"
    r")([eE][+-]?\d+(_\d+)*)?\s*$"
)
NON_FINITE_TEXT = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"
BOOL_TEXTS = ("True", "False")

# The dashboard's narrower number pattern: digits with an optional fraction, no sign.
PLAIN_NUMBER_TEXT = r"^[0-9]\d*(\.\d+)?$"
SIGNED_PLAIN_NUMBER_TEXT = r"^-?[0-9]\d*(\.\d+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(v: Column) -> Column:
    """Only digits, signs, points, exponents and blanks: a cast alone tells numbers from texts."""
    return F.translate(v, "0123456789+-.eE ", "") == ""


def is_number(value: Column | str) -> Column:
    """Whether a text is a number. Patterns are matched only where a cast cannot decide."""
    v = _col(value)
    odd = v.rlike(NUMBER_TEXT) | v.rlike(NON_FINITE_TEXT)
    return F.coalesce(F.when(_plain(v), v.try_cast("double").isNotNull()).otherwise(odd), F.lit(False))


def value_type(value: Column | str = "value") -> Column:
    """``bool``, ``num`` or ``str``; a null is ``str``."""
    v = _col(value)
    return F.when(v.isin(*BOOL_TEXTS), "bool").when(is_number(v), "num").otherwise("str")


def numeric_value(value: Column | str = "value") -> Column:
    """The number a text stands for, null where it is none (NaN stays NaN)."""
    v = _col(value)
    bare = F.replace(F.trim(F.regexp_replace(v, r"\s", " ")), F.lit("_"), F.lit(""))
    odd = v.rlike(NUMBER_TEXT) | v.rlike(NON_FINITE_TEXT)
    return F.when(_plain(v), v.try_cast("double")).when(odd, F.regexp_replace(bare, r"^\+", "").try_cast("double"))


def bool_value(value: Column | str = "value") -> Column:
    """1 for ``True``, 0 for any other text."""
    return F.when(_col(value) == "True", 1).otherwise(0)


def typed_readings(df: DataFrame, value: str = "value") -> DataFrame:
    """Split the mixed column into ``val_num``, ``val_str``, ``val_bool``; one is set per row."""
    kind = value_type(value)
    return df.withColumns(
        {
            "val_num": numeric_value(value),
            "val_str": F.when(kind == "str", F.col(value)),
            "val_bool": F.when(kind == "bool", F.col(value) == "True"),
        }
    )


def separate_cat_and_cont(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows whose value is not a number, and rows whose value is; both gain ``dtype``."""
    typed = df.withColumn("dtype", value_type(value))
    return typed.filter(F.col("dtype") != "num"), typed.filter(F.col("dtype") == "num")


def numeric_cast_filter(df: DataFrame, value: str = "value") -> DataFrame:
    """Numeric rows only, with the column as a double."""
    return df.filter(value_type(value) == "num").withColumn(value, numeric_value(value))


def plain_number_filter(df: DataFrame, value: str = "value", signed: bool = False) -> DataFrame:
    """The dashboard's numeric filter and cast."""
    pattern = SIGNED_PLAIN_NUMBER_TEXT if signed else PLAIN_NUMBER_TEXT
    return df.filter(F.col(value).rlike(pattern)).withColumn(value, F.col(value).try_cast("double"))


def split_datetime(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Add ``date``, ``month`` and ``hour`` as strings, so nothing ever averages them."""
    return df.withColumns(
        {
            "date": F.to_date(ts).cast("string"),
            "month": F.month(ts).cast("string"),
            "hour": F.hour(ts).cast("string"),
        }
    )


def minute_of_time(ts: Column | str = "datetime") -> Column:
    """Minutes since 1970-01-01, free of any session time zone."""
    t = _col(ts)
    return F.unix_date(F.to_date(t)).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)


def to_local_time(ts: Column | str, tz: str = "America/Vancouver") -> Column:
    """UTC wall clock to local wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts).cast("timestamp_ntz"))
