"""Flags, fills and label codes of the metadata and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.schemas import UNKNOWN_CODE, UNKNOWN_LABEL

# Fixed value: the mark that stands for true in metadata exports.
CHECK_MARK = "✓"

FLAG_COLUMNS = ["energy", "power", "sensor", "water"]

# 0/1 columns (name, source column, category) kept by feature selection.
SELECTED_ONE_HOT = [
    ("energy_no_energy", "energy", "no_energy"),
    ("energy_yes_energy", "energy", "yes_energy"),
    ("sensor_no_sensor", "sensor", "no_sensor"),
    ("sensor_yes_sensor", "sensor", "yes_sensor"),
    ("equipRef_Air_Equip", "equipRef", "Air_Equip"),
    ("equipRef_Cooling", "equipRef", "Cooling"),
    ("equipRef_Heating", "equipRef", "Heating"),
    ("equipRef_LEED", "equipRef", "LEED"),
    ("navName_Energy", "navName", "Energy"),
]


def checkmark_flag(name: str) -> Column:
    return F.when(F.col(name) == CHECK_MARK, f"yes_{name}").otherwise(f"no_{name}")


def checkmark_flags(df: DataFrame, columns: list[str] = FLAG_COLUMNS) -> DataFrame:
    return df.withColumns({c: checkmark_flag(c) for c in columns})


def unit_omit(unit: str = "unit") -> Column:
    return F.when(F.col(unit) == "_", "omit").otherwise(F.col(unit))


def is_gas_clean(is_gas: str = "isGas") -> Column:
    """``?`` and ``0`` are no gas, anything else (null too) is gas."""
    return F.when(F.col(is_gas).isin("?", "0"), "no_gas").otherwise("yes_gas")


def one_hot_fixed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: F.when(F.col(src) == cat, 1).otherwise(0) for name, src, cat in SELECTED_ONE_HOT}
    )


def label_code(label: str = "endUseLabel") -> Column:
    return F.substring(F.col(label), 1, 2).cast("int")


def label_or_unknown(label: str = "endUseLabel") -> Column:
    return F.coalesce(F.col(label), F.lit(UNKNOWN_LABEL))


def train_predict_split(df: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """Labelled rows and rows to predict."""
    return df.filter(F.col(code) != UNKNOWN_CODE), df.filter(F.col(code) == UNKNOWN_CODE)


def checkmark_to_int(df: DataFrame) -> DataFrame:
    """Every text column that holds a check mark anywhere becomes 1/0; one pass finds them."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not texts:
        return df
    marks = df.agg(
        *[F.max(F.when(F.col(f"`{c}`") == CHECK_MARK, 1).otherwise(0)).alias(f"m{i}") for i, c in enumerate(texts)]
    ).first()
    marked = {c for i, c in enumerate(texts) if marks[f"m{i}"] == 1}
    return df.withColumns(
        {c: F.when(F.col(f"`{c}`") == CHECK_MARK, 1).otherwise(0) for c in texts if c in marked}
    )
