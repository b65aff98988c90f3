"""Rules that rows and requests must keep: ordered ranges, bounds, shapes of codes, widths of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENCY, COUNTRY = "[A-Z]{3}", "[A-Z]{2}"


def ordered(low: Column, high: Column) -> Column:
    """Broken where both ends are there and the low one is above the high one."""
    return F.coalesce(low > high, F.lit(False))


def within(c: Column, low, high) -> Column:
    """Broken where a value is outside its bounds; null is no value."""
    return F.coalesce((c < low) | (c > high), F.lit(False))


def shaped(c: Column, pattern: str) -> Column:
    """Broken where a code is not of its shape from end to end."""
    return F.coalesce(~c.rlike(f"^(?:{pattern})$"), F.lit(False))


def faults(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in their order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def parted(df: DataFrame, rules: dict[str, Column], out: str = "faults") -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with the names of those they break."""
    judged = df.withColumn(out, faults(rules))
    return judged.filter(F.size(out) == 0).drop(out), judged.filter(F.size(out) > 0)


def checked_range(low: float | None, high: float | None, name: str) -> None:
    """A request for an inverted range finds nothing, silently; it is refused."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name}_min must not exceed {name}_max")


def declare_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """df with the width that a vector column is declared with, in the column's metadata."""
    return df.withMetadata(column, df.schema[column].metadata | {"width": width})


def declared_width(df: DataFrame, column: str) -> int | None:
    """The declared width; None for a column that is not there yet. A column that declares none is no vector column."""
    if column not in df.columns:
        return None
    width = df.schema[column].metadata.get("width")
    if width is None:
        raise ValueError(f"{column} is {df.schema[column].dataType.simpleString()} and declares no width")
    return int(width)


def verify_width(df: DataFrame, column: str, wanted: int) -> None:
    """Refuse a table whose declared width is not the one that the model makes."""
    width = declared_width(df, column)
    if width is not None and width != wanted:
        raise ValueError(f"{column} is declared with {width} components, the model makes {wanted}")


def misfits(df: DataFrame, column: str) -> Column:
    """Where a vector is there and not as wide as declared."""
    return F.coalesce(F.size(column) != declared_width(df, column), F.lit(False)) & F.col(column).isNotNull()
