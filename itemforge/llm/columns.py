"""Column helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(df: DataFrame, *added: str) -> DataFrame:
    """df without columns that have the name of a result's column: the result's replaces them."""
    low = {a.lower() for a in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ddl(df: DataFrame, added: str = "") -> str:
    """Schema text of df's columns and those added."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return f"{own}, {added}" if added else own
