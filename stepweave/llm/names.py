"""Stages that carry all columns of a table, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...; ``toDF`` names them back."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def number_of(docs: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives to a column; case counts only where it must."""
    found = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return f"c{found[0]}"
