"""Identifier order: all-digit ids first and by number, the others after them as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_order(name: str) -> list[Column]:
    """Ascending sort keys for a string id column."""
    text = F.col(name)
    return [
        F.when(text.rlike("^[0-9]+$"), 0).otherwise(1),
        F.expr(f"try_cast(`{name}` AS decimal(38,0))"),
        text,
    ]


def natural_key(value: object) -> tuple[int, int, str]:
    """The same order for the few rows a task has to sort in Python."""
    text = str(value)
    return (0, int(text), text) if text.isdecimal() else (1, 0, text)
