"""Counter-based draws: the same key gives the same number on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4503599627370496.0


def draw(seed: int, *key: Column | str | int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5('seed|key|…')."""
    parts = [F.lit(str(seed))]
    for k in key:
        parts.append((F.lit(str(k)) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k).cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(SPAN)


def draw_sql(seed: int, *key: str) -> str:
    """The same draw in DuckDB's SQL; keys are SQL expressions."""
    text = ", ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in key)])
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT / {SPAN})"


def slot(seed: int, count: Column, *key: Column | str | int) -> Column:
    """A uniform whole number from 0 to count - 1."""
    return F.floor(draw(seed, *key) * count).cast("int")


def slot_sql(seed: int, count: str, *key: str) -> str:
    return f"CAST(floor({draw_sql(seed, *key)} * {count}) AS INT)"
