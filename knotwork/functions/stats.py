"""Statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of hits in n; [0, 1] where n is 0."""
    p = hits / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    below = 1 + Z * Z / n
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (centre - spread) / below))
    return low, F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (centre + spread) / below))


def sql_wilson(hits: str, n: str, sign: str) -> str:
    return f"(({hits}::DOUBLE / {n} + {Z * Z}::DOUBLE / (2 * {n})) {sign} {Z}::DOUBLE * sqrt(({hits}::DOUBLE / {n}) * (1 - {hits}::DOUBLE / {n}) / {n} + {Z * Z}::DOUBLE / (4.0::DOUBLE * {n} * {n}))) / (1 + {Z * Z}::DOUBLE / {n})"
