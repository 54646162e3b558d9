"""Join and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that the trim of a reference removes: ASCII controls, NBSP, zero-width space, BOM.
BLANKS = " \t\n\r\f\v\u00a0\u200b\ufeff"


def trimmed(c: Column | str) -> Column:
    """`c` without white space at its ends; null where nothing is left."""
    return F.nullif(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)), F.lit(""))


def fingerprint(*cols: Column | str) -> tuple[Column, Column]:
    """Two 64-bit hashes with unrelated seeds, so 128 bits: stands for a wide key in a shuffle. Nulls are told from no value by position."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(F.lit(7_919), *cs), F.xxhash64(F.lit(-104_729), *reversed(cs), F.lit(31))


def staged(first: dict[str, Column], *stages) -> Column:
    """A struct made in stages: each stage is a function from a getter of the columns so far to a dict of new ones.

    Every column is worked out once a row however often later ones read it, which the optimizer does not promise for
    chained projections: a filter above them is pushed down with all of their expressions copied into it.
    """
    names, out = list(first), F.struct(*(v.alias(k) for k, v in first.items()))
    for stage in stages:
        made: list[str] = []

        def step(row: Column) -> Column:
            new = stage(lambda k: row[k])  # noqa: B023 - called at once
            made.extend(new)  # noqa: B023
            return F.struct(*(row[k].alias(k) for k in names), *(v.alias(k) for k, v in new.items()))

        out = F.get(F.transform(F.array(out), step), F.lit(0))
        names = names + made
    return out
