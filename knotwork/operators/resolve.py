"""Resolution of call sites by imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_imports(calls: DataFrame, imports: DataFrame, exports: DataFrame, reexports: DataFrame, depth: int = 3) -> DataFrame:
    """`calls` (file, callee) with `target_file` and `target`: through the file's imports (file, local, module, imported), the module's
    re-exports (module, name, from_module, from_name), followed up to `depth` times, to `exports` (module, name).

    A call whose import leads nowhere is left out; a module that exports a name itself wins over what it passes on.
    """
    at = calls.join(imports, (calls.file == imports.file) & (calls.callee == imports.local)).select(calls["*"], F.col("module"), F.col("imported").alias("name"))
    done = None
    x = exports.select(F.col("module").alias("xm"), F.col("name").alias("xn")).distinct()
    r = reexports.select(F.col("module").alias("rm"), F.col("name").alias("rn"), "from_module", "from_name")
    for step in range(depth + 1):
        own = (F.col("module") == F.col("xm")) & (F.col("name") == F.col("xn"))
        here = at.join(x, own, "left_semi").select("file", "callee", F.col("module").alias("target_file"), F.col("name").alias("target"))
        done = here if done is None else done.unionByName(here)
        if step < depth:
            at = at.join(x, own, "left_anti").join(r, (F.col("module") == F.col("rm")) & (F.col("name") == F.col("rn"))).select("file", "callee", F.col("from_module").alias("module"), F.col("from_name").alias("name"))
    return done.distinct()
