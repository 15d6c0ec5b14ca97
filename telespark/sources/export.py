"""CSV / JSON-lines sinks.  Rows are written by the executors; nothing passes
through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.sources.schema import column_kind

# Fixed value: cell starts a spreadsheet would run as a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def guard_formula_cells(df: DataFrame) -> DataFrame:
    """Prefix ``'`` to string cells a spreadsheet would evaluate; numbers stay."""
    return df.withColumns({
        f.name: F.when(F.col(f.name).rlike(FORMULA_START), F.concat(F.lit("'"), F.col(f.name))).otherwise(F.col(f.name))
        for f in df.schema.fields if column_kind(f.dataType) == "string"})


def write_rows(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write ``csv`` (header, all strings quoted, formula-safe) or ``jsonl``."""
    if fmt == "jsonl":
        df.write.mode("errorifexists").json(path)
    elif fmt == "csv":
        flat = df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields
                               if column_kind(f.dataType) in ("map", "array", "json")})
        guard_formula_cells(flat).write.mode("errorifexists").csv(path, header=True, escape='"')
    else:
        raise ValueError(f"format must be csv or jsonl, not {fmt!r}")
