"""Where reports and histories go."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..operators.retention import MOST_ENTRIES, newest


@pandas_udf(T.StringType())
def _indented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))


def compact_json(whole: Column) -> Column:
    """K6: a regular report (``whole``) as JSON text, with all its keys; those of nested objects are in the order of their names."""
    return F.to_json(whole)


def pretty_json(whole: Column) -> Column:
    """K6: the same, indented by two. No built-in function indents what a variant holds, so batches of texts go through Python."""
    return _indented(compact_json(whole))


def sections(report: Column) -> Column:
    """K9: the names of a report's sections that aren't empty, in order; of what is no schematic only the sheet and the notes."""
    names = ["powerRails", "grounds", "indicators", "testPoints", "signals", "connectors", "components", "blocks", "theoryOfOperation", "safetyNotes", "unreadable", "notes"]
    full = F.array(*[F.when(F.size(F.coalesce(report[n], F.array().cast("array<string>") if n in names[-4:] else report[n])) > 0, F.lit(n)) for n in names])
    short = F.array(F.when(F.size(report["notes"]) > 0, F.lit("notes")))
    return F.array_compact(F.when(report["isSchematic"], full).otherwise(short))


def append_history(old: DataFrame, new: DataFrame, path: str, n: int = MOST_ENTRIES) -> None:
    """K1: the newest n of both as Parquet at ``path``, which is not where ``old`` is read from: a cut-short write then leaves the old table whole."""
    newest(new.unionByName(old, allowMissingColumns=True), "at", ["id"], n).write.mode("overwrite").parquet(path)
