"""Reports from stored vendor responses and from JSON, made regular."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import also
from ..functions.text import strip_thinking
from ..operators.graph import prune_edges
from .schema import HISTORY, LISTS, REPORT, TEXT_LISTS

_RESPONSE_A = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>>"


def answer_text(vendor: Column, response: Column) -> Column:
    """The report's JSON text in a stored response: vendor 'a' in its first candidate's first part, 'b' in its first choice, without thinking."""
    a = F.get_json_object(response, "$.candidates[0].content.parts[0].text")
    b = strip_thinking(F.get_json_object(response, "$.choices[0].message.content"))
    return F.when(vendor == "b", b).otherwise(a)


_SHEET = '{"title":"Untitled sheet","circuitType":"Unknown"}'
_REPLACED = ["isSchematic", "sheet", *LISTS, *TEXT_LISTS]


def _same(value: Column) -> Column:
    """A text that equal values share, as a set of a script's values tells them apart: null isn't what is missing, and a number isn't its digits."""
    return F.coalesce(F.to_json(value), F.lit("missing"))


def normalised(fields: Column) -> Column:
    """a parsed report, a map of variants by name, made regular; keys that aren't known stay as they are, at every level.

    Lists that are missing or null are empty, and so is the sheet's default; isSchematic is true unless it is false. Connections are kept whose two ends are
    blocks and differ. Summary and confidence aren't defaulted.
    """
    value = lambda name: F.try_element_at(fields, F.lit(name))
    given = lambda name, default: F.when(value(name).isNull() | F.is_variant_null(value(name)), F.parse_json(F.lit(default))).otherwise(value(name))
    items = lambda name: F.coalesce(F.try_variant_get(value(name), "$", "array<variant>"), F.array().cast("array<variant>"))
    part = lambda v, name: _same(F.try_variant_get(v, f"$.{name}", "variant"))
    ids = F.transform(items("blocks"), lambda b: part(b, "id"))
    kept = F.get(F.transform(F.array(ids), lambda own: F.filter(items("connections"), lambda c: F.array_contains(own, part(c, "from")) & F.array_contains(own, part(c, "to")) & (part(c, "from") != part(c, "to")))), 0)
    told = [F.parse_json(F.when(F.to_json(value("isSchematic")) == "false", F.lit("false")).otherwise(F.lit("true"))), given("sheet", _SHEET)]
    told += [F.to_variant_object(kept) if n == "connections" else given(n, "[]") for n in _REPLACED[2:]]
    rest = F.map_filter(fields, lambda name, _: ~name.isin(_REPLACED))
    return F.map_concat(rest, F.map_from_arrays(F.array(*map(F.lit, _REPLACED)), F.array(*told)))


def typed(whole: Column) -> Column:
    """A regular report's known fields as a struct. A list of another kind of value is empty, any other such field null."""
    report = F.try_variant_get(F.to_variant_object(whole), "$", REPORT.simpleString())
    empty = lambda r, n: F.coalesce(r[n], F.array().cast(REPORT[n].dataType)).alias(n)
    fields = lambda r: F.struct(*[r[n].alias(n) for n in ("summary", "isSchematic", "confidence", "sheet")], *[empty(r, n) for n in [*LISTS, *TEXT_LISTS]])
    return F.get(F.transform(F.array(report), fields), 0)


def parse_reports(rows: DataFrame, json: str = "json") -> DataFrame:
    """Rows with ``parsed`` (whether the text is a JSON object), ``whole`` (F1: the regular report as a map of variants, with all its keys) and ``report`` (its known fields as a struct); both are null for other texts. A text is parsed once."""
    told = also(rows, _value=F.try_parse_json(json))
    told = also(told, _fields=F.try_variant_get("_value", "$", "map<string,variant>"))
    told = also(told, whole=F.when(F.col("_fields").isNotNull(), normalised(F.col("_fields"))))
    told = also(told, report=F.when(F.col("whole").isNotNull(), typed(F.col("whole"))))
    return told.withColumn("parsed", F.col("whole").isNotNull()).drop("_value", "_fields")


def exploded(reports: DataFrame, name: str, key: str = "report_id") -> DataFrame:
    """One of a report's record lists as rows (key, pos, the record's fields)."""
    return reports.select(key, F.posexplode(f"report.{name}").alias("pos", "r")).select(key, "pos", "r.*")


def pruned_connections(blocks: DataFrame, connections: DataFrame, key: str = "report_id") -> DataFrame:
    """F2 over exploded tables, for reports that are stored as such."""
    return prune_edges(connections, blocks, within=[key])


def model_names(rows: DataFrame, vendor: str, body: str = "body") -> DataFrame:
    """The models that a stored list names, ordered by code units: of 'a' those that can generate, without 'models/'."""
    if vendor == "b":
        items = F.from_json(body, "struct<data:array<struct<id:string>>>")["data"]
        return rows.select(F.explode(items).alias("m")).select(F.col("m.id").alias("model")).where("model IS NOT NULL").orderBy("model")
    items = F.from_json(body, "struct<models:array<struct<name:string,supportedGenerationMethods:array<string>>>>")["models"]
    some = rows.select(F.explode(items).alias("m")).where(F.array_contains("m.supportedGenerationMethods", "generateContent"))
    return some.select(F.regexp_replace("m.name", "^models/", "").alias("model")).orderBy("model")


def history(rows: DataFrame, json: str = "json") -> DataFrame:
    """Valid entries of stored histories, each a JSON array: those with an id and an analysis. Text that is no array gives none."""
    parsed = F.from_json(json, T.ArrayType(HISTORY))
    entries = rows.select(F.explode(parsed).alias("e")).select("e.*")
    return entries.where("id <> '' AND analysis IS NOT NULL").withColumn("at", F.timestamp_millis("at"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON files with one entry a line, or an array a file."""
    rows = spark.read.schema(HISTORY).option("multiLine", "true").json(path)
    return rows.where("id <> '' AND analysis IS NOT NULL").withColumn("at", F.timestamp_millis("at"))
