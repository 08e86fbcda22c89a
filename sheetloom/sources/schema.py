"""Shapes of an analysis report, and the record lists in it."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(*names: str, **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names] + [T.StructField(n, k) for n, k in others.items()])


TEXTS = T.ArrayType(_S)
SHEET = _struct("title", "equipment", "circuitType", "sheetRef", "language")
LISTS = {
    "blocks": _struct("id", "label", "kind", "detail", parts=TEXTS, rails=TEXTS),
    "connections": _struct("from", "to", "label", "kind", "evidence", "confidence"),
    "powerRails": _struct("name", "voltage", "kind", "source", "derivedFrom", "testPoint", "notes", "evidence", "confidence", feeds=TEXTS),
    "grounds": _struct("name", "kind", "detail", "tiedTo", "confidence"),
    "indicators": _struct("ref", "label", "color", "drivenBy", "rail", "evidence", "confidence", states=T.ArrayType(_struct("state", "means"))),
    "testPoints": _struct("ref", "label", "where", "measure", "expected", "meaning", "confidence"),
    "signals": _struct("name", "kind", "from", "to", "levels", "detail", "evidence", "confidence"),
    "connectors": _struct("ref", "label", "kind", "mates", "confidence", pins=T.ArrayType(_struct("pin", "name", "detail"))),
    "components": _struct("ref", "part", "value", "role", "block", "evidence", "confidence"),
}
TEXT_LISTS = ["theoryOfOperation", "safetyNotes", "unreadable", "notes"]

REPORT = T.StructType(
    [T.StructField("summary", _S), T.StructField("isSchematic", T.BooleanType()), T.StructField("confidence", _S), T.StructField("sheet", SHEET)]
    + [T.StructField(n, T.ArrayType(k)) for n, k in LISTS.items()]
    + [T.StructField(n, TEXTS) for n in TEXT_LISTS]
)

CHAT = T.ArrayType(_struct("role", "text"))
HISTORY = T.StructType(
    [T.StructField("id", _S), T.StructField("at", T.LongType())]
    + [T.StructField(n, _S) for n in ("title", "summary", "provider", "model", "hint", "origin", "thumbnail")]
    + [T.StructField("analysis", REPORT), T.StructField("chat", CHAT)]
)
