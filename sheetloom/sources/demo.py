"""A small constant report, for trying things out without a vendor."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = {
    "summary": "A bench supply with one regulated output and a fault lamp.",
    "confidence": "high",
    "sheet": {"title": "Bench supply", "circuitType": "Linear supply"},
    "blocks": [
        {"id": "mains", "label": "Mains entry", "kind": "input", "parts": ["J1", "F1"], "detail": "Fuse and switch."},
        {"id": "reg", "label": "Regulator", "kind": "regulator", "parts": ["U1"], "detail": "Holds the output.", "rails": ["+12 V"]},
        {"id": "out", "label": "Output", "kind": "output", "parts": ["J2"], "detail": "Terminals."},
    ],
    "connections": [
        {"from": "mains", "to": "reg", "label": "raw", "kind": "power", "evidence": "seen", "confidence": "high"},
        {"from": "reg", "to": "out", "label": "+12 V", "kind": "power", "evidence": "seen", "confidence": "high"},
        {"from": "out", "to": "reg", "label": "sense", "kind": "feedback", "evidence": "inferred", "confidence": "low"},
        {"from": "reg", "to": "lamp", "label": "fault", "kind": "signal", "evidence": "inferred", "confidence": "low"},
    ],
    "powerRails": [
        {"name": "+12 V", "voltage": "12 V DC", "kind": "derived", "derivedFrom": "raw", "feeds": ["out"], "evidence": "seen", "confidence": "high"},
        {"name": "raw", "voltage": "18 V DC", "kind": "input", "feeds": ["reg"], "evidence": "seen", "confidence": "high"},
    ],
    "notes": ["R3 can't be read."],
}
ANSWER = "The regulator holds the output at twelve volts."


def report_json() -> Column:
    """The report as JSON text, for each row the same."""
    return F.lit(json.dumps(REPORT))


def report_rows(spark: SparkSession) -> DataFrame:
    """The report as a row (report_id, json)."""
    return spark.createDataFrame([(1, json.dumps(REPORT))], "report_id long, json string")


def answer_chunks() -> Iterator[str]:
    """The canned answer word by word, as a stream would bring it."""
    for i, word in enumerate(ANSWER.split(" ")):
        yield word if i == 0 else " " + word
