"""Vendors as plug-ins: what a vendor's stored responses and streams mean, looked up by id."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.sse import decode_chunks
from .reports import answer_text, model_names, parse_reports


class Provider(Protocol):
    """What a vendor offers; all of it over stored data, none over the network."""

    id: str
    label: str
    needs_key: bool
    default_model: str

    def analyze(self, responses: DataFrame, body: str = "body") -> DataFrame: ...

    def chat(self, chunks: DataFrame) -> DataFrame: ...

    def models(self, listings: DataFrame, body: str = "body") -> DataFrame: ...


@dataclass(frozen=True)
class StoredProvider:
    """A vendor of one of the two known kinds, 'a' or 'b'."""

    id: str
    kind: str
    label: str
    needs_key: bool = True
    default_model: str = ""

    def analyze(self, responses: DataFrame, body: str = "body") -> DataFrame:
        """Rows with parsed, raw and report of their stored responses."""
        return parse_reports(responses.withColumn("_json", answer_text(F.lit(self.kind), F.col(body))), "_json").drop("_json")

    def chat(self, chunks: DataFrame) -> DataFrame:
        """(stream_id, text) of stored streams."""
        return decode_chunks(chunks, vendor=self.kind)

    def models(self, listings: DataFrame, body: str = "body") -> DataFrame:
        return model_names(listings, self.kind, body)


#: The registry; the first is the default.
PROVIDERS: dict[str, Provider] = {p.id: p for p in (StoredProvider("a", "a", "Vendor A"), StoredProvider("b", "b", "Vendor B"))}


def provider(name: str | None) -> Provider:
    """A provider by id, the first for an unknown one."""
    return PROVIDERS.get(name or "", next(iter(PROVIDERS.values())))
