"""Media columns: byte payloads stored as TIFF images, and a row per page of stored images."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tiff

STORED = "doc_id long, n_bytes long, media binary"
PAGES = "doc_id long, n_bytes long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, media_bytes long, media_sha256 string, error string"
UNIT = 64


def payload(text: str | bytes | None) -> bytes:
    """UTF-8 bytes and then bytes 0 up to a positive multiple of 64. Null: as empty, 64 bytes 0."""
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def store_as_tiff(docs: DataFrame, compression: int = tiff.DEFLATE, predictor: int = 1, level: int = 6) -> DataFrame:
    """Each row's whole text (columns doc_id and text are used, others ignored) as a one-page TIFF of 8-bit grey samples, 64 wide.

    Returns doc_id, n_bytes (of the text's UTF-8) and media. A null or empty text has one row of zeros;
    null and repeated doc_ids each keep their row; no rows give none. Equal texts give equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                raw = [t.as_py() or b"" for t in texts.slice(at, 256)]
                media = [tiff.write_grey([(payload(r), UNIT)], compression, predictor, level=level) for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def tiff_pages(stored: DataFrame) -> DataFrame:
    """A row per page of each ``media`` value, with its decoded samples and its directory's main fields.

    A value that is null or can't be decoded gives one row with ``error`` set (and page null) after the
    pages before the fault, so no row is lost and no task fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAGES.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PAGES.split(", ")])
        for batch in batches:
            rows, held = [], 0
            for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = media.as_py() or b""
                whole = [len(data), hashlib.sha256(data).hexdigest()]
                try:
                    for p in tiff.pages(data):
                        rows.append([doc_id, n_bytes, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, *whole, None])
                        held += len(p.data)
                except tiff.TiffError as e:
                    rows.append([doc_id, n_bytes, *[None] * 9, *whole, str(e)])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PAGES)


def page_features(paged: DataFrame) -> DataFrame:
    """Digests and a feature string of each page's samples: size, mean and deviation of the samples, their entropy, and the share of steps between neighbours above 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sha, tail, feature, size = [], [], [], []
            for data, width, height in zip(columns["data"], columns["width"].to_pylist(), columns["height"].to_pylist(), strict=True):
                raw = data.as_py()
                if raw is None:
                    sha.append(None), tail.append(None), feature.append(None), size.append(None)
                    continue
                values = np.frombuffer(raw, np.uint8)
                counts = np.bincount(values, minlength=256)
                share = counts[counts > 0] / len(values)
                mean = float(counts @ np.arange(256)) / len(values)
                deviation = float(counts @ (np.arange(256) - mean) ** 2 / len(values)) ** 0.5
                steps = np.abs(np.diff(values.astype(np.int16)))
                rough = float((steps > 32).mean()) if len(steps) else 0.0
                sha.append(hashlib.sha256(raw).hexdigest())
                tail.append(zlib.crc32(raw[-UNIT:]))
                size.append(len(raw))
                feature.append(f"{width}x{height} mean={mean:.4f} sd={deviation:.4f} entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f} rough={rough:.4f}")
            yield pa.RecordBatch.from_arrays(
                [columns["doc_id"], columns["n_bytes"], columns["page"], pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), columns["media_bytes"], columns["media_sha256"], pa.array(feature, pa.string()), columns["error"]],
                ["doc_id", "n_bytes", "page", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"],
            )

    needed = paged.select("doc_id", "n_bytes", "page", "width", "height", "data", "media_bytes", "media_sha256", "error")
    return needed.mapInArrow(run, "doc_id long, n_bytes long, page int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
