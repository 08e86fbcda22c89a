"""Sizes and decisions about images and document pages; no pixels are touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest edge of a prepared image or page, that of a page's preview, and the most bytes that pass unchanged.
LONG_EDGE, PREVIEW_EDGE, LOSSLESS_BYTES = 3072, 260, 6 * 1024 * 1024
PAGES_AT_ONCE = 24
MOST_BODY_BYTES = 12 * 1024 * 1024

_half_up = lambda c: F.floor(c + 0.5).cast("long")


def image_size(width: Column, height: Column, edge: int = LONG_EDGE) -> Column:
    """M1: struct(scale, width, height) of an image shrunk to the edge; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    return F.struct(scale.alias("scale"), _half_up(width * scale).alias("width"), _half_up(height * scale).alias("height"))


def page_size(width: Column, height: Column, edge: int = LONG_EDGE) -> Column:
    """M2: struct(scale, width, height) of a page drawn to the edge, enlarged if need be; at least one pixel. Unknown sizes stay null."""
    scale = F.lit(float(edge)) / F.greatest(width, height)
    drawn = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(1).cast("long"), _half_up(c * scale)))
    return F.struct(scale.alias("scale"), drawn(width).alias("width"), drawn(height).alias("height"))


def passes_unchanged(scale: Column, n_bytes: Column, mime: Column) -> Column:
    """whether an image needs no encoding anew."""
    return (scale == 1) & (n_bytes <= LOSSLESS_BYTES) & mime.isin("image/png", "image/webp")


def is_pdf(path: Column, mime: Column | None = None) -> Column:
    """A page document by MIME type or by its name's ending."""
    named = F.lower(path).endswith(".pdf")
    return named if mime is None else F.coalesce(mime == "application/pdf", F.lit(False)) | named


def page_jump(entered: Column, pages: Column) -> Column:
    """the entered page if it is a whole number from 1 to ``pages``, else null."""
    number = entered.try_cast("double")
    return F.when((number == F.floor(number)) & number.between(1, pages), number.cast("long"))


def page_batch(number: Column, size: int = PAGES_AT_ONCE) -> Column:
    """which batch, from 0, shows the page."""
    return F.floor((number - 1) / size).cast("long")


def body_fits(body: Column, most: int = MOST_BODY_BYTES) -> Column:
    """whether a request body is small enough."""
    return F.octet_length(body) <= most
