"""Compression classifier of text quality.

zstandard dictionaries are trained on good and on bad labelled texts, in a few pairs, each on a share of the texts, for a single
dictionary's luck in the choice of its samples weighs more than its size. A text is compressed with each,
block by block, so that the dictionaries count alike in short and long texts. The difference of the two sizes over the
text's size, averaged over the pairs, is the only thing that a score depends on: a logistic curve, fitted to other labelled
texts and weighted to the labels' true shares, maps it to a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, text_mark

BLOCK = 2048
#: Pairs of dictionaries; one pair where a class has fewer texts than LEAST_TEXTS for each.
PAIRS, LEAST_TEXTS = 4, 16
DICTIONARY_BYTES = 256 << 10
LEVEL = 5
#: Length and step of the segments that a dictionary is put together from: given, so that training searches for neither.
SEGMENT, STEP = 200, 8
#: The bounded sample for fitting: labelled rows for each class and each of the two parts (dictionaries, curve). Their texts are used whole.
SAMPLE_ROWS = 3000
#: Bytes of a class's texts that the driver gathers for its dictionary: beyond them fewer rows are taken, never parts of texts.
TEACH_BYTES = 32 << 20
#: Folds are the remainders of crc32(doc_id as text) by 4.
FOLDS, HELD_OUT, CURVE = 4, 2, 3
_FLOOR = 32  # bytes added to a text's size, so that very short ones don't blow up the ratios


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def blocks(data: bytes) -> list[bytes]:
    """The whole text in near-equal blocks of at most BLOCK bytes; an empty text is one empty block."""
    n = max(1, -(-len(data) // BLOCK))
    return [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]


@dataclass
class Model:
    """Dictionaries of good and of bad texts, in pairs, and the curve's slope and height."""

    good: list[bytes]
    bad: list[bytes]
    slope: float
    height: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model = model

        def compress(dictionary: bytes) -> Callable[[bytes], bytes]:
            known = zstandard.ZstdCompressionDict(dictionary)
            known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress

        self.pairs = [(compress(g), compress(b)) for g, b in zip(model.good, model.bad, strict=True)]

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """For each whole text the compressed size with bad dictionaries less that with good ones, over the text's size; the mean of the pairs."""
        out = np.zeros(len(texts))
        if self.pairs:
            for i, text in enumerate(texts):
                parts, more = blocks(text), 0
                for good, bad in self.pairs:
                    more += sum(len(bad(b)) - len(good(b)) for b in parts)
                out[i] = more / len(self.pairs) / (len(text) + _FLOOR)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of being good: higher for a higher difference."""
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.differences(texts) + self.model.height, -30, 30)))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the texts fit into one, their own bytes."""
    import zstandard

    parts = [b for t in texts for b in blocks(t) if b]
    if sum(map(len, parts)) <= DICTIONARY_BYTES:
        return b"".join(parts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL, k=SEGMENT, d=STEP).as_bytes()
    except zstandard.ZstdError:  # samples too alike to train on: their different blocks, spread over all texts if they are many
        parts = list(dict.fromkeys(parts))
        return b"".join(parts[:: -(-sum(map(len, parts)) // DICTIONARY_BYTES)])


def pairs(bad: list[bytes], good: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Dictionaries of the bad and of the good texts, a pair from every PAIRS-th text of either; none without texts of either or of empty ones only."""
    n = PAIRS if min(len(bad), len(good)) >= PAIRS * LEAST_TEXTS else 1
    made = [(dictionary(bad[i::n]), dictionary(good[i::n])) for i in range(n)]
    made = [p for p in made if all(p)]
    return [b for b, _ in made], [g for _, g in made]


def curve(y: np.ndarray, x: np.ndarray, shares: tuple[float, float]) -> tuple[float, float]:
    """Slope and height of the logistic curve of the label y over the difference x; classes weighted to ``shares`` (bad, good). The slope is never negative."""
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
    weight *= len(y) / weight.sum()
    centre, scale = x.mean(), x.std() + 1e-9
    terms = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, ridge = np.zeros(2), np.array([0.1, 1e-6])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(terms @ w, -30, 30)))
        step = np.linalg.solve(terms.T @ (terms * (weight * p * (1 - p))[:, None]) + np.diag(ridge) + 1e-9 * np.eye(2), terms.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    slope = max(w[0] / scale, 0.0)
    return float(slope), float(w[1] - slope * centre)


def _teaching(rows: DataFrame) -> list[bytes]:
    """Whole texts of the documents of least hash, until they have TEACH_BYTES bytes; one document at least."""
    sizes = rows.groupBy("doc_id", F.xxhash64("doc_id").alias("hash")).agg(F.sum(F.octet_length("text")).alias("n")).orderBy("hash", "doc_id").toArrow()
    until = np.cumsum(sizes.column("n").to_numpy())
    taken = sizes.column("doc_id").slice(0, max(1, int(np.searchsorted(until, TEACH_BYTES, side="right"))))
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(pa.table({"doc_id": taken}))), "doc_id", "left_semi")
    return rows.select("doc_id", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).column("text").to_pylist()


def _told(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The label and the difference of each row's whole text, computed where the rows lie; in an order that depends on nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.differences([t.as_py() for t in batch.column(1)]))], ["quality", "difference"])

    told = rows.select(F.col("quality").cast("double").alias("quality"), "text").mapInArrow(run, "quality double, difference double").toArrow()
    told = told.sort_by([("quality", "ascending"), ("difference", "ascending")])
    return told.column("quality").to_numpy(), told.column("difference").to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out fold: those of the curve's fold for the curve, the others for the dictionaries.

    Of each class and part at most SAMPLE_ROWS labelled doc_ids, those of the least hash, are used, with the whole text of one row of
    their documents each (the least hash of the text), which are written once. The driver gathers the dictionaries' texts, in order of the hash until a class has
    TEACH_BYTES bytes (one document at least), and the curve's differences, which executors compute. Class shares are counted
    over all labels. Labels other than 0 and 1, doc_ids with labels that contradict each other, and rows with a null doc_id or text, teach
    nothing; repeated labels count once. If a class has no rows in a part, the score is the share of good labels (0.5 without labels).
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").select("doc_id", "quality", fold(F.col("doc_id")).alias("fold")).where(F.col("fold") != HELD_OUT)
    counted = {(r[0], r[1]): r[2] for r in known.groupBy((F.col("fold") == CURVE).alias("curve"), "quality").count().collect()}
    chosen = None
    for quality in (0, 1):
        for part in (False, True):
            some = known.where((F.col("quality") == quality) & ((F.col("fold") == CURVE) == part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
            chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.select("doc_id", "quality", (F.col("fold") == CURVE).alias("curve"))
    rows = docs.where("text IS NOT NULL").select("doc_id", text_mark().alias("mark"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "quality", "curve").agg(F.min(F.struct("mark", "text")).alias("r")).select("doc_id", "quality", "curve", "r.text")
    sample = materialize(one, "labelled")
    bad, good = pairs(*[_teaching(sample.where(~F.col("curve") & (F.col("quality") == k))) for k in (0, 1)])
    bads, goods = (sum(n for (_, q), n in counted.items() if q == k) for k in (0, 1))
    prior = (goods + 1) / (bads + goods + 2)
    flat = Model([], [], 0.0, float(np.log(prior / (1 - prior))))
    if not good:
        return flat
    y, x = _told(sample.where("curve"), Model(good, bad, 0.0, 0.0))
    if not 0 < y.sum() < len(y):
        return flat
    return Model(good, bad, *curve(y, x, (bads, goods)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Every row's whole text (columns doc_id and text are used, others ignored) with its score.

    Returns doc_id, held_out, score (0 to 1, higher: good likelier) and predicted (1 from ``threshold`` on). A null
    or empty text gets the score of empty bytes; equal texts get equal scores; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = scorer.scores([t.as_py() or b"" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more. Nothing is shuffled; a null text is scored as empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array(scorer.scores([t.as_py() or b"" for t in texts]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
