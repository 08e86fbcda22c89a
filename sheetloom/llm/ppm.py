"""Language-model scores by prediction by partial matching over bytes.

A text is read as its words, joined by one space, and an end. The trie of byte contexts up to ``order`` bytes, with the
counts of the symbols that followed each, is a table: a row per context and symbol, counted over all training texts; a shorter context
counts a symbol once for each context a byte longer in which it followed (update exclusion). A symbol's
probability is that of the longest context of the trie that ends where it stands; if the symbol never followed it, the
context's escape probability counts and the next shorter context is asked, without the symbols that the longer one
had (exclusion), down to equal shares of the bytes that are left. Escapes are estimated by method D: a context
with total T and q symbols gives one that came n times (2n - 1) / 2T, and an escape q / 2T.

What has a given context of ``order`` bytes and symbol always costs the same, so costs are computed once for each distinct run of bytes, by
joins. The most frequent runs' costs go to every task, and whole texts are scored with them where they are read; the
other runs, few in a text, are joined by shuffle. Words, for the plain unigram score beside it, are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import least_frequent
from .storage import materialize
from .words import SPACED, slices, word_hashes

#: Symbols before a text's begin and at its end: bytes that no UTF-8 text holds.
BEGIN, END = b"\xfe", b"\xff"
SYMBOLS = 256
#: The most words, and runs of bytes, whose values go to every task (16 bytes each there).
MOST_FREQUENT = 1_000_000
#: Counts that a task holds before it hands them on (16 bytes each).
HELD = 3_000_000
#: A word's key is its hash; the end's is this.
END_WORD = -1
WORD, RUN = 0, 1
_ROWS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<long>, word_times array<long>, runs array<long>, run_times array<long>"


def runs(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of ``order`` bytes and a symbol at each symbol of each text, as a number, and each text's count of them. A null text is empty: only its end counts."""
    spelled = [b" ".join((t or b"").lower().split()) + END for t in texts.cast(pa.binary()).to_pylist()]
    data = BEGIN * 8 + b"".join(BEGIN * order + s for s in spelled)
    sizes = np.array([len(s) for s in spelled], dtype=np.int64)
    begins = 8 + np.concatenate(([0], np.cumsum(sizes + order)[:-1])) + order if len(sizes) else np.zeros(0, dtype=np.int64)
    at = np.arange(sizes.sum()) + np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else begins, sizes)
    eight = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    return (eight[at - 7].astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)).view(np.int64), sizes


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def counted(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): how often each word, each run of bytes, and the end stand in the whole texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def emit(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 100_000):
                some = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, dtype=np.int8)), pa.array(some), pa.array(counts[a : a + 100_000])], ["kind", "key", "n"])

        for batch in batches:
            for at, to in slices(batch.column(0)):
                texts = batch.column(0).slice(at, to - at)
                hashed = np.append(word_hashes(texts, SPACED)[0].view(np.int64), np.full(to - at, END_WORD))
                for kind, keys in ((WORD, hashed), (RUN, runs(texts, order)[0])):
                    held[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in held[kind]) > HELD:
                        held[kind] = [_merged(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from emit(kind, *held[kind].pop())
        for kind in (WORD, RUN):
            if held[kind]:
                yield from emit(kind, *_merged(held[kind]))

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What was learnt: words (key, n), with their number and that of all tokens; runs of ``order`` bytes and a symbol (key, n, cost); and the trie's tables."""

    order: int
    words: DataFrame
    tokens: int
    distinct: int
    runs: DataFrame
    symbols: DataFrame
    nodes: DataFrame


def _low(key: Column, n_bytes: Column | int) -> Column:
    """The last bytes of a run."""
    bits = F.lit(n_bytes) * 8 if isinstance(n_bytes, int) else n_bytes * 8
    return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def fit(docs: DataFrame, order: int = 5) -> Model:
    """Learn from every row's whole text (column text; others are ignored). ``order``: bytes of the longest context, 1 to 6.

    The trie has a row for each distinct context and symbol of all lengths, so it grows with the corpus; no count is cut off.
    """
    if not 1 <= order <= 6:
        raise ValueError("an order is from 1 to 6 bytes")
    counts = materialize(counted(docs, order), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    longest = counts.where(F.col("kind") == RUN).select("key", "n")
    # A shorter context counts a symbol once for each longer one in which it followed: only what reaches it by an escape tells about it.
    level, levels = longest, [longest.select(F.lit(order).alias("k"), "key", "n")]
    for k in range(order - 1, -1, -1):
        level = materialize(level.groupBy(_low(F.col("key"), k + 1).alias("key")).agg(F.count(F.lit(1)).alias("n")), "level")
        levels.append(level.select(F.lit(k).alias("k"), "key", "n"))
    symbols = reduce(DataFrame.unionByName, levels)
    context = F.shiftright("key", 8)
    totals = materialize(symbols.groupBy("k", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "totals")
    # What the next shorter context has besides the symbols of this one; below the empty context, bytes of equal shares.
    shorter = symbols.select((F.col("k") + 1).alias("k"), F.col("key").alias("short"), F.col("n").alias("short_n"))
    shared = symbols.withColumn("short", _low(F.col("key"), F.col("k"))).join(shorter, ["k", "short"]).groupBy("k", context.alias("context")).agg(F.sum("short_n").alias("shared"))
    parents = totals.select((F.col("k") + 1).alias("k"), F.col("context").alias("parent"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    own = totals.withColumn("parent", _low(F.col("context"), F.col("k") - 1)).where("k > 0").join(shared, ["k", "context"]).join(parents, ["k", "parent"])
    nodes = own.select("k", "context", "total", "kinds", (F.col("up_total") - F.col("shared")).alias("up_total"), (F.col("up_kinds") - F.col("kinds")).alias("up_kinds"))
    left = (F.lit(SYMBOLS) - F.col("kinds")).cast("long")
    root = totals.where("k = 0").select("k", "context", "total", "kinds", left.alias("up_total"), left.alias("up_kinds"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    seen = symbols.where(F.col("k") == order).withColumn("context", context).join(totals.where(F.col("k") == order).select("context", "total"), "context")
    return Model(order, words, tokens, distinct, materialize(seen.select("key", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("cost")), "costs"), symbols, nodes)


def unseen_costs(keys: DataFrame, model: Model) -> DataFrame:
    """(key, cost): log10 of the probability of runs (column key, distinct) that training texts don't hold, by escapes to shorter contexts."""
    k = F.col("k")
    levels = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(model.order))).alias("k"))
    levels = levels.withColumn("part", _low(F.col("key"), k + 1)).withColumn("context", F.shiftright("part", 8))
    found = levels.join(model.nodes, ["k", "context"], "left").join(model.symbols.withColumnRenamed("key", "part"), ["k", "part"], "left")
    steps = found.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("k", "total", "kinds", "up_total", "up_kinds", "n")))).alias("steps"))
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(False).alias("done"), none.alias("total"), none.alias("kinds"))

    def step(state: Column, x: Column) -> Column:
        total, kinds = F.coalesce(state["total"], x["total"]), F.coalesce(state["kinds"], x["kinds"])
        hit = x["n"].isNotNull()
        part = F.when(hit, F.log10((2 * x["n"] - 1) / (2 * total))).when(total > 0, F.log10(kinds / (2 * total))).otherwise(0.0)
        gone = state["done"] | x["total"].isNull()
        after = F.struct((state["cost"] + part).alias("cost"), hit.alias("done"), x["up_total"].alias("total"), x["up_kinds"].alias("kinds"))
        return F.when(gone, state).otherwise(after)

    def finish(state: Column) -> Column:
        return F.when(state["done"], state["cost"]).otherwise(state["cost"] - F.log10(F.coalesce(state["kinds"], F.lit(SYMBOLS)).cast("double")))

    return steps.select("key", F.aggregate("steps", start, step, finish).alias("cost"))


def _frequent(values: DataFrame, value: Column, least: int) -> tuple[np.ndarray, np.ndarray]:
    table = values.where(F.col("n") >= least).select("key", value.alias("value")).toArrow()
    keys, found = table.column("key").to_numpy(), table.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], found[order]


def _told(owner: np.ndarray, keys: np.ndarray, known: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray, pa.ListArray]:
    """For each of n texts the sum of the values of its known keys, their number, and the others with how often each stands in it."""
    distinct, which = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
    hit = known[at] == distinct if len(known) else np.zeros(len(distinct), dtype=bool)
    value = np.where(hit, values[at], 0.0) if len(known) else np.zeros(len(distinct))
    total, there = np.bincount(owner, value[which], n), np.bincount(owner, hit[which], n)
    rest = ~hit[which]
    pairs, times = np.unique(owner[rest] * max(len(distinct), 1) + which[rest], return_counts=True)
    ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * max(len(distinct), 1)), pa.int32())
    others = distinct[pairs % max(len(distinct), 1)] if len(pairs) else np.zeros(0, dtype=np.int64)
    return total, there.astype(np.int64), pa.ListArray.from_arrays(ends, pa.array(others, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def scored(docs: DataFrame, model: Model, least_word: int, least_run: int) -> DataFrame:
    """_ROWS: every row's whole text by the values of frequent words and runs, with the other words and runs and how often each stands there. ``base`` takes these words as unknown."""
    smooth = F.log10(F.col("n") + 0.1)
    frequent = _frequent(model.words, smooth, least_word), _frequent(model.runs, F.col("cost"), least_run)
    ends = model.words.where(F.col("key") == END_WORD).first()
    n_ends, order = (ends.n if ends else 0), model.order
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, word_values), (known_runs, costs) = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, to in slices(batch.column(1)):
                texts, n = batch.column(1).slice(at, to - at), to - at
                hashed, before = word_hashes(texts, SPACED)
                n_words = np.diff(before)
                base, n_known, rare_words, word_times = _told(np.repeat(np.arange(n), n_words), hashed.view(np.int64), words, word_values, n)
                base += (n_words - n_known) * np.log10(0.1) + np.log10(n_ends + 0.1)
                keys, sizes = runs(texts, order)
                score, _, rare_runs, run_times = _told(np.repeat(np.arange(n), sizes), keys, known_runs, costs, n)
                numbers = pa.array(np.arange(row, row + n), pa.int64())
                row += n
                columns = [numbers, batch.column(0).slice(at, n), pa.array(n_words + 1, pa.int64()), pa.array(n_known + (n_ends > 0), pa.int64()), pa.array(base), pa.array(score), rare_words, word_times, rare_runs, run_times]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "word_times", "runs", "run_times"])

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (doc_id and text are used, others ignored) with its scores: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text, A-Z lower-cased, and one end; n_known counts those that training texts hold. base_score is the sum over
    tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))), with c the token's count, N all and V the distinct tokens in training. score is
    the trie's log10 probability of the words, joined by one space, and the end. Null and empty texts are an end alone;
    null and repeated doc_ids each keep their row; no rows give none. A model without any text knows no token and gives every byte an equal share.
    """
    least_word, least_run = (least_frequent(t, "n", MOST_FREQUENT) for t in (model.words, model.runs))
    rows = materialize(scored(docs, model, least_word, least_run), "rows")
    rare = lambda keys, times: rows.select("row", F.explode(F.arrays_zip(keys, times)).alias("r")).select("row", F.col(f"r.{keys}").alias("key"), F.col(f"r.{times}").alias("times"))
    zero = lambda kind, name: F.lit(0).cast(kind).alias(name)
    seldom = model.words.where(F.col("n") < least_word).select("key", (F.log10(F.col("n") + 0.1) + 1).alias("more"))
    by_word = rare("words", "word_times").join(seldom, "key").groupBy("row").agg(F.sum("times").alias("n_known"), F.sum(F.col("times") * F.col("more")).alias("base"))
    rare_runs = rare("runs", "run_times")
    needed = materialize(rare_runs.select("key").distinct().join(model.runs.where(F.col("n") < least_run).select("key", "cost"), "key", "left"), "needed")
    unseen = unseen_costs(needed.where("cost IS NULL").select("key"), model)
    costs = materialize(needed.where("cost IS NOT NULL").unionByName(unseen), "rare-costs")
    by_run = rare_runs.join(costs, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("score"))
    more = by_word.select("row", "n_known", "base", zero("double", "score")).unionByName(by_run.select("row", zero("long", "n_known"), zero("double", "base"), "score"))
    more = more.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("n_known", "base", "score")])
    told = rows.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    add = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    share = float(np.log10(model.tokens + 0.1 * (model.distinct + 1)))
    return told.select(
        "doc_id", "n_tokens", add("n_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (add("base") - F.col("n_tokens") * share).alias("base_score"), add("score").alias("score")
    )


def held_out(doc_id: Column, parts: int = 10) -> Column:
    """Whether a document is kept out of training: the crc32 of its doc_id as text (null: empty text) is divisible by ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0
