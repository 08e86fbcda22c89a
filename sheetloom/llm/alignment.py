"""Alignment of two tokenizers' tokens over the same bytes.

Python tokenises: for each text it gives both tokenizers' ids and the byte offsets at which their tokens end. Both encode a word alike wherever
it stands, so a worker encodes it once and texts are put together from their words' tokens. Most tokens
of ordinary text hold the same bytes in both: each such pair is a group and a link of its own, and is told apart at once
(``parted``). The stretches of tokens between them are linked by Spark's higher-order functions, as is the
whole text where ``align`` is given all its tokens. Offsets at which both end (``array_intersect``) cut it into groups. How many of one
tokenizer's ends lie before another offset is its place in the sorted union of both, so the tokens that overlap a token are a range that
``sequence`` spells out: the work is in proportion to a text's tokens and links. Spark interprets these functions, element by element,
which is why pairs of the same bytes don't go through them, and why Python, which has the tokens at hand, spells the query's groups.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters, default_vocabulary
from .lookups import sums
from .storage import materialize
from .words import slices

#: The pairs of ids whose counts go to every task: the most frequent ones, at most as many.
MOST_PAIRS = 1_000_000
TOKENS = "row long, doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
_REST = "alike array<long>, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>"
#: As TOKENS, but for the pairs of tokens that hold the same bytes: ``pairs`` has them in order, with -1 and -1 where a stretch of others stands, and
#: ``alike`` as links. Of the others, ends are doubled, and those at which a stretch ends are greater by one; n_a and n_b count all tokens.
PARTED = f"row long, doc_id long, n_a long, n_b long, pairs array<struct<a: int, b: int>>, {_REST}"
#: As PARTED, with ``last_b``, for each of A's other tokens the place among B's of the one that holds its last byte; and the groups of all tokens as text.
SAID = f"row long, doc_id long, n_a long, n_b long, groups_text string, {_REST}, last_b array<int>"
#: Words that a worker remembers (about 150 bytes each), and the characters of the longest.
REMEMBERED, LONG = 250_000, 64
#: Words that are encoded at once.
AT_ONCE = 1000
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], _Words] = {}


def default_pieces() -> str:
    """Path of the public piece vocabulary with 32,000 ids; the file must be at the same path on every executor."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Vocabulary:
    """Bytes, sizes and decimal digits of each id's token."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.sizes = np.array([len(t) for t in table], dtype=np.int64)
        self.leads = np.array([t.startswith(b" ") for t in table])
        width = len(str(len(table) - 1))
        self.digits = np.frombuffer("".join(f"{i:0{width}}" for i in range(len(table))).encode(), dtype=np.uint8).reshape(-1, width)
        self.shown = np.arange(width) >= width - np.array([len(str(i)) for i in range(len(table))])[:, None]

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


class _Runs(NamedTuple):
    """Runs of ids, one after the other."""

    ids: np.ndarray
    counts: np.ndarray

    def take(self, at: np.ndarray) -> _Runs:
        own = self.counts[at]
        first = (np.cumsum(self.counts) - self.counts)[at] - (np.cumsum(own) - own)
        return _Runs(self.ids[np.arange(own.sum()) + np.repeat(first, own)], own)


def _joined(runs: Iterable[_Runs]) -> _Runs:
    return _Runs(*(np.concatenate(c) for c in zip(*runs, strict=True)))


class _Words(dict):
    """The tokens of both vocabularies of texts, put together from those of their words, which are encoded once: place by word.

    A is a byte-level vocabulary, for which the names of special tokens in a text are plain text. B has pieces in which U+2581 stands for a
    space, and bytes for what no piece holds. A word begins at a space between two characters that aren't white space, or at the text's start,
    before which a space is put. A's pattern begins a piece there; B has no piece that goes on over a space behind something else (if
    it has, texts are single words). So each vocabulary's tokens of a word are the same wherever it stands.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a_path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = _Vocabulary(table)
        self.model = SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b = _Vocabulary([bytes([int(x[1], 16)]) if (x := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in pieces])
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        none = np.zeros(0, dtype=np.int32)
        self.runs = [_Runs(none, np.zeros(0, dtype=np.int64))] * 2
        self.good = np.zeros(0, dtype=bool)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place

    def _cut(self, text: str) -> list[str]:
        if not text or not self.cuts:
            return [text] if text else []
        return _SEAM.split(text) if _ODD_SPACE.search(text) or text[0].isspace() else text.split(" ")

    def _encode(self, words: list[str]) -> tuple[_Runs, _Runs, np.ndarray]:
        """Both tokenizers' tokens of words, encoded as one text, and whether their bytes are the words'."""
        text = " ".join(words)
        a = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype=np.int32)
        b = np.array(self.model.encode(text, num_threads=1), dtype=np.int32)
        good = self.a.spell(a) == (" " + text).encode() == self.b.spell(b)
        if len(words) == 1:
            return _Runs(a, np.array([len(a)])), _Runs(b, np.array([len(b)])), np.array([good])
        starts = [np.flatnonzero(v.leads[ids]) for v, ids in ((self.a, a), (self.b, b))]
        if not good or any(len(s) != len(words) for s in starts):
            return self._each(words, 1)
        return *(_Runs(ids, np.diff(s, append=len(ids))) for ids, s in zip((a, b), starts, strict=True)), np.full(len(words), True)

    def _each(self, words: list[str], n: int) -> tuple[_Runs, _Runs, np.ndarray]:
        a, b, good = zip(*[self._encode(words[i : i + n]) for i in range(0, len(words), n)], strict=True)
        return _joined(a), _joined(b), np.concatenate(good)

    def _learn(self) -> None:
        """Tokens of the new words. Those that hold white space at their start, or a space, are encoded one by one: a space wouldn't be a seam beside them."""
        odd = [" " in w or "▁" in w or w[0].isspace() for w in self.new]
        parts = [self._each(x, n) for x, n in (([w for w, o in zip(self.new, odd, strict=True) if not o], AT_ONCE), ([w for w, o in zip(self.new, odd, strict=True) if o], 1)) if x]
        order = np.argsort(np.argsort(odd, kind="stable"))
        self.runs = [_joined([known, _joined(p[i] for p in parts).take(order)]) for i, known in enumerate(self.runs)]
        self.good = np.concatenate([self.good, np.concatenate([p[2] for p in parts])[order]])

    def _forget(self) -> None:
        """The new words but for short ones, as many as there is room for."""
        before = len(self) - len(self.new)
        kept = [k for k, w in enumerate(self.new) if len(w) <= LONG][: max(0, REMEMBERED - before)]
        if len(kept) < len(self.new):
            for w in self.new:
                del self[w]
            self.update((self.new[k], before + i) for i, k in enumerate(kept))
            at = np.concatenate((np.arange(before), np.array(kept, dtype=np.int64) + before))
            self.runs, self.good = [r.take(at) for r in self.runs], self.good[at]
        self.new = []

    def encode(self, texts: list[str]) -> tuple[_Runs, _Runs]:
        """Each whole text's tokens, space before it included. Those of A and B of a text whose bytes they aren't are left out."""
        cut = [self._cut(t) for t in texts]
        words = np.array([len(c) for c in cut])
        at = np.array(list(map(self.__getitem__, chain.from_iterable(cut))), dtype=np.int64)
        if self.new:
            self._learn()
        ends = np.cumsum(words)
        found = []
        for known in self.runs:
            own = known.take(at)
            found.append(_Runs(own.ids, np.diff(np.append(0, np.cumsum(own.counts))[ends], prepend=0)))
        doubted = np.unique(np.searchsorted(ends, np.flatnonzero(~self.good[at]), side="right"))
        if len(doubted):
            kept = np.full(len(texts), True)
            to = [np.cumsum(r.counts) for r in found]
            for t in doubted.tolist():
                a, b = (v.spell(r.ids[e[t] - r.counts[t] : e[t]]) for v, r, e in zip((self.a, self.b), found, to, strict=True))
                kept[t] = a == (" " + texts[t]).encode() == b
            found = [_Runs(r.ids[np.repeat(kept, r.counts)], r.counts * kept) for r in found]
        self._forget()
        return found[0], found[1]


def _words(a_path: str, b_path: str) -> _Words:
    if (a_path, b_path) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[a_path, b_path] = _Words(a_path, b_path)
    return _LOADED[a_path, b_path]


def _lists(counts: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _ends(v: _Vocabulary, runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which tokens end, counted through all texts, and for each token the one at which its text begins."""
    ends = np.cumsum(v.sizes[runs.ids])
    return ends, np.repeat(np.append(0, ends)[np.cumsum(runs.counts) - runs.counts], runs.counts)


def _tokenised(docs: DataFrame, a_path: str | None, b_path: str | None, shape: str, columns: Callable[[_Words, _Runs, _Runs], list[pa.Array]]) -> DataFrame:
    """A row of ``shape`` for each row of ``docs``: its number in this reading, doc_id, and ``columns`` of the tokens of a slice's texts."""
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()
    names = [x.split()[0] for x in re.sub("<[^>]*>", "", shape.replace("array<struct<a: int, b: int>>", "pairs")).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(a_path, b_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, to in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                rows = pa.array(np.arange(row, row + to - at), pa.int64())
                row += to - at
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(at, to - at), *columns(words, *words.encode(texts))], names)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """TOKENS for each row of ``docs`` (doc_id and text are used, others ignored); ``row`` is a number of the row in this reading.

    A encodes a space and the text, B the text, before which it puts a space itself. Whole texts are encoded. Null and empty texts have
    no tokens, nor have those whose tokens' bytes, joined, aren't the space and the text: the offsets wouldn't meet.
    """

    def columns(words: _Words, *runs: _Runs) -> list[pa.Array]:
        found = []
        for v, r in zip((words.a, words.b), runs, strict=True):
            ends, begin = _ends(v, r)
            found += [_lists(r.counts, r.ids), _lists(r.counts, (ends - begin).astype(np.int32))]
        return found

    return _tokenised(docs, a_path, b_path, TOKENS, columns)


def _said(words: _Words, a: _Runs, b: _Runs, a_cuts: np.ndarray, b_cuts: np.ndarray) -> pa.StringArray:
    """groups_text of each text; cuts: whether a group ends with the token."""
    a_group, b_group = np.cumsum(a_cuts) - a_cuts, np.cumsum(b_cuts) - b_cuts
    at = np.arange(len(a.ids)) + np.searchsorted(b_group, a_group), np.arange(len(b.ids)) + np.searchsorted(a_group, b_group, side="right")
    width = max(v.digits.shape[1] for v in (words.a, words.b)) + 1
    data = np.zeros((len(a.ids) + len(b.ids), width), dtype=np.uint8)
    shown = np.zeros(data.shape, dtype=bool)
    for v, r, cuts, to, mark in ((words.a, a, a_cuts, at[0], "|"), (words.b, b, b_cuts, at[1], ";")):
        data[to, -1 - v.digits.shape[1] : -1], shown[to, -1 - v.digits.shape[1] : -1] = v.digits[r.ids], v.shown[r.ids]
        data[to, -1], shown[to, -1] = np.where(cuts, ord(mark), ord(",")), True
    counts = a.counts + b.counts
    shown[(np.cumsum(counts) - 1)[counts > 0], -1] = False
    ends = np.append(0, np.cumsum(shown.sum(axis=1)))[np.append(0, np.cumsum(counts))].astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(data[shown]))


def _within(mask: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of ``mask`` hold in each of the runs of ``counts``."""
    return np.diff(np.append(0, np.cumsum(mask))[np.cumsum(counts)], prepend=0)


def _part(docs: DataFrame, a_path: str | None, b_path: str | None, shape: str) -> DataFrame:
    """PARTED or SAID for each row of ``docs``."""

    def columns(words: _Words, a: _Runs, b: _Runs) -> list[pa.Array]:
        (a_ends, a_begin), (b_ends, b_begin) = _ends(words.a, a), _ends(words.b, b)
        at = np.searchsorted(b_ends, a_ends)  # the token of B that holds the last byte of A's
        alike = (b_ends[at] == a_ends) & (words.b.sizes[b.ids[at]] == words.a.sizes[a.ids])
        there = np.zeros(len(b.ids), dtype=bool)
        there[at[alike]] = True
        if shape == SAID:
            both = b_ends[at] == a_ends
            b_both = np.zeros(len(b.ids), dtype=bool)
            b_both[at[both]] = True
            told = _said(words, a, b, both, b_both)
        else:
            shown = alike | np.append(True, alike)[: len(alike)]  # the first of a stretch stands for all of it
            shown[(np.cumsum(a.counts) - a.counts)[a.counts > 0]] = True
            pairs = np.where(alike, a.ids, -1)[shown], np.where(alike, b.ids[at], -1)[shown]
            counts = _within(shown, a.counts)
            told = _lists(counts, pa.StructArray.from_arrays([pa.array(p) for p in pairs], ["a", "b"]))
        rest = [_lists(_within(alike, a.counts), (a.ids[alike].astype(np.int64) << 32) + b.ids[at[alike]])]
        for r, ends, begin, gone in ((a, a_ends, a_begin, alike), (b, b_ends, b_begin, there)):
            closes = np.append(gone[1:], True)[: len(gone)]
            closes[(np.cumsum(r.counts) - 1)[r.counts > 0]] = True
            left = _within(~gone, r.counts)
            rest += [_lists(left, r.ids[~gone]), _lists(left, ((ends - begin) * 2 + closes)[~gone])]
        if shape == SAID:
            before = np.append(0, np.cumsum(~there))  # of B's others
            begin = np.repeat(before[np.cumsum(b.counts) - b.counts], a.counts)
            rest.append(_lists(_within(~alike, a.counts), (before[at] - begin)[~alike].astype(np.int32)))
        return [pa.array(a.counts, pa.int64()), pa.array(b.counts, pa.int64()), told, *rest]

    return _tokenised(docs, a_path, b_path, shape, columns)


def parted(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """PARTED for each row of ``docs``, of the tokens that :func:`tokens` gives."""
    return _part(docs, a_path, b_path, PARTED)


def _before(ends: Column, values: Column, ties: bool) -> Column:
    """For each of ascending ``values`` how many of ascending ``ends`` are less, with ``ties`` also those that are equal: its place in the union of both, less those of its own before it."""
    both = F.sort_array(F.concat(F.transform(values, lambda v: v * 2 + int(ties)), F.transform(ends, lambda e: e * 2 + int(not ties))))
    places = F.filter(F.transform(both, lambda code, k: F.when(F.pmod(code, F.lit(2)) == int(ties), k)), lambda k: k.isNotNull())
    return F.transform(places, lambda k, i: k - i)


def _also(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once a row: later expressions read them, instead of holding them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def align(tokens: DataFrame) -> DataFrame:
    """TOKENS with ``groups`` (array of structs a, b: the ids of each group, in order), ``groups_text`` (the same as ``a1,a2|b1;a3|b2,b3``) ``links`` (array of longs: A's id times 2**32 plus B's for each pair of overlapping tokens, in order), and n_groups."""
    told = _linked(tokens.withColumn("last_b", _before(F.col("b_ends"), F.col("a_ends"), False)))
    # Groups end at common ends: where the token of B that holds the last byte of one of A ends with it.
    told = _also(told, a_last=F.filter(F.transform("a_ids", lambda x, i: i), _same))
    told = _also(told, a_cut=F.concat(F.array(F.lit(0)), F.transform("a_last", lambda i: i + 1)), b_cut=F.concat(F.array(F.lit(0)), F.transform("a_last", lambda i: F.get("last_b", i) + 1)))
    own = lambda ids, cut, g: F.slice(ids, F.get(cut, g) + 1, F.get(cut, g + 1) - F.get(cut, g))
    told = told.withColumn("groups", F.transform("common", lambda c, g: F.struct(own("a_ids", "a_cut", g).alias("a"), own("b_ids", "b_cut", g).alias("b"))))
    said = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    text = F.array_join(F.transform("groups", lambda g: F.concat(said(g["a"]), F.lit("|"), said(g["b"]))), ";")
    return told.select(*tokens.columns, "groups", text.alias("groups_text"), "links", "n_groups")


def _same(i: Column) -> Column:
    """Whether A's i-th token ends where the one of B does that holds its last byte."""
    return F.get("b_ends", F.get("last_b", i)) == F.get("a_ends", i)


def _linked(tokens: DataFrame) -> DataFrame:
    """Columns a_ids, a_ends, b_ids, b_ends and last_b, and more, with ``common`` ends, ``links`` and n_groups as in :func:`align`."""
    told = _also(tokens, common=F.array_intersect("a_ends", "b_ends"))
    # A's i-th token overlaps the one of B that holds its last byte, and those before it from the one that holds its first byte: the one
    # that holds the byte before that, or the next if that ends there.
    first = lambda i: F.when(i == 0, 0).otherwise(F.get("last_b", i - 1) + F.when(_same(i - 1), 1).otherwise(0))
    code = lambda a, b: F.shiftleft(a.cast("long"), 32) + b
    at_end = F.transform("a_ids", lambda a, i: code(a, F.get("b_ids", F.get("last_b", i))))
    several = F.filter(F.transform("a_ids", lambda x, i: i), lambda i: F.get("last_b", i) > first(i))
    others = F.transform(several, lambda i: F.transform(F.sequence(first(i), F.get("last_b", i) - 1), lambda j: code(F.get("a_ids", i), F.get("b_ids", j))))
    return told.select("*", F.concat(at_end, F.flatten(others)).alias("links"), F.size("common").alias("n_groups"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best): how many links of the whole table hold each pair of ids linked, and whether no other pair with the same id of B has more."""
    counts = materialize(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n")), "pairs")
    b = lambda: F.col("link").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(b().alias("b")).agg(F.max("n").alias("highest"))
    return counts.join(highest, b() == F.col("b")).select("link", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with the sizes of its alignment: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is their B id's most frequent in the whole table, ties included; count_sum adds up the pairs' counts
    over the links; groups_sha256 is of groups_text, '' without tokens. A text without tokens (see :func:`tokens`) has zeros; null and
    repeated doc_ids each keep their row, and repeated rows count each; no rows give none.
    """
    aligned = _linked(_part(docs, a_path, b_path, SAID))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups_text", 256)).otherwise("")
    links = F.concat("alike", "links")
    told = aligned.select("row", "doc_id", "n_a", "n_b", (F.size("alike") + F.col("n_groups")).cast("long").alias("n_groups"), F.size(links).cast("long").alias("n_links"), sha.alias("groups_sha256"), links.alias("links"))
    told = materialize(told, "aligned")
    values = materialize(pair_counts(told), "values")
    links = told.select("row", F.explode("links").alias("link"))
    found = sums(links, values.select("link", "n", F.col("n").alias("count_sum"), F.col("best").alias("n_best")), "row", "link", ["count_sum", "n_best"], "n", MOST_PAIRS)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.drop("links").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
