"""Near-duplicate documents: fast similarity sketches, banding, and verification on full shingle sets.

1. One pass over the texts gives each row's set size, set digest and band keys. Equal sets are one
   set from there on, so any number of copies costs one sketch's worth of work. Sets, not ids, are linked.
2. Sets that share a band key form a bucket. Buckets with the same members are verified once.
3. A bucket's members are dealt into blocks of bounded size. In a small bucket all pairs are compared on
   full sets, but for those that links found so far connect. In a larger one, all blocks are compared with
   one block of pivots first, which takes rows in proportion to the bucket, and components are formed.
4. Large buckets that are not one component then are searched by their sets' rarest shingles: two sets of similarity t
   have at least a share t of either in common, so among the first (1 - t) of each, in any one order of all shingles, there
   is a common one. Rarest first, that splits boilerplate into small groups; only sets of different
   components in such a group are compared. Every pair that shares a band key is thus either
   verified or already connected: no bucket is capped. What leaves a task is a spanning forest of its links.
5. Links are joined to components by star contraction.

A pair with similarity s shares a band key with probability 1 - (1 - s**rows)**bands: 1 - 3e-6 at 0.8 with
32 bands of 5 rows, and more above.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketch import band_keys, sketches
from .storage import materialize, temporary, text_mark, without, without_rows
from .words import shingle_sets

#: Bounds of a block: documents, and bytes of their texts.
BLOCK_ROWS, BLOCK_BYTES = 256, 2_000_000
#: Blocks of a bucket's members outside its largest component up to which all of them are compared: about as many copies of a text as its first shingles would take.
DIRECT_BLOCKS = 24
#: The shingles by whose counts a rarest-first order is made: those in a thousandth of the sets, and of these the most frequent. Others come first, by hash. The order changes the work, never the links.
FREQUENT_SHARE, MOST_FREQUENT = 1000, 500_000
_LINKS = "a binary, b binary"
_SIGN = 1 << 63


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_mark, n_shingles, set_hash (128 bits), node, n_bytes of the text, keys; the hash, node and keys are null without shingles.

    ``node`` names the row such that nodes are ordered as (doc_id, text_mark), nulls last.
    """

    def name(doc_id: int | None, mark: int, digest: bytes) -> bytes:
        return struct.pack(">BQQ8s", doc_id is None, (doc_id or 0) + _SIGN, mark + _SIGN, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = shingle_sets(some.column(2), words)
                keys = band_keys(sketches(sets, bands * rows), bands, rows)
                some_keys = [k if len(s) else None for k, s in zip(keys, sets, strict=True)]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                nodes = [name(i, m, h) if h else None for i, m, h in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), hashes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:2], sizes, pa.array(hashes, pa.binary()), pa.array(nodes, pa.binary()), some.column(3), pa.array(some_keys, pa.list_(pa.int64()))],
                    ["doc_id", "text_mark", "n_shingles", "set_hash", "node", "n_bytes", "keys"],
                )

    lean = docs.select("doc_id", text_mark().alias("text_mark"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return lean.mapInArrow(run, "doc_id long, text_mark long, n_shingles long, set_hash binary, node binary, n_bytes long, keys array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(sets: list[np.ndarray], left: list[bool], within: bool, percent: int, known: list | None = None) -> list[tuple[int, int]]:
    """Links that span the components of some sets: i and j are linked if 100 * intersection >= percent * union.

    Compares the sets of the left side with all others, or all with all if ``within``; pairs that are
    connected already, by links found here or by equal ``known`` labels, are skipped.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    forest, out = _Forest(n), []
    if known is not None:
        first: dict[object, int] = {}
        for i, label in enumerate(known):
            forest.join(i, first.setdefault(label, i))
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    present = np.zeros(len(vocabulary), dtype=bool)
    waiting = [i for i in range(n) if within or left[i]]
    while waiting:
        if within:  # members of the largest component need not be pivots: the others meet them as pivots
            roots = [forest.find(i) for i in range(n)]
            largest = Counter(roots).most_common(1)[0][0] if n > 2 and out else -1
            pivot = next((i for i in waiting if roots[i] != largest), None)
            if pivot is None:
                break
        else:
            pivot = waiting[0]
        waiting.remove(pivot)
        mine = ids[begins[pivot] : begins[pivot] + sizes[pivot]]
        present[mine] = True
        both = np.add.reduceat(present[ids], begins, dtype=np.int64)
        present[mine] = False
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[pivot] - both)).tolist():
            if j != pivot and (within or not left[j]) and forest.join(pivot, j):
                out.append((pivot, j))
    return out


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])


def _verify(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members: node, text, bucket, pair, left, within, label (null: unknown). Links (a, b) found by comparing the members of each (bucket, pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray, bool, bool, bytes | None]] = []
        group = None

        def close() -> list[tuple[bytes, bytes]]:
            if len(held) < 2:
                return []
            nodes, sets, left, within, labels = zip(*held, strict=True)
            links = linked(list(sets), list(left), within[0], percent, list(labels) if labels[0] is not None else None)
            return [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in links]

        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            sets = shingle_sets(batch.column(1), words)
            others = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)]
            for own, node, bucket, pair, left, within, label in zip(sets, *others, strict=True):
                if (bucket, pair) != group:
                    found += close()
                    held, group = [], (bucket, pair)
                if len(own):
                    held.append((node, own, left, within, label))
            if found:
                yield _pairs(found)
        if last := close():
            yield _pairs(last)

    grouped = members.select("node", "text", "bucket", "pair", "left", "within", "label")
    return grouped.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(run, _LINKS)


def _blocks(rows: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")


def _buckets(one: DataFrame, aside: list[Column] | None = None) -> DataFrame:
    """bucket, n and blocks of the buckets of (bucket, node, n_bytes) with more members than one; of those with the same members only one."""
    mark = F.xxhash64("node")
    told = one.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"), F.bit_xor(mark).alias("mark"), F.min(mark).alias("low"), F.max(mark).alias("high"), *(aside or []))
    told = told.where("n > 1" if not aside else "n > 1 AND mixed")
    told = told.groupBy("n", "mark", "low", "high").agg(F.min("bucket").alias("bucket"), F.max("size").alias("size"))
    return told.select("bucket", "n", _blocks("n", "size").alias("blocks"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """Every row of ``docs`` (columns doc_id and text are used, others ignored) with its near-duplicate component.

    Returns doc_id, text_mark (a hash of the text), n_shingles (distinct shingles of ``words`` words), component_id (the least doc_id
    reachable over links of ``percent`` or more, itself included), kept (doc_id = component_id), and first: whether the
    row has the least (doc_id, text_mark) of its component, nulls last. A text with fewer words is one shingle of them all. A null
    text or one without words links with nothing. Each row is a document of its own: rows that repeat a doc_id
    with different texts are in the components of their texts, and aren't linked through the id. Rows that repeat
    doc_id and text get the same result each. A component without any doc_id has a null component_id, and its rows are kept.
    """
    with temporary(docs.sparkSession) as keep:  # texts, members and links aren't read once components are known
        sig = keep(materialize(signatures(docs, words, bands, rows), "signatures"))
        sets = sig.where("n_shingles > 0").groupBy("set_hash").agg(F.min(F.struct("node", "doc_id", "text_mark", "n_bytes", "keys")).alias("r")).select("set_hash", "r.*")
        sets = materialize(sets, "sets")
        one = sets.select("node", "n_bytes", F.explode("keys").alias("bucket"))
        buckets = materialize(_buckets(one), "buckets")
        members = materialize(one.join(buckets, "bucket").select("bucket", "node", "n_bytes", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "members")
        # The texts that will be compared, written once. Always by shuffle: their number grows with the corpus.
        wanted = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_id"), "text_mark")
        texts = docs.select("doc_id", text_mark().alias("_mark"), "text").hint("merge").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("text_mark")))
        texts = texts.select("node", "text")
        if not sig.groupBy("doc_id", "text_mark").count().where("count > 1").isEmpty():  # rows that repeat both would be compared again and again
            texts = texts.dropDuplicates(["node"])
        texts = materialize(texts, "texts")

        # The block of pivots meets every block; a small bucket is one block.
        pairs = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
        first = members.select("bucket", "node", F.explode(pairs.cast("array<long>")).alias("pair"), (F.col("block") == 0).alias("left"))
        first = first.withColumn("within", F.col("pair") == 0).withColumn("label", F.lit(None).cast("binary"))
        links = materialize(_verify(first.hint("merge").join(texts, "node"), words, percent), "links")
        roots = materialize(components(links), "roots")

        large = members.where("blocks > 1")
        if not large.isEmpty():
            links = links.unionByName(_beyond_pivots(large, roots, texts, words, percent))
            roots = materialize(components(links), "roots")

        told = sets.select("set_hash", "node").join(roots, "node", "left").select("set_hash", F.coalesce("root", "node").alias("root"))
        told = keep(materialize(told, "components"))
    own = sig.select("doc_id", "text_mark", "n_shingles", "set_hash", "node").join(told, "set_hash", "left")
    number = F.conv(F.hex(F.substring("root", 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(_SIGN)).cast("decimal(20,0)")
    least = F.when(F.hex(F.substring("root", 1, 1)) == "00", number.cast("long"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(least)
    first = F.col("root").isNull() | (F.col("node") == F.col("root"))
    return own.select("doc_id", "text_mark", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate component, with all columns of ``docs``: the one with the least doc_id, then the least hash of its text, nulls last.

    Of rows that repeat both, the one with the least other columns stays. Rows without words stay, but for such repetitions of a doc_id and text.
    """
    with temporary(docs.sparkSession) as keep:
        found = keep(materialize(near_duplicates(docs, words, percent).select("doc_id", "text_mark", "first"), "found"))
    left = without(docs, found.withColumn("copy", ~F.col("first")), "copy", "copies")
    again = found.where("first").groupBy("doc_id", "text_mark").count().where("count > 1").drop("count")
    if again.isEmpty():
        return left
    key = [F.col("doc_id").alias("_a"), F.col("text_mark").alias("_b")]
    again = materialize(again, "repeated")
    many = left.join(again.select(*key), F.col("doc_id").eqNullSafe(F.col("_a")) & text_mark().eqNullSafe(F.col("_b")), "left_semi")
    alone = many.groupBy("doc_id", text_mark().alias("_mark")).agg(F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in docs.columns])).alias("r"))
    return without_rows(left, again).unionByName(alone.select(*[F.col(f"r.{c}.{c}").alias(c) for c in docs.columns]))


def _shingles(sets: DataFrame, words: int, percent: int | None = None, order: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(node, n_bytes, label, element) for the shingles of the sets (node, n_bytes, label, text): all, or with ``percent`` only those that come first in an order from the rarest on, as many as that similarity needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = shingle_sets(some.column(3), words)
                if percent is not None:
                    known, counts = order
                    for i, own in enumerate(found):
                        n = len(own)
                        keep = n + (-percent * n // 100) + 1 if n else 0
                        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                        often = np.where(known[place] == own, counts[place], 0) if len(known) else np.zeros(n, dtype=np.int64)
                        found[i] = own[np.lexsort((own, often))[:keep]]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in some.columns[:3]), pa.array(np.concatenate(found).view(np.int64))], ["node", "n_bytes", "label", "element"])

    return sets.select("node", "n_bytes", "label", "text").mapInArrow(run, "node binary, n_bytes long, label binary, element long")


def _beyond_pivots(large: DataFrame, roots: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links in buckets of several blocks between members that aren't connected yet.

    Where those outside a bucket's largest component take at most DIRECT_BLOCKS blocks, they are compared with the whole bucket, which takes that many times its rows.
    In larger ones they are found by the shingles that come first in an order from the rarest on.
    """
    labelled = materialize(large.join(roots, "node", "left").select("bucket", "node", "n_bytes", F.coalesce("root", "node").alias("label")), "labelled")
    plan = _plan(labelled)
    links = _between_components(labelled, plan.where(F.col("rests") <= DIRECT_BLOCKS), texts, words, percent)
    many = plan.where(F.col("rests") > DIRECT_BLOCKS)
    if many.isEmpty():
        return links
    split = materialize(labelled.join(many.select("bucket"), "bucket", "left_semi"), "split")
    nodes = materialize(split.select("node", "n_bytes", "label").distinct(), "nodes")
    sets = materialize(nodes.hint("merge").join(texts, "node"), "sets")
    often = _shingles(sets, words).groupBy("element").count().where(F.col("count") >= max(2, nodes.count() // FREQUENT_SHARE)).orderBy(F.desc("count"), "element").limit(MOST_FREQUENT).toArrow()
    known = often.column("element").to_numpy().view(np.uint64)
    by_hash = np.argsort(known)
    firsts = _shingles(sets, words, percent, (known[by_hash], often.column("count").to_numpy()[by_hash])).select("node", "element")
    # Only members of one bucket are to be compared: a group is those of a bucket that have a first shingle in common.
    firsts = split.join(firsts, "node").select("node", "n_bytes", "label", F.xxhash64("bucket", "element").alias("bucket"))
    firsts = materialize(firsts, "firsts")
    groups = _buckets(firsts, [(F.min(F.xxhash64("label")) != F.max(F.xxhash64("label"))).alias("mixed")])
    firsts = materialize(firsts.join(materialize(groups.select("bucket"), "groups"), "bucket", "left_semi"), "mixed")
    return links.unionByName(_between_components(firsts, _plan(firsts), sets, words, percent))


def _plan(labelled: DataFrame) -> DataFrame:
    """bucket, main (the label of its largest component), and the blocks that this and the rest take, for the buckets of (bucket, node, n_bytes, label) that are more than one component."""
    parts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"))
    main = materialize(parts, "parts").groupBy("bucket").agg(F.max(F.struct("n", "label", "size")).alias("m"), F.sum("n").alias("all"), F.sum("size").alias("all_size"))
    main = main.select("bucket", F.col("m.label").alias("main"), F.col("m.n").alias("main_n"), F.col("m.size").alias("main_size"), (F.col("all") - F.col("m.n")).alias("rest_n"), (F.col("all_size") - F.col("m.size")).alias("rest_size"))
    main = main.where("rest_n > 0").withColumn("rests", _blocks("rest_n", "rest_size")).withColumn("mains", _blocks("main_n", "main_size"))
    return materialize(main.select("bucket", "main", "rests", "mains"), "plan")


def _between_components(labelled: DataFrame, plan: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links in the planned buckets between members of different labels: all but the largest component against everything, in blocks."""
    dealt = labelled.join(plan, "bucket").withColumn("in_main", F.col("label") == F.col("main"))
    mark = F.xxhash64("node", F.lit(2))
    block = F.when(F.col("in_main"), F.pmod(mark, "mains")).otherwise(F.pmod(mark, "rests")).cast("long")
    dealt = dealt.withColumn("block", block)
    # Pairs: (rest i, rest j) with i <= j, and (rest i, main j); named "i.j" by rest i, j counted on from the rests.
    span = (F.col("rests") + F.col("mains")).cast("long")
    with_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: F.least(i.cast("long"), "block") * span + F.greatest(i.cast("long"), "block"))
    with_mains = F.transform(F.sequence(F.col("rests").cast("long"), span - 1), lambda j: F.col("block") * span + j)
    from_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: i * span + F.col("rests") + F.col("block"))
    pairs = F.when(F.col("in_main"), from_main).otherwise(F.concat(with_rests, with_mains))
    rows = dealt.select("bucket", "node", "label", "rests", "block", "in_main", span.alias("span"), F.explode(pairs).alias("pair"))
    i, j = F.floor(F.col("pair") / F.col("span")), F.pmod("pair", "span")
    rows = rows.select("bucket", "node", "label", "pair", (~F.col("in_main") & (F.col("block") == i)).alias("left"), (i == j).alias("within"))
    return materialize(_verify(rows.hint("merge").join(texts.select("node", "text"), "node"), words, percent), "links")
