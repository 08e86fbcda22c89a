"""Packing into fixed windows by multiway differencing (Karmarkar-Karp).

Documents stream through a task in blocks. In a block, every document gives its full windows first; what
is left of it is cut into near-equal pieces of at most ``piece`` tokens. The pieces are spread over
ceil(tokens / window) windows: each piece starts as a partial partition of its own, and the two partial
partitions whose windows differ most are merged again and again, fullest window onto emptiest. The
windows come out near-equal; if the fullest exceeds the capacity, the block is packed again with one
window more. A block is a bounded number of tokens, so a task's memory doesn't grow with the corpus,
and no row leaves the task that read it: packing shuffles nothing.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequences of one task lie in a range of their own of this many ids.
TASK_IDS = 1 << 36
#: Rows of a batch that a task hands on.
ROWS_AT_ONCE = 8192


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Spread items over ``k`` windows by multiway differencing: indices by window. Ties go by item order, so equal input gives equal output.

    A partial partition lists its windows that hold anything as (sum, first item, last item), fullest first; an item's successor in its
    window is linked. So an item starts as one entry, two partitions that fit side by side are merely put
    together, and memory grows with the items, not with items times windows.
    """
    n = len(sizes)
    if n <= k:
        return [[i] for i in range(n)] + [[] for _ in range(k - n)]
    follow = [-1] * n
    heap = [(-sizes[i], turn, [(sizes[i], i, i)]) for turn, i in enumerate(sorted(range(n), key=lambda i: (-sizes[i], i)))]
    turn = n  # the list is in ascending order, which is a heap
    fullest = lambda w: -w[0]
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        spare = k - len(a)
        both, alone = a, b[:spare]  # fullest onto emptiest: the first windows of b go to empty ones
        for more, first, last in b[spare:]:
            less, head, tail = a.pop()
            follow[tail] = first
            alone.append((less + more, head, last))
        if len(alone) == 1:
            insort(both, alone[0], key=fullest)
        else:
            both = sorted(a + alone, key=fullest)
        heapq.heappush(heap, (-(both[0][0] - (both[-1][0] if len(both) == k else 0)), turn, both))
        turn += 1
    out = []
    for _, i, _ in heap[0][2]:
        window = []
        while i >= 0:
            window.append(i)
            i = follow[i]
        out.append(window)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of at most ``capacity`` in as few near-equal windows as differencing finds: the count rises until none exceeds the capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, k) if k else []
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def cut(n: int, window: int, piece: int) -> tuple[int, list[int]]:
    """Full windows of a document of n tokens, and the sizes of the near-equal pieces of what is left."""
    full, rest = divmod(n, window)
    parts = -(-rest // piece)
    return full, [rest * (j + 1) // parts - rest * j // parts for j in range(parts)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, window: int = 2048, piece: int = 512, block_windows: int = 192, end_id: int = 1, vocabulary: str | None = None, docs_at_once: int = 512) -> DataFrame:
    """Cut and pack every row's whole text (columns doc_id and text are used, others ignored).

    Returns a row per piece: doc_id; start and length of the piece in its document's ids, which end with
    ``end_id``; ids as little-endian unsigned 32-bit integers; doc_tokens; sequence_id; offset in the
    sequence, gapless from 0. No sequence holds more than ``window`` ids, each id is in exactly one piece.
    A null or empty text is packed as its end id; null and repeated doc_ids are packed like others; no
    rows give no rows. Sequence ids are the task's number times 2**36 and then counted up, so the same
    input files give the same result when a task runs again.
    """
    path = vocabulary or default_vocabulary()
    target = block_windows * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        following = (task.partitionId() if task else 0) * TASK_IDS
        code = encoder(path).encode
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following, held, tokens
            rows: list[tuple] = []
            pieces: list[tuple[int, int, int]] = []  # document, start, length
            for d, (doc_id, ids) in enumerate(held):
                n = len(ids) // 4
                full, parts = cut(n, window, piece)
                for j in range(full):
                    rows.append((doc_id, j * window, window, ids[j * window * 4 : (j + 1) * window * 4], n, following, 0))
                    following += 1
                at = full * window
                for size in parts:
                    pieces.append((d, at, size))
                    at += size
            for members in windows([p[2] for p in pieces], window):
                offset = 0
                for i in sorted(members):
                    d, at, size = pieces[i]
                    doc_id, ids = held[d]
                    rows.append((doc_id, at, size, ids[at * 4 : (at + size) * 4], len(ids) // 4, following, offset))
                    offset += size
                following += 1
                if len(rows) >= ROWS_AT_ONCE:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)
            held, tokens = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, docs_at_once):
                some = batch.slice(at, docs_at_once)
                for doc_id, ids in zip(some.column(0).to_pylist(), code(some.column(1).to_pylist(), end_id), strict=True):
                    held.append((doc_id, ids))
                    tokens += len(ids) // 4
                    if tokens >= target:
                        yield from flush()
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
