"""Containers of fixed capacity filled with documents, neighbours together.

Method: space-filling-curve order. Each document becomes a hashed bag of words, projected to ``DIMENSIONS`` numbers;
their Hilbert key orders all documents so that similar ones are neighbours; the rows are range-sorted by the key and
packed along the curve. Within a window of neighbours the longest go first, each into the fullest open container that
holds it; the number of open containers is bounded, so a task's memory does not grow with its input.

Defined cases: null and empty texts take no part; a document longer than a container's room is cut into full
containers and a rest that is packed like any other item; no other document is cut; equal keys are ordered by
``doc_id``; repeated texts under other ids are items of their own; a container without any room raises ValueError;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm import tokens as T
from lodeline.llm.parsing import spread
from lodeline.session import cut

DIMENSIONS, BITS = 3, 10
#: Neighbours that are placed together, longest first, and containers kept open from one window to the next.
WINDOW, OPEN = 256, 256
_WORDS = re.compile(r"\w+")


def hilbert_key(point: list[int], bits: int = BITS) -> int:
    """Position of a point with coordinates below 2**bits on the Hilbert curve (Skilling's transposition)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


class Projector(dict):
    """Hashed words projected to a few dimensions. Both steps are linear, so each word's share is computed once: the
    mapping gives a word's row in a table of shares, and a document is the sum of its words' rows."""

    def __init__(self, dimensions: int = DIMENSIONS):
        super().__init__()
        self.dimensions = dimensions
        self.shares = np.empty((1024, dimensions))

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.shares):
            self.shares = np.concatenate([self.shares, np.empty_like(self.shares)])
        seed = zlib.crc32(word.encode("utf-8", "replace")) & 0xFFFF  # the hashed dimension: one of 65,536
        self.shares[row] = np.random.default_rng(seed).standard_normal(self.dimensions)
        self[word] = row
        return row

    def key(self, text: str) -> int:
        if len(self) > 200_000:
            self.clear()
        words = _WORDS.findall(text.lower())
        if not words:
            return 0
        rows = [self[w] for w in words]
        v = self.shares[rows].sum(axis=0) / len(words) ** 0.5
        unit = 0.5 * (1 + np.tanh(v / 2))
        return hilbert_key([int(u) for u in np.minimum(unit * (1 << BITS), (1 << BITS) - 1)])


def _measure(folder: str, vocabulary: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projector = Projector()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = pa.array([T.count(t, folder, vocabulary) for t in texts], type=pa.int64())
            keys = pa.array([projector.key(t) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, keys], names=["doc_id", "tokens", "curve"])

    return measure


def measured(documents: DataFrame, folder: str = T.TOKENIZERS, vocabulary: str = T.VOCABULARY) -> DataFrame:
    """(doc_id, tokens, curve): length and place on the curve of each document with a text."""
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    return spread(rows, "doc_id").mapInArrow(_measure(folder, vocabulary), "doc_id long, tokens long, curve long").where(F.col("tokens") > 0)


class Packer:
    """Best fit, longest first, over windows of neighbours, with a bounded number of open containers."""

    def __init__(self, room: int, first: int, window: int = WINDOW, keep: int = OPEN):
        self.room, self.next, self.window, self.keep = room, first, window, keep
        self.waiting: list[tuple[int, int, int]] = []  # (tokens, doc_id, piece_no)
        self.open: list[tuple[int, int]] = []  # (room left, container), ascending
        self.out: list[tuple[int, int, int, int]] = []  # (container, doc_id, piece_no, tokens)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int, tokens: int) -> None:
        piece = 0
        while tokens > self.room:
            self.out.append((self._new(), doc_id, piece, self.room))
            tokens -= self.room
            piece += 1
        if tokens:
            self.waiting.append((tokens, doc_id, piece))
        if len(self.waiting) >= self.window:
            self.place()

    def place(self) -> None:
        for tokens, doc_id, piece in sorted(self.waiting, key=lambda x: (-x[0], x[1])):
            i = bisect_left(self.open, (tokens, -1))
            left, container = self.open.pop(i) if i < len(self.open) else (self.room, self._new())
            self.out.append((container, doc_id, piece, tokens))
            if left > tokens:
                insort(self.open, (left - tokens, container))
        self.waiting = []
        if len(self.open) > self.keep:  # the fullest are closed
            del self.open[: len(self.open) - self.keep]


def _pack(rooms: dict[str, int], window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        packer, name = None, None

        def flush(last: bool):
            if packer is None:
                return None
            if last:
                packer.place()
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            arrays = [pa.array([name] * len(rows), type=pa.string()), *(pa.array(c, type=pa.int64()) for c in columns)]
            return pa.RecordBatch.from_arrays(arrays, names=["container_name", "container_no", "doc_id", "piece_no", "tokens"])

        for batch in batches:
            for n, doc_id, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n != name:
                    done = flush(True)
                    if done is not None:
                        yield done
                    packer, name = Packer(rooms[n], first, window), n
                packer.add(doc_id, size)
            if packer is not None:
                yield flush(False)
        done = flush(True)
        if done is not None:
            yield done

    return pack


def pack_documents(sizes: DataFrame, containers: DataFrame, window: int = WINDOW) -> DataFrame:
    """(container_name, container_no, doc_id, piece_no, tokens): every document in containers of every kind.

    ``sizes`` is (doc_id, tokens, curve); ``containers`` is the register of kinds, one short row for each.
    """
    rooms = {r["container_name"]: r["capacity_tokens"] - (r["reserved_tokens"] or 0) for r in containers.collect()}
    if any(room <= 0 for room in rooms.values()):
        raise ValueError("a container without room")
    kinds = F.explode(F.array(*[F.lit(n) for n in sorted(rooms)])) if rooms else F.explode(F.array().cast("array<string>"))
    sizes = cut(sizes.select("doc_id", "tokens", "curve"))  # range bounds take a pass of their own; texts are measured once
    items = sizes.select(kinds.alias("container_name"), "doc_id", "tokens", "curve")
    # the folded key gives each kind and curve range its place, so that no kind waits for another
    ranged = items.repartitionByRange("container_name", "curve", "doc_id").sortWithinPartitions("container_name", "curve", "doc_id")
    schema = "container_name string, container_no long, doc_id long, piece_no long, tokens long"
    return ranged.select("container_name", "doc_id", "tokens").mapInArrow(_pack(rooms, window), schema)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, containers, documents, tokens, fill): share of the room that is used, one row a kind."""
    each = packed.groupBy("container_name", "container_no").agg(F.sum("tokens").alias("used"), F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).alias("begun"))
    kinds = containers.select("container_name", (F.col("capacity_tokens") - F.coalesce("reserved_tokens", F.lit(0))).alias("room"))
    sums = each.groupBy("container_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("begun").alias("documents"), F.sum("used").alias("tokens"))
    return sums.join(F.broadcast(kinds), "container_name").select("container_name", "containers", "documents", "tokens", (F.col("tokens") / (F.col("containers") * F.col("room"))).alias("fill"))


def locality_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(container_name, shared, apart, random): how near the documents of a container lie on the curve, one row a kind.

    ``apart`` is the mean distance of a document's key from the mean of its container, over containers that two or more
    documents share; ``random`` is the same distance from the mean of all, which containers filled without regard to the
    curve come near. Both in parts of the whole curve.
    """
    whole = float(1 << (DIMENSIONS * BITS))
    keyed = packed.join(sizes.select("doc_id", (F.col("curve") / whole).alias("at")), "doc_id")
    means = keyed.groupBy("container_name", "container_no").agg(F.avg("at").alias("mid"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    every = keyed.groupBy("container_name").agg(F.avg("at").alias("all"))  # one row a kind
    near = keyed.join(means, ["container_name", "container_no"]).join(F.broadcast(every), "container_name").groupBy("container_name")
    return near.agg(F.count_distinct("container_no").alias("shared"), F.avg(F.abs(F.col("at") - F.col("mid"))).alias("apart"), F.avg(F.abs(F.col("at") - F.col("all"))).alias("random"))
