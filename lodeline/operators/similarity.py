"""Similar texts and vectors."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.session import cut

#: Queries compared at once with a partition; bounds what a task and the driver hold.
QUERY_BLOCK = 4_096
#: Buckets that shingles are counted in, to tell rare from frequent ones; a power of 2.
BUCKETS = 1 << 16


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine neighbours, score 1 - distance/2; brute force in blocks.

    Queries come a block at a time; each partition hands on its k best for each query, and those meet in one shuffle.
    Vectors that are null, of another length, without length or not finite are not compared.
    """
    ids = queries.select("vec_id").where(F.col("vec_id").isNotNull()).orderBy("vec_id")
    out = None
    last = None
    while True:
        page = ids if last is None else ids.where(F.col("vec_id") > last)
        rows = queries.join(page.limit(block), "vec_id", "left_semi").select("vec_id", "embedding").collect()
        if not rows:
            break
        last, full = max(r["vec_id"] for r in rows), len(rows) >= block  # of the page as read, usable or not
        rows = [r for r in rows if r["embedding"] and np.all(np.isfinite(r["embedding"])) and np.any(r["embedding"])]
        if rows:
            part = _nearest_block(vectors, rows, k)
            out = part if out is None else out.unionByName(part)
        if not full:
            break
    if out is None:
        return vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest_block(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    width = len(rows[0]["embedding"])
    rows = [r for r in rows if len(r["embedding"]) == width]
    names = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    q = np.array([r["embedding"] for r in rows], dtype=np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: list[list] = [[] for _ in names]
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(lambda e: e is not None and len(e) == width)]
            if pdf.empty:
                continue
            m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            m, vid = m[good] / norm[good, None], pdf["vec_id"].to_numpy()[good]
            for i, sims in enumerate(q @ m.T):
                # all that may belong to the k best, ties included; their sums do not depend on the place in the batch, so copies score the same
                near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k] - 1e-9) if len(sims) > k else np.arange(len(sims))
                exact = (m[near] * q[i]).sum(axis=1)
                for j in np.lexsort((vid[near], -exact))[:k]:
                    item = (float(exact[j]), -int(vid[near[j]]))
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], item)
                    elif item > heaps[i][0]:
                        heapq.heapreplace(heaps[i], item)
        data = [(int(names[i]), -v, (1 + s) / 2) for i, h in enumerate(heaps) for s, v in h]
        yield pd.DataFrame(data, columns=["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, score double")


def shingles(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, s): hashes of the distinct runs of n words; a text with fewer words has one of all its words.

    Words become hashes first, and those meet their followers by shifted slices of one array, so a long text costs time
    in proportion to its length. Texts without words are told by their characters, so that no text is split twice.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = docs.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    runs = F.col("w") if n == 1 else F.arrays_zip(*[F.slice("w", k + 1, F.greatest(F.lit(1), F.size("w") - n + 1)).alias(f"w{k}") for k in range(n)])
    return split.select("doc_id", F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r))).alias("s"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A signature of each document's set; at the end how often shingles of each bucket came."""
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        sets = batch.column("s")
        values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
        seen += np.bincount(values[ends[0] : ends[-1]] & (BUCKETS - 1), minlength=BUCKETS)
        names = [hashlib.blake2b(np.sort(values[a:b]).tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.binary()), pa.nulls(len(names), pa.int64())], ["doc_id", "sig", "n"])
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.binary()), pa.array(seen[at])], ["doc_id", "sig", "n"])


def _prefixes(counts: np.ndarray, threshold: float):
    """The rarest shingles of each set, as many as it must share one of with a similar set."""

    def cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("s")
            values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
            of, size, g = [], [], []
            for doc, a, b in zip(batch.column("doc_id").to_numpy(), ends, ends[1:]):
                s, k = values[a:b], b - a - math.ceil((b - a) * threshold - 1e-9) + 1
                rank = np.lexsort((s, counts[s & (BUCKETS - 1)]))[:k]
                g.append(s[rank])
                of.append(np.full(len(rank), doc))
                size.append(np.full(len(rank), b - a))
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in ((of, pa.int64()), (size, pa.int32()), (g, pa.int64()))], ["class_id", "size", "g"])

    return cut_off


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(doc_id, class_id, links): one row a document; the class holds texts with equal shingles, ``links`` counts other
    classes at least ``threshold`` similar (Jaccard over shingles of n words).

    Exact: equal shingle sets collapse first, so copies never meet in pairs; each class is then found under the rarest
    shingles of its set, as many as two similar sets must share one of (prefix filter). What two sets share outside both
    prefixes lies behind the prefix that ends first, so pairs with too few common shingles in front go, and the others
    are verified in full. Any one order of all shingles serves; here it is how often their bucket of ``BUCKETS`` came,
    so no row a shingle is shuffled to count them. Sets are made again from the texts where they are needed; only
    prefixes and the sets of pairs are shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    noted = cut(shingles(docs, n).mapInArrow(_signed, "doc_id long, sig binary, n long"))
    keyed = noted.where(F.col("sig").isNotNull()).select("doc_id", "sig")
    came = noted.where(F.col("n").isNotNull()).groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[came["doc_id"].to_numpy()] = came["n"].to_numpy()
    classes = cut(keyed.groupBy("sig").agg(F.min("doc_id").alias("class_id")))
    firsts = docs.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    prefix = shingles(firsts, n).mapInArrow(_prefixes(counts, threshold), "class_id long, size int, g long")
    a, b = prefix.alias("a"), prefix.alias("b")
    close = (F.col("a.class_id") < F.col("b.class_id")) & (F.col("a.size") >= F.col("b.size") * threshold) & (F.col("b.size") >= F.col("a.size") * threshold)
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & close).groupBy(F.col("a.class_id").alias("x"), F.col("b.class_id").alias("y"), F.col("a.size").alias("nx"), F.col("b.size").alias("ny"))
    behind = F.ceil(F.greatest("nx", "ny") * threshold - 1e-9) - 1  # the longer rest
    most = F.col("front") + behind
    pairs = cut(met.agg(F.count(F.lit(1)).alias("front")).where(most >= threshold * (F.col("nx") + F.col("ny") - most) - 1e-6).select("x", "y"))
    ends = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct()
    full = shingles(docs.join(ends, "doc_id", "left_semi"), n)
    both = pairs.join(full.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x").join(full.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    links = cut(both.where(common >= threshold * (F.size("sx") + F.size("sy") - common)).select("x", "y"))
    linked = links.select(F.col("x").alias("class_id")).unionByName(links.select(F.col("y").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    named = keyed.join(classes, "sig")
    return named.join(linked, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
