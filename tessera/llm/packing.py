"""Lexical retrieval packing over BM25 indexes of like documents.

Each document's ids are cut into full windows, which need no company, and a tail. Documents are
ordered by their nearest of centroids of sketches (random projections of weighted token counts),
and cut into shards of about SHARD, so that like documents share one. A shard is an inverted BM25
index over its documents' whole texts, with document frequencies and the mean length of all
documents. From each seed its best unused neighbours fill the window, whole where they fit; the
one that doesn't is cut at the window's end, and what is left of it is the next seed. So every
sequence but a shard's last is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import cut, table
from tessera.llm.embeddings import _kmeans, _nearest

SHARD = 2048  #: documents in a shard, about
K1, B = 1.2, 0.75
DENSE = 1024  #: terms of a shard whose weights are kept as dense rows
SKETCH = 64  #: dimensions of a document's sketch
SAMPLE = 8192  #: sketches that centroids are fitted on, about
GROUPS = 2048  #: centroids, at most


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class BM25:
    """An inverted index over token arrays: posting lists, and dense rows for the terms of most texts."""

    def __init__(self, texts: list[np.ndarray], known: tuple[int, float, np.ndarray] | None = None):
        """`known`: number, mean length and document frequencies by token of all texts that these are part of."""
        self.n = n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        stream = np.concatenate(texts).astype(np.int64) if texts else np.empty(0, np.int64)
        owner = np.repeat(np.arange(n), sizes)
        keys, tf = np.unique(stream * max(1, n) + owner, return_counts=True)
        terms, docs = np.divmod(keys, max(1, n))
        named, df = np.unique(terms, return_counts=True)
        total, mean, everywhere = known or (n, sizes.mean() if n else 1.0, None)
        frequency = df if everywhere is None else everywhere[named]
        idf = np.log1p((total - frequency + 0.5) / (frequency + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, mean))
        weights = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[docs])).astype(np.float32)
        # the DENSE most frequent terms: all texts against all as one matrix product, of a shard's bounded size
        common = np.zeros(len(df), bool)
        common[np.argsort(-df, kind="stable")[:DENSE]] = True
        number = np.cumsum(common) - 1
        dense = np.repeat(common, df)
        rows, cols = np.repeat(number, df)[dense], docs[dense]
        table, asked = np.zeros((int(common.sum()), n), np.float32), np.zeros((n, int(common.sum())), np.float32)
        table[rows, cols] = weights[dense]
        asked[cols, rows] = 1
        self.common = asked @ table
        # the others stay posting lists
        self.docs, self.weights = docs[~dense].astype(np.int32), weights[~dense]
        rare = df[~common]
        self.starts = np.append(0, np.cumsum(rare))
        by = np.argsort(self.docs, kind="stable")
        lists = np.repeat(np.arange(len(rare)), rare)[by]
        self.own = np.split(lists, np.cumsum(np.bincount(self.docs, minlength=n))[:-1]) if n else []

    def scores(self, text: int) -> np.ndarray:
        """BM25 of every text for the terms of one."""
        own = self.own[text]
        starts, sizes = self.starts[own], self.starts[own + 1] - self.starts[own]
        total = int(sizes.sum())
        if not total:
            return self.common[text]
        # all postings of the query's rare terms, as one index
        at = np.arange(total) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        return self.common[text] + np.bincount(self.docs[at], self.weights[at], self.n)


def packed(tails: list[np.ndarray], window: int, index: BM25 | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (text, from, to) that hold each id once; all but the last are `window` long.

    `index` holds the texts that the tails end, or else the tails themselves are indexed.
    """
    index = index or BM25(tails)
    sizes = [len(t) for t in tails]
    unused = np.array([s > 0 for s in sizes], bool)
    out, now, room = [], [], window
    seed, next_unused = -1, 0
    start = 0  # where the text that is being placed begins
    while True:
        if seed < 0:
            while next_unused < len(tails) and not unused[next_unused]:
                next_unused += 1
            if next_unused == len(tails):
                break
            seed, start = next_unused, 0
            unused[seed] = False
        now.append((seed, start, sizes[seed]))
        room -= sizes[seed] - start
        scores = None
        rest = (-1, 0)
        while room > 0 and unused.any():
            if scores is None:
                scores = index.scores(seed)
                order = iter(_best(scores, unused))
            near = next(order, None)
            if near is None:
                break
            if not unused[near]:
                continue
            unused[near] = False
            take = min(room, sizes[near])
            now.append((near, 0, take))
            room -= take
            if take < sizes[near]:
                rest = (near, take)
        if room == 0 or not unused.any():
            out.append(now)
            now, room = [], window
            seed, start = rest
            if seed < 0 and not unused.any():
                break
        else:
            seed = -1
    if now:
        out.append(now)
    return out


def _best(scores: np.ndarray, unused: np.ndarray) -> Iterator[int]:
    """Unused texts by falling score, ties by number; found a few at a time."""
    left = np.flatnonzero(unused)
    few = 8
    done = 0
    while done < len(left):
        if few < len(left):
            own = scores[left]
            bar = np.partition(own, len(left) - few)[len(left) - few]
            top = left[own >= bar]
        else:
            top = left
        top = top[np.lexsort((top, -scores[top]))]
        yield from top[done:].tolist()
        done = len(top)
        few *= 8


def _frequencies(encoded: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """In how many documents each token stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                own[np.unique(np.frombuffer(ids, dtype))] += 1
        held = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(own[held])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # a row a token of the vocabulary
        out[r["token"]] = r["n"]
    return out


def _sketches(rows: list[bytes], dtype: np.dtype, weights: np.ndarray) -> np.ndarray:
    """A unit vector a text: random signs of its tokens, each with the token's weight and the logarithm of its count."""
    signs = np.random.default_rng(42).choice(np.array([-1, 1], np.float32), (len(weights), SKETCH))
    out = np.zeros((len(rows), SKETCH))
    for i, ids in enumerate(rows):
        own, tf = np.unique(np.frombuffer(ids, dtype), return_counts=True)
        v = (weights[own] * (1 + np.log(tf))) @ signs[own]
        out[i] = v / max(1e-9, np.sqrt(v @ v))
    return out


def _chained(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which each is followed by the nearest that is left."""
    left, order = np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        far = ((centres - centres[order[-1]]) ** 2).sum(1)
        order.append(int(np.where(left, far, np.inf).argmin()))
        left[order[-1]] = False
    return centres[order]


def _with_shard(encoded: DataFrame, dtype: np.dtype, known: tuple[int, float, np.ndarray], shard: int) -> DataFrame:
    """The rows with a shard's number: like documents beside each other, about `shard` to each."""
    total, _, frequency = known
    if total <= shard:
        return encoded.withColumn("shard", F.lit(0).cast("long"))
    weights = np.log1p((total - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    share = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / total)))
    sample = sorted(bytes(r["ids"]) for r in encoded.filter(share).select(F.substring("ids", 1, 2048).alias("ids")).collect())  # about SAMPLE rows, the first tokens of long ones
    sample = sample or [b""]
    few = max(1, min(GROUPS, 8 * total // shard, len(sample)))
    centres = _chained(np.unique(_kmeans(_sketches(sample, dtype, weights), few), axis=0))
    fit = encoded.sparkSession.sparkContext.broadcast((weights, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centres = fit.value
        for batch in batches:
            near = _nearest(_sketches(batch.column(3).to_pylist(), dtype, weights), centres)[:, 0] if batch.num_rows else np.empty(0, np.int32)
            yield batch.append_column("near", pa.array(near, pa.int32()))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    grouped = encoded.mapInArrow(run, f"doc_id {kind}, salt long, n long, ids binary, near int")  # twice, as whole texts are much to write again
    sizes = {r["near"]: r["count"] for r in grouped.groupBy("near").count().collect()}  # a row a centroid
    ends = np.cumsum([sizes.get(i, 0) for i in range(len(centres))])
    first = F.array(*[F.lit(int(e - sizes.get(i, 0))) for i, e in enumerate(ends)])
    held = F.array(*[F.lit(int(sizes.get(i, 0))) for i in range(len(centres))])
    at = F.col("near") + 1
    within = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(1 << 20)) / F.lit(1 << 20)
    place = F.element_at(first, at) + F.floor(within * F.element_at(held, at))
    return grouped.withColumn("shard", F.floor(place / F.lit(shard)).cast("long")).drop("near")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    `docs` (doc_id, text): null and empty texts are the end id alone. Every id of every document
    lies in exactly one piece; a sequence is at most `window` long and gapless from offset 0, and
    all are full but the last of each shard. Null ids stay; repeated rows are packed each; an
    empty table gives no rows; other columns are not read.
    """
    short = tokens.proved(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(path, short)
        last = np.array([end_id], codec.dtype)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, texts = [], []
            for text in batch.column(1).to_pylist():
                ids = np.concatenate([codec.encode(text), last])
                sizes.append(len(ids))
                texts.append(ids.tobytes())
            # a number of its own for each row: many rows of one id, or of none, go to many shards
            salts = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(salts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "salt", "n", "ids"])

    dtype = np.dtype("<u4" if max(tokens.vocabulary(path).names) >= 1 << 16 else "<u2")

    def filled(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("salt", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        number = rows["shard"][0].as_py()
        who, sizes = rows["doc_id"].to_pylist(), rows["n"].to_pylist()
        texts = [np.frombuffer(t, dtype) for t in rows["ids"].to_pylist()]
        tails = [t[len(t) - len(t) % window :] for t in texts]
        out: list[tuple] = []
        at = 0
        for i, n, text in zip(who, sizes, texts):
            for w in range(n // window):
                own = text[w * window : (w + 1) * window]
                out.append((i, w * window, window, crc(own), n, (number << 32) + at, 0, own if with_ids else None))
                at += 1
        for sequence in packed(tails, window, BM25(texts, known.value)):
            offset = 0
            for t, s, e in sequence:
                own = tails[t][s:e]
                out.append((who[t], sizes[t] - len(tails[t]) + s, e - s, crc(own), sizes[t], (number << 32) + at, offset, own if with_ids else None))
                offset += e - s
            at += 1
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], rows.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([c.astype(np.int32) for c in columns[7]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.table(arrays, names)

    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    rows = cut(docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, salt long, n long, ids binary"))
    total, mean = rows.agg(F.count("*"), F.avg("n")).first()
    facts = (total, mean or 1.0, _frequencies(rows, dtype, max(end_id, *tokens.vocabulary(path).names) + 1))
    known = docs.sparkSession.sparkContext.broadcast(facts)
    return _with_shard(rows, dtype, facts, shard).groupBy("shard").applyInArrow(filled, shape)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
