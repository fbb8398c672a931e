"""SimHash near-duplicates over pigeonhole blocks.

Fingerprints are 64 majority bits over the hashes of word shingles. Two that differ in at most
`max_bits` bits agree on all but that many of their blocks, so they share a key made of those
blocks; the join on these keys finds every close pair, and the Hamming distance
verifies it. A key that a crowd shares is parted by choices of blocks of the other bits. Equal fingerprints are one row from the start, however many documents have them.
Within a key, rows are dealt into bounded cells, and every two cells of a key meet in one task
that returns no more than a spanning forest of the links there.

`near_copies` goes on from there to near copies by text: within the components of fingerprints
that differ in at most NEAR_BITS bits, different texts link where their word shingles' Jaccard
similarity reaches a bound, again in bounded cells and as spanning forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, table
from tessera.llm.components import components

SEED = 42
NEAR_BITS = 6  #: bits in which fingerprints of near copies may differ
NEAR_ROWS, NEAR_BYTES = 256, 1 << 24  #: texts, and bytes of them, in one cell of a component, about
CELL = 512  #: fingerprints of one key that meet in one task, about
CROWD = 8 * CELL  #: fingerprints of one key from which it is parted further
SHINGLES = 1 << 16  #: shingles whose bits are summed at once

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, size: int) -> int:
    """The SimHash of a text: A-Z lower-cased, words between ASCII white space, shingles of `size` words with repeats."""
    words = words_of(text)  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= size:
        return _hash(b" ".join(words))
    totals = np.zeros(64, np.int64)
    n = len(words) - size + 1
    for at in range(0, n, SHINGLES):
        end = min(n, at + SHINGLES)
        hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[at + i : end + i] for i in range(size))))), "<u8", end - at)
        totals += _bit_totals(hashes)
    bits = totals * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # eight rows of 0/1 bytes at a time as one 64-bit word: sums of up to 255 rows fit in each byte
    words = bits.view("<u8")
    totals = np.zeros(64, np.int64)
    for at in range(0, len(words), 255):
        totals += words[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return totals


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, fp long), the fingerprint's bits as a signed long. Null and empty texts give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, size) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """The bits in `blocks` blocks: masks of all choices of `agree` of them."""
    ends = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[s:e]) for s, e in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(masks, agree)]


def _keys(max_bits: int) -> list[int]:
    """Masks of the keys: of so many blocks that pairs within `max_bits` bits agree on two (three where those are many)."""
    agree = 2 if max_bits <= 3 else 3
    return _masks([*range(64)], max_bits + agree, agree)


def _finer(mask: int, max_bits: int) -> list[int]:
    """Masks for the pairs that share a key: of the bits outside it they agree on two blocks again."""
    return _masks([b for b in range(64) if not mask >> b & 1], max_bits + 2, 2)


def _signed(masks: list[int]) -> Column:
    """The masks as one array, a literal however many they are."""
    return F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)), ",").cast("array<bigint>")


class Forest:
    """Components of rows; `label` names each row's by its first row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def meet(self, i: int, near: np.ndarray) -> None:
        """Row i hangs together with the rows `near`."""
        own = np.unique(self.label[near])
        if len(own) and (own != self.label[i]).any():
            all_ = np.append(own, self.label[i])
            self.label[np.isin(self.label, all_)] = all_.min()


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links, each to the first row of a component, that connect what the close pairs between (or within) two cells connect.

    Where two cells meet, what hangs together within either is found again but not returned, as
    each cell's meeting with itself does that: a tight crowd gives one link for two cells.
    """
    forest = Forest(len(fps))
    near = lambda i, rows: rows[np.bitwise_count(fps[rows] ^ fps[i]) <= max_bits]
    if left is not right:
        for own in (left, right):
            for i in own:
                forest.meet(i, near(i, own))
    before = forest.label.copy()
    for i in left:
        forest.meet(i, near(i, right))
    moved = np.flatnonzero((before == np.arange(len(fps))) & (forest.label != before))
    return list(zip(fps[moved].view(np.int64).tolist(), fps[forest.label[moved]].view(np.int64).tolist()))


def _stars(edges: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the given ones do, fewer where a node has been linked to many: to the least of them, and they to that."""
    own = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy("node").agg(F.sort_array(F.collect_set("to")).alias("m"))  # a few for each key
    link = lambda a: F.struct(a.alias("a"), F.col("m")[0].alias("b"))
    out = F.concat(F.array(link(F.col("node"))), F.transform(F.slice("m", F.lit(2), F.size("m") - 1), link))
    return own.select(F.explode(out).alias("e")).select("e.a", "e.b").distinct()


def _met(rows: DataFrame) -> DataFrame:
    """Each row once for every pair (x, y) of cells that its own is one of."""
    meets = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.struct(F.least("cell", o).alias("x"), F.greatest("cell", o).alias("y")))
    return rows.withColumn("m", F.explode(meets)).withColumns({"x": F.col("m.x"), "y": F.col("m.y")}).drop("m")


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all pairs within `max_bits` bits."""
    if not 0 < max_bits <= 8:
        raise ValueError("max_bits must lie between 1 and 8")
    masks = _keys(max_bits)
    # a key is the hash of its blocks; should two hashes meet, the Hamming distance still decides
    keys = F.transform(_signed(masks), lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))

    def counted(rows: DataFrame) -> DataFrame:
        """The rows with the number of those that share their key, where these fill more than a cell."""
        large = rows.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
        return rows.join(large, "part", "left").withColumn("n", F.coalesce("n", F.lit(1)))

    shared = counted(distinct.select("fp", F.explode(keys).alias("part")))
    # a crowded key is parted by further blocks
    finer = [_finer(m, max_bits) for m in masks]
    which = F.array_position(keys, F.col("part")).cast("int") - 1
    own = F.slice(_signed([m for ms in finer for m in ms]), which * len(finer[0]) + 1, len(finer[0]))
    parts = F.transform(own, lambda m, i: F.xxhash64(F.col("part"), i, F.col("fp").bitwiseAND(m)))
    crowded = shared.filter(F.col("n") > CROWD).select("fp", F.explode(parts).alias("part"))
    shared = shared.filter(F.col("n") <= CROWD).unionByName(counted(crowded))
    # as many cells as hold CELL each; a cell meets itself and every other cell of its key
    celled = shared.withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")).withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    dealt = _met(celled).select("fp", "part", "cell", "x", "y")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and pair of cells; a group's rows are bounded by two cells."""
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if rest.num_rows:
                out, rest = _groups(rest, max_bits, last=False)
                yield from out.to_batches()
        if rest is not None and rest.num_rows:
            out, _ = _groups(rest, max_bits, last=True)
            yield from out.to_batches()

    group = ["part", "x", "y"]
    found = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(joined, "a long, b long")
    return _stars(_stars(found))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(rows: pa.Table, max_bits: int, last: bool) -> tuple[pa.Table, pa.Table]:
    """Links of all groups that are complete, and the rows of the one that may go on."""
    rows = rows.combine_chunks()
    fps = rows["fp"].to_numpy().view(np.uint64)
    columns = [rows[c].to_numpy() for c in ("part", "x", "y")]
    new = np.ones(len(fps), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(fps))
    cell, x, y = rows["cell"].to_numpy(), columns[1], columns[2]
    done = len(starts) if last else len(starts) - 1
    found: list[tuple[int, int]] = []
    sizes = ends - starts
    for size in np.unique(sizes[:done]):
        if size == 1:
            continue
        at = starts[:done][sizes[:done] == size]
        if size <= 8:  # small groups, which are most: all pairs of all groups of a size at once
            block = fps[at[:, None] + np.arange(size)]
            for i, j in combinations(range(size), 2):
                near = np.bitwise_count(block[:, i] ^ block[:, j]) <= max_bits
                found += zip(block[near, i].view(np.int64).tolist(), block[near, j].view(np.int64).tolist())
            continue
        for s in at:
            # the same rows give the same links under whatever key they meet
            order = s + np.argsort(fps[s : s + size])
            index, where = np.arange(size), cell[order]
            left = index[where == x[s]]
            found += _forest(fps[order], left, left if x[s] == y[s] else index[where == y[s]], max_bits)
    cut_at = len(fps) if last else int(starts[-1])
    a, b = ([p for p, _ in found], [q for _, q in found])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK), rows.slice(cut_at)


def _classes(docs: DataFrame, size: int, max_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), and per distinct fingerprint (fp, root, component_id)."""
    found = cut(fingerprints(docs, size, id_col, text_col))
    least = cut(found.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(least.select("fp"), max_bits))
    grouped = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return found, cut(grouped.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"))


def simhash_groups(docs: DataFrame, size: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links, itself included).

    Documents link where their fingerprints differ in at most `max_bits` bits; null and empty
    texts, and texts of white space, have fingerprint zero and link like any other. Null ids keep
    their rows and never are a component's id unless all its ids are null. Repeated rows each give
    a row; an empty table gives none; other columns are not read.
    """
    found, classes = _classes(docs, size, max_bits, id_col, text_col)
    return found.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, between ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of a word list's different shingles, ascending; of fewer words than `size` the whole list is one."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter(map(_hash, (b" ".join(words[i : i + size]) for i in range(n))), np.uint64, n))


def _alike(texts: list[bytes], left: list[int], right: list[int], size: int, least: float) -> list[tuple[int, int]]:
    """Links that connect what the pairs of similarity `least` between (or within) two cells connect; see `_forest`."""
    sets = [shingles(t.split(), size) for t in texts]
    sizes = np.array([len(own) for own in sets])
    forest = Forest(len(texts))

    def meet(rows: list[int], others: np.ndarray) -> None:
        for i in rows:
            n = sizes[i]
            for j in others[(np.minimum(sizes[others], n) >= least * np.maximum(sizes[others], n)) & (n > 0)]:
                if forest.label[i] != forest.label[j]:
                    both = n + sizes[j] - len(np.union1d(sets[i], sets[j]))
                    if both >= least * (n + sizes[j] - both):
                        forest.meet(i, np.array([j]))

    if left is not right:
        meet(left, np.array(left, int))
        meet(right, np.array(right, int))
    before = forest.label.copy()
    meet(left, np.array(right, int))
    moved = np.flatnonzero((before == np.arange(len(texts))) & (forest.label != before))
    return list(zip(moved.tolist(), forest.label[moved].tolist()))


def _near_links(entries: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) between keys of texts (root, key, words) of one root that connect all pairs of similarity `least`."""
    sizes = entries.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes")).filter("n > 1")
    cells = F.greatest(F.ceil(F.col("n") / NEAR_ROWS), F.ceil(F.col("bytes") / NEAR_BYTES)).cast("int")
    shared = entries.join(sizes.select("root", cells.alias("cells")), "root").withColumn("cell", F.pmod(F.xxhash64("key"), "cells").cast("int"))
    group = ["root", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by root and pair of cells; a group's rows are bounded by two cells."""
        own: list[dict] = []

        def linked() -> pa.RecordBatch:
            x, y = own[0]["x"], own[0]["y"]
            own.sort(key=lambda r: r["key"])
            left = [i for i, r in enumerate(own) if r["cell"] == x]
            right = left if x == y else [i for i, r in enumerate(own) if r["cell"] == y]
            found = _alike([r["words"] for r in own], left, right, size, least)
            return pa.RecordBatch.from_arrays([pa.array([own[i]["key"] for i, _ in found], pa.binary()), pa.array([own[j]["key"] for _, j in found], pa.binary())], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if own and any(r[c] != own[0][c] for c in group):
                        yield linked()
                        own = []
                    own.append(r)
        if own:
            yield linked()

    return _met(shared).select("root", "key", "words", "cell", "x", "y").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a binary, b binary").distinct()


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8, max_bits: int = NEAR_BITS, print_size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, key (a digest of its words) and component_id (the smallest id reachable by links, itself included).

    Rows of the same words are one class. Classes link where the Jaccard similarity of their
    shingles of `size` words is at least `least`, among those whose fingerprints (shingles of
    `print_size` words) hang together by links of at most `max_bits` bits; so every link is a near
    copy, and a near copy is missed where its fingerprint is farther than that from all others of
    its component. Texts without words are one class. Null ids name no component unless all its
    ids are null; repeated rows each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.fromiter((fingerprint(t, print_size) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), pa.array([_key(words_of(t)) for t in texts], pa.binary())], ["id", "fp", "key"])

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, own), pa.binary()), pa.array([b" ".join(w) for w in own], pa.binary())], ["key", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, key binary"))
    texts = cut(found.groupBy("key").agg(F.min("id").alias("first"), F.min("fp").alias("fp")))
    roots = components(links(texts.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    rooted = texts.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    crowds = rooted.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    wanted = cut(rooted.join(crowds, "root"))  # texts that may have near copies
    entries = docs.select(text_col).mapInArrow(worded, "key binary, words binary").join(wanted, "key").groupBy("key").agg(F.first("root").alias("root"), F.first("words").alias("words"))
    near = components(_near_links(cut(entries), size, least)).withColumnRenamed("node", "key")
    classes = texts.join(near.withColumnRenamed("root", "class"), "key", "left").withColumn("class", F.coalesce("class", "key"))
    smallest = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = cut(classes.select("key", "class").join(smallest, "class"))
    return found.join(named, "key").select(F.col("id").alias(id_col), "key", "class", "component_id")


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def keep_first(docs: DataFrame, size: int = 5, least: float = 0.8, max_bits: int = NEAR_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all its columns: the one with the smallest id.

    Of rows that share that id the least by text and then the other columns stays, and so it does
    in a component whose ids are all null.
    """
    found = near_copies(docs, size, least, max_bits, id_col=id_col, text_col=text_col)
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    rest = [text_col, *(c for c in docs.columns if c not in (id_col, text_col))]

    def least_of(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min(F.struct(*[c for c in rest])).alias("_row"))

    named = least_of(docs.filter(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi"), id_col).select(id_col, "_row.*").select(*docs.columns)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.append_column("_key", pa.array([_key(words_of(t)) for t in texts], pa.binary()))

    alone = found.filter("component_id is null").select(F.col("key").alias("_key"), F.col("class").alias("_class")).distinct()
    bare = docs.filter(F.col(id_col).isNull()).mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField("_key", T.BinaryType())]))
    nameless = least_of(bare.join(alone, "_key"), "_class").select(F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), "_row.*").select(*docs.columns)
    return named.unionByName(nameless)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
