"""A content-addressed store of token ids.

Rolling hashes over the ids cut each document's stream into chunks at places that the content
chooses, so equal passages give equal chunks wherever they stand. A chunk is stored once under the
digest of its bytes; a document is a recipe, the list of its chunks' digests, whose Merkle root
names its content. Each recipe's id, place, size and root make a leaf; the leaves of a recipe file
in order make its Merkle root, and the files' roots, starts and sizes that of the manifest.
Reading checks every chunk against its digest, every recipe against its root, every file against
the manifest and the manifest against its own root.

Files, all Parquet in one folder: `blocks/kind=chunk` (digest, payload: ids as little-endian
integers of the manifest's width), `recipes` (part, doc_id ascending, row in the part, local: ids
of the part before it, n_tokens, root, recipe: 16-byte digests one after another), `manifest`
(part, start, tokens, docs, width in bytes, tree: root over the part's leaves, root: over the
row; part -1 has the sums and the root over the other rows).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import new_folder, remove_folder, table

LEAST, MOST = 64, 8192  #: ids in a chunk, but for a document's last
RARE = 9  #: bits of the rolling hash that are zero at a cut: a chunk has LEAST + 2^RARE ids or so
SPAN = 16  #: ids in the rolling hash's window
TOGETHER = 300_000  #: ids that are cut at once
DIGEST = 16
LEAVES = 4096  #: leaves that are put together at once, a power of two; a file's tree is made of such subtrees
RECENT = 50_000  #: digests a task remembers, not to send a chunk again

#: Odd multipliers of the hash; any would do.
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over digests; an odd last one moves up as it is, no leaves give the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place the hash of the SPAN ids that end there, by doubling the window."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _SEED
    h ^= h >> np.uint64(29)
    width = 1
    while width < SPAN:
        shifted = h[:-width] * np.uint64(pow(_STEP, width, 1 << 64))
        h[width:] += shifted
        width *= 2
    return h


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document in a run of documents that end at `ends`.

    A cut needs LEAST ids before it, more than the hash's window, so a document's chunks don't
    depend on what precedes it in the run.
    """
    places = np.flatnonzero(rolling(ids) >> np.uint64(64 - RARE) == 0) + 1
    out, start = [], 0
    for end, own in zip(ends.tolist(), np.split(places, np.searchsorted(places, ends))):
        found, last = [], start
        for p in [*own.tolist(), end]:
            while p - last > MOST:
                last += MOST
                found.append(last)
            if p == end or p - last >= LEAST:
                found.append(p)
                last = p
        if len(found) > 1 and found[-1] == found[-2]:
            found.pop()
        out.append(found)
        start = end
    return out


def _encoded(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Recipe rows (doc_id, n_tokens, recipe, root) and chunk rows (digest, payload), each chunk once for a task's recent ones."""
    short = tokens.proved(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema([("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", _arrow_type(docs)), ("n_tokens", pa.int64()), ("recipe", pa.binary()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(path, short)
        last = np.empty(0, codec.dtype) if end_id is None else np.array([end_id], codec.dtype)
        seen: dict[bytes, None] = {}

        def rows(who: list, streams: list[np.ndarray]) -> pa.RecordBatch:
            stream = np.concatenate(streams) if streams else last[:0]
            ends = np.cumsum([len(s) for s in streams], dtype=np.int64)
            raw, size = stream.tobytes(), stream.itemsize
            digests, payloads, recipes, roots = [], [], [], []
            start = 0
            for found in cuts(stream, ends):
                own = []
                for end in found:
                    data = raw[start * size : end * size]
                    start = end
                    own.append(d := digest(data))
                    if d not in seen:
                        if len(seen) >= RECENT:
                            seen.clear()
                        seen[d] = None
                        digests.append(d)
                        payloads.append(data)
                recipes.append(b"".join(own))
                roots.append(merkle(own))
            no, all_ = [None] * len(who), [None] * len(digests)
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for f, v in zip(arrow, (digests + no, payloads + no, all_ + who, all_ + [len(s) for s in streams], all_ + recipes, all_ + roots))], schema=arrow
            )

        for batch in batches:
            who, streams, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                who.append(i)
                streams.append(np.concatenate([codec.encode(text), last]))
                size += len(streams[-1])
                if size >= TOGETHER:
                    yield rows(who, streams)
                    who, streams, size = [], [], 0
            if who:
                yield rows(who, streams)

    return docs.select("doc_id", "text").mapInArrow(run, f"digest binary, payload binary, doc_id {kind}, n_tokens long, recipe binary, root binary")


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without the chunks whose digest this task has had; all rows of a digest are in one task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d is None or d not in seen)
            if d is not None:
                seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, folder: str, end_id: int | None = None) -> None:
    """Encodes `docs` (doc_id, text) and writes the store; only driver-side sums are collected, a row for each recipe file.

    One shuffle deals chunks by digest and recipes by document; a second, of recipes only, orders
    them by doc_id (null ids first; equal ids by root). Null and empty texts give only the end id,
    or an empty recipe without one. Repeated rows each have a recipe and share chunks.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _encoded(docs, path, end_id)
    dealt = rows.repartition(F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "root")))
    shape = f"digest binary, payload binary, doc_id {kind}, n_tokens long, recipe binary, root binary"
    dealt.mapInArrow(_once, shape).withColumn("kind", F.when(F.col("digest").isNull(), "recipe").otherwise("chunk")).write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/blocks")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = np.asarray(batch.column("n_tokens").to_numpy(zero_copy_only=False), np.int64)
            ends = at + np.cumsum(sizes)
            starts = ends - sizes
            at = int(ends[-1]) if len(ends) else at
            rows = np.arange(row, row + len(sizes))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part), pa.int32()), batch.column("doc_id"), pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), batch.column("n_tokens"), batch.column("root"), batch.column("recipe")], ["part", "doc_id", "row", "local", "n_tokens", "root", "recipe"])

    recipe = f"part int, doc_id {kind}, row long, local long, n_tokens long, root binary, recipe binary"
    raw = _blocks(spark, folder, shape).filter("kind = 'recipe'").select("doc_id", "n_tokens", "root", "recipe")
    ordered = raw.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.mapInArrow(placed, recipe).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    remove_folder(spark, f"{folder}/blocks/kind=recipe")
    width = 4 if max(end_id or 0, *tokens.vocabulary(path).names) >= 1 << 16 else 2
    start, parts = 0, []
    for r in _trees(spark.read.schema(recipe).parquet(f"{folder}/recipes")):
        parts.append((r["part"], start, r["tokens"], r["docs"], width, bytes(r["tree"])))
        start += r["tokens"]
    roots = [_row_root(*p) for p in parts]
    total = (-1, 0, start, sum(p[3] for p in parts), width, merkle(roots))
    spark.createDataFrame([(*p, r) for p, r in zip([total, *parts], [_row_root(*total), *roots])], "part int, start long, tokens long, docs long, width int, tree binary, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def _row_root(part: int, start: int, tokens_: int, docs: int, width: int, tree: bytes) -> bytes:
    return digest(b"".join(v.to_bytes(8, "little", signed=True) for v in (part, start, tokens_, docs, width)) + bytes(tree))


def _trees(recipes: DataFrame) -> list:
    """For each recipe file: part, tokens, docs and the Merkle root over its leaves; a row a file comes to the driver.

    Leaves go by LEAVES into subtrees, and those into the file's tree, so no task holds a file.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "local", "n_tokens", "root")))
            own = [digest(repr(i).encode() + b"".join(v.to_bytes(8, "little", signed=True) for v in (row, local, n)) + root) for i, row, local, n, root in rows]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), batch.column("n_tokens"), pa.array(own, pa.binary())], ["part", "row", "n", "leaf"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, whole = [], []
            for own in batch.column("own").to_pylist():
                # rows count up without a gap, from a subtree's first
                whole.append(all(b["at"] == a["at"] + 1 for a, b in zip(own, own[1:])))
                trees.append(merkle([x["leaf"] for x in own]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "at", "n", "docs")), pa.array([t if ok else b"" for t, ok in zip(trees, whole)], pa.binary())], ["part", "at", "n", "docs", "leaf"])

    found = recipes.select("part", "doc_id", "row", "local", "n_tokens", "root").mapInArrow(leaves, "part int, row long, n long, leaf binary")
    block = F.floor(F.col("row") / LEAVES)
    of = lambda at: F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "leaf"))).alias("own")
    shape = "part int, at long, n long, docs long, leaf binary"
    small = found.groupBy("part", block.alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("docs"), of("row")).mapInArrow(joined, shape)
    large = small.groupBy("part").agg(F.lit(0).cast("long").alias("at"), F.sum("n").alias("n"), F.sum("docs").alias("docs"), of("at")).mapInArrow(joined, shape)
    return large.select("part", F.col("n").alias("tokens"), "docs", F.col("leaf").alias("tree")).orderBy("part").collect()


def _blocks(spark: SparkSession, folder: str, shape: str = "digest binary, payload binary") -> DataFrame:
    return spark.read.schema(f"{shape}, kind string").parquet(f"{folder}/blocks")


def _manifest(spark: SparkSession, folder: str) -> tuple[list, int]:
    """The manifest's rows but the total, and the ids' width; all checked against the total's root."""
    rows = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()  # a row for each recipe file
    total, parts = rows[0], rows[1:]
    start = 0
    whole = total["part"] == -1 and total["width"] in (2, 4) and bytes(total["tree"]) == merkle([bytes(p["root"]) for p in parts])
    for p in rows:
        whole = whole and bytes(p["root"]) == _row_root(p["part"], p["start"], p["tokens"], p["docs"], p["width"], p["tree"]) and p["width"] == total["width"]
    for p in parts:
        whole = whole and p["start"] == start
        start += p["tokens"]
    if not whole or total["tokens"] != start or total["docs"] != sum(p["docs"] for p in parts):
        raise ValueError("the manifest doesn't match its root")
    return parts, total["width"]


def read_recipes(spark: SparkSession, folder: str) -> tuple[DataFrame, np.dtype]:
    """(doc_id, start, n_tokens, root, recipe), start counting the ids of all documents before; and the ids' type."""
    parts, width = _manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    got = [(r["part"], r["tokens"], r["docs"], bytes(r["tree"])) for r in _trees(recipes)]
    if got != [(p["part"], p["tokens"], p["docs"], bytes(p["tree"])) for p in parts]:
        raise ValueError("a recipe file doesn't match the manifest")
    starts = spark.createDataFrame([(p["part"], p["start"]) for p in parts], "part int, first long")
    placed = recipes.join(F.broadcast(starts), "part").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "root", "recipe")  # a row for each recipe file
    return placed, np.dtype(f"<u{width}")


def _chunk_rows(recipes: DataFrame) -> DataFrame:
    """(start, seq, digest) of every chunk of every recipe, each recipe checked against its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, seqs, digests = [], [], []
            for start, root, recipe in zip(*(batch.column(c).to_pylist() for c in ("start", "root", "recipe"))):
                own = [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]
                if merkle(own) != root:
                    raise ValueError(f"the recipe at {start} doesn't match its root")
                starts += [start] * len(own)
                seqs += range(len(own))
                digests += own
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(seqs, pa.int32()), pa.array(digests, pa.binary())], ["start", "seq", "digest"])

    return recipes.select("start", "root", "recipe").mapInArrow(run, "start long, seq int, digest binary")


def _checked(data: bytes, name: bytes) -> bytes:
    if digest(data) != name:
        raise ValueError(f"chunk {name.hex()} is damaged")
    return data


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document rebuilt from its chunks."""
    recipes, dtype = read_recipes(spark, folder)
    chunks = _blocks(spark, folder).filter("kind = 'chunk'").select("digest", "payload")
    whole = _chunk_rows(recipes).join(chunks, "digest", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "payload"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for n, parts in zip(batch.column("n_tokens").to_pylist(), batch.column("parts").to_pylist()):
                data = np.frombuffer(b"".join(_checked(p["payload"] or b"", p["digest"]) for p in parts or []), dtype)
                if len(data) != n:
                    raise ValueError("a document's chunks don't add up")
                ids.append(data.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])

    return recipes.select("doc_id", "start", "n_tokens").join(whole, "start", "left").select("doc_id", "start", "n_tokens", "parts").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids array<int>")


def _crc_tables() -> np.ndarray:
    """For each k, tables by byte of what 2^k zero bytes after it make of a CRC-32."""
    # one zero bit shifts the reflected register and folds the polynomial in
    poly = 0xEDB88320
    step = lambda c: (c >> 1) ^ (poly if c & 1 else 0)
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = step(c)
        columns.append(c)
    tables = []
    for _ in range(40):
        grid = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                on = (np.arange(256) >> bit & 1).astype(bool)
                grid[byte, on] ^= np.uint32(columns[8 * byte + bit])
        tables.append(grid)
        apply = lambda c: int(grid[0, c & 255] ^ grid[1, c >> 8 & 255] ^ grid[2, c >> 16 & 255] ^ grid[3, c >> 24])  # noqa: E731, B023
        columns = [apply(c) for c in columns]
    return np.array(tables)


def crc_joined(crcs: np.ndarray, following: np.ndarray, sizes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of byte strings, from both CRCs and the size of the second."""
    out = crcs.astype(np.uint32).copy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        on = (sizes >> k & 1).astype(bool)
        c = out[on]
        out[on] = tables[k, 0][c & 255] ^ tables[k, 1][c >> 8 & 255] ^ tables[k, 2][c >> 16 & 255] ^ tables[k, 3][c >> 24]
    return out ^ following.astype(np.uint32)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files.

    The CRC over a document's ids as little-endian unsigned 32-bit integers is put together from
    its chunks' CRCs, so that no payload is moved: each chunk is read and checked where it lies.
    """
    recipes, dtype = read_recipes(spark, folder)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, crcs = batch.column("digest").to_pylist(), [], []
            for name, data in zip(names, batch.column("payload").to_pylist()):
                ids = np.frombuffer(_checked(data, name), dtype).astype("<u4")
                n.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _crc_tables()
        for batch in batches:
            parts = batch.column("parts")
            offsets = np.asarray(parts.offsets)
            n, crc = (np.asarray(parts.values.field(f).to_numpy(zero_copy_only=False)).astype(float) for f in ("n", "crc"))
            if np.isnan(n).any():
                raise ValueError("a chunk is missing")
            n, crc = n.astype(np.int64), crc.astype(np.int64)
            first, count = offsets[:-1], np.diff(offsets)
            total, size = np.zeros(len(first), np.uint32), np.zeros(len(first), np.int64)
            order = np.argsort(-count, kind="stable")
            for k in range(int(count.max(initial=0))):
                own = order[: np.searchsorted(-count[order], -k, side="left")]
                at = first[own] + k
                total[own] = crc_joined(total[own], crc[at], 4 * n[at], tables)
                size[own] += n[at]
            if (size != batch.column("n_tokens").to_numpy()).any():
                raise ValueError("a document's chunks don't add up")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(total.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    chunks = _blocks(spark, folder).filter("kind = 'chunk'").select("digest", "payload").mapInArrow(chunk, "digest binary, n long, crc long")
    parts = _chunk_rows(recipes).join(chunks, "digest", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
    rows = recipes.select("doc_id", "start", "n_tokens").join(parts, "start", "left").select("doc_id", "start", "n_tokens", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)).alias("parts"))
    return rows.mapInArrow(whole, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return read_digests(spark, folder)
