"""Embedding near-duplicates by product quantisation, searched by bounds that leave out no link.

Unit vectors are assigned to the list of the nearest centroid and coded: each subspace of the
residual by the nearest of its codebook's entries; how much the code misses is kept. A vector asks
every later list that can hold a link: by the triangle inequality one whose centroid is no farther
than the list's radius and the threshold's distance, and on this side, within that distance, of the
plane between the first-level centroids. So each pair of lists meets once, and a found pair counts
for both its ends. In a list, asymmetric distances are summed from a query's look-up tables by the
members' codes. A true distance lies within what a code misses of that sum: pairs that are too far
apart by it are dropped, pairs near enough by it are links, and the others get their cosines:
single-precision products decide all but those within their rounding error of the threshold, double
precision those. Equal vectors are one entry with a count.

Lists are dealt into bounded cells, of members and of queries, so that a crowded list is the work
of many tasks. A cell returns each entry's number of links and a spanning forest of the links, not
the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, table
from tessera.llm.components import components

LIST = 16_384  #: vectors of up to 64 dimensions to a list, about; fewer of longer ones
COARSE = 4096  #: centroids of the first level, and of the second, at most: up to COARSE^2 lists
SENT = 65_536  #: lists whose sizes may be broadcast
SLACK = 1e-4  #: more than rounding can change in a sum of look-ups, a squared distance of unit vectors
SAMPLE = 65_536  #: vectors that centroids and codebooks are fitted on, at most
CODES = 256  #: codes of a subspace
WIDTH = 4  #: dimensions of a subspace
CELL = 16_384  #: members of a list in one cell, and half of its queries; fewer of longer vectors


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the k nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(k, len(centres))), np.int32)
    half = (centres**2).sum(1) / 2
    for at in range(0, len(x), 2048):
        score = x[at : at + 2048] @ centres.T - half
        if k == 1:
            out[at : at + 2048, 0] = score.argmax(1)
        else:
            top = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
            out[at : at + 2048] = np.take_along_axis(top, order, 1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of x; x is in an order without meaning."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """List centroids of one or two levels, and the codebooks of what they leave.

    Where more lists are wanted than the first level may have, each of its lists is split by the
    nearest of second-level centroids, which are fitted on the first level's residuals and shared.
    """

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, min(lists, COARSE))
        own = _nearest(sample, self.centres)[:, 0]
        split = min(COARSE, -(-lists // len(self.centres)))
        self.fine = _kmeans(sample - self.centres[own], split) if split > 1 else np.zeros((1, sample.shape[1]))
        dim = sample.shape[1]
        self.parts = [slice(i, min(i + WIDTH, dim)) for i in range(0, dim, WIDTH)]
        residual = sample - self.base(self.lists(sample, 1)[:, 0])
        self.books = [_kmeans(np.ascontiguousarray(residual[:, p]), CODES, 4) for p in self.parts]
        #: |r - b|^2 = |r|^2 + (-2 r b + |b|^2): a query's table is one small product
        self.tables = [((-2 * b).astype(np.float32), (b**2).sum(1).astype(np.float32)) for b in self.books]

    @property
    def size(self) -> int:
        return len(self.centres) * len(self.fine)

    def base(self, lists: np.ndarray) -> np.ndarray:
        """The centroids of lists."""
        return self.centres[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the k nearest lists among the second levels of the k nearest first-level ones, nearest first."""
        first = _nearest(x, self.centres, k)
        if len(self.fine) == 1:
            return first
        numbers, away = [], []
        for c in range(first.shape[1]):
            residual = x - self.centres[first[:, c]]
            near = _nearest(residual, self.fine, k)
            numbers.append(first[:, c : c + 1] * len(self.fine) + near)
            away.append(np.stack([((residual - self.fine[near[:, j]]) ** 2).sum(1) for j in range(near.shape[1])], axis=1))
        numbers, away = np.concatenate(numbers, axis=1), np.concatenate(away, axis=1)
        best = np.argsort(away, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(numbers, best, 1)

    def within(self, x: np.ndarray, own: np.ndarray, radii: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each row the later lists, ascending, that may hold a vector within `reach` of it; `radii` are negative for lists without members.

        A member of another first-level list lies beyond the plane between that list's centroid and
        the row's own, so a row farther than `reach` from the plane has no link there. Only the
        second levels of the others are looked at, one first-level list at a time.
        """
        reach += 1e-6  # rounding of the distances
        split = len(self.fine)
        first = own // split
        sizes = (x**2).sum(1)
        centred = (self.centres**2).sum(1)
        squares = np.maximum(sizes[:, None] + centred - 2 * x @ self.centres.T, 0)
        apart = np.sqrt(np.maximum((self.centres[first] ** 2).sum(1)[:, None] + centred - 2 * self.centres[first] @ self.centres.T, 0))
        ahead = squares - np.take_along_axis(squares, first[:, None], 1)
        near = ((ahead <= 2 * reach * apart) | (apart < 1e-4)) & (np.arange(len(self.centres)) >= first[:, None])
        rows, lists = [], []
        for c in np.flatnonzero(near.any(0)):
            asking = np.flatnonzero(near[:, c])
            numbers = np.arange(c * split, (c + 1) * split)
            numbers = numbers[radii[numbers] >= 0]
            bases = self.base(numbers)
            away = np.sqrt(np.maximum(sizes[asking, None] + (bases**2).sum(1) - 2 * x[asking] @ bases.T, 0))
            r, n = np.nonzero((away - radii[numbers] <= reach) & (numbers > own[asking, None]))
            rows.append(asking[r])
            lists.append(numbers[n])
        rows, lists = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (rows, lists))
        order = np.lexsort((lists, rows))
        return np.split(lists[order].astype(np.int32), np.searchsorted(rows[order], np.arange(1, len(x))))

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector's residual, and the length of what they miss."""
        residual = x - self.base(lists)
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        missed = np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            codes[:, m] = _nearest(np.ascontiguousarray(residual[:, p]), book)[:, 0]
            missed += ((residual[:, p] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def distances(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Squared look-up distances of a list's coded members (rows) to queries (columns)."""
        residual = (queries - self.base(np.array([centre]))).astype(np.float32)
        total = np.repeat((residual**2).sum(1)[None], len(codes), axis=0)
        for m, (p, (book, size)) in enumerate(zip(self.parts, self.tables)):
            total += (book @ residual[:, p].T + size[:, None])[codes[:, m]]
        return total


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaled by their largest part first, against overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _keyed(rows: DataFrame, kind: str, numbers: np.dtype) -> DataFrame:
    """(vec_id, dim, key, raw): raw bytes of valid vectors and a digest of them; nulls for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, raws = [], [], []
            for v in batch.column(1):
                values = v.values
                x = None
                if values is not None and len(values) and not values.null_count:
                    x = np.asarray(values.to_numpy(zero_copy_only=False), numbers) + numbers.type(0)
                ok = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x) if ok else None)
                raws.append(x.tobytes() if ok else None)
                keys.append(hashlib.blake2b(raws[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "dim", "key", "raw"])

    return rows.mapInArrow(run, f"vec_id {kind}, dim int, key binary, raw binary")


def _vectors(batch: pa.RecordBatch | pa.Table, numbers: np.dtype) -> np.ndarray:
    return unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), numbers).reshape(batch.num_rows, -1))


def _radii(reps: DataFrame, quantiser, numbers: np.dtype) -> np.ndarray:
    """The largest distance of a member of each list from its centroid; -1 for lists without members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        radii = np.full(q.size, -1.0)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, numbers)
                own = q.lists(x, 1)[:, 0]
                np.maximum.at(radii, own, np.sqrt(((x - q.base(own)) ** 2).sum(1)))
        held = np.flatnonzero(radii >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(radii[held])], ["list", "radius"])

    radii = np.full(quantiser.value.size, -1.0)
    for r in reps.select("raw").mapInArrow(run, "list int, radius double").groupBy("list").agg(F.max("radius").alias("radius")).collect():  # a row a list
        radii[r["list"]] = r["radius"]
    return radii


ENTRY = ["key", "n", "raw", "code", "missed", "list"]  #: what a cell holds of an entry


def _dealt(reps: DataFrame, quantiser, numbers: np.dtype, least: float) -> DataFrame:
    """Each entry with its list, its code there and what that misses, and the later lists that may hold links of it."""
    radii = _radii(reps, quantiser, numbers)
    reach = math.sqrt(max(0.0, 2 - 2 * least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _vectors(batch, numbers)
                own = q.lists(x, 1)[:, 0]
                codes, missed = q.code(x, own)
                probes = pa.array(q.within(x, own, radii, reach), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "raw")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), pa.array(own, pa.int32()), probes], [*ENTRY, "probes"])

    return reps.select("key", "n", "raw").mapInArrow(run, "key binary, n long, raw binary, code binary, missed double, list int, probes array<int>")


def _cell_links(rows: pa.Table, quantiser: Quantiser, numbers: np.dtype, least: float) -> tuple[list, list, list, list]:
    """A cell's rows: for each entry with links its key and their number, and links that connect what they connect.

    Queries meet all members; members meet each other, once, in the first part of the cell's queries.
    """
    member = rows["member"].to_numpy(zero_copy_only=False).astype(bool)
    inside, asking = np.flatnonzero(member), np.flatnonzero(~member)
    x = _vectors(rows, numbers)
    single = x.astype(np.float32)
    slack = (x.shape[1] + 4) * 2.0**-23  # of single-precision products of unit vectors
    keys, counts = rows["key"].to_pylist(), rows["n"].to_numpy().astype(float)
    own_codes = np.frombuffer(b"".join(rows["code"].drop_null().to_pylist()), np.uint8).reshape(len(inside), -1)
    codes = np.zeros((len(x), own_codes.shape[1] if len(inside) else 0), np.uint8)
    codes[inside] = own_codes
    reach, missed = math.sqrt(max(0.0, 2 - 2 * least)), np.nan_to_num(rows["missed"].to_numpy().astype(float))
    # squared look-up distances up to `sure` are links, beyond `may` none
    may = (reach + missed) ** 2 + SLACK
    sure = np.where(missed < reach, (reach - missed) ** 2 - SLACK, -1.0)
    own_list = rows["list"][0].as_py()
    totals, label = np.zeros(rows.num_rows), np.arange(rows.num_rows)
    a, b = [], []

    def meet(own: np.ndarray, others: np.ndarray, later: bool) -> None:
        far = quantiser.distances(x[own], own_list, codes[others]).T
        linked = far <= sure[others]
        unsure = (far <= may[others]) & ~linked
        if later:
            ordered = others > own[:, None]
            linked &= ordered
            unsure &= ordered
        columns = np.flatnonzero(unsure.any(0))
        if len(columns):  # the exact cosines of what the look-ups leave open
            product = single[own] @ single[others[columns]].T
            open_ = unsure[:, columns]
            near = open_ & (product >= least + slack)
            r, c = np.nonzero(open_ & (np.abs(product - least) <= slack))
            near[r, c] = np.einsum("ij,ij->i", x[own[r]], x[others[columns[c]]]) >= least
            linked[:, columns] |= near
        if not linked.any():
            return
        totals[own] += linked @ counts[others]
        totals[others] += counts[own] @ linked
        for k in np.flatnonzero(linked.any(1)):
            s, to = own[k], others[linked[k]]
            to = to[label[to] != label[s]]
            if len(to):
                roots, at = np.unique(label[to], return_index=True)
                a.extend([keys[s]] * len(at))
                b.extend(keys[t] for t in to[at])
                label[np.isin(label, roots)] = label[s]

    for at in range(0, len(asking) if len(inside) else 0, 256):
        meet(asking[at : at + 256], inside, False)
    if rows["part"][0].as_py() == 0:
        for at in range(0, len(inside), 256):
            meet(inside[at : at + 256], inside[at:], True)
    found = np.flatnonzero(totals)
    return [keys[f] for f in found], [int(t) for t in totals[found]], a, b


def _of(rows: int, dim: int) -> int:
    """So many rows of 64 dimensions, in vectors of `dim`."""
    return max(1, rows * 64 // max(64, dim))


def _links(index: DataFrame, quantiser, numbers: np.dtype, least: float, cell: int) -> DataFrame:
    """Rows (key, n) of entries' links and rows (a, b) of linked keys, from all cells of `cell` members."""
    # into how many cells a list's members and its queries are dealt; members ask the later cells of their list too
    places = cut(index.select("list", "probes"))
    members = places.groupBy("list").agg(F.count("*").alias("members")).withColumn("cells", F.ceil(F.col("members") / cell).cast("int"))
    asking = places.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("asking"))
    queries = F.coalesce("asking", F.lit(0)) + F.when(F.col("cells") > 1, F.col("members")).otherwise(0)
    sizes = cut(members.join(asking, "list", "left").select("list", "cells", F.greatest(F.lit(1), F.ceil(queries / (2 * cell))).cast("int").alias("parts")))
    if quantiser.value.size <= SENT:
        sizes = F.broadcast(sizes)
    visit = lambda to, own: F.struct(to.alias("list"), F.lit(own).alias("own"))
    visits = F.concat(F.array(visit(F.col("list"), True)), F.transform("probes", lambda p: visit(p, False)))
    rows = index.select("key", "n", "raw", "code", "missed", F.explode(visits).alias("v")).select("key", "n", "raw", "code", "missed", "v.list", "v.own").join(sizes, "list")
    own_cell, own_part = F.pmod(F.xxhash64("key"), "cells").cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), "parts").cast("int")
    place = lambda to, part, member: F.struct(to.alias("cell"), part.alias("part"), F.lit(member).alias("member"))
    asked = lambda first: F.transform(F.sequence(first, F.col("cells") - 1), lambda c: place(c, own_part, False))
    later = F.when(own_cell < F.col("cells") - 1, asked(own_cell + 1)).otherwise(F.array().cast("array<struct<cell: int, part: int, member: boolean>>"))
    home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(own_cell, p, True))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("own"), F.concat(home, later)).otherwise(asked(F.lit(0)))))
    # only members are looked up by their codes
    only = lambda c: F.when(F.col("at.member"), F.col(c)).alias(c)
    dealt = dealt.select("key", "n", "raw", only("code"), only("missed"), "list", "at.cell", "at.part", "at.member")
    group = ["list", "cell", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell's rows are bounded."""
        rest = None

        def found(rows: pa.Table) -> pa.RecordBatch:
            keys, n, a, b = _cell_links(rows, quantiser.value, numbers, least)
            pad = lambda v, left, right: [None] * left + v + [None] * right
            return pa.RecordBatch.from_arrays([pa.array(pad(keys, 0, len(a)), pa.binary()), pa.array(pad(n, 0, len(a)), pa.int64()), pa.array(pad(a, len(keys), 0), pa.binary()), pa.array(pad(b, len(keys), 0), pa.binary())], ["key", "n", "a", "b"])

        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            starts = _starts(rest, group)
            for s, e in zip(starts, starts[1:]):
                yield found(rest.slice(s, e - s))
            rest = rest.slice(int(starts[-1])) if len(starts) else None
        if rest is not None and rest.num_rows:
            yield found(rest)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "key binary, n long, a binary, b binary")


def _starts(rows: pa.Table, group: list[str]) -> np.ndarray:
    columns = [rows[c].to_numpy() for c in group]
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def embedding_groups(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Vectors of equal length link where their cosine is at least `least`; every such pair is found.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing:
    n_links 0, their own id as component. Equal vectors link with each other; repeated rows count
    as other vectors. Rows without an id link and count like any other, but name no component
    unless all its rows lack one: its id is null then, and they are kept. An empty table gives no
    rows; other columns are not read. The centroids and codebooks are fitted on at most SAMPLE
    vectors, which decides the work, not the links.
    """
    spark = rows.sparkSession
    field = rows.schema[vec_col].dataType
    numbers = np.dtype("<f4" if isinstance(field, T.ArrayType) and isinstance(field.elementType, T.FloatType) else "<f8")
    kind = rows.schema[id_col].dataType.simpleString()
    keyed = _keyed(rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")), kind, numbers)  # twice, as vectors are much to write again
    reps = cut(keyed.filter("key is not null").groupBy("dim", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("raw").alias("raw")))
    found = None
    for dim, total in sorted((r["dim"], r["n"]) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = reps.filter(F.col("dim") == dim)
        sample = own.orderBy("key").limit(max(1, SAMPLE * 64 // max(64, dim))).select("raw").collect()
        quantiser = spark.sparkContext.broadcast(Quantiser(unit(np.frombuffer(b"".join(bytes(r["raw"]) for r in sample), numbers).reshape(len(sample), dim)), max(1, total // _of(LIST, dim))))
        links = _links(_dealt(own, quantiser, numbers, least), quantiser, numbers, least, _of(CELL, dim))
        found = links if found is None else found.unionByName(links)
    if found is None:
        return keyed.select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.filter("key is not null").groupBy("key").agg(F.sum("n").alias("links"))
    roots = components(found.filter("a is not null").select("a", "b")).select(F.col("node").alias("key"), "root")
    entries = reps.select("key", "node", F.col("n").alias("copies")).join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = entries.groupBy("root").agg(F.min("node").alias("component"))
    by_key = entries.join(least_id, "root").select("key", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = keyed.select("vec_id", "key").join(cut(by_key), "key", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select(F.col("vec_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op10_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
