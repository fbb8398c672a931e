"""All pairs of sets, block by block: where most sets meet, pairs are compared in place and none is shuffled.

A block is one row of up to BLOCK sets: their ids, signatures and item numbers. Every two blocks
meet in a task of a Cartesian product that reads both from the checkpoint, so memory is bounded by
two blocks and nothing but the blocks is written, however many pairs there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

BLOCK = 4096  #: sets of a block, at most
STRIP = 1 << 20  #: pairs that are looked at, and returned, at once
DENSE = 256  #: an item that this share of a block pair holds is counted by a matrix product


def blocks(rows: DataFrame) -> DataFrame:
    """(place, data): (user_id, sig, items) in blocks; nulls in sig or items where a comparison needs none."""
    n = rows.count()
    parts = max(1, math.ceil(n / BLOCK), min(8, math.ceil(n / 512)))

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, BLOCK))
                yield pa.RecordBatch.from_pydict({"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return cut(cut(rows).repartition(parts).mapInArrow(packed, "data binary").select(F.monotonically_increasing_id().alias("place"), "data"))


def _read(data):
    """ids (Arrow), signatures (a matrix), item numbers one after another, sizes."""
    import numpy as np
    import pyarrow as pa

    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    sig, items = table["sig"].combine_chunks(), table["items"].combine_chunks()
    flat = lambda lists: lists.flatten().to_numpy(zero_copy_only=False)
    signed = flat(sig).reshape(table.num_rows, -1) if sig.null_count < len(sig) else None
    sizes = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return table["user_id"].combine_chunks(), signed, flat(items), sizes


def _codes(one, two):
    """Columns of both as small numbers that are equal exactly where the values are."""
    import numpy as np

    found = np.stack([np.unique(c, return_inverse=True)[1].ravel() for c in np.concatenate([one, two]).T])
    found = found.astype(np.uint16 if found.max(initial=0) < 65536 else np.uint32)
    return np.ascontiguousarray(found[:, : len(one)]), np.ascontiguousarray(found[:, len(one) :])


def _bands(signed, rows: int):
    """A number for each band of each signature, of `rows` values each."""
    import numpy as np

    columns = []
    for at in range(0, signed.shape[1] // rows * rows, rows):
        code = np.zeros(len(signed), np.int64)
        for c in signed[:, at : at + rows].T:
            kept = np.unique(c, return_inverse=True)[1].ravel()
            code = np.unique(code * (kept.max(initial=0) + 1) + kept, return_inverse=True)[1].ravel()
        columns.append(code)
    return np.stack(columns, 1) if columns else np.zeros((len(signed), 0), np.int64)


def _both(x, m, y, n):
    """The number of items that each set of one block and each of the other hold."""
    import numpy as np

    common = np.intersect1d(x, y)

    def held(items, sizes):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(common, items), max(0, len(common) - 1))
        kept = common[at] == items if len(common) else np.zeros(len(items), bool)
        at, owner = at[kept], owner[kept]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order], np.bincount(at, minlength=len(common))

    (ax, ox, cx), (ay, oy, cy) = held(x, m), held(y, n)
    dense = cx * cy * DENSE > len(m) * len(n)
    column = np.cumsum(dense) - 1
    left, right = np.zeros((len(m), int(dense.sum())), np.float32), np.zeros((len(n), int(dense.sum())), np.float32)
    for matrix, at, owner in ((left, ax, ox), (right, ay, oy)):
        matrix[owner[dense[at]], column[at[dense[at]]]] = 1
    both = left @ right.T
    ex, ey = np.cumsum(cx), np.cumsum(cy)
    for k in np.flatnonzero(~dense):
        both[np.ix_(ox[ex[k] - cx[k] : ex[k]], oy[ey[k] - cy[k] : ey[k]])] += 1
    return both


def _strips(one, two, same: bool, band_rows: int | None, least: float | None, agreement: bool) -> Iterator[tuple]:
    """Strips of a pair of blocks: first row, masks of pairs (band candidates, similar ones, either None), similarities and equal entries of similar pairs."""
    import numpy as np

    (_, s1, x, m), (_, s2, y, n) = one, two
    if band_rows is not None:
        codes = _bands(np.concatenate([s1, s2]), band_rows)
        b1, b2 = _codes(codes[: len(s1)], codes[len(s1) :])
    if agreement:
        e1, e2 = _codes(s1, s2)
    both = _both(x, m, y, n) if least is not None else None
    step = max(1, STRIP // max(1, len(n)))
    for at in range(0, len(m), step):
        rows = slice(at, min(len(m), at + step))
        shape = (rows.stop - at, len(n))
        allowed = np.arange(at, rows.stop)[:, None] < np.arange(len(n))[None, :] if same else None
        near = similar = sims = equal = None
        if band_rows is not None:
            near = np.zeros(shape, bool)
            for a, b in zip(b1, b2):
                near |= a[rows, None] == b[None, :]
            near = near & allowed if same else near
        if least is not None:
            shared = both[rows]
            total = (m[rows, None] + n[None, :]).astype(np.float32)
            similar = (shared > 0) & (shared * (1 + least) >= (least - 1e-4) * total)  # wide enough for rounding
            if same:
                similar &= allowed
            i, j = np.nonzero(similar)
            hit = shared[i, j].astype(np.int64)
            union = m[rows][i] + n[j] - hit
            sims = ((2_000_000 * hit + union) // (2 * union)) / 1e6  # half up at six digits, as Spark and SQL round
            kept = sims >= least
            similar[i[~kept], j[~kept]] = False
            sims = sims[kept]
        if agreement:
            counted = np.zeros(shape, np.uint16)
            for a, b in zip(e1, e2):
                counted += a[rows, None] == b[None, :]
            equal = counted[similar]
        yield at, near, similar, sims, equal


def _met(blocked: DataFrame) -> DataFrame:
    """(p1, d1, p2, d2): every two blocks, and each with itself, without a shuffle."""
    one, two = (blocked.select(F.col("place").alias(f"p{k}"), F.col("data").alias(f"d{k}")) for k in (1, 2))
    return one.join(two.hint("shuffle_replicate_nl"), F.col("p1") <= F.col("p2"))


def pairs(rows: DataFrame, band_rows: int | None = None, least: float | None = None, agreement: bool = False) -> DataFrame:
    """(u1, u2), u1 < u2: the pairs that share a band, are similar by `least`, or both; with `least` also sim; with `agreement` also same, the number of equal signature entries.

    `rows` has user_id, sig (array<long>) and items (array<long>, numbers of distinct items); a set without items is similar to none.
    """
    kind = rows.schema["user_id"].dataType.simpleString()
    shape = f"a {kind}, b {kind}" + (", sim double" if least is not None else "") + (", same long" if agreement else "")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for p1, d1, p2, d2 in zip(*[batch.column(c) for c in ("p1", "d1", "p2", "d2")]):
                one, two = _read(d1.as_buffer()), _read(d2.as_buffer())
                for at, near, similar, sims, equal in _strips(one, two, p1 == p2, band_rows, least, agreement):
                    mask = near if similar is None else similar
                    if near is not None and similar is not None:
                        kept = near[similar]
                        mask, sims, equal = near & similar, sims[kept], equal[kept] if equal is not None else None
                    i, j = np.nonzero(mask)
                    out = {"a": one[0].take(pa.array(i + at)), "b": two[0].take(pa.array(j))}
                    if sims is not None:
                        out["sim"] = pa.array(sims)
                    if equal is not None:
                        out["same"] = pa.array(equal.astype(np.int64))
                    yield pa.RecordBatch.from_pydict(out)

    rest = [c for c, wanted in (("sim", least is not None), ("same", agreement)) if wanted]
    return _met(blocks(rows)).mapInArrow(run, shape).select(F.least("a", "b").alias("u1"), F.greatest("a", "b").alias("u2"), *rest)


def counts(rows: DataFrame, band_rows: int, least: float) -> DataFrame:
    """One row: f, the pairs that share a band; t, the pairs similar by `least`; hit, those that are both. No pair leaves its task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            f = t = hit = 0
            for p1, d1, p2, d2 in zip(*[batch.column(c) for c in ("p1", "d1", "p2", "d2")]):
                for _, near, similar, _, _ in _strips(_read(d1.as_buffer()), _read(d2.as_buffer()), p1 == p2, band_rows, least, False):
                    f, t, hit = f + int(near.sum()), t + int(similar.sum()), hit + int((near & similar).sum())
            yield pa.RecordBatch.from_pydict({"f": [f], "t": [t], "hit": [hit]})

    found = _met(blocks(rows)).mapInArrow(run, "f long, t long, hit long")
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("f", "t", "hit")])
