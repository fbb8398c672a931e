"""SimHash groups, embedding groups and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import embeddings, simhash
from tessera.llm.components import components


class Union:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(90)]
    union = Union({n for e in edges for n in e})
    for a, b in edges:
        union.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: union.find(n) for n in union.parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_are_the_definition(odd_rows):
    for _, text, *_ in odd_rows:
        if text is None or len(text) < 50_000:
            assert simhash.fingerprint(text, 3) == plain_print(text)


def test_fingerprints_in_blocks(monkeypatch, odd_rows):
    want = simhash.fingerprint(odd_rows[3][1], 3)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(odd_rows[3][1], 3) == want


@pytest.mark.parametrize("cell, crowd, bits", [(512, 4096, 3), (6, 48, 3), (6, 8, 3), (6, 8, 6), (512, 4096, 6)])
def test_links_connect_what_close_pairs_connect(spark, monkeypatch, cell, crowd, bits):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(9)
    centre = draw.getrandbits(64)
    prints = {draw.getrandbits(64) for _ in range(60)} | {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(60)}
    chain = draw.getrandbits(64)
    for _ in range(30):
        prints.add(chain)
        chain ^= sum(1 << b for b in draw.sample(range(64), 3))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    union = Union(signed)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                union.join(a, b)
    got = Union(signed)
    for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect():
        got.join(r["a"], r["b"])
    assert {p: got.find(p) for p in signed} == {p: union.find(p) for p in signed}


def test_simhash_groups(odd, odd_rows, none):
    prints = [plain_print(t) if t is None or len(t) < 50_000 else simhash.fingerprint(t, 3) for _, t, *_ in odd_rows]
    union = Union(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                union.join(a, b)
    least = {}
    for k, (i, *_) in enumerate(odd_rows):
        if i is not None:
            root = union.find(k)
            least[root] = min(least.get(root, i), i)
    want = sorted(repr((i, f"{prints[k]:016x}", least.get(union.find(k)))) for k, (i, *_) in enumerate(odd_rows))
    assert sorted(repr(tuple(r)) for r in simhash.simhash_groups(odd).collect()) == want
    assert simhash.simhash_groups(none).count() == 0


def plain_near(texts, bits=6, size=5, least=0.8):
    """Classes of near copies: Hamming components of fingerprints, and in them all pairs by the Jaccard similarity of their shingles."""
    words = [b" ".join((t or "").encode().lower().split()) for t in texts]
    prints = [simhash.fingerprint(t, 3) for t in texts]
    own = []
    for t in texts:
        w = (t or "").encode().lower().split()
        own.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    close, union = Union(range(len(texts))), Union(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                close.join(a, b)
    for a in range(len(texts)):
        for b in range(a):
            both = len(own[a] & own[b])
            if words[a] == words[b] or (close.find(a) == close.find(b) and both and both >= least * len(own[a] | own[b])):
                union.join(a, b)
    return [union.find(k) for k in range(len(texts))]


@pytest.mark.parametrize("cell", [256, 3])
def test_near_copies(spark, odd, odd_rows, none, vocabulary, monkeypatch, cell):
    monkeypatch.setattr(simhash, "NEAR_ROWS", cell)
    draw = random.Random(41)
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = [*odd_rows]
    for i in range(40):  # near copies of one text, by ever more changed words
        own = [*base]
        for _ in range(i // 4):
            own[draw.randrange(120)] = draw.choice(vocabulary)
        rows.append((1000 + i, " ".join(own), "en", "a", 1))
    docs = odd.unionByName(spark.createDataFrame(rows[len(odd_rows) :], odd.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True)
    roots = plain_near([t for _, t, *_ in rows])
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    got = sorted(repr((r["doc_id"], r["component_id"])) for r in simhash.near_copies(docs).collect())
    assert got == sorted(repr((i, least.get(roots[k]))) for k, (i, *_) in enumerate(rows))
    assert 3 < len({roots[len(odd_rows) + i] for i in range(40)}) < 40
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({*least.values()})
    # of the components without any id one row each stays
    assert ids.count(None) == len({*roots} - {*least})
    assert simhash.keep_first(none).count() == simhash.near_copies(none).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 4, 6])
def test_keys_find_all_close_pairs(bits):
    draw = random.Random(bits)
    masks = simhash._keys(bits)
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a ^ sum(1 << i for i in draw.sample(range(64), bits))
        key = next(m for m in masks if a & m == b & m)
        assert any(a & m == b & m for m in simhash._finer(key, bits)) and all(not m & key for m in simhash._finer(key, bits))


def plain_groups(rows, least=0.9):
    ok = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, union = [0] * len(rows), Union(range(len(rows)))
    for x, (k, i, u) in enumerate(ok):
        for y, (m, j, v) in enumerate(ok):
            if x != y and len(u) == len(v) and (u / np.abs(u).max()) @ (v / np.abs(v).max()) / np.linalg.norm(u / np.abs(u).max()) / np.linalg.norm(v / np.abs(v).max()) >= least:
                links[k] += 1
                union.join(k, m)
    known, name = {k for k, _, _ in ok}, {}
    for k, i, _ in ok:
        if i is not None:
            name[union.find(k)] = min(i, name.get(union.find(k), i))
    components = [name.get(union.find(k)) if k in known else i for k, (i, _) in enumerate(rows)]
    return [(i, links[k], components[k], components[k] == i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("cell", [512, 5])
def test_embedding_groups(spark, monkeypatch, clashes, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    draw = np.random.default_rng(7)
    base = draw.normal(size=(8, 16))
    rows = [(i, (base[i % 8] + draw.normal(size=16) * (0.05 if i % 3 else 0.6)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(4)] + [(300, None), (301, []), (302, [0.0] * 16), (303, [None] + [1.0] * 15), (304, [float("nan")] * 16), (305, [float("inf")] + [0.0] * 15), (None, rows[1][1]), (None, [0.0] * 15 + [-1.0]), (None, [0.0] * 15 + [-2.0]), (None, None), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [3e38] * 16), (309, [-0.0] * 15 + [1.0]), (310, [0.0] * 15 + [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = sorted(map(repr, (tuple(r) for r in embeddings.embedding_groups(table.withColumns({c: F.lit(v) for c, v in clashes.items()})).collect())))
    assert got == sorted(map(repr, plain_groups(rows)))
    assert embeddings.embedding_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("coarse", [4096, 4])
def test_embedding_recall(spark, monkeypatch, coarse):
    """One level of lists, and two."""
    monkeypatch.setattr(embeddings, "COARSE", coarse)
    draw = np.random.default_rng(8)
    base = draw.normal(size=(400, 64))
    vectors = np.concatenate([base, base + draw.normal(size=base.shape) * 0.4, draw.normal(size=(1200, 64))])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.9 * want.sum() > 0


@pytest.mark.parametrize("lists", [4, 20])
def test_look_up_distances_bound_true_ones(monkeypatch, lists):
    monkeypatch.setattr(embeddings, "COARSE", 4)
    draw = np.random.default_rng(9)
    x = embeddings.unit(draw.normal(size=(500, 24)))
    q = embeddings.Quantiser(x, lists)
    assert (q.size > 4) == (lists > 4)
    own = q.lists(x, 1)[:, 0]
    assert (q.lists(x, 3)[:, 0] == own).mean() > 0.8
    codes, missed = q.code(x, own)
    inside = np.flatnonzero(own == own[0])
    found = np.sqrt(np.maximum(q.distances(x[:50], int(own[0]), codes[inside]).T, 0))
    true = np.linalg.norm(x[:50, None] - x[inside], axis=2)
    assert (found - missed[inside] <= true + 1e-3).all() and (true <= found + missed[inside] + 1e-3).all()
    radii = np.array([np.sqrt(((x[own == n] - q.base(np.array([n]))) ** 2).sum(1)).max() if (own == n).any() else -1 for n in range(q.size)])
    asked = q.within(x, own, radii, 0.9)
    for i in range(len(x)):
        near = {int(own[j]) for j in np.flatnonzero(np.linalg.norm(x - x[i], axis=1) <= 0.9)}
        assert {n for n in near if n > own[i]} <= {*asked[i].tolist()} and (np.diff(asked[i]) > 0).all()


@pytest.mark.parametrize("coarse", [4096, 24])
def test_all_links_of_many_lists(spark, monkeypatch, coarse):
    """16,000 vectors in hundreds of lists, of one level and of two: planted pairs near the threshold, and a crowded group."""
    monkeypatch.setattr(embeddings, "COARSE", coarse)
    monkeypatch.setattr(embeddings, "LIST", 50)
    draw = np.random.default_rng(12)
    base = draw.normal(size=(6000, 32))
    vectors = np.concatenate([base, base + draw.normal(size=base.shape) * 0.48, draw.normal(size=32) + draw.normal(size=(4000, 32)) * 0.3]).astype(np.float32)
    unit = embeddings.unit(vectors)
    near = unit @ unit.T >= 0.9
    want = near.sum(1) - 1
    label = np.arange(len(vectors))
    while True:
        # the least label among a row's own and its links'
        new = np.array([label[np.flatnonzero(row)].min() for row in near])
        if (new == label).all():
            break
        label = new
    rows = embeddings.embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()
    assert want[:12_000].sum() > 2000 and np.median(want[12_000:]) > 100
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == {i: (int(n), int(c), bool(i == c)) for i, (n, c) in enumerate(zip(want, label))}


@pytest.mark.parametrize("coarse", [4096, 30])
def test_crowded_near_copies_are_all_linked(spark, monkeypatch, coarse):
    """A third of the rows in one group of near, unequal vectors, over many lists; one level of lists, and two."""
    monkeypatch.setattr(embeddings, "COARSE", coarse)
    monkeypatch.setattr(embeddings, "LIST", 8)
    draw = np.random.default_rng(10)
    centre = draw.normal(size=32)
    vectors = np.concatenate([centre + draw.normal(size=(300, 32)) * 0.2, draw.normal(size=(600, 32))])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    rows = embeddings.embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert want[:300].min() > 200
    assert {r["vec_id"]: r["n_links"] for r in rows} == dict(enumerate(want))
