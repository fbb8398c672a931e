"""Token counts, round trips, the store and packing against the tokenizers library."""

import collections
import hashlib
import random
import shutil
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_counts, token_store, tokens
from tessera.llm.common import new_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_token_is_proved(path):
    assert tokens.proved(path)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcdeé Zß'stlrem9²½\n\t\r\x0b\x85\xa0\x1c.,!-<|>µª  中́"), max_size=60))
def test_codec_is_the_library(text):
    for path in (BYTE, WORD):
        assert tokens.codec(path, True).encode(text).tolist() == ids(path, text)


def test_blocks_of_a_long_text_join(monkeypatch):
    text = "it's a  long\n\n text with 12 words, and more. " * 50
    monkeypatch.setattr(tokens, "BLOCK", 100)
    for path in (BYTE, WORD):
        assert tokens.codec(path, True).encode(text).tolist() == ids(path, text)


@pytest.mark.parametrize("alphabet", ["ab", "aeioust", "thequick", "é漢a"])
def test_tree_concatenation(alphabet):
    draw = random.Random(alphabet)
    for path in (BYTE, WORD):
        codec = tokens.codec(path, True)
        for size in (1, 7, 63, 500, 3000):
            spelling = "".join(draw.choice(alphabet) for _ in range(size)).encode()
            whole = codec._merge(spelling)
            for leaf in (2, 5, 16, 64):
                assert tokens.concatenated(spelling, codec._merge, codec.vocab.spelling, leaf) == whole


def unsplit_texts():
    """Texts whose pieces are long, in several scripts, with white space, marks and special strings."""
    draw = random.Random(5)
    of = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    texts = [of("aeioust", n) for n in (250, 256, 257, 1000, 16_383, 16_384, 16_385, 32_767, 32_768, 40_001, 70_000)]
    texts += [of("漢字仮名交文", 30_000), of("абвгд", 20_000) + " " + of("xyz", 20_000), of("!?;-", 40_000), "e\u0301" * 20_000, "\u1112\u1161\u11ab" * 15_000, " \n" * 20_000, "7" * 40_000]
    texts += [" ".join(of("abc漢é'", draw.randint(1, 9)) for _ in range(9_000)), of("ab", 40_000) + "<|endoftext|>" + of("ab", 10), "İ" + of("Σσς", 40_000) + "Σ", "a" * 16_384 + "b", "x" * 16_383 + "é" + "x" * 40_000]
    return texts


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_unsplit_texts_take_the_tree(spark, path):
    texts = unsplit_texts()
    rows = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    library = LIBRARY[path]
    want = []
    for i, t in enumerate(texts):
        own = ids(path, t)
        text = library.decode(own, skip_special_tokens=False)
        want.append((i % 20, len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    for long in (1 << 40, 16_384):  # within one task, and dealt over many
        got = bpe.round_trip(rows, path, long=long).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:4]) for r in got)
        taken = [r for r in got if r["n_joined"]]
        assert len(taken) >= 13 or (path == BYTE and long > 16_384)  # tree concatenation encoded these
    for t in texts:
        assert tokens.codec(path, True).encode(t).tolist() == ids(path, t)


def test_counts(odd, odd_rows, none):
    got = sorted(map(repr, (tuple(r) for r in token_counts.token_counts(odd, BYTE).collect())))
    want = sorted(repr((i, len((t or "").encode()), len(ids(BYTE, t)), len(ids(BYTE, t)) > 1024)) for i, t, *_ in odd_rows)
    assert got == want
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = spark.createDataFrame([(1, "Hello wörld 日本"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(table, path).collect()) == [(1, len(model.encode("Hello wörld 日本"))), (2, 0), (3, 0)]


def test_round_trip(odd, odd_rows, none):
    def digests(t):
        own = ids(WORD, t)
        return len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(LIBRARY[WORD].decode(own, skip_special_tokens=False).encode()).hexdigest()

    got = bpe.round_trip(odd, WORD)
    assert sorted(repr(tuple(r)) for r in got.drop("n_joined").collect()) == sorted(repr((i, *digests(t))) for i, t, *_ in odd_rows)
    assert got.filter("doc_id = 141").first()["n_joined"] == 1
    assert bpe.round_trip(none, WORD).count() == 0
    back = bpe.decoded(bpe.encoded(odd, BYTE), BYTE)
    assert sorted(repr(tuple(r)) for r in back.collect()) == sorted(repr((i, LIBRARY[BYTE].decode(ids(BYTE, t), skip_special_tokens=False))) for i, t, *_ in odd_rows)


def stored(spark, odd_rows):
    """What the store must hold: ascending ids, nulls first, starts running on."""
    rows = sorted(((i is not None, i or 0, ids(WORD, t) + [2]) for i, t, *_ in odd_rows), key=lambda r: r[:2])
    return [(i if known else None, own) for known, i, own in rows]


def test_store(spark, odd, odd_rows, none):
    folder = new_folder(spark, "test")
    token_store.write_store(odd, WORD, folder, end_id=2)
    got = sorted(token_store.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    want = stored(spark, odd_rows)
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda own: zlib.crc32(np.array(own, "<u4").tobytes())
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((i, len(o), crc(o)) for i, o in want)
    whole = token_store.read_documents(spark, folder).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in whole) == collections.Counter((i, tuple(o)) for i, o in want)
    chunks = [bytes(r["digest"]) for r in spark.read.parquet(f"{folder}/blocks").filter("kind = 'chunk'").collect()]
    assert len(chunks) == len({*chunks})
    empty = new_folder(spark, "test")
    token_store.write_store(none, WORD, empty, end_id=2)
    assert token_store.read_digests(spark, empty).count() == 0


def test_store_notices_damage(spark, odd):
    folder = new_folder(spark, "test")
    token_store.write_store(odd, WORD, folder)
    rows = spark.read.parquet(f"{folder}/recipes").collect()
    other = [tuple(r)[:-1] + (bytes(reversed(r["recipe"])),) if len(r["recipe"]) > 64 else tuple(r) for r in rows]
    spark.createDataFrame(other, spark.read.parquet(f"{folder}/recipes").schema).write.mode("overwrite").parquet(f"{folder}/recipes2")
    bad = spark.read.parquet(f"{folder}/recipes2").select("doc_id", F.col("local").alias("start"), "n_tokens", "root", "recipe")
    with pytest.raises(Exception, match="root"):
        token_store._chunk_rows(bad).collect()


def _rewritten(spark, folder, name, change):
    """A copy of the store with one of its tables changed."""
    copy = new_folder(spark, "test")
    shutil.copytree(folder, copy)
    shutil.rmtree(f"{copy}/{name}")
    change(spark.read.parquet(f"{folder}/{name}")).coalesce(1).write.parquet(f"{copy}/{name}")
    return copy


def test_store_notices_changes(spark, odd):
    folder = new_folder(spark, "test")
    token_store.write_store(odd.filter("doc_id < 20"), WORD, folder, end_id=2)
    assert token_store.read_digests(spark, _rewritten(spark, folder, "recipes", lambda d: d)).count() == odd.filter("doc_id < 20").count()
    recipes = {
        "swapped ids": lambda d: d.withColumn("doc_id", F.when(F.col("doc_id") == 3, 4).when(F.col("doc_id") == 4, 3).otherwise(F.col("doc_id"))),
        "a changed id": lambda d: d.withColumn("doc_id", F.when(F.col("doc_id") == 3, 300).otherwise(F.col("doc_id"))),
        "a null id": lambda d: d.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))),
        "changed starts": lambda d: d.withColumn("local", F.col("local") + F.when(F.col("doc_id") == 3, 1).otherwise(0)),
        "changed sizes": lambda d: d.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("doc_id") == 3, 1).when(F.col("doc_id") == 4, -1).otherwise(0)),
        "a dropped recipe": lambda d: d.filter("doc_id <> 3"),
        "an added recipe": lambda d: d.unionByName(d.filter("doc_id = 3")),
        "two added recipes": lambda d: d.unionByName(d.filter("doc_id = 3")).unionByName(d.filter("doc_id = 3")),
        "changed rows": lambda d: d.withColumn("row", F.col("row") + F.when(F.col("doc_id") == 19, 1).otherwise(0)),
        "an exchanged root": lambda d: d.withColumn("root", F.when(F.col("doc_id") == 3, F.lit(b"0" * 16)).otherwise(F.col("root"))),
        "nothing left": lambda d: d.filter("false"),
    }
    for name, change in recipes.items():
        with pytest.raises(ValueError, match="manifest"):
            token_store.read_digests(spark, _rewritten(spark, folder, "recipes", change))
            pytest.fail(name)
    for column, value in (("width", 4), ("start", 1), ("tokens", 9), ("docs", 9), ("tree", F.lit(b"0" * 16)), ("root", F.lit(b"0" * 16))):
        for part in (-1, 0):
            change = lambda d: d.withColumn(column, F.when(F.col("part") == part, value).otherwise(F.col(column)).cast(d.schema[column].dataType))  # noqa: B023, E731
            with pytest.raises(ValueError, match="manifest"):
                token_store.read_documents(spark, _rewritten(spark, folder, "manifest", change))
                pytest.fail(column)
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_digests(spark, _rewritten(spark, folder, "manifest", lambda d: d.withColumn("width", F.lit(4))))


def test_chunks_follow_content():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 40_000, 30_000).astype("<u2"), draw.integers(0, 40_000, 777).astype("<u2")

    def chunks(run, ends):
        found, start = [], 0
        for own in token_store.cuts(run, np.array(ends)):
            found.append([])
            for e in own:
                found[-1].append(run[start:e].tobytes())
                start = e
        return found

    alone = chunks(a, [len(a)])[0]
    after = chunks(np.concatenate([b, a]), [len(b), len(b) + len(a)])[1]
    assert alone == after  # what precedes a document in a run doesn't matter
    shifted = chunks(np.concatenate([b, a]), [len(b) + len(a)])[0]
    assert len({*alone} & {*shifted}) > 0.9 * len(alone)
    assert all(len(c) <= 2 * token_store.MOST for c in alone) and all(len(c) >= 2 * token_store.LEAST for c in alone[:-1])
    same = np.full(20_000, 7, "<u2")
    assert b"".join(chunks(same, [len(same)])[0]) == same.tobytes()


def test_crcs_join():
    tables = token_store._crc_tables()
    draw = random.Random(2)
    for _ in range(50):
        a, b = draw.randbytes(draw.randint(0, 90)), draw.randbytes(draw.randint(0, 5000))
        got = token_store.crc_joined(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]), tables)
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("shard", [4, 2048])
def test_packed_digests_without_ids(odd, odd_rows, shard):
    """The registered form: every piece's CRC, those of long documents' inner windows included."""
    own = {i: ids(BYTE, t) + [0] for i, t, *_ in odd_rows if i is not None}
    assert max(map(len, own.values())) > 5 * 1024
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), BYTE, shard=shard).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, own.values()))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_of_one_id_go_to_many_shards(spark, hot):
    rows = spark.createDataFrame([(hot, "one text of a few words")] * 3000, "doc_id long, text string").repartition(3)
    got = packing.pack(rows, BYTE, shard=64)
    shards = {r["s"]: r["n"] for r in got.groupBy((F.col("sequence_id") / 2**32).cast("long").alias("s")).agg(F.count("*").alias("n")).collect()}
    assert len(shards) > 30 and max(shards.values()) < 200


@pytest.mark.parametrize("shard", [4, 2048])
def test_packing(odd, odd_rows, none, shard):
    got = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), BYTE, shard=shard, with_ids=True).collect()
    want = {i: ids(BYTE, t) + [0] for i, t, *_ in odd_rows if i is not None}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        own = want[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids"] == own[r["start"] : r["start"] + r["length"]] and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in want.items():
        at = 0
        for s, n in sorted(pieces[i]):
            assert s == at
            at += n
        assert at == len(own)
    short = 0
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
        short += at < 1024
    assert short <= max(1, -(-len(want) // shard))
    assert packing.pack(none, BYTE).count() == 0


def test_packing_takes_repeats_and_nulls(odd, odd_rows):
    got = packing.pack(odd, BYTE, shard=8).groupBy("doc_id").sum("length").collect()
    want = collections.Counter()
    for i, t, *_ in odd_rows:
        want[i] += len(ids(BYTE, t)) + 1
    assert {r[0]: r[1] for r in got} == want


@pytest.mark.parametrize("dense", [0, 7, 1024])
def test_neighbours_are_bm25(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    draw = np.random.default_rng(4)
    texts = [draw.integers(0, 30, draw.integers(0, 40)) for _ in range(25)]
    index = packing.BM25(texts)
    mean = np.mean([len(t) for t in texts])
    for q in range(25):
        want = np.zeros(25)
        for term in {*texts[q].tolist()}:
            df = sum(term in t for t in texts)
            for d, t in enumerate(texts):
                if tf := int((t == term).sum()):
                    want[d] += np.log1p((25 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(t) / mean))
        assert np.allclose(index.scores(q), want, rtol=1e-4)
    order = list(packing._best(index.scores(0), np.ones(25, bool)))
    assert order == sorted(range(25), key=lambda d: (-index.scores(0)[d], d))
    first = packing.packed([np.array([1, 2, 3]), np.array([9, 9]), np.array([1, 2, 3, 4])], 5)[0]
    assert first == [(0, 0, 3), (2, 0, 2)]


def test_like_documents_share_windows(spark):
    """Families of texts over many shards: pieces of a window come from one family, not from what a shard happens to hold."""
    draw = random.Random(51)
    families = [["".join(draw.choice("abcdefghilmnoprstuv") for _ in range(7)) for _ in range(12)] for _ in range(16)]
    rows = [(i, " ".join(draw.choice(families[i % 16]) for _ in range(6))) for i in range(512)]
    windows = collections.defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, window=128, shard=32).collect():
        windows[r["sequence_id"]].append(r["doc_id"] % 16)
    alike = [a == b for own in windows.values() for a, b in zip(own, own[1:])]
    assert sum(alike) >= 0.7 * len(alike)


def test_bm25_with_frequencies_of_all_texts():
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 30, draw.integers(1, 40)) for _ in range(40)]
    everywhere = np.array([sum(t in x for x in texts) for t in range(30)])
    whole, part = packing.BM25(texts), packing.BM25(texts[:15], (40, np.mean([len(t) for t in texts]), everywhere))
    for q in range(15):
        assert np.allclose(whole.scores(q)[:15], part.scores(q), rtol=1e-4)
