"""Each stage of the pipeline, and all of them, against plain versions."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_groups import plain_near

from tessera.llm import secrets, toxicity
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect()}
    kept = clean.cache()
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < 0.3}
    single = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert single.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    ids = sorted(texts)
    root = dict(zip(ids, plain_near([texts[i] for i in ids])))
    first = {}
    for i in ids:
        first.setdefault(root[i], i)
    alone = single.cache()
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(first.values())
    masked = corpus_pipeline.mask_secrets(spark, alone, SF)
    assert masked.columns == docs.columns
    for r in masked.collect():
        before = texts[r["doc_id"]]
        assert r["text"] == secrets.redacted(before, secrets.secret_spans(before))
        assert not secrets.base_spans(r["text"])
    packed = corpus_pipeline.pack_windows(spark, masked, SF)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in masked.collect()}
    assert {r[0]: r[1] for r in packed.groupBy("doc_id").sum("length").collect()} == want
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secret_scans", "packing"]


def test_odd_and_empty_documents(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, none):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF).cache()
            assert now.count() >= (1 if start is docs else 0)
