"""Token counts by the whole-token shortcut.

Offline, `tokens.proof` shows which vocabulary strings encode alone as one token. A pre-token
that is such a string counts one, without any merge; only the rest are merged, each distinct
one once while it stays in a worker's bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import table


class Counter:
    """Counts tokens of texts; one for each task."""

    def __init__(self, path: str, short: bool, whole: frozenset[str]):
        self.codec = tokens.codec(path, short)
        self.whole = dict.fromkeys(whole, 1)
        self.rest = tokens.Cache(lambda piece: len(self.codec.ranks_of(piece)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.codec.shortly(text):
            return len(self.codec.library.encode(text, add_special_tokens=False).ids)
        n, whole, rest = 0, self.whole, self.rest
        for block in self.codec.pieces(text):
            others = [piece for piece in block if piece not in whole]
            n += len(block) - len(others) + sum(map(rest.__getitem__, others))
        return n


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are proved to encode alone as one token; no more than the vocabulary."""
    proof = tokens.proof(path)
    if proof is None:
        return frozenset()
    vocab = tokens.vocabulary(path)
    found = set()
    for spelling, alone in zip(vocab.spelling, proof):
        if alone and (not vocab.suffix or spelling.endswith(b"\xff")):
            try:
                found.add(spelling.removesuffix(b"\xff").decode() if vocab.suffix else spelling.decode())
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token is this
    return frozenset(found)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", library: str = "") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    `path` names a .json file (tokenizers) or a .model file (sentencepiece, `library`); no special
    tokens are added, and special strings inside texts are handled as the library does. Null and
    empty texts have no bytes and no tokens; null ids stay null; repeated rows are counted row by
    row; other columns of `docs` are not read. An empty table gives no rows. Long texts are
    counted whole, in blocks.
    """
    plain = path.endswith(".model")
    short = not plain and tokens.proved(path)
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(path) if short else frozenset())  # the vocabulary's size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if plain:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(model.encode(t)) if t else 0
        else:
            count = _counter(path, short, shared).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(map(count, texts), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str, short: bool, shared) -> Counter:
    """The worker's counter, kept between tasks with its caches."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, short, shared.value)
    return _COUNTERS[path]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
