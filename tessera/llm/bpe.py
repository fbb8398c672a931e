"""BPE encoding and decoding of whole texts, long unsplit stretches by tree concatenation.

`tokens.halves` has the method: halves of unsplit text are encoded on their own, and growing
windows around each join are encoded again until both sides agree exactly. A piece of more than
`tokens.LEAF` bytes is joined from such leaves. Texts of LONG characters or more are dealt over
tasks: one task splits the text into pieces, a piece of more than SEGMENT bytes into segments;
segments and groups of pieces are encoded in parallel, wherever there is room; then one task joins
the segments' ends and streams the document's digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import table

LONG = 32_768  #: characters from which a text is dealt over tasks
SEGMENT = 16_384  #: bytes of a long piece, or of a group of pieces, that one row holds


class Digester:
    """Token count and digests of ids and decoded texts, from the strings of words; one for each worker."""

    def __init__(self, path: str, short: bool):
        self.codec = tokens.codec(path, short)
        self.names = self.codec.vocab.names
        self.strings = tokens.Cache(self._strings)
        # without a decoder in the file, the library joins the names of the tokens by blanks
        self.joins = self.codec.library.decoder is None
        self.joined = 0  # pieces by tree concatenation in the text read last

    def _strings(self, piece: str) -> tuple[int, str, str]:
        ids = self.codec.vocab.ids[self.codec.ranks_of(piece)].tolist()
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        self.joined = 0
        if text and self.joins and self.codec.shortly(text):
            for block in self.codec.pieces(text):
                if not block:
                    continue
                sizes, ids, names = zip(*map(self.strings.__getitem__, block))
                if 4 * max(map(len, block)) >= tokens.LEAF:  # a character has four bytes at most
                    self.joined += sum(self.codec.size(piece) > tokens.LEAF for piece in block)
                lead = " " if n else ""
                n += sum(sizes)
                ids_hash.update((lead + " ".join(ids)).encode())
                text_hash.update((lead + " ".join(names)).encode())
        else:
            ids = self.codec.encode(text).tolist()
            n = len(ids)
            ids_hash.update(" ".join(map(str, ids)).encode())
            text_hash.update((self.codec.library.decode(ids, skip_special_tokens=False) if ids else "").encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and `ids array<int>`, as the tokenizers library encodes the text without special tokens.

    Null and empty texts have no ids; null ids stay; repeated rows are encoded row by row; an
    empty table gives no rows; other columns are not read.
    """
    short = tokens.proved(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(path, short)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t).astype("int32") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and the `text` that the library decodes, special tokens kept; null ids give empty text."""
    short = tokens.proved(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokens.codec(path, short).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(library.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False), pa.string())], ["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


_DIGESTERS: dict[str, Digester] = {}


def _digester(path: str, short: bool) -> Digester:
    """The worker's digester, kept between tasks with its caches."""
    if path not in _DIGESTERS:
        _DIGESTERS[path] = Digester(path, short)
    return _DIGESTERS[path]


#: What a row of a dealt text holds: whole pieces, a segment of one piece, or a text for the library.
GROUP, PART, LIBRARY = 0, 1, 2


def _cut_up(text: str, codec: tokens.Codec) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows (kind, piece, data) of a text, in order; `piece` numbers the pieces that are cut."""
    if not codec.shortly(text):
        yield LIBRARY, 0, [text.encode()]
        return
    group: list[bytes] = []
    size = cut = 0
    for block in codec.pieces(text):
        for piece in block:
            data = piece.encode()
            if len(data) > SEGMENT or size > SEGMENT:
                yield GROUP, 0, group
                group, size = [], 0
            if len(data) > SEGMENT:
                data += codec.end
                cut += 1
                # only the last segment has the mark of a word's end, so it must have a byte before that
                for at in range(0, len(data) - 1, SEGMENT):
                    yield PART, cut, [data[at : at + SEGMENT] if at + SEGMENT < len(data) - 1 else data[at:]]
            else:
                group.append(data)
                size += len(data)
    yield GROUP, 0, group


def _dealt(docs: DataFrame, path: str, short: bool) -> DataFrame:
    """Digest rows of texts whose pieces are encoded in parallel and joined."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(path, short)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                i = batch.column("id").filter(pa.compute.equal(batch.column("key"), key))
                rows = [(seq, *row) for seq, row in enumerate(_cut_up(text, codec))]
                whose = pa.concat_arrays([i] * len(rows))
                seqs, kinds, pieces, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), whose, pa.array(seqs, pa.int64()), pa.array(kinds, pa.int32()), pa.array(pieces, pa.int64()), pa.array(data, pa.list_(pa.binary()))], ["key", "id", "seq", "kind", "piece", "data"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(path, short)
        for batch in batches:
            found, joined = [], []
            for what, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
                joined.append(0)
                if what == LIBRARY:
                    ids = codec.library.encode(data[0].decode(), add_special_tokens=False).ids
                elif what == PART:
                    ids = codec.ranks(data[0])
                else:
                    joined[-1] = sum(n + len(codec.end) > tokens.LEAF for n in map(len, data))
                    ids = np.frombuffer(codec.coded([piece.decode() for piece in data]), codec.dtype)
                found.append(np.asarray(ids, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "seq", "kind", "piece")), pa.array(found, pa.binary()), pa.array(joined, pa.int64())], ["key", "id", "seq", "kind", "piece", "ids", "joined"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by text and place; a text's ids go into its digests as they come."""
        codec = tokens.codec(path, short)
        spaced = codec.library.decoder is None
        names = [codec.vocab.names.get(i, "") for i in range(max(codec.vocab.names) + 1)]
        numbers = [*map(str, range(len(names)))]
        now = None

        class Text:
            def __init__(self, key: int, whose: pa.Array):
                self.key, self.whose, self.n, self.joined = key, whose, 0, 0
                self.ids_hash, self.text_hash = hashlib.sha256(), hashlib.sha256()
                self.open: list[list[int]] = []  # ranks of the segments of the piece that is being read
                self.piece, self.held = 0, []

            def add(self, ids: list[int]) -> None:
                if ids:
                    lead = " " if self.n else ""
                    self.n += len(ids)
                    self.ids_hash.update((lead + " ".join([numbers[i] for i in ids])).encode())
                    if spaced:
                        self.text_hash.update((lead + " ".join([names[i] for i in ids])).encode())
                    else:
                        self.held += ids

            def close(self) -> None:
                if self.open:
                    self.joined += 1
                    self.add(codec.vocab.ids[tokens.halves(self.open, codec._merge, codec.vocab.spelling)].tolist())
                    self.open = []

            def row(self) -> pa.RecordBatch:
                self.close()
                if self.held:
                    self.text_hash.update(codec.library.decode(self.held, skip_special_tokens=False).encode())
                return pa.RecordBatch.from_arrays([self.whose, pa.array([self.n], pa.int64()), pa.array([self.ids_hash.hexdigest()]), pa.array([self.text_hash.hexdigest()]), pa.array([self.joined], pa.int64())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joined"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "kind", "piece", "ids", "joined"))
            for at, (key, what, piece, data, joined) in enumerate(zip(*columns)):
                if now is None or key != now.key:
                    if now is not None:
                        yield now.row()
                    now = Text(key, batch.column("id").slice(at, 1))
                ids = np.frombuffer(data, "<u4").tolist()
                now.joined += joined
                if what != PART or piece != now.piece:
                    now.close()
                if what == PART:
                    now.piece = piece
                    now.open.append(ids)
                else:
                    now.add(ids)
        if now is not None:
            yield now.row()

    keyed = docs.withColumn("key", F.monotonically_increasing_id())
    rows = keyed.select("key", "id", "text").mapInArrow(cut_up, f"key long, id {kind}, seq long, kind int, piece long, data array<binary>")
    spread = rows.repartition("key", "seq").mapInArrow(encoded, f"key long, id {kind}, seq long, kind int, piece long, ids binary, joined long")
    return spread.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(together, _shape(kind))


def _shape(kind: str) -> str:
    return f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joined long"


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (decimal ids joined by one blank), decoded_sha256 and n_joined.

    Ids and decoded text are those of `encoded` and `decoded`; here they go straight into the
    digests, so that neither leaves the worker. `n_joined` counts the pieces that tree
    concatenation encoded. Null and empty texts: no tokens, the digests of the empty string. Texts
    of any length and script are encoded whole, those of `long` characters or more over several
    tasks. Null ids stay; repeated rows each give a row; an empty table gives none; other columns
    are not read.
    """
    short = tokens.proved(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = _digester(path, short)
        for batch in batches:
            found = [(*digester.digests(t), digester.joined) for t in batch.column(1).to_pylist()]
            n, ids, text, joined = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string()), pa.array(joined, pa.int64())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joined"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not short:
        return rows.mapInArrow(run, _shape(kind)).withColumnRenamed("id", id_col)
    large = F.coalesce(F.length("text") >= long, F.lit(False))
    found = rows.filter(~large).mapInArrow(run, _shape(kind)).unionByName(_dealt(rows.filter(large), path, short))
    return found.withColumnRenamed("id", id_col)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
