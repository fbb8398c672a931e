"""Exact and fast byte-pair encoding for the two shapes of public tokenizer file.

The tokenizers library defines every id. Its own speed is one to two MB a second, so texts take a
shorter way to the same ids: they are split by the file's pattern (Latin-1 text by an equal pattern
here, other text by the library's own normaliser and splitter) and each piece is merged by rank, in
a word vocabulary once while it stays in a bounded cache; long pieces by tree concatenation. Texts
that hold a special token's string go to the library whole.

Why the shorter way is exact. A rank merger joins two neighbours whenever their concatenation
is a token; the file lists one pair for each token. The two agree if each token's own string,
merged by the listed pairs alone, ends as that token: when a pair spells token t, nothing of
lower rank has crossed the ends of its span, so what is inside is what t alone has come to at
that rank, which is the listed pair. `proof` checks this for every token; where any fails, all
texts go to the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

#: Latin-1 letters, numbers and white space, as Unicode's L, N and White_Space give them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
#: Fixed value: the split pattern that files of the word shape hold.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: That and the byte shape's, for Latin-1 text only; letters first, as no two alternatives but the quotes' start alike.
BYTE_SPLIT = f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_BYTE_PIECES = re.compile(BYTE_SPLIT)
_WORD_PIECES = re.compile(f"[{LETTER}]+|[{NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{LETTER}{NUMBER}]+")
#: Ends a word in the byte strings of word vocabularies; UTF-8 never holds it.
_END = b"\xff"

CACHE_WORDS = 200_000  #: words that a cache holds at most; it is emptied when full
LONG_WORD = 200  #: characters from which a word is not kept
LEAF = 256  #: bytes from which unsplit text is encoded in halves
BLOCK = 1 << 20  #: characters from which a text is split block by block


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte, by the byte-level rule.

    Bytes that print stand for themselves; the others get the characters from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Ranks, ids and byte strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.names: dict[int, str] = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}

        def spelt(name: str) -> bytes:
            stem = name.removesuffix(self.suffix) if self.suffix else name
            return b"".join(byte_of[c] for c in stem) + (_END if stem != name else b"")

        alphabet = byte_alphabet()
        base = [(bytes([b]), c) for b, c in enumerate(alphabet)]
        if self.suffix:
            base += [(bytes([b]) + _END, c + self.suffix) for b, c in enumerate(alphabet)]
        try:
            merged = [(spelt(a), spelt(b), a + b if not self.suffix or not a.endswith(self.suffix) else None) for a, b in merges]
            self.spelling = [s for s, _ in base] + [a + b for a, b, _ in merged]
            self.ids = np.array([model["vocab"].get(n, -1) for _, n in base] + [model["vocab"][n] for _, _, n in merged], np.int64)
            self.regular = self._shape(spec) and len({*self.spelling}) == len(self.spelling) and bool((self.ids >= 0).all())
        except KeyError:
            self.regular = False
            return
        self.ranks = {s: r for r, s in enumerate(self.spelling)}
        self.first_merge = len(base)
        self.pairs = {(self.ranks[a], self.ranks[b]): self.first_merge + i for i, (a, b, _) in enumerate(merged)}

    def _shape(self, spec: dict) -> bool:
        """Whether the file is one of the two shapes that the shorter way reproduces."""
        model, before, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and model["type"] == "BPE" and not spec.get("post_processor") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not self.suffix:
            return plain and normal is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        steps = before.get("pretokenizers") or [{}, {}]
        kinds = [n["type"] for n in (normal or {}).get("normalizers", [])]
        return plain and kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": WORD_SPLIT} and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]

    def listed(self, spelling: bytes) -> list[int]:
        """The ranks that the listed pairs alone make of a byte string."""
        ended = bool(self.suffix) and len(spelling) > 1 and spelling.endswith(_END)
        units = [self.ranks[bytes([b])] for b in (spelling[:-1] if ended else spelling)]
        if ended:
            units[-1] = self.ranks[spelling[-2:]]
        while len(units) > 1:
            rank, at = min((self.pairs.get(p, len(self.spelling)), i) for i, p in enumerate(zip(units, units[1:])))
            if rank == len(self.spelling):
                break
            units[at : at + 2] = [rank]
        return units


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def proof(path: str) -> np.ndarray | None:
    """For each rank, whether its string alone is encoded as that one token; None for other file shapes.

    Made once, on the driver; its size is the vocabulary's.
    """
    vocab = vocabulary(path)
    if not vocab.regular:
        return None
    return np.array([vocab.listed(s) == [r] for r, s in enumerate(vocab.spelling)])


def proved(path: str) -> bool:
    """Whether the shorter way gives the library's ids."""
    found = proof(path)
    return found is not None and bool(found.all())


class Cache(dict):
    """Values of words, made when first asked for.

    Bounded by two generations: when the young one is full it becomes the old one, and an old
    word that is asked for again moves to the young one, so frequent words stay.
    """

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) < LONG_WORD:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def latin(text: str) -> bool:
    """Whether a text lies within Latin-1."""
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Codec:
    """Encodes texts; one for each file and worker process."""

    def __init__(self, path: str, short: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab = vocabulary(path)
        self.short = short
        self.dtype = np.dtype("<u4" if max(self.vocab.names) >= 1 << 16 else "<u2")
        if short:
            import tiktoken

            self._ranker = tiktoken.Encoding("ranks", pat_str=BYTE_SPLIT, mergeable_ranks=self.vocab.ranks, special_tokens={})
            self._merge = self._ranker._core_bpe.encode_single_piece
            self._ids = self.vocab.ids.astype(self.dtype)
            self._code = [int(i).to_bytes(self.dtype.itemsize, "little") for i in self.vocab.ids]
        self._pieces = Cache(self.piece, 3 * CACHE_WORDS)

    @property
    def end(self) -> bytes:
        """What ends a piece's byte string."""
        return _END if self.vocab.suffix else b""

    def size(self, piece: str) -> int:
        """Bytes of a piece's string."""
        return len(piece.encode()) + len(self.end)

    def ranks(self, spelling: bytes) -> list[int]:
        """Ranks of one unsplit byte string; long ones by concatenating halves."""
        return self._merge(spelling) if len(spelling) <= LEAF else concatenated(spelling, self._merge, self.vocab.spelling)

    def ranks_of(self, piece: str) -> list[int]:
        return self.ranks(piece.encode() + self.end)

    def piece(self, piece: str) -> bytes:
        return b"".join([self._code[r] for r in self.ranks_of(piece)])

    def coded(self, pieces: list[str]) -> bytes:
        """The ids of pieces, as bytes of the codec's type."""
        return b"".join(map(self._pieces.__getitem__, pieces))

    def shortly(self, text: str) -> bool:
        """Whether the shorter way may take a text."""
        return self.short and not any(s in text for s in self.vocab.specials)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text that `shortly` admits, in blocks of bounded size.

        A word vocabulary's normaliser only lowers Latin-1 text and changes white space, which
        its pieces never hold.
        """
        if not latin(text):
            normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            spans = self.library.pre_tokenizer.pre_tokenize_str(normal)
            for at in range(0, len(spans), BLOCK // 8):
                yield [normal[s:e] for _, (s, e) in spans[at : at + BLOCK // 8]]
            return
        if self.vocab.suffix:
            find, text = _WORD_PIECES, text.lower()
        else:
            find = _BYTE_PIECES
        if len(text) < BLOCK:
            yield find.findall(text)
            return
        found = find.finditer(text)
        while block := [m.group() for m in islice(found, BLOCK // 8)]:
            yield block

    def encode(self, text: str | None) -> np.ndarray:
        """The library's ids of a whole text; null is empty."""
        if not text:
            return np.empty(0, self.dtype)
        if not self.shortly(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        if not self.vocab.suffix and len(text) < BLOCK and latin(text):
            return self._ids[np.array(self._ranker.encode_ordinary(text), np.intp)]
        return np.frombuffer(b"".join(map(self.coded, self.pieces(text))), self.dtype)


def concatenated(spelling: bytes, merge: Callable[[bytes], list[int]], spell: list[bytes], leaf: int = LEAF) -> list[int]:
    """Ranks of a long unsplit byte string, by tree concatenation.

    Halves are encoded alone. Around each join the last tokens of the left half and the first of
    the right are encoded again as one, in windows that double until both sides agree: the new
    tokens leave the outer neighbours of the window as they are, that is, the pair at either edge
    encodes as itself. A sequence of self-encoding tokens whose neighbours are all such pairs is
    the encoding of its text, so the result is exact. Depth is the logarithm of the length.
    """

    return halves([merge(spelling[i : i + leaf]) for i in range(0, len(spelling), leaf)], merge, spell)


def halves(level: list[list[int]], merge: Callable[[bytes], list[int]], spell: list[bytes]) -> list[int]:
    """The ranks of one byte string from those of its consecutive parts, joined two by two."""

    def keeps(a: int, b: int) -> bool:
        return merge(spell[a] + spell[b]) == [a, b]

    def join(left: list[int], right: list[int]) -> list[int]:
        width = 1
        while True:
            i, j = min(width, len(left)), min(width, len(right))
            middle = b"".join(spell[t] for t in left[len(left) - i :] + right[:j])
            window = merge(middle)
            fits_left = i == len(left) or keeps(left[-i - 1], window[0])
            fits_right = j == len(right) or keeps(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            width *= 2

    while len(level) > 1:
        level = [join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else []


@lru_cache(maxsize=4)
def codec(path: str, short: bool) -> Codec:
    """The codec of a worker; `short` is what `proved` said on the driver."""
    return Codec(path, short)
