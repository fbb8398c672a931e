"""Secret scans by assignment-aware lexing.

Three base patterns come first. Then source and configuration syntax is read as name-literal
pairs (`name = "literal"`, `"name": "literal"`, `name: literal`, `name := ...`, `name => ...`, an
XML element's text), names that stand for other names or for literals joined by `+` are followed
to the literals themselves, and each literal is scored by how sensitive the names are that it
ends in. Literals at or over the threshold that no base span covers are added as kind `literal`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

KINDS = ("assign", "access", "hex", "literal")
#: A-Z and a-z only: other letters that fold to these are not meant.
_either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile(
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a run of 24 or more is what remains of [0-9a-f]+
_STEMS = ("password", "passwd", "secret", "token", "api")  # in every text with an assign match

#: How sensitive a target name is, by a part of it; the most sensitive part counts.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 0.9, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "bearer": 0.8, "authkey": 0.9, "connectionstring": 0.7,
}
#: Values that only hold a place.
PLACEHOLDERS = frozenset({"changeme", "example", "none", "null", "true", "false", "password", "secret", "token", "undefined", "redacted", "placeholder", "your_password"})
_LONGEST = max(map(len, PLACEHOLDERS))
#: Parts of names, lower-cased with `_`, `-`, `.` and `$` left out; a text without any, read so too, has no sensitive name.
_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "connection")
_OPERATOR = re.compile(r"(?::=|=>|(?<![=!<>])=(?!=)|:(?![:/]))[ \t]*")
_QUOTED = re.compile(r"""[rbuf]?"((?:[^"\\\n]|\\.)*+)"|[rbuf]?'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`""")
_PLAIN = re.compile(r"""[^\s,;"'`{}\[\]()<>+]+""")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*")
_ELEMENT = re.compile(r"<([A-Za-z][\w.-]*+)>([^<>\n]++)</\1>")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*\Z")
THRESHOLD = 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    joined = re.sub(r"[\W_]", "", name).lower()
    return max((s for part, s in NAME_SCORES.items() if part in joined), default=0.0)


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret: 0 for placeholders and references, more with length and mixture."""
    return tail_scores(literal, 0, len(literal), [0])[0]


_CLASSES = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))


def tail_scores(text: str, first: int, end: int, starts: list[int]) -> dict[int, float]:
    """The scores of the literals that begin at `starts`, ascending from `first`, and all end at `end`; the text is read once."""
    while end > first and text[end - 1].isspace():
        end -= 1
    seen: Counter = Counter()
    found, bits, at = {}, 0.0, end  # bits: the sum of n log2(n) over the counts
    mixed = [False] * len(_CLASSES)
    for start in reversed(starts):
        piece = text[start:at]
        for c, n in Counter(piece).items():
            had = seen[c]
            seen[c] = had + n
            bits += (had + n) * math.log2(had + n) - (had * math.log2(had) if had else 0.0)
        mixed = [m or bool(p.search(piece)) for m, p in zip(mixed, _CLASSES)]
        at = start
        begin = start
        while begin < end and text[begin].isspace():
            begin += 1
        size = end - begin
        if size < 6 or text[begin] in "$<{%" or (size <= _LONGEST and text[begin:end].lower() in PLACEHOLDERS):
            found[start] = 0.0
            continue
        # white space before the literal is no part of it
        own, total = (seen, bits) if begin == start else (own := Counter(text[begin:end]), sum(n * math.log2(n) for n in own.values()))
        kinds = mixed if begin == start else [bool(p.search(text, begin, end)) for p in _CLASSES]
        if len(own) < 4 or " " in own:
            found[start] = 0.0
            continue
        found[start] = min(1.0, 0.4 + 0.1 * (math.log2(size) - total / size) + 0.1 * (sum(kinds) - 1))
    return found


class Term:
    """One term of a right side: its literal, whether that is a name, and where the term after a `+` begins (-1 without)."""

    def __init__(self, start: int, end: int, name: str, after: int):
        self.start, self.end, self.name, self.after = start, end, name, after


class Terms:
    """The terms of a text by where they begin; each stretch of text is read once, however many terms end with it."""

    def __init__(self, text: str):
        self.text, self.at = text, {}
        self.run = (0, 0, -1)  # the plain run read last, and what follows it
        self.runs: dict[int, list[int]] = {}  # starts of plain terms by end

    def get(self, at: int) -> Term | None:
        if at not in self.at:
            self.at[at] = self._read(at)
        return self.at[at]

    def _after(self, end: int) -> int:
        plus = _PLUS.match(self.text, end)
        return plus.end() if plus else -1

    def _read(self, at: int) -> Term | None:
        if quoted := _QUOTED.match(self.text, at):
            return Term(*quoted.span(quoted.lastindex), "", self._after(quoted.end()))
        start, end, after = self.run
        if not start <= at < end:
            plain = _PLAIN.match(self.text, at)
            if not plain:
                return None
            end = plain.end()
            after = self._after(end)
            self.run = (at, end, after)
        name = _NAME.match(self.text, at, end)
        self.runs.setdefault(end, []).append(at)
        return Term(at, end, name[0] if name else "", after)


def _target(text: str, end: int) -> str:
    """The name that ends at `end`, quoted or plain; empty if there is none."""
    stop = end
    quote = text[end - 1] if end and text[end - 1] in "\"'" else ""
    if quote or (end and text[end - 1] == "]"):
        stop = end - 1
        if not quote and stop and text[stop - 1] in "\"'":  # os.environ["NAME"] = ...
            stop -= 1
    start = stop
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-$"):
        start -= 1
    return text[start:stop]


def pairs(text: str) -> tuple[list[tuple[str, int]], Terms]:
    """The target names of source or configuration text, each with where its right side's terms begin."""
    found, terms = [], Terms(text)
    for m in _OPERATOR.finditer(text):
        end = m.start()
        while end and text[end - 1] in " \t":
            end -= 1
        name = _target(text, end)
        if name and (name[0].isalpha() or name[0] in "_$"):
            found.append((name, m.end()))
    return found, terms


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Literals that sensitive names come to hold, directly or through other names.

    Names are followed from the most sensitive one on, and each pair, name and term is visited
    once, by the highest score that reaches it; so the work grows with the text.
    """
    low = text.lower().replace("_", "").replace("-", "").replace(".", "").replace("$", "")
    if not any(h in low for h in _HINTS) or not ("=" in text or ":" in text or "</" in text):
        return []
    found, terms = pairs(text)
    own: dict[str, list[int]] = {}
    for name, at in found:
        own.setdefault(name, []).append(at)
    elements = [(m[1], m.span(2)) for m in _ELEMENT.finditer(text)]
    held: dict[str, list[tuple[int, int]]] = {}  # what elements of a name hold
    for name, span in elements:
        held.setdefault(name, []).append(span)
    scores = sorted(((score, name) for name in own.keys() | held.keys() if (score := name_score(name))), reverse=True)
    best: dict[tuple[int, int], float] = {}
    firsts: set[int] = set()
    later: set[int] = set()
    names: set[str] = set()
    for score, sensitive in scores:
        todo = [sensitive]
        while todo:
            name = todo.pop()
            if name in names:
                continue
            names.add(name)
            for span in held.get(name, ()):
                best.setdefault(span, score)
            for at in own.get(name, ()):
                first = True
                # a name that starts a right side may be a literal as well, unless the text defines it
                while at >= 0 and at not in (firsts if first else later) and (term := terms.get(at)):
                    (firsts if first else later).add(at)
                    known = term.name in own or term.name in held
                    if term.name and known:
                        todo.append(term.name)
                    if not term.name or (first and not known):
                        best.setdefault((term.start, term.end), score)
                    at, first = term.after, False
    # plain literals that end together are scored in one go
    scored: dict[tuple[int, int], float] = {}
    for end, starts in terms.runs.items():
        wanted = sorted(s for s in {*starts} if (s, end) in best)
        if wanted:
            scored |= {(s, end): v for s, v in tail_scores(text, wanted[0], end, wanted).items()}
    return sorted(span for span, score in best.items() if score * (scored[span] if span in scored else literal_score(text[span[0] : span[1]])) >= threshold)


def _uncovered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that lie in no base span; both come sorted."""
    reach, at = -1, 0
    for s, e in spans:
        while at < len(base) and base[at][0] <= s:
            reach = max(reach, base[at][2])
            at += 1
        if e > reach:
            yield s, e


def secret_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    added = [(s, 3, e) for s, e in _uncovered(literal_spans(text, threshold), base)]
    return sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_literal.

    Spans are `kind:start:end` in code points, end exclusive, ordered by start and then kind.
    Null and empty texts have none; null ids stay; repeated rows each give a row; an empty table
    gives none; other columns are not read. Texts of any length are scanned whole, in time that grows with the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = [secret_spans(t, threshold) for t in batch.column(1).to_pylist()]
            count = lambda k: pa.array([sum(x[1] == k for x in spans) for spans in all_spans], pa.int64())
            base = [hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in all_spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array(map(joined, all_spans), pa.string()), count(3)], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")
    return found.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in the text replaced by the mark; all columns stay, and n_chars follows the text if there is one.

    Null texts stay null; rows without secrets are unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [redacted(t, spans, mark) if t and (spans := secret_spans(t, threshold)) else t for t in batch.column(names.index(text_col)).to_pylist()]
            at = names.index(text_col)
            columns = [*batch.columns]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(kind))
    return out


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
