"""URL filters by a sorted digest array.

Rules and listed hosts are strings `host` + `path`, in lists or in tables of any size. Spark hashes
them to 64-bit xxhash digests and sorts them; the sorted columns go, piece by piece, into files that
each executor maps into memory. A URL's candidate strings (its host and the parent domains with no
more labels than some entry has, with the beginnings of its path that have some entry's length) are
hashed and probed together by binary search. A digest found is confirmed by the full string stored
beside it, so collisions can't match.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_folder, table

ALLOW, BLOCK, LISTED = 0, 1, 2
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
#: Rules of the query: (action, host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Hosts that the query's own list blocks, subdomains included, where no rule fits.
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42  #: of the digests, as Spark's xxhash64 has it
COLUMNS = {"keys": np.int64, "sizes": np.int32, "actions": np.int8, "strings": np.uint8}  #: the index's files


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode(), seed=SEED) for s in strings), np.uint64, len(strings)).view(np.int64)


class Shape:
    """What candidates can match: lengths of the entries' paths, the most labels and characters of their hosts."""

    def __init__(self, lengths: list[int], labels: int, longest: int):
        self.lengths, self.labels, self.longest = sorted(lengths), labels, longest

    def candidates(self, host: str, path: str) -> list[str]:
        if not host:
            return []
        domains, end = [], len(host)
        for _ in range(self.labels):
            end = host.rfind(".", 0, end) if end else -1
            if len(host) - end - 1 > self.longest:
                break
            domains.append(host[end + 1 :])
            if end < 0:
                break
        return [d + path[:n] for d in domains for n in self.lengths if n <= len(path)]


class DigestArray:
    """The index's files, mapped into memory."""

    def __init__(self, prefix: str):
        mapped = {c: np.memmap(f"{prefix}-{c}", kind, "r") if os.path.getsize(f"{prefix}-{c}") else np.empty(0, kind) for c, kind in COLUMNS.items()}
        self.keys, self.actions, self.strings = mapped["keys"], mapped["actions"], mapped["strings"]
        self.ends = np.concatenate([[0], np.cumsum(mapped["sizes"], dtype=np.int64)])

    def probe(self, strings: list[str]) -> list[list[tuple[str, int]]]:
        """The entries equal to each string."""
        keys = digests(strings)
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        found: list[list[tuple[str, int]]] = [[] for _ in strings]
        for i in np.flatnonzero(hit):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.strings[self.ends[j] : self.ends[j + 1]].tobytes() == strings[i].encode():
                    found[i].append((strings[i], int(self.actions[j])))
                j += 1
        return found


_MAPPED: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    """The index of a worker, mapped once; the one before it is let go."""
    if name not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[name] = DigestArray(SparkFiles.get(name + "-keys").removesuffix("-keys"))
    return _MAPPED[name]


def _pieces(entries: DataFrame) -> DataFrame:
    """Rows (entry, action) with their digests (key), sorted by Spark, in pieces of the index's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [s.encode() for s in batch.column(1).to_pylist()]
            own = {"keys": batch.column(0).to_numpy(), "sizes": [len(s) for s in strings], "actions": batch.column(2).to_numpy(), "strings": np.frombuffer(b"".join(strings), np.uint8)}
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(own[c], kind).tobytes()], pa.binary()) for c, kind in COLUMNS.items()], [*COLUMNS])

    return entries.select("key", "entry", "action").orderBy("key", "entry", "action").mapInArrow(run, ", ".join(f"{c} binary" for c in COLUMNS))


def write_index(entries: DataFrame, prefix: str) -> Shape:
    """Writes the index of `entries` (entry, action) to files of that prefix and hands them to every executor.

    Null entries are left out, repeated ones stored once. The driver holds one piece at a time, and
    the numbers of the shape.
    """
    spark = entries.sparkSession
    host = F.substring_index("entry", "/", 1)
    known = entries.filter(F.col("entry").isNotNull()).distinct().withColumn("key", F.xxhash64("entry"))
    sizes = known.agg(F.collect_set(F.length("entry") - F.length(host)), F.max(F.size(F.split(host, r"\."))), F.max(F.length(host))).first()
    paths = {c: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{prefix}-{c}") for c in COLUMNS}
    files = {c: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at) for c, at in paths.items()}
    for piece in _pieces(known).toLocalIterator():
        for c, file in files.items():
            file.write(piece[c])
    for c, file in files.items():
        file.close()
        spark.sparkContext.addFile(f"{prefix}-{c}")
    return Shape(sizes[0], sizes[1] or 0, sizes[2] or 0)


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, listed: list[str] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict.

    Rules are (action, entry), `listed` entries; lists, or tables with those columns. The longest
    rule that fits host (or a parent domain) and path decides; of the same string given
    twice, block. Without a rule a listed entry blocks, any other URL is allowed. Null URLs, and
    those without `://`, have empty host and path and fit nothing: allow. Null ids stay; repeated
    rows each give a row; an empty table gives none; other columns are not read. Hosts and paths
    may have any length.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "action string, entry string")
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(s,) for s in listed], "entry string")
    action = F.when(F.col("action") == "block", BLOCK).otherwise(ALLOW).cast("int")
    entries = rules.select("entry", action.alias("action")).unionByName(listed.select("entry", F.lit(LISTED).alias("action")))
    name = f"url-digests-{uuid.uuid4().hex}"
    shape = write_index(entries, f"{new_folder(spark, 'urls')}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(name)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            own = [shape.candidates(*p) for p in parts]
            found = iter(index.probe([c for cs in own for c in cs]))
            rule_of, verdict = [], []
            for cs in own:
                hits = [h for _ in cs for h in next(found)]
                fits = sorted(((len(s), a, s) for s, a in hits if a != LISTED), reverse=True)
                rule_of.append(fits[0][2] if fits else None)
                blocks = fits[0][1] == BLOCK if fits else bool(hits)
                verdict.append("block" if blocks else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule_of, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("id", id_col)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES, LISTED_HOSTS)


_VALUES = ", ".join(f"('{s[: s.index('/')]}', '{s[s.index('/') :]}', '{a}')" for a, s in RULES)
_HOSTS = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
ORACLE = rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules(rule_host, rule_path, action) AS (VALUES {_VALUES}),
listed(name) AS (VALUES {_HOSTS}),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN action
            WHEN EXISTS (SELECT 1 FROM listed WHERE host = name OR ends_with(host, '.' || name)) THEN 'block'
            ELSE 'allow' END AS verdict
FROM fits WHERE place = 1
"""
