"""Document fingerprints by winnowing, in DataFrame functions only.

Each word is hashed once; rolling hashes of k words come from them by rotations and exclusive ors
(a cyclic polynomial), in windows that double, so a gram takes log k steps. Of every `window`
consecutive grams the least hash is chosen, the rightmost of equals, and its position is kept. A
passage of at least window + k - 1 words that two texts share has a hash chosen in both. Texts
with fewer words than k have one gram, the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

GRAM = 5  #: words in a gram
WINDOW = 8  #: grams in a window
ROWS = 2000  #: documents in a run of consecutive ids, about
RUNS = 1_000_000  #: runs whose first keys go into the plan; larger tables have longer runs, not more


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _zipped(a: Column, b: Column, offset: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(a[i], b[i + offset]) wherever both exist; `a` is no longer than `b`, which is longer than the offset."""
    n = F.least(F.size(a), F.size(b) - offset)
    return F.zip_with(F.slice(a, 1, n), F.slice(b, F.lit(offset + 1), n), join)


def rolled(words: Column, k: int) -> Column:
    """Rolling hashes of every k consecutive values of an array<long> of at least k."""

    def grown(now: Column, width: int, bits: str) -> Column:
        if not bits:
            return now
        twice = _zipped(now, now, width, lambda x, y: _turned(x, width).bitwiseXOR(y))
        if bits[0] == "0":
            return _let(twice, lambda t: grown(t, 2 * width, bits[1:]))
        more = lambda t: _zipped(t, words, 2 * width, lambda x, y: _turned(x, 1).bitwiseXOR(y))
        return _let(twice, lambda t: _let(more(t), lambda m: grown(m, 2 * width + 1, bits[1:])))

    return grown(words, 1, f"{k:b}"[1:])


def least(grams: Column, window: int) -> Column:
    """Of every `window` consecutive grams (hash, position) the one of least hash, the rightmost of equals; at least `window` grams."""
    right = lambda x, y: F.when(y["hash"] <= x["hash"], y).otherwise(x)

    def grown(now: Column, width: int) -> Column:
        if width == window:
            return now
        step = min(width, window - width)  # the two windows may overlap
        return _let(_zipped(now, now, step, right), lambda t: grown(t, width + step))

    return grown(grams, 1)


def winnow(text: Column, k: int = GRAM, window: int = WINDOW) -> Column:
    """struct<hash: array<long>, position: array<int>> of the chosen grams, in order.

    Null and empty texts, and those of white space alone, give empty arrays.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def grams(w: Column) -> Column:
        whole = F.array(F.aggregate(w, F.lit(0).cast("long"), lambda h, x: _turned(h, 1).bitwiseXOR(x)))
        return F.transform(F.when(F.size(w) < k, whole).otherwise(rolled(w, k)), lambda h, i: F.struct(h.alias("hash"), i.alias("position")))

    def chosen(g: Column) -> Column:
        # a short text is one window; halves meet until one gram is left
        alone = F.array(F.aggregate(g, F.get(g, F.lit(0)), lambda x, y: F.when(y["hash"] <= x["hash"], y).otherwise(x)))
        picks = F.when(F.size(g) < window, alone).otherwise(least(g, window))
        # positions never fall from window to window
        picked = _let(picks, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["position"] != F.get(p, i - 1)["position"])))
        return _let(picked, lambda p: F.struct(p["hash"].alias("hash"), p["position"].alias("position")))

    none = F.struct(F.array().cast("array<bigint>").alias("hash"), F.array().cast("array<int>").alias("position"))
    return _let(hashed, lambda w: F.when(F.size(w) == 0, none).otherwise(_let(grams(w), chosen)))


def hashes(chosen: Column) -> Column:
    return chosen["hash"]


def positions(chosen: Column) -> Column:
    return chosen["position"]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two fingerprints' hashes, from 0 to 1; two without any hash are alike (1)."""
    x, y = F.array_distinct(hashes(a)), F.array_distinct(hashes(b))
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def spelled(chosen: Column) -> Column:
    """The fingerprint as text: hash:position of each chosen gram, hash in hex, comma-joined; empty without any."""
    one = lambda h, p: F.concat(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit(":"), p.cast("string"))
    return F.concat_ws(",", F.zip_with(hashes(chosen), positions(chosen), one))


def _openings(keys: DataFrame, run_rows: int) -> list[tuple[int, object, int]]:
    """The keys (known, id, hash) that open runs of about `run_rows` rows in order, the least key first; RUNS and one a partition at most."""
    order = [F.col(c) for c in keys.columns]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", inside)
    return sorted({tuple(r)[:-1] for r in ranged.filter(F.col("_row") % run_rows == 0).collect()})


def with_next(rows: DataFrame, id_col: str, text_col: str, follow: list[str], run_rows: int = ROWS) -> DataFrame:
    """`rows` with next_<c> for each c of `follow`: its value in the next row by id, after the last the first row's.

    Rows go by (null ids first, id, hash of the text), equal ids so by their texts' hashes. A pass
    over these keys alone finds those that open runs of consecutive rows; whole rows are then
    shuffled once, each run to one window, so nothing is sorted in a single task and rows of a
    single id spread over many runs. The rows that open a run are also last rows of the run
    before. Ids are numbers. Equal rows share a run, whose window spills. One row follows itself.
    """
    key = [F.col(id_col).isNotNull().cast("int").alias("_known"), F.coalesce(F.col(id_col), F.lit(0).cast(rows.schema[id_col].dataType)).alias("_id"), F.xxhash64(text_col).alias("_hash")]
    keys = rows.select(*key)
    cuts = _openings(keys, max(run_rows, keys.count() // RUNS))
    kinds = [keys.schema[c].dataType.simpleString() for c in keys.columns]
    # as one text each: a literal of any length is one call
    columns = [F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast(f"array<{kind}>") if cuts else F.array().cast(f"array<{kind}>") for i, kind in enumerate(kinds)]
    own = [F.col(c) for c in keys.columns]

    def reached(at: Column) -> Column:
        """Whether the opening key of that number is at or before the row's."""
        known, ident, hashed = (F.get(c, at) for c in columns)
        return (known < own[0]) | ((known == own[0]) & ((ident < own[1]) | ((ident == own[1]) & (hashed <= own[2]))))

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        after, upto = F.struct((mid + 1).alias("low"), s["high"].alias("high")), F.struct(s["low"].alias("low"), mid.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(reached(mid), after).otherwise(upto)

    ends = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    run = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), ends, halved)["low"] - 1
    at = rows.select("*", *key).withColumn("_run", run)
    opens = F.coalesce((F.get(columns[0], F.col("_run")) == own[0]) & (F.get(columns[1], F.col("_run")) == own[1]) & (F.get(columns[2], F.col("_run")) == own[2]), F.lit(False))
    # opening rows close the run before, the very first rows close the last run
    place = lambda to, ghost: F.struct(to.alias("run"), F.lit(ghost).alias("ghost"))
    before = F.when(F.col("_run") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("_run") - 1)
    copies = F.when(opens, F.array(place(F.col("_run"), False), place(before, True))).otherwise(F.array(place(F.col("_run"), False)))
    dealt = at.withColumn("_at", F.explode(copies)).withColumns({"_run": F.col("_at.run"), "_ghost": F.col("_at.ghost")})
    inside = Window.partitionBy("_run").orderBy("_ghost", *own)
    return dealt.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in follow]).filter(~F.col("_ghost")).drop(*keys.columns, "_run", "_at", "_ghost")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and their likeness.

    The edited text keeps the first half of the code points (the larger where odd); the rest is
    replaced by as many first code points of the next document by id, or all of a shorter one;
    after the last comes the first. Null texts are empty; empty fingerprints are alike with one
    another and unlike any other. Null ids come first; rows of equal id go by the hash of their
    texts; repeated rows each give a row; a table of one row follows itself; an empty table
    gives none; other columns are not read. Whole texts are used, however long.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    printed = base.withColumn("chosen", winnow(F.col("text"), k, window))
    pairs = with_next(printed, "id", "text", ["text", "chosen"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("edited_chosen", winnow(F.col("edited"), k, window))
    return edited.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("chosen")).alias("fingerprint"),
        spelled(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
