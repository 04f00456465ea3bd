"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased (A-Z) and stripped of ASCII punctuation at both ends. A mask picks six of nine consecutive words; MASKS are two such that any
thirteen words with two of them substituted keep all six words of a mask at some place (the tests try all cases). The masks' hashes at all
places of the benchmark items are joined with those at all places of the documents. A row of either side carries the words around its place, so a
hit is verified where the join puts it: windows of thirteen words around the place with two substitutions at most are overlaps.
Shorter items: the whole item is the window, with one substitution from seven words on and none below (mask SHORT, three words in sequence).
Items of one or two words are found in documents that hold these words and nothing else; items without a word never.

Both tables are read in a distributed way and neither is collected; the join is by hash, of distinct (mask, hash, words around) only: a passage that
stands in countless documents, or again and again in one document or item, meets an item's words once. A document row whose hash no item has is
mostly dropped before it is exchanged, by a bit filter of at most `filter_bits` bits (two for each hash, 16 MB, the one thing that is broadcast);
the filter only saves work, a full one would let every row through to the join. Hot hashes are split by Spark's skew join.
Spans are word positions, end exclusive.

Null or empty texts (documents or items): no overlap. Null doc_id or item_id: kept as null. Equal document rows: each gets its rows. Items of equal
text and different ids: each is found; equal rows of the benchmark count once. An empty table on either side gives no overlaps.
Very long texts: rows are cut from a text in slices, so memory follows the text. Other columns, whatever their names, are kept by `decontaminate`
and not read by `overlaps`.
"""

from __future__ import annotations

from string import punctuation

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamellar.llm.common import bit_filter, broadcast_if_small, in_filter, staged, text_batches

WINDOW, SUBSTITUTIONS = 13, 2
MASKS, SHORT = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 7, 8)), (0, 1, 2)
#: Kinds of rows: 0 and 1 by MASKS, 2 by SHORT, 3 whole texts of one or two words. Words before and after a place that may share a window with it.
WHOLE = 3
REACH = {0: (WINDOW - 9, WINDOW), 1: (WINDOW - 9, WINDOW), 2: (WINDOW - 4, WINDOW - 1), WHOLE: (0, 2)}
HITS = "k1 long, k2 int, n_words long, at long, kind int, h long, before int, around binary"
SEEDS = "item long, item_id long, size int, kind int, h long, before int, around binary"


def words(text: str | None) -> list[bytes]:
    strip = punctuation.encode()
    return [w.strip(strip) or w for w in (text or "").encode().lower().split()]


class Numbers(dict):
    """Word -> its 64-bit hash; at most `most` words are kept."""

    def __init__(self, most: int = 1 << 19):
        super().__init__()
        self.most = most

    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(w, 42)
        if len(self) < self.most:
            self[w] = h
        return h


def hashes(numbers, kind: int):
    """One hash for each place of a mask over word hashes (an array), or for the whole text."""
    import numpy as np

    mask = (*MASKS, SHORT, range(len(numbers)))[kind]
    n = 1 if kind == WHOLE else len(numbers) - mask[-1]
    h = np.full(max(n, 0), kind + 1, np.uint64)
    if n <= 0 or not len(numbers):
        return h[:0]
    for k, m in enumerate(mask):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + numbers[m : m + n] * np.uint64(2 * k + 0x2545F4914F6CDD1D)
    return h ^ h >> np.uint64(29)


def allowed(n: int) -> tuple[int, int]:
    """Window and substitutions for an item of n words."""
    return (WINDOW, SUBSTITUTIONS) if n >= WINDOW else (n, 1 if n >= 7 else 0)


def kinds_of(n: int) -> tuple[int, ...]:
    """Kinds of rows of an item of n words."""
    return (0, 1) if n >= WINDOW else (2,) if n >= len(SHORT) else (WHOLE,)


def around(w: list[bytes], at: int, kind: int) -> tuple[int, bytes]:
    """The words that may share a window with a place, and how many of them stand before it."""
    left, right = REACH[kind]
    lo = max(0, at - left)
    return at - lo, b" ".join(w[lo : at + right])


def fits(before_a: int, a: bytes, before_b: int, b: bytes, size: int) -> list[int]:
    """Document words a and item words b, laid over each other at their places: starts of overlapping windows, from a's place on. size: words of the item."""
    x, y = a.split(b" "), b.split(b" ")
    window, most = allowed(size)
    lo, hi = -min(before_a, before_b), min(len(x) - before_a, len(y) - before_b)
    if hi - lo < window:
        return []
    miss = [x[before_a + i] != y[before_b + i] for i in range(lo, hi)]
    return [lo + i for i in range(hi - lo - window + 1) if sum(miss[i : i + window]) <= most]


def text_key(text: Column) -> list[Column]:
    """96 bits for a text."""
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def seeds(benchmark: DataFrame) -> DataFrame:
    """Staged rows SEEDS: the distinct places of all items."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        number = Numbers()
        for part, texts in text_batches(batches, rows=64):
            out = set()
            for item, item_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                w = words(t)
                ids = np.fromiter(map(number.__getitem__, w), np.uint64, len(w))
                for kind in kinds_of(len(w)):
                    for at, h in enumerate(hashes(ids, kind).view(np.int64).tolist()):
                        out.add((item, item_id, len(w), kind, h, *around(w, at, kind)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SEEDS.split(", ")])

    items = benchmark.where("text is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return staged(items.mapInArrow(cut, SEEDS), "seeds")


def hits(docs: DataFrame, of: DataFrame, filter_bits: int) -> DataFrame:
    """Staged rows HITS: the places of the texts whose hash an item has (and few others)."""
    import numpy as np

    has = {r[0] for r in of.select("kind").distinct().collect()}  # four kinds at most
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(of.select("h").distinct(), filter_bits))

    def find(batches):
        import pyarrow as pa

        number, bits = Numbers(), known.value
        for part, texts in text_batches(batches):
            out, keys = [], zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True)
            for k1, k2, t in keys:
                w = words(t)
                ids = np.fromiter(map(number.__getitem__, w), np.uint64, len(w))
                for kind in has:
                    if kind == WHOLE and len(w) > 2:
                        continue
                    h = hashes(ids, kind)
                    for at in np.flatnonzero(in_filter(h, bits)).tolist():
                        out.append((k1, k2, len(w), at, kind, int(h[at].view(np.int64)), *around(w, at, kind)))
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    def batch(out):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in HITS.split(", ")])

    return staged(docs.select(*text_key(F.col("text")), "text").mapInArrow(find, HITS), "hits")


def matches(docs: DataFrame, benchmark: DataFrame, filter_bits: int = 1 << 27) -> DataFrame:
    """Staged rows k1, k2 (a text), n_words, item, item_id, start, end: overlapping windows of the texts of docs."""

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                starts = fits(r["before"], r["around"], r["item_before"], r["item_around"], r["size"])
                out += [(r["kind"], r["h"], r["before"], r["around"], r["item"], r["item_id"], s, s + allowed(r["size"])[0]) for s in starts]
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "h", "before", "around", "item", "item_id", "s", "e"])

    of = seeds(benchmark)
    found = hits(docs, of, filter_bits)
    place = ["kind", "h", "before", "around"]
    pairs = found.select(*place).distinct().join(of.withColumnsRenamed({"before": "item_before", "around": "item_around"}), ["kind", "h"])
    good = staged(pairs.mapInArrow(verify, "kind int, h long, before int, around binary, item long, item_id long, s int, e int").distinct(), "verified")
    out = found.join(broadcast_if_small(good, 100_000), place).select("k1", "k2", "n_words", "item", "item_id", (F.col("at") + F.col("s")).alias("start"), (F.col("at") + F.col("e")).alias("end"))
    return staged(out.distinct(), "windows")


def overlaps(docs: DataFrame, benchmark: DataFrame, filter_bits: int = 1 << 27) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, n_words, n_overlap_words, spans."""
    window = Window.partitionBy("k1", "k2", "item").orderBy("start")
    found = matches(docs, benchmark, filter_bits).withColumn("new", (F.col("start") > F.coalesce(F.lag("end").over(window), F.lit(-1))).cast("int"))
    found = found.withColumn("span", F.sum("new").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.groupBy("k1", "k2", "n_words", "item", "item_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")  # of one text and item
    found = staged(found.groupBy("k1", "k2", "n_words", "item", "item_id").agg(F.sum(F.col("end") - F.col("start")).alias("n_overlap_words"), spans), "overlaps")
    of = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")))
    return of.join(broadcast_if_small(found, 100_000), ["k1", "k2"]).select("doc_id", "item_id", "n_words", "n_overlap_words", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, filter_bits: int = 1 << 27) -> DataFrame:
    """docs without those that overlap an item."""
    gone = staged(matches(docs, benchmark, filter_bits).select("k1", "k2").distinct(), "contaminated")
    k1, k2 = text_key(F.col("text"))
    same = (k1 == F.col("__lamellar_k1")) & (k2 == F.col("__lamellar_k2"))
    return docs.join(broadcast_if_small(gone.toDF("__lamellar_k1", "__lamellar_k2")), same, "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark text, with the items and spans (start-end, joined by commas); clean documents have no row."""
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))
