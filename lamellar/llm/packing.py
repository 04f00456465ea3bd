"""Best-fit packing of token sequences in bulk-synchronous supersteps.

A document is its ids and an end id; only longer ones than `capacity` are cut, into pieces of `capacity`, the first piece shorter.
Pieces are range-sorted by length: each has a rank within its length, by prefix sums over (task, length) counts. Gaps are what sequences have left;
each has a rank within its size. A superstep sweeps over the sizes from the largest: a piece's successor is the smallest gap that holds it and
that no longer piece has taken. Conflicts are resolved by rank: the k-th piece of a length takes the k-th gap (a gap that holds several pieces
of that length takes them all). The sweep works on the numbers of pieces and gaps by size, at most `capacity` each, whatever the number of documents,
and gives intervals of ranks. The gaps, a distributed table, are joined with these: that matches their ranks with the pieces' ranks, shrinks them
and gives them new ranks. When no piece fits a gap, sequences are opened: one for each piece of over half the capacity, else for three quarters
of what the rest needs at least (all of it from superstep 24 on). Supersteps end when all pieces have a gap: some 20 on real lengths, as they grow with
the number of different lengths in a sequence, not with the number of documents. At last pieces and gaps meet in one join by length and rank.

Null text: as empty (the end id alone). Null doc_id and equal rows: each row is a document of its own. An empty table gives no rows.
Very long texts: cut into as many pieces as needed; a text is held once. Other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamellar.llm.common import compact, small_table, staged, text_batches
from lamellar.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, row long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Staged rows PIECES; (task, row) names the document's row, in the order in which a task read it."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, last, task, row = encoder(tokenizer_path).encode, end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for part, texts in text_batches(batches):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = encode(text or "") + last
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    end = at + (n % capacity or capacity) if piece == 0 else at + capacity
                    out.append((doc_id, piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end]), task, row))
                    at, piece = end, piece + 1
                row += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "row"])

    return staged(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def sweep(pieces: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """One superstep's matches: pieces and gaps by size -> (size, gaps, length, pieces, copies in each gap), in the order of their ranks."""
    found, free = [], []  # free: gaps not taken yet, the smallest size last
    for size in sorted(pieces.keys() | gaps.keys(), reverse=True):
        if gaps.get(size):
            free.append([size, gaps[size]])
        left = pieces.get(size, 0)
        while left and free:
            gap, n = free[-1]
            copies = gap // size
            used = min(n, -(-left // copies))
            taken = min(left, used * copies)
            found.append((gap, used, size, taken, copies))
            left -= taken
            free[-1][1] -= used
            if not free[-1][1]:
                free.pop()
    return found


def opened_for(pieces: dict[int, int], capacity: int, step: int) -> int:
    """How many sequences to open when no piece fits."""
    large = sum(n for length, n in pieces.items() if 2 * length > capacity)
    need = sum(length * n for length, n in pieces.items())
    return large or -(-need * (3 if step < 24 else 4) // (4 * capacity))


def supersteps(counts: dict[int, int], capacity: int):
    """For each superstep the number of sequences opened and its plan: intervals [low, high) of ranks of gaps of a size, each taking `copies` pieces of `length`
    from rank `first` on, and the size and rank that they have then. Sizes that hold no piece any more are left out, so those gaps are dropped."""
    pieces, gaps, done, step = {k: v for k, v in counts.items() if v}, Counter(), Counter(), 0
    while pieces:
        new, matches = 0, sweep(pieces, gaps)
        if not matches:
            new = opened_for(pieces, capacity, step)
            gaps[capacity] += new
            matches = sweep(pieces, gaps)
        plan, at, then = [], Counter(), Counter()

        def put(size, n, length, copies, first):
            if n:
                left = size - copies * length  # noqa: B023
                plan.append({"size": size, "low": at[size], "high": at[size] + n, "length": length, "copies": copies, "first": first, "left": left, "rank_left": then[left]})
                at[size] += n
                then[left] += n

        for size, n, length, taken, copies in matches:
            full, rest = divmod(taken, copies)
            put(size, full, length, copies, done[length])
            put(size, 1 if rest else 0, length, rest, done[length] + full * copies)
            done[length] += taken
            pieces[length] -= taken
        pieces = {k: v for k, v in pieces.items() if v}
        for size, n in list(gaps.items()):
            put(size, n - at[size], 0, 0, 0)
        gaps = Counter({size: n for size, n in then.items() if size >= min(pieces, default=capacity + 1)})
        yield new, plan
        step += 1


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (staged) with sequence_id and offset."""
    spark = pieces.sparkSession
    offset = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("task", "length").count().select("task", "length", F.coalesce(F.sum("count").over(offset), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("task", "length").orderBy("row", "piece"))
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + within - 1).alias("rank"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    fields = "size:bigint,low:bigint,high:bigint,length:bigint,copies:bigint,first:bigint,left:bigint,rank_left:bigint"
    gaps, taken, sequences = None, [], 0
    for new, plan in supersteps(counts, capacity):
        # a gap: sequence_id, size, rank in its size
        fresh = spark.range(new).select((F.col("id") + sequences).alias("sequence_id"), F.when(F.col("id") >= 0, F.lit(capacity)).cast("long").alias("size"), F.col("id").alias("rank"))
        sequences += new
        kept = None if gaps is None else gaps.select("sequence_id", F.col("left").alias("size"), F.col("rank_left").alias("rank"))
        now = fresh if kept is None else kept.union(fresh) if new else kept
        steps = F.broadcast(small_table(spark, plan, fields))  # intervals of sizes up to capacity
        i = F.col("rank") - F.col("low")
        now = compact(now, sum(p["high"] - p["low"] for p in plan), 500_000)
        now = now.join(steps, "size").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        gaps = staged(now.select("sequence_id", "size", "length", "copies", (F.col("first") + i * F.col("copies")).alias("first"), "left", (F.col("rank_left") + i).alias("rank_left")), "gaps")
        taken.append(gaps.where("copies > 0").select("sequence_id", "size", "length", "copies", "first"))
    if not taken:
        return ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    places = taken[0]
    for t in taken[1:]:
        places = places.union(t)
    places = places.select("sequence_id", "size", "length", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    places = places.select("length", (F.col("first") + F.col("k")).alias("rank"), "sequence_id", (F.lit(capacity) - F.col("size") + F.col("k") * F.col("length")).alias("offset"))
    return ranked.join(places, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)


def op7_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
