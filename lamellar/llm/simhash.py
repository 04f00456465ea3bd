"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are 32 segments of two bits; its point has 32 coordinates, the segments' numbers of one bits (0 to 2). The Manhattan
distance of two points is never more than the fingerprints' Hamming distance, so links of two bits or fewer lie within Manhattan distance 2.
The grid has a cell for each point of whole coordinates. A fingerprint goes to the cell of its point and to the cells one step from it (49 on
average); two points within distance 2 always meet in a cell, others never do. Two-bit segments part best: unrelated fingerprints come within
distance 2 with a chance of 2e-11, with segments of eight bits it would be 2e-4.
Fingerprints that meet another one in a cell are verified exactly: two differ in two bits or fewer if and only if one bit string is at most one
bit away from both, so all that share such a string are tied to the smallest of them. The rule is the same for every cell, takes 65 rows for a
fingerprint that has met another, whatever the number in a cell, and loses no link. Equal fingerprints are one point, so copies make no pairs.

Null text, empty text or no word: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is one shingle.
Null doc_id: linked, never the smallest id; a component without any id gets null. Equal rows: each gets its row. An empty table gives no rows.
Very long texts: shingles are taken some 65,000 words at a time, so memory follows the text, not its shingles. Of the input's other columns none
is read by the query, whatever its name; `one_of_each` keeps them all (names that begin with `__lamellar` are its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.llm.common import bit_filter, broadcast_if_small, compact, components, drop_staged, in_filter, staged, text_batches

EVEN = 0x5555555555555555
ROW, ID = "__lamellar_row", "__lamellar_id"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str | None, width: int, most: int = 1 << 16):
    """Lists of up to `most` shingles (bytes) of a text, words joined by single spaces."""
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space only
    if not words:
        return
    if len(words) <= width:
        yield [b" ".join(words)]
        return
    for lo in range(0, len(words) - width + 1, most):
        part = words[lo : lo + most + width - 1]
        yield [b" ".join(x) for x in zip(*(part[i:] for i in range(width)))]


def fingerprint(text: str | None, width: int) -> int:
    import numpy as np
    from xxhash import xxh64_digest

    ones, n = np.zeros(64, np.int64), 0
    for some in shingles(text, width):
        h = np.frombuffer(b"".join([xxh64_digest(x, 42) for x in some]), np.uint8).reshape(-1, 8)
        for lo in range(0, len(h), 4096):
            ones += np.unpackbits(h[lo : lo + 4096], axis=1).sum(0, dtype=np.int32)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), staged."""

    def measure(batches):
        import pyarrow as pa

        for part, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signed(fingerprint(t, width)) for t in texts], pa.int64())], ["doc_id", "fp"])

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, fp long"), "fingerprints")


def embedding(fp: Column) -> Column:
    """The point of a fingerprint: each two-bit segment's count in unary (00, 01, 11), so that Manhattan distance is the bit count of a difference."""
    even, high = F.lit(EVEN), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def one_bit_away(x: Column) -> Column:
    return F.array(x, *(x.bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))


def grid_cells(points: DataFrame) -> DataFrame:
    """points: fp. Rows (cell, fp): the cell of each point and those one step from it, each at most once."""
    near = points.select("fp", F.explode(one_bit_away(embedding(F.col("fp")))).alias("cell"))
    lacks = F.shiftrightunsigned("cell", 1).bitwiseAND(F.lit(EVEN)).bitwiseAND(F.bitwise_not("cell"))  # 10 is no count
    return near.where(lacks == 0).select("cell", "fp")


def links(points: DataFrame) -> DataFrame:
    """points (staged): distinct fp. Staged rows (a, b) that tie what pairs at two bits or fewer tie."""
    met = staged(grid_cells(points).groupBy("cell").count().where("count > 1").select("cell"), "met")
    near = staged(grid_cells(points).join(broadcast_if_small(met), "cell", "left_semi").select("fp").distinct(), "near")
    at = compact(near, n := near.count(), 2_000).select("fp", F.explode(one_bit_away(F.col("fp"))).alias("point"))
    centre = staged(at.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b"), "centres")
    centre = broadcast_if_small(compact(centre, n))
    out = staged(at.join(centre, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct(), "fp-links")
    drop_staged(points.sparkSession, met)
    return out


def near_duplicates(fps: DataFrame) -> DataFrame:
    """fps (staged: doc_id, fp) with component_id, the smallest doc_id that links of two bits or fewer reach."""
    points = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    tied = links(points.select("fp"))
    roots = components(tied, "links")
    tied = points.join(broadcast_if_small(roots), points.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    of = staged(tied.join(smallest, "root").select("fp", "component_id"), "components")
    return fps.join(of, "fp")


def shingle_hashes(text: str | None, width: int):
    """The distinct shingles' hashes in rising order; a text without a word has one shingle, the empty one."""
    import numpy as np
    from xxhash import xxh64_digest

    found = set().union(*shingles(text, width)) or {b""}
    return np.unique(np.frombuffer(b"".join([xxh64_digest(x, 42) for x in found]), ">i8").astype(np.int64))


def frequent_shingles(texts: DataFrame, width: int, share: int = 16, least: int = 3, most: int = 1 << 19) -> tuple:
    """Hashes (sorted) and ranks from 1 of shingles that are frequent in a share of the texts. Only the order of shingles depends on them, no result does."""
    import numpy as np

    def spell(batches):
        import pyarrow as pa

        for _, some in text_batches(batches):
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_hashes(t, width) for t in some]))], ["h"])

    some = texts.where(F.pmod("id", F.lit(share)) == 0).select("id", "text").mapInArrow(spell, "h long")
    top = some.groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = top.column("h").to_numpy(), top.column("count").to_numpy()
    ranks = np.empty(len(h), np.int64)
    ranks[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], ranks[order]


def majority_bits(hashes) -> int:
    """The fingerprint of an array of 64-bit hashes, signed."""
    import numpy as np

    ones, b = np.zeros(64, np.int64), hashes.astype(">i8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(b), 4096):
        ones += np.unpackbits(b[lo : lo + 4096], axis=1).sum(0, dtype=np.int32)
    return signed(int.from_bytes(np.packbits(ones * 2 > len(b)).tobytes(), "big"))


PARTS = 64


def part_counts(hashes):
    """Numbers of an array's hashes in PARTS parts of their range, as bytes. The Manhattan distance of two texts' counts is never more than the size of
    the symmetric difference of their shingle sets."""
    import numpy as np

    return np.minimum(np.bincount(hashes.view(np.uint64) >> np.uint64(58), minlength=PARTS), 65535).astype("<u2").tobytes()


def prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows token, id, n, pos: the first of each text's n shingles in one order for all texts, rare ones first. Texts of the similarity share one.

    At pos -1, token is the text's fingerprint, `typical` the number per million of its shingles that are frequent, `parts` its part_counts.
    """
    import numpy as np

    spark = texts.sparkSession
    ordered = spark.sparkContext.broadcast(frequent_shingles(texts, width))

    def cut(batches):
        import math

        import pyarrow as pa

        frequent, ranks = ordered.value
        for part, some in text_batches(batches):
            out, typical, parts = [], [], []
            for i, t in zip(part.column(0).to_pylist(), some, strict=True):
                h = shingle_hashes(t, width)
                n, rank = len(h), np.zeros(len(h), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    rank = np.where(frequent[at] == h, ranks[at], 0)
                first = h[np.argsort(rank, kind="stable")][: n - math.ceil(similarity * n - 1e-6) + 1]
                k = len(first) + 1
                out.append((np.append(first, majority_bits(h)), np.full(k, i, np.int64), np.full(k, n, np.int32), np.append(np.arange(k - 1, dtype=np.int32), np.int32(-1))))
                typical += [None] * (k - 1) + [int((rank > 0).sum() * 1_000_000 // n)]
                parts += [None] * (k - 1) + [part_counts(h)]
            if out:
                cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(typical, pa.int32()), pa.array(parts, pa.binary())], ["token", "id", "n", "pos", "typical", "parts"])

    return texts.select("id", "text").mapInArrow(cut, "token long, id long, n int, pos int, typical int, parts binary")


def jaccard_at_least(a: str, b: str, width: int, similarity: float) -> bool:
    x, y = (set().union(*shingles(t, width)) for t in (a, b))
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both)


def of_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of table whose id is among distinct ids (staged)."""
    return table.join(broadcast_if_small(ids), "id", "left_semi")


def verified(pairs: DataFrame, marks: DataFrame, once: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of text ids whose shingle sets are similar enough, staged. marks: id, n, parts; once: id, text.

    Pairs that the part counts already tell apart (a lower bound of the distance) go before any text is read.
    """
    spark, t = pairs.sparkSession, similarity / (1 + similarity)
    ids = lambda p, name: staged(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name)
    some = staged(of_ids(marks, ids(pairs, "ids")).select("id", "n", "parts"), "sketches")
    hint = F.broadcast if some.count() <= 100_000 else (lambda df: df)
    for c in "ab":
        pairs = pairs.join(hint(some.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"p_{c}"))), c)

    def bound(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(f"p_{c}")).to_pylist()), "<u2").reshape(-1, PARTS).astype(np.int32) for c in "ab")
                n = sum(b.column(b.schema.get_field_index(f"n_{c}")).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
                good = pa.array(np.abs(x - y).sum(1) <= (1 - 2 * t) * n + 1e-6)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(good) for c in "ab"], ["a", "b"])

    close = staged(pairs.mapInArrow(bound, "a long, b long"), "close")
    needed = staged(of_ids(once, ids(close, "close-ids")).select("id", "text"), "needed")
    both = close.join(needed.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(needed.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                a, b, x, y = (part.column(part.schema.get_field_index(c)) for c in "abxy")
                good = pa.array([jaccard_at_least(i or "", j or "", width, similarity) for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])

    out = staged(both.mapInArrow(test, "a long, b long"), "ties")
    drop_staged(spark, needed)
    drop_staged(spark, some)
    return out


def likely(tokens: DataFrame, shared: DataFrame, most_bits: int = 1 << 25) -> DataFrame:
    """tokens (first column: token) without most of those that aren't in shared: by a bit filter of 4 MB at most, before they are exchanged."""
    import numpy as np

    known = tokens.sparkSession.sparkContext.broadcast(bit_filter(shared, most_bits, 16))

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(in_filter(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), known.value).astype(bool)))

    return tokens.mapInArrow(keep, tokens.schema)


def near_fingerprints(marks: DataFrame) -> DataFrame:
    """marks (staged): fp, id. Pairs (a, b) of ids whose fingerprints are linked: each id with the smallest of its fingerprint, and these with each other."""
    points = staged(marks.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "points")
    shared = broadcast_if_small(staged(points.where("n > 1").select("fp", "first"), "shared"))
    same = marks.select("fp", "id").join(shared, "fp").where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    tied = links(points.select("fp"))
    of = tied.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    firsts = broadcast_if_small(staged(points.join(broadcast_if_small(staged(of, "linked")), "fp").select("fp", "first"), "firsts"))
    for c in "ab":
        tied = tied.join(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")), c)
    return same.union(tied.select(F.greatest("first_a", "first_b"), F.least("first_a", "first_b")))


def near_copies(texts: DataFrame, width: int = 5, similarity: float = 0.8, rounds: int = 6) -> DataFrame:
    """Groups of near copies: Jaccard similarity of the sets of `width`-word shingles of at least `similarity`. Staged rows (id, root).

    texts (staged): row (unique), id (the text's hash), text. SimHash links come first, each verified on the shingle sets. They don't reach far
    enough (at a similarity of 0.8 some ten of 64 bits differ), so a prefix filter completes them: with all shingles in one order, two texts of the
    similarity share one among the first n - similarity * n + 1 of each, and from the first that they share enough must be left in both.
    Texts with such a shingle in common are a cell. Each text is compared with its cells' most typical ones. Then those that aren't in the
    group of their cell's typical one are compared with all the cell, so far as they aren't in one group; where many are left, with
    other centres of their own first (up to `rounds` times, while that halves the work). Candidates are complete, so the groups are those of all pairs.
    """
    spark, t = texts.sparkSession, similarity / (1 + similarity)
    again = staged(texts.groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("id", "first"), "again")
    copies = staged(texts.select("id", "row").join(broadcast_if_small(again), "id").where("row > first").select("row"), "copies")
    once = texts.join(broadcast_if_small(copies), "row", "left_anti")
    tokens = staged(prefixes(once, width, similarity), "tokens")
    marks = staged(tokens.where("pos < 0").select("id", "n", F.col("token").alias("fp"), "typical", "parts"), "marks")
    check = lambda pairs: verified(staged(pairs, "pairs"), marks, once, width, similarity)
    ties = check(near_fingerprints(marks).distinct())
    in_prefix = tokens.where("pos >= 0").select("token", "id", "n", "pos")
    shared = staged(in_prefix.groupBy("token").count().where("count > 1").select("token"), "shared")
    members = staged(likely(in_prefix, shared).join(shared, "token"), "members")
    drop_staged(spark, tokens)
    drop_staged(spark, shared)
    typical = broadcast_if_small(staged(marks.where("typical > 0").select("id", "typical"), "typical"))
    by_typical = F.max_by(F.struct(F.col("id").alias("c"), F.col("n").alias("c_n"), F.col("pos").alias("c_pos")), F.struct(F.coalesce("typical", F.lit(0)), "id")).alias("c")
    centres = members.join(typical, "id", "left").groupBy("token").agg(by_typical).select("token", "c.*")
    cells = staged(members.join(centres, "token"), "cells")
    drop_staged(spark, members)

    def may_reach(a: tuple, b: tuple) -> Column:
        """Whether enough shingles are left after the places at which two texts share one."""
        (n_a, pos_a), (n_b, pos_b) = ((F.col(n), F.col(p)) for n, p in (a, b))
        return F.least(n_a - pos_a, n_b - pos_b) >= t * (n_a + n_b) - 1e-6

    def untried(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of the members of cells in a and in b that may reach the similarity and aren't in one group."""
        a, b = (x.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "pos", "root"))) for x, k in ((a, "a"), (b, "b")))
        near = a.join(b, "token").where((F.col("root_a") != F.col("root_b")) & may_reach(("n_a", "pos_a"), ("n_b", "pos_b")))
        return near.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()

    with_centre = cells.where((F.col("id") != F.col("c")) & may_reach(("n", "pos"), ("c_n", "c_pos")))
    ties = ties.union(check(with_centre.select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct().join(ties, ["a", "b"], "left_anti")))
    open_, last = cells, float("inf")
    for k in range(rounds + 1):
        groups = components(ties, "groups")
        of, main = (broadcast_if_small(groups.toDF(c, g)) for c, g in (("id", "root"), ("c", "main")))
        now = open_.select("token", "id", "n", "pos", "c").join(of, "id", "left").join(main, "c", "left")
        now = staged(now.withColumns({"root": F.coalesce("root", "id"), "main": F.coalesce("main", "c")}), "now")
        drop_staged(spark, open_)
        others = staged(now.where("root <> main"), "others")
        left = staged(others.groupBy("token").count(), "left")
        open_ = staged(now.join(left.select("token"), "token"), "open")
        drop_staged(spark, now)
        work, rows = open_.groupBy("token").agg(F.count("*").alias("n")).join(left, "token").agg(F.sum(F.col("n").cast("double") * F.col("count")), F.sum("n")).first()
        if k == rounds or (work or 0) <= 8 * (rows or 0) or work > last / 2:
            break
        last = work
        some = others.groupBy("token").agg(F.max_by(F.struct("id", "n", "pos", "root"), F.struct(F.xxhash64("id", F.lit(k)), "id")).alias("c")).select("token", "c.*")
        ties = ties.union(check(untried(some, open_)))
    ties = ties.union(check(untried(others, open_)))
    for spent in (open_, others, marks):
        drop_staged(spark, spent)
    return components(ties, "groups").select(F.col("node").alias("id"), "root")


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs without near copies: of each group the row of the smallest doc_id stays (of equal ones, any one)."""
    fields = docs.columns
    rows = staged(docs.withColumns({ROW: F.monotonically_increasing_id(), ID: F.xxhash64(F.coalesce("text", F.lit("")))}), "rows")
    groups = near_copies(rows.select(F.col(ROW).alias("row"), F.col(ID).alias("id"), "text"), **kw)
    keys = rows.select(ROW, ID, "doc_id").join(broadcast_if_small(groups), F.col(ID) == F.col("id"), "left").select(ROW, "doc_id", F.coalesce("root", ID).alias("g"))
    keys = staged(keys, "keys")
    first = keys.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("m")).select("m." + ROW)
    gone = staged(keys.select(ROW).join(first, ROW, "left_anti"), "gone")
    return rows.join(broadcast_if_small(gone), ROW, "left_anti").select(*fields)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of 3-word shingles, linked at two bits or fewer."""
    fps = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3)
    return near_duplicates(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
