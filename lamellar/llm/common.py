"""Shared helpers: the folder all executors see, staged tables, bounded text batches, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.session import shared_dir

#: Words of all operators: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: What this process has put into the shared folder.
_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/lamellar-{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def clear_staged(spark: SparkSession) -> int:
    """Deletes the folders this process has written; for when results have been written and no DataFrame reads them any more."""
    n = 0
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _PATHS[:] = [p for p in _PATHS if p.split(":", 1)[-1].lstrip("/") != file.split(":", 1)[-1].lstrip("/")]


def compact(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df (staged, of so many rows) in as many tasks as that many rows need; in a single one, later steps need no exchange."""
    return df.coalesce(rows // each + 1)


def drop_paths(spark: SparkSession, paths: list[str], reads: DataFrame | None = None) -> None:
    """Deletes folders that this process has written, but for those that `reads` still reads."""
    used = [f.split(":", 1)[-1].lstrip("/") for f in reads.inputFiles()] if reads is not None else []
    for p in paths:
        if not any(f.startswith(p.split(":", 1)[-1].lstrip("/")) for f in used):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            if p in _PATHS:
                _PATHS.remove(p)


def written_since(mark: int) -> list[str]:
    """The folders written after written() was so many."""
    return _PATHS[mark:]


def written() -> int:
    return len(_PATHS)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df (staged: its count is cheap; a few narrow columns) with a broadcast hint if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= rows else df


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A few driver-side rows as a local relation (JSON text, parsed by Spark; no RDD)."""
    import json

    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{ddl}>>'))", args={"rows": json.dumps(rows)})


def slices(texts: list, most: int = 2_000_000):
    """(from, to) over texts so that a slice holds about `most` characters or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def text_batches(batches, text: str = "text", rows: int = 512):
    """Arrow batches cut to at most `rows` rows, with the text column as a list."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part, part.column(at).to_pylist()


def sum_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def bit_places(h, bits: int):
    """The two bits of each hash (unsigned array) in a filter of so many bits (a power of two)."""
    import numpy as np

    mix = h * np.uint64(0xD6E8FEB86659FD93)
    return (h & np.uint64(bits - 1)).astype(np.int64), (mix >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def bit_filter(of: DataFrame, most_bits: int, each: int = 64):
    """of (staged): one long column. A byte array of at most most_bits bits (`each` for a value), with the two bits of each value set; built in blocks of 32,768 bits."""
    import numpy as np

    n, bits = of.count(), 1 << 15
    while bits < min(most_bits, each * n):
        bits *= 2

    def places(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bit_places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))], ["p"])

    at = of.mapInArrow(places, "p long").select((F.col("p") + 1).alias("p"))  # Spark's bitmaps count from 1
    blocks = at.groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for block, some in blocks.collect():  # most_bits at most
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(some, np.uint8)
    return out


def in_filter(h, bits):
    """For each value (unsigned array) whether both of its bits are set; values that were put in always have them, few others do."""
    import numpy as np

    p, q = bit_places(h, 8 * len(bits))
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & (bits[q >> 3] >> (q & 7).astype(np.uint8)) & 1


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both long: staged rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps; each round is a staged table, so lost executors cost one round.
    Ends when a round changes nothing. Nodes without an edge aren't returned.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    both = lambda e: e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    seen = mark(now)
    for _ in range(most_rounds):
        now_ = compact(now, 2 * seen[0])
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        low = both(now_).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both(now_).join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, now = now, staged(small, name)
        drop_staged(spark, last)
        if (at := mark(now)) == seen:
            out = staged(compact(now, seen[0]).groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), f"{name}-roots")
            drop_staged(spark, now)
            return out
        seen = at
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
