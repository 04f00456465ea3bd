"""Token-id output: one zstandard dictionary for all shards, one frame per document, dictionary hash and offset index in each shard.

Shard file, all integers little-endian:

    b"LTK1" | id width u32 (2 or 4) | dictionary SHA-256 (32 bytes) | frames, one per document |
    index: for each document, frame end (offset in the file) u64, doc_id i64, ids u32, doc_id is null u8 | documents u64 | index offset u64 | b"LTKE"

A document is read with its two index entries and its own frame only. Ids that fit are stored in 2 bytes.
The dictionary is trained on a bounded sample of serialized id arrays (`sample_rows` short documents, the smallest hashes of doc_id).

Very long texts: one document of a task is held at a time, whole. Null text: as empty (the end id alone). Null doc_id: sorts first. Equal doc_ids: all kept, ordered by text hash.
An empty table writes no shard and gives no rows. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamellar.llm.common import new_path, staged, text_batches
from lamellar.llm.tokens import encoder

HEAD, TAIL, ENTRY, MAGIC, END = "<4sI32s", "<QQ4s", "<QqIB", b"LTK1", b"LTKE"
HEAD_SIZE, TAIL_SIZE, ENTRY_SIZE = map(struct.calcsize, (HEAD, TAIL, ENTRY))


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file://" + path.removeprefix("file:"))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; with too few samples for training, their bytes themselves (a raw-content dictionary)."""
    import zstandard

    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_shard(folder: str, shard: int, documents, dictionary: bytes, narrow: bool, level: int) -> tuple[str, int, int]:
    """documents: (doc_id, ids as u32 bytes) in order. The name is new for each attempt, so a task that runs twice leaves no mixed file."""
    import numpy as np
    import zstandard

    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.ltk"
    zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if zdict:
        zdict.precompute_compress(level=level)
    pack = zstandard.ZstdCompressor(level=level, dict_data=zdict).compress if zdict else zstandard.ZstdCompressor(level=level).compress
    index, at, total = bytearray(), HEAD_SIZE, 0
    with fs.open_output_stream(path) as out:
        out.write(struct.pack(HEAD, MAGIC, 2 if narrow else 4, hashlib.sha256(dictionary).digest()))
        for doc_id, ids in documents:
            frame = pack(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
            out.write(frame)
            at += len(frame)
            index += struct.pack(ENTRY, at, doc_id or 0, len(ids) // 4, doc_id is None)
            total += len(ids) // 4
        out.write(bytes(index))
        out.write(struct.pack(TAIL, len(index) // ENTRY_SIZE, at, END))
    return path, len(index) // ENTRY_SIZE, total


class ShardReader:
    """Random access to the documents of a shard: len(reader), reader[i] gives the ids of document i as u32 bytes."""

    def __init__(self, folder: str, path: str, dictionary: bytes):
        import zstandard

        fs, _ = file_system(folder)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, digest = struct.unpack(HEAD, self.file.read_at(HEAD_SIZE, 0))
        self.n, index, end = struct.unpack(TAIL, self.file.read_at(TAIL_SIZE, size - TAIL_SIZE))
        if magic != MAGIC or end != END:
            raise ValueError(f"{path} is no whole shard file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = self.file.read_at(self.n * ENTRY_SIZE, index)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return self.n

    def doc_id(self, i: int) -> int | None:
        _, doc_id, _, null = struct.unpack_from(ENTRY, self.index, i * ENTRY_SIZE)
        return None if null else doc_id

    def __getitem__(self, i: int) -> bytes:
        import numpy as np

        end, _, n, _ = struct.unpack_from(ENTRY, self.index, i * ENTRY_SIZE)
        start = struct.unpack_from(ENTRY, self.index, (i - 1) * ENTRY_SIZE)[0] if i else HEAD_SIZE
        raw = self.unpack.decompress(self.file.read_at(end - start, start))
        if len(raw) != n * self.width:
            raise ValueError(f"document {i} has {len(raw)} bytes, not {n * self.width}")
        return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if self.width == 2 else raw

    def close(self) -> None:
        self.file.close()


def token_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, rows: int, chars: int, size: int) -> tuple[bytes, bool]:
    """The dictionary of at most `size` bytes, and whether ids are stored in 2 bytes. The sample: `rows` documents of up to `chars` characters."""
    import numpy as np
    from tokenizers import Tokenizer

    short = docs.where(F.length("text").between(1, chars)).withColumn("h", F.xxhash64("doc_id", "text"))
    n = short.agg(F.count("*")).first()[0]
    # of n hashes, about 2 * rows lie below this; so what tasks send to the driver doesn't grow with their number
    low = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * (rows + 100) // max(1, n))
    few = short.where(F.col("h") <= low).select("text", "h").orderBy("h", "text").limit(rows)
    encode, last, narrow = encoder(tokenizer_path).encode, struct.pack("<I", end_id), Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 65536
    samples = [encode(r[0]) + last for r in few.collect()]
    if narrow:
        samples = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in samples]
    return train_dictionary(samples, size), narrow


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, shards: int = 0, sample_rows: int = 1000, sample_chars: int = 4096, dictionary_bytes: int = 65536, level: int = 3) -> tuple[DataFrame, bytes]:
    """Writes docs (doc_id, text) to folder as shards in ascending doc_id order; gives the manifest and the dictionary.

    Manifest: shard, path, n_docs, n_tokens; only files of tasks that ended are in it. shards: 0 takes spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dictionary, narrow = token_dictionary(docs, tokenizer_path, end_id, sample_rows, sample_chars, dictionary_bytes)
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as out:
        out.write(dictionary)
    last = struct.pack("<I", end_id)

    def write(batches):
        import itertools

        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer_path).encode
        rows = ((i, encode(t) + last) for part, texts in text_batches(batches) for i, t in zip(part.column(0).to_pylist(), texts, strict=True))
        first = next(rows, None)
        if first is not None:
            shard = TaskContext.get().partitionId()
            path, n, total = write_shard(folder, shard, itertools.chain([first], rows), dictionary, narrow, level)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n], "n_tokens": [total]})

    h = F.xxhash64("text")  # splits equal doc_ids over shards
    ranged = docs.withColumn("h", h).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return staged(ranged.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "manifest"), dictionary


def read_token_files(manifest: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Each document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, position."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                reader, at, n = ShardReader(folder, row["path"], dictionary), row["base"], 0
                while n < len(reader):
                    got = []
                    for i in range(n, min(n + 1000, len(reader))):
                        ids = reader[i]
                        got.append((reader.doc_id(i), at, len(ids) // 4, zlib.crc32(ids), row["shard"], i))
                        at += len(ids) // 4
                    n += len(got)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "position"])
                reader.close()

    spread = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, position long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through write_token_files and back."""
    import public_tokenizers

    folder = new_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest, dictionary = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(manifest, folder, dictionary)
