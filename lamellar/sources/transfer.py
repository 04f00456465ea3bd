"""Fetching payloads on executors: a status row for each work item, never a failed job for a bad one."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_all(work: DataFrame, fetch: Callable[[str], bytes], tasks: int = 8, tries: int = 3, delay: float = 1.0, done: DataFrame | None = None) -> DataFrame:
    """work: id, md5 (empty: unchecked). id, content, status (downloaded, skipped, mismatch, failed), detail.

    A failed fetch, and one whose checksum differs, is tried again, waiting longer each time. Ids in `done` (a status table of an earlier run) that were
    downloaded are skipped, so a run goes on where the last one ended.
    """
    if done is not None:
        ready = done.where("status in ('downloaded', 'skipped')").select("id").distinct()
        rest = fetch_all(work.join(ready, "id", "left_anti"), fetch, tasks, tries, delay)
        skipped = work.join(ready, "id", "left_semi").select("id", F.lit(None).cast("binary").alias("content"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("detail"))
        return rest.union(skipped)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                content, status, detail = None, "failed", None
                for k in range(tries):
                    if k:
                        time.sleep(delay * k)
                    try:
                        content, status, detail = fetch(r.id), "downloaded", None
                    except Exception as e:  # noqa: BLE001  any transport's error
                        content, status, detail = None, "failed", str(e)[:200]
                        continue
                    if not r.md5 or hashlib.md5(content).hexdigest() == r.md5:
                        break
                    content, status = None, "mismatch"
                yield pd.DataFrame({"id": [r.id], "content": [content], "status": [status], "detail": [detail]})

    return work.select("id", "md5").repartition(tasks, "id").mapInPandas(run, "id string, content binary, status string, detail string")


class RangeFile:
    """A seekable file over ranged reads of blocks: read_range(start, end) gives the bytes, end exclusive. The last `kept` blocks used are held."""

    def __init__(self, read_range: Callable[[int, int], bytes], size: int, block: int = 1 << 20, kept: int = 64):
        self.read_range, self.size, self.block, self.at, self.blocks, self.kept = read_range, size, block, 0, OrderedDict(), kept

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n < 0 else min(self.size, self.at + n)
        out = bytearray()
        while self.at < end:
            k = self.at // self.block
            if k not in self.blocks:
                self.blocks[k] = self.read_range(k * self.block, min(self.size, (k + 1) * self.block))
            self.blocks.move_to_end(k)
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
            part = self.blocks[k][self.at - k * self.block : end - k * self.block]
            out += part
            self.at += len(part)
        return bytes(out)
