"""Encoders as plug-ins: load() once for each Python worker's task, embed() a batch of payloads."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from lamellar.functions.scalars import item_key
from lamellar.operators.pooling import mean_pool


class NoAccess(Exception):
    """The weights may not be loaded; a run reports it apart from failures."""


class Encoder(Protocol):
    name: str

    def load(self) -> object: ...

    def embed(self, state: object, batch: list[bytes]) -> list[list[float]]: ...


class ByteStatistics:
    """A deterministic encoder for tests: mean, spread and a coarse histogram of the payload's bytes."""

    def __init__(self, name: str = "byte_statistics", bins: int = 6):
        self.name, self.bins = name, bins

    def load(self) -> object:
        return self.bins

    def embed(self, state: object, batch: list[bytes]) -> list[list[float]]:
        import numpy as np

        out = []
        for content in batch:
            a = np.frombuffer(content, np.uint8).astype(float)
            a = a if a.size else np.zeros(1)
            out.append([a.mean(), a.std(), *(np.histogram(a, state, (0, 256))[0] / a.size)])
        return out


#: How token outputs become one vector.
TOKEN_RULES = {"first_token": ["phikon"], "first_and_mean_of_rest": ["virchow"], "first_and_mean_after_registers": ["virchow2"], "as_is": ["conch", "uni2", "exaone-path", "gigapath", "h-optimus", "mSTAR", "hipt"]}


def pool_tokens(tokens, rule: str, registers: int = 4):
    """tokens: array [n, d]."""
    import numpy as np

    t = np.asarray(tokens, dtype=np.float32)
    if rule == "first_token":
        return t[0]
    if rule == "first_and_mean_of_rest":
        return np.concatenate([t[0], t[1:].mean(0)])
    if rule == "first_and_mean_after_registers":
        return np.concatenate([t[0], t[1 + registers :].mean(0)])
    return t


def encode(patches: DataFrame, encoder: Encoder, batch: int = 128) -> DataFrame:
    """model, path, embedding for each patch (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = encoder.load()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                yield pd.DataFrame({"model": encoder.name, "path": part["path"], "embedding": encoder.embed(state, [bytes(x) for x in part["content"]])})

    return patches.select("path", "content").mapInPandas(run, "model string, path string, embedding array<float>")


def item_embeddings(patches: DataFrame, encoder: Encoder) -> DataFrame:
    """model, item_id, embedding (mean over the item's patches), n_patches."""
    e = encode(patches, encoder)
    return mean_pool(e.withColumn("item_id", item_key(e.path)), ["model", "item_id"], "embedding")
