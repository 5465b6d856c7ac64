"""Exact duplicates by a minimal perfect hash over the digests seen before.

The digests of earlier documents (``history``) are cut into shards by their leading bytes. Each
shard gets a minimal perfect hash: levels of bit arrays, where a key sits on the first level on
which nobody else hashed to its bit, and its slot is the number of set bits before. A slot holds
the whole digest, the winner's id and the number of copies. New digests are looked up by slot and
compared byte by byte; members repeat the slot's winner, all others are grouped among themselves.

Both sides are reduced to one row per digest before any shuffle (partial aggregation), so that a
text with any number of copies is one row of its shard. Only digests and ids are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WHITE = r"[\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1
LEVEL_LOAD = 2  # bits per key on a level
SHARD_KEYS = 1024
SLOT = np.dtype([("digest", "S32"), ("keep", "<i8"), ("copies", "<i8")])
_INFO = "digest binary, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """Null as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest (SHA-256 is uniform)."""
    raw = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return raw[:, 1], raw[:, 2] | np.uint64(1)


def _fixed(values) -> np.ndarray:
    """Digests as a (n, 32) byte matrix; numpy's own strings would lose trailing zero bytes."""
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


class PerfectHash:
    """Slots 0..n-1 for n distinct digests; others get any slot or -1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = []
        seen = 0
        for bits in levels:
            self.before.append(seen + np.r_[0, np.cumsum(bits)[:-1]])
            seen += int(bits.sum())

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((a + np.uint64(level) * b) ^ (b >> np.uint64(level % 32))) % np.uint64(size)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = _words(digests)
        levels = []
        while len(a):
            size = max(LEVEL_LOAD * len(a), 8)
            at = cls._place(a, b, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        a, b = _words(digests)
        found = np.full(len(a), -1, np.int64)
        for level, bits in enumerate(self.levels):
            at = self._place(a, b, level, len(bits)).astype(np.int64)
            hit = (found < 0) & bits[at]
            found[hit] = self.before[level][at[hit]]
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            width = -(-int(size) // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=int(size)).astype(bool))
            at += width
        return cls(levels)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = _fixed(group["digest"])
    hashed = PerfectHash.build(digests)
    slots = np.zeros(len(digests), SLOT)
    at = hashed.slots(digests)
    slots.view(np.uint8).reshape(-1, SLOT.itemsize)[at, :32] = digests
    slots["keep"][at] = group["keep_id"].to_numpy()
    slots["copies"][at] = group["group_size"].to_numpy()
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "hash": [hashed.to_bytes()], "slots": [slots.tobytes()]})


def _look_up(index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    """One row per digest of the shard, whether known before, new, or both."""
    digests = _fixed(fresh["digest"])
    keep, copies = fresh["keep_id"].to_numpy(np.int64), fresh["group_size"].to_numpy(np.int64)
    if not len(index):
        return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": keep, "group_size": copies})
    slots = np.frombuffer(index["slots"].iloc[0], SLOT).copy()
    stored = slots.view(np.uint8).reshape(-1, SLOT.itemsize)[:, :32]
    at = PerfectHash.from_bytes(index["hash"].iloc[0]).slots(digests) if len(digests) else np.zeros(0, np.int64)
    member = at >= 0
    member[member] = (stored[at[member]] == digests[member]).all(axis=1)
    slots["copies"][at[member]] += copies[member]  # digests of one side are distinct, and so are their slots
    return pd.DataFrame(
        {
            "digest": [d.tobytes() for d in stored] + [d.tobytes() for d in digests[~member]],
            "keep_id": np.r_[slots["keep"], keep[~member]],
            "group_size": np.r_[slots["copies"], copies[~member]],
        }
    )


def exact_duplicates(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest doc_id of the rows with equal normalised text; null ids come last,
    so ``keep_id`` is null only where all are. Null text counts as empty. Rows that repeat the
    winner's id with equal text are all kept. Of ``docs`` only doc_id and text are read; an empty
    table gives an empty result. Earlier documents are those with ids up to the middle of the ids' range.
    """
    digests = staged(
        docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "digests"
    ).withColumn("digest", F.unhex("text_sha256"))
    bounds = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = 0 if bounds[0] is None else (bounds[0] + bounds[1]) // 2
    shards = max(1, -(-bounds[2] // (2 * shard_keys)))

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(
            F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ).withColumn("shard", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(shards)))

    earlier = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    history = distinct(digests.where(earlier))
    index = history.groupBy("shard").applyInPandas(_build, "shard long, hash binary, slots binary")
    fresh = distinct(digests.where(~earlier))
    known = index.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInPandas(_look_up, _INFO)
    return (
        digests.join(known, "digest")
        .withColumn("keep_id", F.when(F.col("keep_id") != NO_ID, F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
