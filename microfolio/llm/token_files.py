"""Token ids in files: frequency ranks in byte-aligned code, control bytes apart from data bytes.

Ids are replaced by their rank in the corpus (most frequent: 0). A rank takes 1 to 4 bytes; the
lengths of four ranks share one control byte. Documents lie in ascending doc_id order: range
partitions in order are the shards, and a shard's blocks follow each other. A block is a row of
(shard, start, doc_ids, counts, control, data), where ``start`` counts the shard's ids before it.
The table of ranks is written beside the blocks. A reader looks up the four lengths of a control
byte in a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE
from .common import map_pieces, named, staged, texts

END = b"\x00\x00\x00\x00"
BLOCK_IDS = 1 << 18
BLOCKS = "shard long, start long, n_ids long, doc_ids binary, known binary, counts binary, control binary, data binary"
#: Which bytes of four ranks a control byte fills.
FILLED = (np.arange(4) <= (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)[:, :, None]).reshape(256, 16)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    padded[: len(ranks)] = ranks
    size = (padded >= 1 << 8).view(np.uint8) + (padded >= 1 << 16) + (padded >= 1 << 24)  # bytes but one
    control = size[::4] | size[1::4] << 2 | size[2::4] << 4 | size[3::4] << 6
    filled = FILLED[control].reshape(-1)
    filled[4 * len(ranks) :] = False
    return control.tobytes(), padded.view(np.uint8)[filled].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    out = np.zeros(4 * n, np.uint8)
    out[FILLED[np.frombuffer(control, np.uint8)].reshape(-1)[: 4 * n]] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


def id_type(tokenizer_path: str, added_tokens: bool = False) -> str:
    """The smallest unsigned type for all ids of the vocabulary."""
    return "<u2" if len(ByteBPE.from_json(tokenizer_path, added_tokens).bytes_of) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer_path: str, added_tokens: bool = False) -> DataFrame:
    """(doc_id, ids as little-endian integers of ``id_type``, the end id 0 included)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, kind = ByteBPE.from_json(tokenizer_path, added_tokens), id_type(tokenizer_path, added_tokens)
        ids = [np.frombuffer(bpe.encode(t) + END, "<u4").astype(kind).tobytes() for t in texts(batch)]
        return named(batch, ["doc_id"], ids=pa.array(ids, pa.binary()))

    return map_pieces(docs.select("doc_id", "text"), "text", run, "doc_id long, ids binary")


def ranked_ids(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; each task sends one row per id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            if len(got) > len(total):
                got, total = total, got.astype(np.int64)
            total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(rank_of: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, docs, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        names, width = [x.split()[0] for x in BLOCKS.split(", ")], np.dtype(kind).itemsize

        def block() -> pa.RecordBatch:
            nonlocal start, docs, ids, size
            joined = np.frombuffer(b"".join(ids), kind)
            control, data = pack_ranks(rank_of[joined])
            row = [shard, start, len(joined), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs]).tobytes(), np.array([len(i) // width for i in ids], "<i8").tobytes(), control, data]
            start, docs, ids, size = start + len(joined), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row], names=names)

        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                ids.append(own)
                size += len(own) // width
                if size >= BLOCK_IDS:
                    yield block()
        if docs:
            yield block()

    return run


def write(docs: DataFrame, tokenizer_path: str, added_tokens: bool = False) -> tuple[DataFrame, DataFrame]:
    """Writes the files; returns (blocks, ranks) as read from them; ``added_tokens`` as in ``ByteBPE``.

    Null text counts as empty: its end id alone. Null doc_ids come first; rows of one doc_id stand
    in the order of their ids. Other columns are not read; an empty table gives no block.
    """
    tokens = staged(tokenised(docs, tokenizer_path, added_tokens), "tokens")
    kind = id_type(tokenizer_path, added_tokens)
    counts = ranked_ids(tokens, kind).orderBy(F.desc("n"), "id").toPandas()  # one row per id of the vocabulary at most
    ids = counts["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    ranks = staged(tokens.sparkSession.createDataFrame([(ids.astype("<u4").tobytes(),)], "ids binary"), "ranks")
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return staged(ordered.mapInArrow(_blocks(rank_of, kind), BLOCKS), "blocks"), ranks


def read(blocks: DataFrame, ranks: DataFrame, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before), n_tokens, and ids or their crc32."""
    before = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    )  # a row per shard, of which there are as many as partitions; small enough to broadcast
    id_of = np.frombuffer(bytes(ranks.first()["ids"]), "<u4")
    kind = pa.int64() if digest else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = id_of[unpack_ranks(b["control"], b["data"], b["n_ids"])].tobytes()
                docs, known, n = np.frombuffer(b["doc_ids"], "<i8"), np.frombuffer(b["known"], bool), np.frombuffer(b["counts"], "<i8")
                ends = np.cumsum(n)
                own = [ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=~known), pa.array(b["before"] + b["start"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in own] if digest else own, kind)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return blocks.join(F.broadcast(before.select("shard", "before")), "shard").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")
