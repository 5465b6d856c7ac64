"""Packing documents into training sequences, balanced by the cost of attention.

A document of n ids costs about n + n^2 / width. Full stretches of ``width`` ids are sequences of
their own. The ends that are left are packed in groups of ``GROUP`` documents: a group gets as many
sequences as its ids need, its ends are taken in order of falling cost, and each goes to the
sequence of the lowest cost so far that has room. An end that fits nowhere is cut and goes on in the
sequence with most room, so that a group has less than one sequence of padding.

Groups are runs of rows of a task: nothing is shuffled, and a task holds the ends of one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import ByteBPE
from .common import pieces, texts

WIDTH = 1024
GROUP = 8192
END = b"\x00\x00\x00\x00"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place(lengths: np.ndarray, width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """(end, first id of the piece in the end, length, sequence) of each piece; lengths are below ``width``."""
    bins = -(-int(lengths.sum()) // width)
    cost, room = np.zeros(bins), np.full(bins, width, np.int64)
    out = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        at, left = 0, int(lengths[i])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            k = int(fits.argmin())
            n = left
            if fits[k] == np.inf:
                k = int(room.argmax())
                n = int(room[k])
            cost[k] += n + n * n / width
            room[k] -= n
            out.append((i, at, n, k))
            at, left = at + n, left - n
    return out


def _group(rows: list[tuple], first: int, width: int) -> tuple[list[tuple], int]:
    """The pieces of a group of (doc_id, ids, crc of each full stretch); the next free sequence."""
    out, ends, lengths = [], [], []
    for doc, total, crcs, end in rows:
        for k, crc in enumerate(crcs):
            out.append((doc, k * width, width, crc, total, first, 0))
            first += 1
        if end:
            ends.append((doc, total, len(crcs) * width, end))
            lengths.append(len(end) // 4)
    used: dict[int, int] = {}
    for i, at, n, k in place(np.array(lengths, np.int64), width):
        doc, total, begin, end = ends[i]
        out.append((doc, begin + at, n, zlib.crc32(end[4 * at : 4 * (at + n)]), total, first + k, used.get(k, 0)))
        used[k] = used.get(k, 0) + n
    return out, first + len(used)


def pack(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, group: int = GROUP, added_tokens: bool = False) -> DataFrame:
    """One row per piece, see ``SCHEMA``; every document ends with id 0; ``added_tokens`` as in ``ByteBPE``.

    Null text counts as empty and is packed as its end id alone. Null ids and repeated rows are
    packed like all others; other columns are not read; an empty table gives no piece. Sequence ids
    are unique: the task's number times 2^40 and a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.from_json(tokenizer_path, added_tokens)
        first, rows = TaskContext.get().partitionId() << 40, []
        types = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def packed() -> pa.RecordBatch:
            nonlocal first, rows
            out, first = _group(rows, first, width)
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in pieces(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = bpe.encode(text) + END
                full = len(ids) // (4 * width)
                crcs = [zlib.crc32(ids[4 * width * k : 4 * width * (k + 1)]) for k in range(full)]
                rows.append((doc, len(ids) // 4, crcs, ids[4 * width * full :]))
                if len(rows) >= group:
                    yield packed()
        if rows:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
