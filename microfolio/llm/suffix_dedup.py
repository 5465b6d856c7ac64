"""Removal of repeated passages with a sparse suffix array.

A byte goes if it lies in a ``width``-byte string that also starts anywhere else. Sorting the
suffixes at all bytes would move hundreds of times the text, so suffixes are taken at the places
that ``spans.find`` chooses by content: equal strings choose equal places, and a string belongs to
the span of its place.

1. Spans are counted by the hash of the seed at their place. Spans with a seed of their own hold no
   repeated string and are left.
2. Of every content that shares a seed the bytes are fetched: of one copy, or of two where there are
   several. The suffixes that begin with equal leading tokens, the seed's bytes, form a group.
3. A group of more than ``bucket`` suffixes is split by further leading tokens: its strings are halved by how far they
   reach to the left of the seed, and each half has a longer stretch of bytes that all its strings hold. Spans are cut down to
   their strings of the half; equal ones are repeated from end to end, so they are marked and one of them goes on. Halving
   ends with whole strings, of which none differ.
4. Sampled splitters range-partition the groups by those tokens, never cutting equal ones, so
   nothing is left to compare across a bucket's boundaries; a bucket sorts its strings locally by multikey quicksort: runs of
   strings that agree so far are split by the first token (8 bytes) in which they differ, until runs are equal or single.
5. Removed stretches of bytes go back to the texts.

Bytes decide what is repeated; hashes name texts (128 bits) and contents (seed and content, 64 bits each).
Contents are counted before they are shuffled by key, so copies in any number are one row or two.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import likely_in, pieces, scratch, staged

WIDTH, SEED = 200, 24
BUCKET = 1024
TOKEN = 8
CHUNK = 1024
SPAN_BYTES = 1 << 18  # some 200 times as much memory for the spans of so many bytes
SPAN = "key binary, place long, seed long, content long"
PIECE = "seed long, content long, pieces long, core binary, low int, high int, shift int, anchor int, windows int, bytes binary"
RANGE = "seed long, content long, first long, last long"


def _spans(width: int, seed: int):
    """Spans of each text; ``place`` packs first byte, windows and the seed's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SPAN_BYTES):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            starts = np.r_[0, np.cumsum([len(d) for d in data], dtype=np.int64)]
            row, first, windows, anchor, key, content = spans.find(np.frombuffer(b"".join(data), np.uint8), starts, width, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row, pa.int64())), pa.array(first << 16 | windows << 8 | anchor), pa.array(key), pa.array(content)],
                names=["key", "place", "seed", "content"],
            )

    return run


def _unpacked(place: int) -> tuple[int, int, int]:
    return place >> 16, place >> 8 & 255, place & 255


def _fetch(width: int, seed: int):
    """The bytes of the wanted spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 5, pa.binary()]
        for batch in pieces(batches, "text", 1 << 20):
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for w in wanted:
                    first, windows, anchor = _unpacked(w["place"])
                    at = first + anchor
                    whole = data[first : first + windows + width - 1]
                    out.append((w["seed"], w["content"], w["pieces"], data[at : at + seed], 0, width - seed + 1, 0, anchor, windows, whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    return run


def repeated(
    strings: list[bytes], windows: np.ndarray, anchors: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, width: int
) -> list[np.ndarray]:
    """For each span of a group, which of its windows another span of the group holds too.

    Only windows that reach from ``low`` to less than ``high`` bytes to the left of the seed are looked at. Equal
    windows have their seed at equal places, so runs begin as (group, place of the seed).
    """
    size = int(windows.max()) + width - 1 + TOKEN
    data = np.zeros((len(strings), size), np.uint8)
    for i, s in enumerate(strings):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
    token_at = np.ndarray(data.size - TOKEN + 1, ">u8", data, strides=(1,))
    bounds = np.r_[0, np.cumsum(windows)]
    row = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(bounds[-1]) - bounds[:-1][row]
    base = row * size + offset
    depths = np.array([*range(0, width - TOKEN, TOKEN), width - TOKEN])
    flags = np.zeros(len(row), bool)

    def split(member: np.ndarray, run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs split by a key, without those of one member: members in order, their runs, run starts."""
        order = np.lexsort((key, run))
        member, run, key = member[order], run[order], key[order]
        new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])] if len(run) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1 if len(run) else new
        member, number, new = member[several], number[several], new[several]
        return member, np.cumsum(new) - 1, np.flatnonzero(new)

    def token(member: np.ndarray, depth) -> np.ndarray:
        return token_at[base[member] + depth].astype(np.uint64)

    reach = anchors[row] - offset
    member = np.flatnonzero((reach >= low[row]) & (reach < high[row]))
    member, run, head = split(member, (group[row] * 256 + reach)[member], np.zeros(len(member), np.uint64))
    for depth in (0, width - TOKEN):
        member, run, head = split(member, run, token(member, depth))
    while len(member):
        lead = member[head][run]
        differs = np.full(len(member), len(depths))
        for d in range(len(depths) - 1, -1, -1):
            differs[token(member, depths[d]) != token(lead, depths[d])] = d
        first = np.minimum.reduceat(differs, head)
        settled = (first == len(depths))[run]
        flags[member[settled]] = True
        member, run, first = member[~settled], run[~settled], first[run[~settled]]
        member, run, head = split(member, run, token(member, depths[first]) if len(member) else first.astype(np.uint64))
    return np.split(flags, bounds[1:-1])


def _sorted(width: int):
    """Repeated windows, bucket by bucket; rows come ordered by leading tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done(rows: list[dict]) -> pa.RecordBatch:
            out, unlike, number = [], [], []
            for k, (_, group) in enumerate(itertools.groupby(rows, lambda r: (r["core"], r["low"]))):
                group = list(group)
                if len(group) > 1 and all(r["bytes"] == group[0]["bytes"] and r["anchor"] == group[0]["anchor"] for r in group):
                    out += [(r["seed"], r["content"], r["shift"], r["shift"] + r["windows"] - 1) for r in group[:1]]  # one run from end to end
                elif len(group) > 1:
                    unlike += group
                    number += [k] * len(group)
            if unlike:
                windows, anchors, low, high = (np.array([r[k] for r in unlike], np.int64) for k in ("windows", "anchor", "low", "high"))
                for r, flag in zip(unlike, repeated([r["bytes"] for r in unlike], windows, anchors, np.array(number), low, high, width)):
                    if flag.any():
                        edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
                        out += [(r["seed"], r["content"], r["shift"] + a, r["shift"] + b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            columns = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seed", "content", "first", "last"])

        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= CHUNK and r["core"] != held[-1]["core"]:
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    return run


def _halved(groups: DataFrame, width: int) -> DataFrame:
    """The spans of each half of a group, cut down to their strings of that half; ``shift`` counts the bytes cut off in front."""
    middle = F.expr("(low + high) div 2").cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    least = F.col("anchor") - F.col("windows") + 1
    held = F.filter(halves, lambda h: (F.col("anchor") >= h.low) & (least < h.high))
    rows = groups.withColumn("half", F.explode(held)).withColumns({"low": F.col("half.low"), "high": F.col("half.high")}).drop("half")
    begin, end = F.greatest("low", least), F.least("high", F.col("anchor") + 1)
    front = F.col("anchor") + 1 - end
    return rows.select(
        "seed", "content", "low", "high", (F.col("shift") + front).alias("shift"), (end - 1).alias("anchor"), (end - begin).alias("windows"),
        F.substring("bytes", front + 1, end - begin + width - 1).alias("bytes"),
    )


def repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(documents with null text as empty and a 128-bit key of the text, removed stretches per key)."""
    if not TOKEN <= seed < width or width - seed > 254:
        raise ValueError("width must exceed the seed by 1 to 254 bytes")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    with scratch(docs.sparkSession) as keep:
        cuts = keep(_cuts(texts.where(F.octet_length("text") >= width).select("key", "text"), width, seed, bucket), "cuts")
    return texts, cuts


def _cuts(long: DataFrame, width: int, seed: int, bucket: int) -> DataFrame:
    """(key, cuts) of the texts that lose bytes."""
    found = staged(long.mapInArrow(_spans(width, seed), SPAN), "spans")
    shared = staged(found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "seeds")  # read anew, so that the join may split a hot seed
    found = staged(found.join(shared, "seed"), "shared-spans")
    at = F.struct("key", "place")
    kinds = found.groupBy("seed", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("one"), F.max(at).alias("other"))
    kinds = staged(kinds, "contents")
    groups = kinds.groupBy("seed").agg(F.sum(F.least("copies", F.lit(2))).alias("pieces"))
    taken = F.when(F.col("copies") > 1, F.array("one", "other")).otherwise(F.array("one"))
    wanted = kinds.join(groups, "seed").select("seed", "content", "pieces", F.explode(taken).alias("at"))
    wanted = wanted.groupBy("at.key").agg(
        F.collect_list(F.struct("seed", "content", "pieces", F.col("at.place").alias("place"))).alias("wanted")
    )  # at most twice as many as the text has spans
    wanted = staged(wanted, "wanted-spans")
    sources = likely_in(long, wanted, "key").groupBy("key").agg(F.min("text").alias("text"))
    fetched = staged(sources.join(wanted, "key").select("text", "wanted").mapInArrow(_fetch(width, seed), PIECE), "suffixes")

    local, large, whole = [fetched.where(F.col("pieces") <= bucket)], fetched.where(F.col("pieces") > bucket), []
    held = F.substring("bytes", F.col("anchor") - F.col("low") + 1, F.lit(width + 1) - F.col("high") + F.col("low"))
    strings, half = ["low", "high", "anchor", "windows", "bytes"], ["core", "low", "high"]
    while not large.isEmpty():
        halves = staged(_halved(large, width), "halves")
        one = F.min(F.struct("seed", "content", "shift")).alias("one")
        unlike = staged(halves.groupBy(strings).agg(F.count(F.lit(1)).alias("alike"), one).withColumn("core", held), "unlike-halves")
        several = halves.join(staged(unlike.where("alike > 1").select(strings), "alike-halves"), strings)
        whole.append(several.select("seed", "content", F.col("shift").cast("long").alias("first"), (F.col("shift") + F.col("windows") - 1).cast("long").alias("last")))
        sizes = staged(unlike.groupBy(half).agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"), "half-sizes")
        rest = staged(unlike.join(sizes, half).select("one.*", "pieces", *half, *strings[2:]).select(fetched.columns), "sized-halves")
        local.append(rest.where(F.col("pieces") <= bucket))
        large = rest.where(F.col("pieces") > bucket)
    sorted_ = reduce(DataFrame.unionByName, local).repartitionByRange("core").sortWithinPartitions("core", "low")
    marks = reduce(DataFrame.unionByName, [sorted_.mapInArrow(_sorted(width), RANGE), *whole])
    parts = staged(marks.groupBy("seed", "content").agg(F.collect_set(F.struct("first", "last")).alias("parts")), "repeated-windows")

    begin = F.shiftright("place", 16)
    marked = found.join(parts, ["seed", "content"]).select("key", begin.alias("begin"), F.explode("parts").alias("p"))
    cut = F.struct((F.col("begin") + F.col("p.first")).alias("start"), (F.col("begin") + F.col("p.last") + width).alias("end"))
    cuts = marked.select("key", cut.alias("cut")).groupBy("key").agg(F.collect_set("cut").alias("cuts"))  # bounded by the text's own length
    return cuts


def merged(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[list[int]] = []
    for a, b in sorted((c["start"], c["end"]) for c in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    """The stretches between removed runs."""
    at, left = 0, []
    for a, b in runs:
        left.append(data[at:a])
        at = b
    return [*left, data[at:]]


def removal_digests(docs: DataFrame, width: int = WIDTH, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty; texts shorter than ``width`` lose nothing. Rows that repeat a text
    are copies of each other and lose all that is long enough. Ids play no part in what is removed, so rows with null ids and
    different texts of one id are judged each by its text. Other columns are not read; an empty table gives an empty result.
    """
    texts, cuts = repeats(docs, width, seed, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            runs = [merged(c) for c in batch.column("cuts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array((sum(b - a for a, b in r) for r in runs), pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array(hashlib.sha256(b"".join(_kept(d, r))).hexdigest() for d, r in zip(data, runs))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = texts.join(cuts, "key", "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with repeated passages taken out of the texts, all other columns as they are.

    Null text stays null. Characters of which only some bytes lie in a repeated passage go whole, and what is left on
    both sides of a cut never makes a new character.
    """
    cuts = repeats(docs, width, seed, bucket)[1].withColumnsRenamed({"key": "cut_key__", "cuts": "cuts__"})
    key = F.unhex(F.md5(F.coalesce(docs.text, F.lit("")).cast("binary")))
    joined = docs.join(cuts, key == cuts.cut_key__, "left").drop("cut_key__")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = zip(batch.column("text").to_pylist(), batch.column("cuts__").to_pylist())
            new = [t if t is None or not c else "".join(k.decode(errors="ignore") for k in _kept(t.encode(), merged(c))) for t, c in rows]
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
