"""Near duplicates by a chosen-path set similarity join over word shingles.

A document's set holds its distinct shingles of five words. Rows of equal sets are one
representative. Every representative stands in independent trees; on each of ``LEVELS`` levels of a tree
it goes to the child named by its smallest shingle under the level's own hash function, so two sets
of similarity s stay together with probability s. A node of at most ``SMALL`` sets is a leaf, the sets of a
larger one go on. The number of trees follows from the target recall: sets at the threshold t miss each other in all trees with probability
(1 - t^LEVELS)^trees at most, so ``trees_for`` takes the least number that keeps this under 1 - ``RECALL`` (10 at 0.85, 16 at 0.8).

In every node each set is compared with the node's first; that links a group of sets all alike without its
pairs. Leaves are then compared exhaustively, but for pairs that the links so far have put into one component.
Nodes still large after all levels branch once more, by every shingle that could be the first common
one of a link: shingles are ordered from rare to common among the sets that are left, and linked sets share one in the first few
places (``_selected``). Sets whose own shingles exceed what a link allows fall out there, so a template with many
fillings gives no pairs; nothing is lost at that step. A child's sets are compared across components only.

Candidates pass bounds that every link passes (the sizes) or all but surely passes (agreement of two bits of each smallest
shingle), and are confirmed on the full sets. Sets are made again from the texts
for the documents in shared nodes. Components come from rounds of pointing at smaller neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely_in, pieces, scratch, staged

WORDS = 5
PERCENT = 85
LEVELS, SMALL = 6, 48
RECALL = 0.99
#: Standard deviations of agreement below which a candidate goes.
SLACK = 4.5
#: Functions of the longer sketch of sets in large nodes.
FINE = 512
#: Counters of shingles by which they are ordered from rare to common.
TALLIES = 1 << 20
PIECE_BYTES = 1 << 20
SIGNED = "doc_id long, text_hash long, n_shingles long, rep binary, sketch array<long>, minima array<int>"
_FACTORS = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_PAIRS = np.uint64(0x5555555555555555)


def trees_for(percent: int, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Trees after which a pair at the threshold has met in a leaf of depth ``levels`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** levels))


@lru_cache
def _functions(count: int, seed: int = 6) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes: A-Z in lower case, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    n = len(words)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n == 0:
        return hashed
    m = max(n - WORDS + 1, 1)
    total = np.full(m, np.uint64(min(n, WORDS)))
    for k in range(min(n, WORDS)):
        total += _mixed(hashed[k : k + m] * _FACTORS[k])
    return np.unique(_mixed(total))


def minima(found: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """For each function, 32 bits that name the smallest shingle."""
    out = np.full(len(functions), np.iinfo(np.uint64).max)
    for i in range(0, len(found), 512):
        part = found[i : i + 512, None] * functions[None, :]
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(16)).astype(np.uint32).view(np.int32)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each smallest shingle, 32 of them to a word."""
    bits = np.zeros(-(-len(least) // 32) * 64, np.uint8)
    bits[0 : 2 * len(least) : 2], bits[1 : 2 * len(least) : 2] = least & 1, least >> 1 & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _sign(trees: int):
    functions = _functions(trees * LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            sizes, ids, sketches, least = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                least.append(minima(found, functions) if len(found) else None)
                sketches.append(sketch(least[-1]) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "rep", "sketch", "minima"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        found = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
        ids = [xxhash.xxh3_128_digest(f) for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.binary())], names=["rep", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "one"):
            keep = []
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist()):
                a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(a: str, b: str, percent: int, k: int, column: str = "sketch", slack: float = SLACK) -> Column:
    """The sizes of linked sets differ by no more than the similarity allows, and their sketches of ``k`` functions in few places.

    Two bits agree where the smallest shingles agree, and by chance in a quarter of the other cases.
    """
    agree = percent / 100 + (1 - percent / 100) / 4
    most = int(k * (1 - agree) + slack * (k * agree * (1 - agree)) ** 0.5)
    m, n = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = F.lit(0)
    for word in range(-(-k // 32)):
        x = F.get(f"{a}.{column}", F.lit(word)).bitwiseXOR(F.get(f"{b}.{column}", F.lit(word)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(int(_PAIRS))))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (differ <= most)


def _tree_rows(reps: DataFrame, trees: int) -> DataFrame:
    paths = F.array(*(F.struct(F.lit(t).alias("tree"), F.slice("minima", t * LEVELS + 1, LEVELS).alias("path")) for t in range(trees)))
    rows = reps.select("rep", "n_shingles", "sketch", F.explode(paths).alias("p"))
    return rows.select("rep", "n_shingles", "sketch", "p.path", F.xxhash64("p.tree", F.get("p.path", F.lit(0))).alias("node"))


def candidates(reps: DataFrame, percent: int = PERCENT, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs with the first sets of nodes, rows of leaves, rows of nodes that stay large)."""
    trees = trees_for(percent)
    rows, pairs, ends = _tree_rows(reps, trees), [], []
    for level in range(1, LEVELS + 1):
        first = F.min(F.struct("rep", "n_shingles", "sketch")).alias("first")
        if level == 1:  # most nodes hold one set; they leave before anything is shuffled but their names
            sizes = staged(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes")
            together = staged(likely_in(rows, sizes, "node").join(sizes, "node"), "level")
            nodes = together.groupBy("node").agg(first)
        else:
            together = rows
            nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), first).where("size > 1")
        held = staged(together.join(staged(nodes, "nodes"), "node"), "level").alias("held")  # read anew, so that the join may split a large node
        others = held.where((F.col("rep") != F.col("first.rep")) & _alike("held", "first", percent, trees * LEVELS))
        pairs.append(others.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")))
        large = held.where(F.col("size") > small)
        # The pair of a leaf of two is compared already.
        ends.append(held.where((F.col("size") > 2) & (F.col("size") <= small)).select("node", "rep", "n_shingles", "sketch"))
        rows = large.select("rep", "n_shingles", "sketch", "path", "node")
        if level == LEVELS or large.isEmpty():
            break
        rows = rows.withColumn("node", F.xxhash64("node", F.get("path", F.lit(level))))
    return reduce(DataFrame.union, pairs).distinct(), reduce(DataFrame.union, ends), rows.select("node", "rep", "n_shingles", "sketch")


def full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the wanted representatives, made again from one text of each."""
    hashes = staged(reps.join(wanted, "rep", "left_semi").select("text_hash").distinct(), "wanted")
    texts = likely_in(docs.select(F.xxhash64("text").alias("text_hash"), "text"), hashes, "text_hash").join(hashes, "text_hash")  # a semi-join would be moved before the bitmap
    one = texts.groupBy("text_hash").agg(F.min("text").alias("text")).select("text")
    return staged(one.mapInArrow(_sets, "rep binary, shingles binary"), "sets")


def links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The candidate pairs whose full sets are similar enough."""
    likely = staged(pairs, "candidates")
    both = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("other")), "b")
    return staged(both.mapInArrow(_confirm(percent), "a binary, b binary"), "links")


def components(pairs: DataFrame) -> DataFrame:
    """(rep, component) of all ends of links; component is the smallest representative reachable.

    Each round links all neighbours of an id, and the id, to the smallest of them (larger ones in
    one half, smaller ones in the other) until nothing changes.
    """
    def state(rows: DataFrame):
        return rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    edges = staged(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    before, now = None, state(edges)
    while now != before:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        edges = staged(small, "edges")
        before, now = now, state(edges)
    down = edges.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "rep")
    return down.union(down.select("component", "component").distinct())


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their component so far."""
    return rows.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _across_leaves(leaves: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one leaf."""
    grouped = staged(_named(leaves, found), "leaves")
    mixed = grouped.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("node")
    left = staged(grouped.join(mixed, "node"), "mixed-leaves")
    a, b = left.alias("a"), left.alias("b")
    on = (F.col("a.node") == F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.rep") < F.col("b.rep")) & _alike("a", "b", percent, trees_for(percent) * LEVELS)
    return a.join(b, on).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A longer sketch of the sets for which the short one decides too little."""
    functions = _functions(FINE, 7)
    for batch in pieces(batches, "shingles", PIECE_BYTES):
        found = [sketch(minima(np.frombuffer(s, np.uint64), functions)) for s in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.list_(pa.int64()))], names=["rep", "fine"])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "shingles", PIECE_BYTES):
        tokens = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
        tally = np.bincount((tokens % np.uint64(TALLIES)).astype(np.int64), minlength=TALLIES)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(tally[at], pa.int64())], names=["tally", "n"])


def _selected(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The shingles by which sets of large nodes branch once more: (token, rep, place, inner, n_shingles).

    In an order from rare to common, a link's first common shingle is among the first n - ceil(t n) + 1 of the longer set and
    among the first n - ceil(2 t n / (1 + t)) + 1 of the shorter (``inner``). Any order is right, as long as all sets use the same; this one
    follows ``TALLIES`` counters that shingles share by their remainder, so its table has a fixed size at any input.
    """
    held = sets.join(rows.select("rep"), "rep", "left_semi")
    counts = np.zeros(TALLIES, np.int64)
    for r in held.mapInArrow(_tallied, "tally int, n long").groupBy("tally").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["tally"]] = r["n"]
    shared = held.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "shingles", PIECE_BYTES):
            tokens, owner, place, inner, sizes = [], [], [], [], []
            for k, text in enumerate(batch.column("shingles").to_pylist()):
                found = np.frombuffer(text, np.uint64)
                n = len(found)
                most = n - -(-n * percent // 100) + 1
                order = np.lexsort((found, shared.value[(found % np.uint64(TALLIES)).astype(np.int64)]))[:most]
                tokens.append(found[order].view(np.int64))
                owner.append(np.full(len(order), k))
                place.append(np.arange(1, len(order) + 1))
                inner.append(place[-1] <= n + -(n * 2 * percent // (100 + percent) + (n * 2 * percent % (100 + percent) > 0)) + 1)
                sizes.append(np.full(len(order), n))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (tokens, owner, place, inner, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), batch.column("rep").take(pa.array(columns[1], pa.int64())), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3].astype(bool)), pa.array(columns[4], pa.int64())],
                names=["token", "rep", "place", "inner", "n_shingles"],
            )

    return held.mapInArrow(run, "token long, rep binary, place long, inner boolean, n_shingles long")


def _branches(large: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The children that sets of nodes with several components go to: (token, rep, place, inner, n_shingles, fine)."""
    grouped = staged(_named(large, found), "large")
    mixed = grouped.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("node")
    rows = staged(grouped.join(mixed, "node", "left_semi").select("rep").distinct(), "large-sets")
    chosen = staged(_selected(rows, sets, percent), "selected")
    several = chosen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    finer = sets.join(rows, "rep", "left_semi").mapInArrow(_finer, "rep binary, fine array<long>")
    return staged(chosen.join(several, "token").join(finer, "rep"), "branches")


def _across_branches(branches: DataFrame, found: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs of different components in one child; those within the child's largest component are left out whole."""
    entries = staged(_named(branches, found), "named-branches")
    weight = entries.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    children = entries.join(weight, "component").groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.struct("weight", "component")).alias("main")
    )
    children = staged(children.where("x <> y").select("token", F.col("main.component").alias("main")), "children")
    there = staged(entries.join(children, "token"), "mixed-branches")
    a, b = there.where("component <> main").alias("a"), there.alias("b")
    shares = (F.least(F.col("a.n_shingles") - F.col("a.place"), F.col("b.n_shingles") - F.col("b.place")) + 1) * (100 + percent)
    enough = shares >= percent * (F.col("a.n_shingles") + F.col("b.n_shingles"))
    places = (F.col("a.inner") & (F.col("a.n_shingles") <= F.col("b.n_shingles"))) | (F.col("b.inner") & (F.col("b.n_shingles") <= F.col("a.n_shingles")))
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.rep") < F.col("b.rep"))
    alike = _alike("a", "b", percent, FINE, "fine", slack)
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & once & places & enough & alike
    return a.join(b, on).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()


def _reachable(docs: DataFrame, reps: DataFrame, percent: int, small: int) -> DataFrame:
    """(rep, component) of all representatives with links."""
    pairs, leaves, large = candidates(reps, percent, small)
    pairs = staged(pairs, "first-pairs")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(leaves.select("rep")).union(large.select("rep")).distinct()
    sets = full_sets(docs, reps, wanted)
    found = staged(components(links(pairs, sets, percent)), "components")

    def joined_by(more: DataFrame) -> DataFrame:
        """Components after further candidates; those so far stand for their links."""
        links_so_far = found.select(F.col("rep").alias("a"), F.col("component").alias("b"))
        return staged(components(links_so_far.union(links(more, sets, percent))), "components")

    found = joined_by(_across_leaves(leaves, found, percent))
    branches = _branches(large, found, sets, percent)
    for slack in (0.0, SLACK):  # likely links first: what they join needs no pairs of the second round
        found = joined_by(_across_branches(branches, found, percent, slack))
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Linked are rows with 100 * common >= percent * all shingles; ``component_id`` is the smallest
    doc_id reachable over links. Null or blank texts have no shingles, no links and a component of
    their own. Different texts under one id are linked each by itself. Rows with a null id are linked like others; they
    take the smallest id of their component, or null where there is none, and are kept only then. Rows that
    repeat an id with the same text are kept or not together. An empty table gives an empty result; other columns
    are not read.
    """
    trees = trees_for(percent)
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = staged(read.mapInArrow(_sign(trees), SIGNED), "signatures")
    alike = signed.where("rep is not null").groupBy("rep")
    reps = staged(alike.agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("text_hash", "n_shingles", "sketch", "minima")]), "representatives")
    with scratch(docs.sparkSession) as keep:
        found = keep(_reachable(docs, reps, percent, small), "components")
    named = reps.select("rep", "least_id").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = signed.drop("minima", "sketch").join(named.join(least, "component").select("rep", "component_id"), "rep", "left")
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
