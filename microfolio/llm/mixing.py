"""Mixing sources to target weights by pivotal dependent rounding.

A source's target in words is its share by weight of all words; a share above ``MOST`` times the source's own words
stops there and the rest is shared again by weight. Every document of a source is due target / size copies: the
whole part is taken as it is, the rest is a fractional copy. Fractional copies are paired; words are moved at random
from one to the other until one of them is taken or left whole, so that each keeps its expected number of copies and the sum of words
of the pair stays; a document that holds a large part of a block's words is paired with all others together
first, so that what remains is small. Blocks of a source do so by themselves and hand on one residual document at most; residuals meet again in blocks of blocks, a
reduction tree whose last node is rounded to the nearer side. A source's words thus miss its target by half of one document at most.

Random numbers come from a fixed seed and the block's place; documents are placed by (hash of id and size, id, size), so runs
agree however the table is split. Rows equal in id and size are interchangeable.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, after all
others; null and repeated ids are rows like others; sources without words have target 0; an empty table has no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .places import numbered

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 4096
SEED = 20261
#: Part of a block's words from which a document is settled against all others together.
LARGE = 0.01


def words(text: Column) -> Column:
    """Number of runs of characters other than blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Orders as the source does, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to rows (tree, source_size): one per source, weighed by their order of ``tree``.

    Of the sources only two sums reach the driver per round of sharing; sums are exact (whole numbers).
    """
    ranked = numbered(sizes.withColumn("all__", F.lit(0)), "all__", ["tree"], "mixing-sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("pos") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("most", (F.col("source_size") * most).cast("decimal(38,0)"))
    total = int(ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    full, before = F.lit(False), None
    while True:
        weight, sharers, stopped = ranked.agg(
            F.sum(F.when(~full, F.col("weight"))), F.count(F.when(~full, F.lit(1))), F.sum(F.when(full, F.col("most")))
        ).first()
        left = total - int(stopped or 0)
        if not sharers or sharers == before:
            break
        before = sharers
        full = full | (F.col("most") * F.lit(weight) <= F.lit(left).cast("decimal(38,0)") * F.col("weight"))
    even = F.lit(float(left)) * F.col("weight") / F.lit(float(weight or 1))
    target = F.when(full, F.col("most").cast("double")).otherwise(even)
    return ranked.select("tree", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def settle_large(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> None:
    """Pairs a document that holds a large part of the words with all others together, largest first, in place.

    It is taken or left whole at random by its own share, and the others take or give its words in even parts, so that
    expectations and the sum stay. Shares are even before and after; where the others have no room, pairs are left to ``pivot``.
    """
    loose = np.flatnonzero((share > 0) & (share < 1))
    if not len(loose) or share[loose].min() != share[loose].max():
        return
    p, rest = float(share[loose[0]]), float(size[loose].sum())
    for i in loose:
        words = float(size[i])
        if words < LARGE * rest or words >= rest:
            break
        rest -= words
        up, down = p + words * p / rest, p - words * (1 - p) / rest
        if up >= 1 or down <= 0:
            break
        share[i] = float(rng.random() < p)
        p = down if share[i] else up
        share[loose[loose > i]] = p


def pivot(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds ``share`` (fractional copies, in place, the largest sizes first) pair by pair; the place of the one still fractional, or -1."""
    settle_large(size, share, rng)
    carry = -1
    draws = rng.random(len(size))
    for i in range(len(size)):
        if not 0.0 < share[i] < 1.0:
            continue
        if carry < 0:
            carry = i
            continue
        a, b = float(size[carry]), float(size[i])
        p, q = float(share[carry]), float(share[i])
        up = min(a * (1 - p), b * q)  # words the carried one can gain from the other
        down = min(a * p, b * (1 - q))
        if draws[i] * (up + down) < down:
            whole = (1.0, None) if up == a * (1 - p) else (None, 0.0)
            p, q = p + up / a, q - up / b
        else:
            whole = (0.0, None) if down == a * p else (None, 1.0)
            p, q = p - down / a, q + down / b
        share[carry], share[i] = (p if whole[0] is None else whole[0]), (q if whole[1] is None else whole[1])
        loose = [k for k in (carry, i) if 0.0 < share[k] < 1.0]
        carry = loose[0] if loose else -1
    return carry


def _rounded(level: int):
    """One node of the tree: rows of one block, the largest documents first."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("pos", "ascending")])
        share = rows.column("share").to_numpy().copy()
        seed = zlib.crc32(f"{SEED}:{level}:{key[0].as_py()}:{key[1].as_py()}".encode())
        pivot(rows.column("size").to_numpy(), share, np.random.default_rng(seed))
        return rows.set_column(rows.schema.get_field_index("share"), "share", pa.array(share))

    return run


def _node(rows: DataFrame, level: int, block: int) -> DataFrame:
    rows = rows.withColumn("node", F.expr(f"pos div {block}"))
    return rows.groupBy("tree", "node").applyInArrow(_rounded(level), rows.schema)


def _loose() -> Column:
    return (F.col("share") > 0) & (F.col("share") < 1)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``source_size``, ``target`` of its source, ``copies`` and ``taken`` = copies × size."""
    rows = docs.select(F.col("doc_id"), _source_key(F.col("source")).alias("tree"), words(F.col("text")).alias("size"))
    rows = numbered(rows.withColumn("hash", F.xxhash64("doc_id", "size")), "tree", ["hash", "doc_id", "size"], "mixing").drop("hash", "n")
    sources = staged(targets(rows.groupBy("tree").agg(F.sum("size").alias("source_size")), weights, most), "mixing-targets")

    due = F.col("target") / F.col("source_size")
    whole = F.least(F.floor(due), F.lit(most))
    sized = rows.join(sources, "tree")
    sized = sized.withColumn("base", F.when(F.col("size") > 0, whole).otherwise(0).cast("long"))
    sized = sized.withColumn("share", F.when((F.col("size") > 0) & (whole < most), due - whole).otherwise(0.0))
    leaves = staged(_node(sized, 0, block), "mixing-leaves")

    residuals = leaves.where(_loose()).select("tree", "node", "size", "share", F.col("node").alias("pos")).withColumnRenamed("node", "leaf")
    settled, level = [], 0
    while True:
        level += 1
        last = (residuals.agg(F.max("pos")).first()[0] or 0) < block
        nodes = _node(residuals, level, block)
        if last:
            settled.append(nodes.withColumn("share", F.round("share")).select("tree", "leaf", "share"))
            break
        nodes = staged(nodes, "mixing-nodes")
        settled.append(nodes.where(~_loose()).select("tree", "leaf", "share"))
        residuals = nodes.where(_loose()).drop("pos").withColumnRenamed("node", "pos")
    ends = settled[0]
    for more in settled[1:]:
        ends = ends.unionByName(more)
    ends = ends.select(F.col("tree"), F.col("leaf").alias("node"), F.col("share").alias("end"), F.lit(True).alias("loose"))

    done = leaves.withColumn("loose", _loose()).join(ends, ["tree", "node", "loose"], "left")
    copies = F.col("base") + F.coalesce("end", "share").cast("long")
    return done.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
