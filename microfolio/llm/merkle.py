"""Merkle manifest of a table: a tree of digests per source, a tree over the sources, and proofs for every row.

The leaves of a source stand in ``doc_id`` order at positions 0, 1, ... Levels are built in blocks of ``FAN ** LEVELS``
neighbouring positions, which hold whole runs of every level inside them, so one exchange serves ``LEVELS`` levels and
a source of any size is spread over its blocks. On level l the row at a multiple of 3^l stands for a node: ``lag`` and
``lead`` by 3^l and twice 3^l rows, masked by the node's slot and the length of its run, are its siblings, and the row of
the first child hashes the parent. The top nodes of all blocks are the rows of the next round.

Defined cases: a null field is ``-``; a null source is a source of its own, before all others; null ids come first,
rows of one id are ordered by their digest (equal rows are interchangeable); rows without an id are never tampered with;
an empty table has no rows. Columns other than the five of ``documents`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .places import numbered

FAN = 3
LEVELS = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row; ``text`` in place of its own."""
    columns = [F.col(f) for f in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return digest(*[_field(c) for c in columns])


def _tree_key(source: Column) -> Column:
    """Orders as the source does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """Adds ``block``, ``top`` (digest of the block's node after ``levels`` levels, on its first row) and ``path``."""
    in_block = Window.partitionBy("tree", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.expr(f"pos div {FAN**levels}")).withColumn("top", F.col("digest"))
    for level in range(levels):
        step = FAN**level
        rows = rows.withColumns(
            {f"{side.__name__}{k}": side("top", k * step).over(in_block) for side in (F.lag, F.lead) for k in (1, 2)}
        )
        node = F.expr(f"pos div {step}")
        width = F.expr(f"(n + {step - 1}) div {step}")
        slot = node % FAN
        run = F.least(F.lit(FAN), width - node + slot)
        here = (width > 1) & (F.col("pos") % step == 0)
        masked = {
            "left": [F.when(slot == 2, F.col("lag2")), F.when(slot >= 1, F.col("lag1"))],
            "right": [F.when(slot + 1 < run, F.col("lead1")), F.when(slot + 2 < run, F.col("lead2"))],
        }
        sides = {f"{side}_{level}": F.when(here, F.concat_ws("", *columns)) for side, columns in masked.items()}
        parent = F.when(width > 1, digest(F.col("top"), F.col(f"right_{level}"))).otherwise(F.col("top"))
        rows = rows.withColumns(sides).withColumn("top", F.when(F.col("pos") % (FAN * step) == 0, parent))
        rows = rows.drop("lag1", "lag2", "lead1", "lead2")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    steps = []
    for level in range(levels):
        found = {side: F.last(f"{side}_{level}", ignorenulls=True).over(so_far) for side in ("left", "right")}
        steps.append(F.struct(*[c.alias(side) for side, c in found.items()]))
    rows = rows.withColumn("path", F.filter(F.array(*steps), lambda s: s.left.isNotNull()))
    return rows.drop(*[f"{side}_{level}" for level in range(levels) for side in ("left", "right")])


def climb(leaves: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of nodes (tree, pos, n, digest), each ``levels`` levels above the one before; the last has one row per tree."""
    tables = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while len(tables) == 1 or most > 1:
        size = FAN**levels
        tops = _climbed(tables[-1], levels).where(F.col("pos") % size == 0)
        tops = tops.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))
        tables.append(staged(tops, f"{name}-nodes"))
        most = -(-most // size)
    return tables


def proofs(tables: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The leaves with the columns of ``above`` (one row per tree, with ``path``); their own siblings precede its path."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(tables[:-1]):
        upper = above.withColumnRenamed("path", "path_above")
        rows = _climbed(nodes, levels).drop("top").join(upper, ["tree", "block"])
        rows = rows.withColumn("path", F.concat("path", "path_above")).drop("block", "path_above")
        above = rows.drop("n", "digest").withColumnRenamed("pos", "block")
    return rows


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings left and right, level by level up to the
    root) and ``changed``, the leaf of the row with ``tampered`` as its text (its own where null or not given)."""
    changed = leaf() if tampered is None else leaf(tampered)
    rows = docs.select(F.col("doc_id"), _tree_key(F.col("source")).alias("tree"), leaf().alias("digest"), changed.alias("changed"))
    documents = climb(numbered(rows, "tree", ["doc_id", "digest"], "merkle"), "merkle", levels)

    subroots = documents[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = climb(numbered(subroots, "tree", ["source"], "merkle-sources"), "merkle-sources", levels)
    root = sources[-1].select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    above = proofs(sources, root, levels).select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return proofs(documents, above, levels).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "changed")


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda node, step: digest(step.left, node, step.right))


def verification(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest checked after a tampering: texts of rows whose id has an even crc32 lose their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, cut, levels)
    siblings = F.concat_ws("", F.transform("path", lambda step: F.concat(step.left, step.right)))
    rows = rows.withColumn("folded_root", folded(F.col("changed")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
