"""Document fingerprints: all shingle hashes below a fixed share of the hash range (native).

A shingle is five neighbouring words, or all words of a shorter text; its hash is 32 bits of
xxhash64. The fingerprint holds, sorted and in hex, each distinct hash below 2^32 / SCALE, and the
smallest hash where there is none. Fingerprints of two texts merge by union, and the share of common
hashes in the smaller fingerprint estimates how much of that text's shingles the other one holds,
however unequal the texts are.

The next document is found inside ranges of ids: quantiles of the ids are bounds, and the
first document of a range is also sent to the range before it, so one window per range suffices. All
is done by DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
SCALE = 4
RANGE_DOCS, MOST_RANGES = 512, 1 << 16
WHITE = r"[\x20\x09-\x0D]+"
LAST_ID = (1 << 63) - 1
HEX = 8


def with_fingerprint(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """Adds the fingerprint of a text column as a sorted array of hashes; an empty text has none."""
    words, hashes, low = f"{name}_words__", f"{name}_hashes__", f"{name}_low__"
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), lambda w: w != ""))
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(
        hashes, F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WORDS))).bitwiseAND(F.lit((1 << 32) - 1)))
    )
    df = df.withColumn(low, F.filter(hashes, lambda h: h < (1 << 32) // scale))
    smallest = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.col(hashes))
    return df.withColumn(name, F.array_sort(F.array_distinct(F.when(F.size(low) > 0, F.col(low)).otherwise(smallest)))).drop(words, hashes, low)


def written(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.lpad(F.hex(h), HEX, "0"))), "")


def read(text: str) -> Column:
    """The hashes of a written fingerprint."""
    return F.transform(
        F.filter(F.split(F.col(text), f"(?<=\\G.{{{HEX}}})"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long")
    )


def merge(one: Column, other: Column) -> Column:
    """The fingerprint of two texts' shingles together; what only stood in for an empty one may stay."""
    return F.array_sort(F.array_union(one, other))


def likeness(one: str, other: str) -> Column:
    """The share of common hashes in the smaller fingerprint; 1 for two empty ones, 0 for one."""
    least = F.least(F.size(one), F.size(other))
    return F.when(least > 0, F.size(F.array_intersect(one, other)) / least).otherwise((F.size(one) == F.size(other)).cast("double"))


def _ranges(rows: DataFrame) -> tuple[list[list[int]], int]:
    """Bounds of ids that occur, the smallest first, as rows of about equal length (65,536 at most)."""
    count, first = rows.agg(F.count(F.lit(1)), F.min("order_id")).first()
    n = min(MOST_RANGES, -(-count // RANGE_DOCS))
    bounds = {first} if count else set()
    if n > 1:
        shares = [k / n for k in range(1, n)]
        bounds |= set(rows.agg(F.percentile_approx("order_id", shares, max(10_000, 10 * n)).alias("q")).first()["q"])
    ordered = sorted(bounds)
    width = max(1, int(len(ordered) ** 0.5))
    return [ordered[i : i + width] for i in range(0, len(ordered), width)], len(ordered)


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    In the edited text the last quarter of the code points gives way to as many first ones of the
    next document by id, or all it has. Null text counts as empty. Null ids come after all others,
    rows of one id are ordered by text, and the first document follows the last one. Columns besides
    doc_id and text are not read; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("order_id"))
    grid, ranges = _ranges(rows)
    bounds = F.from_json(F.lit(json.dumps(grid)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([g[0] for g in grid])), "array<bigint>")
    width = len(grid[0]) if grid else 1
    at = F.size(F.filter(heads, lambda b: b <= F.col("order_id")))
    rows = rows.withColumn("row", F.when(F.lit(not grid), 1).otherwise(at))
    own = F.get(bounds, F.col("row") - 1)
    rows = rows.withColumn("range", (F.col("row") - 1) * width + F.size(F.filter(own, lambda b: b <= F.col("order_id"))))
    rows = rows.withColumn("is_bound", F.array_contains(own, F.col("order_id")))
    rows = with_fingerprint(rows, "text", "fp", scale)
    before = F.when(F.col("range") > 1, F.col("range") - 1).otherwise(ranges)
    places = F.filter(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), F.when(F.col("is_bound"), F.struct(before.alias("at"), F.lit(True).alias("guest")))), lambda p: p.isNotNull())
    dealt = rows.select("doc_id", "order_id", "text", "fp", F.explode(places).alias("place")).select("doc_id", "order_id", "text", "fp", "place.*")
    window = Window.partitionBy("at").orderBy("guest", "order_id", "text")
    pairs = dealt.select("*", F.lead("text").over(window).alias("next_text"), F.lead("fp").over(window).alias("next_fp")).where("not guest")
    quarter = F.floor(F.length("text") / 4).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)))
    pairs = with_fingerprint(pairs, "edited", "edited_fp", scale)
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written("fp").alias("fingerprint"),
        written("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
