"""Repair of damaged conversations: the cheapest edits that give roles ``(s?(ua)+)?``.

A row is its role's initial and its first fault. The edit lattice of a conversation has nodes (row, state); the states are:
nothing yet, after the system row, after a user row, after an assistant row. Edits Delete, Keep and Rerole go to the
next row, Insert stays at the row; in every state a letter leads to one node only, so the letters name the edits fully.
``search`` runs Dijkstra from both ends: the forward heap is ordered by (cost, letters so far), the reverse heap by
(cost, rows last first, letters to come). It goes on until no path as cheap as the best meeting is open, then takes the least
concatenation over all equal-cost crossings.

A conversation is cut into blocks of ``BLOCK`` rows, each searched by itself, so that a conversation of any length is spread:
for conversations of several blocks the blocks' cost tables (4 × 4 numbers) are chained from the end, which gives
each block the costs that follow it, and from the start, which gives it its first state. Only the digest of the repaired text, which is sequential
by its definition, reads a conversation in one task, as a stream that holds one row and the letters at a time.

Defined cases: nulls in the key, role or text count as one space (so a null text is blank and a null role can't be kept); null
``conv_id`` is one conversation, null turns come first; rows of one turn are ordered by role, then by the text's
digest; a role whose initial is none of s, u, a is illegal beside any row and can't be kept; a conversation that loses all rows
has zeros, an empty audit and the digest of an empty text; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

from .common import staged
from .places import numbered

BLOCK = 256
INF = 1 << 40
INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where an inserted or reroled row leads
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
CLOSED = (0, INF, INF, 0)  # costs after the last row: nothing or a whole exchange
SPACES = " \t\n\x0b\f\r"


# --- the lattice of one block -------------------------------------------------------------------------------------------


def _edges(initials: str, faults: str, last: bool):
    """Edges out of and into (row, state): (cost, letter, other node). ``faults``: b, d, t or - per row."""
    n = len(initials)

    def out(node):
        i, state = node
        found = []
        if i < n:
            found.append((DELETE, "D", (i + 1, state)))
            if faults[i] not in "bd":
                extra = TRUNCATED if faults[i] == "t" else 0
                found.append((REROLE + extra, "R", (i + 1, NEXT[state])))
                if (state, initials[i]) in KEPT:
                    found.append((extra, "K", (i + 1, KEPT[state, initials[i]])))
        if i < n or last:
            found.append((INSERT, "I", (i, NEXT[state])))
        return found

    def into(node):
        i, state = node
        return [
            (cost, letter, (j, q))
            for j in ((i - 1, i) if i else (i,))
            for q in range(4)
            for cost, letter, to in out((j, q))
            if to == node
        ]

    return out, into


@lru_cache(maxsize=10_000)  # short conversations repeat the same few patterns
def search(initials: str, faults: str, first: int, after: tuple, last: bool) -> tuple[int, str, int]:
    """Cost, least letters and last state of the cheapest way from state ``first`` to the end, where ``after`` holds the costs that follow.

    Inserts behind the last row belong to the next block, unless this one is the ``last``.
    """
    out, into = _edges(initials, faults, last)
    n = len(initials)
    ahead, behind = {}, {}  # settled: node -> (cost, letters), node -> (cost, letters, last state)
    forward = [(0, "", (0, first))]
    reverse = [(after[q], -n, "", (n, q), q) for q in range(4) if after[q] < INF]
    heapq.heapify(reverse)
    best = INF

    def goal(node):
        return after[node[1]] if node[0] == n else INF

    while forward and (not ahead or forward[0][0] + (reverse[0][0] if reverse else INF) <= best):
        if not ahead or not reverse or forward[0][0] <= reverse[0][0]:
            cost, letters, node = heapq.heappop(forward)
            if node in ahead:
                continue
            ahead[node] = (cost, letters)
            best = min(best, cost + goal(node))
            for step, letter, to in out(node):
                if to in behind:
                    best = min(best, cost + step + behind[to][0])
                if to not in ahead:
                    heapq.heappush(forward, (cost + step, letters + letter, to))
        else:
            cost, _, letters, node, end = heapq.heappop(reverse)
            if node in behind:
                continue
            behind[node] = (cost, letters, end)
            for step, letter, before in into(node):
                if before in ahead:
                    best = min(best, ahead[before][0] + step + cost)
                if before not in behind:
                    heapq.heappush(reverse, (cost + step, -before[0], letter + letters, before, end))

    crossings = [(letters, node[1]) for node, (cost, letters) in ahead.items() if cost + goal(node) == best]
    for node, (cost, letters) in ahead.items():
        for step, letter, to in out(node):
            if to in behind and cost + step + behind[to][0] == best:
                crossings.append((letters + letter + behind[to][1], behind[to][2]))
    letters, end = min(crossings)
    return best, letters, end


def transfer(initials: str, faults: str, last: bool) -> list[int]:
    """Least costs from each first state to each last state of a block, as 16 numbers."""
    out, _ = _edges(initials, faults, last)
    costs = []
    for first in range(4):
        settled, heap = {}, [(0, (0, first))]
        while heap:
            cost, node = heapq.heappop(heap)
            if node not in settled:
                settled[node] = cost
                for step, _, to in out(node):
                    heapq.heappush(heap, (cost + step, to))
        costs += [settled.get((len(initials), q), INF) for q in range(4)]
    return costs


def _mapped(df: DataFrame, function, **added: DataType) -> DataFrame:
    """Rows (dicts) through ``function``, which gives the values of the columns ``added``."""
    schema = StructType(df.schema.fields + [StructField(*field) for field in added.items()])
    types = [to_arrow_type(kind) for kind in added.values()]
    names = list(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(r) for r in batch.to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, names=batch.schema.names + names)

    return df.mapInArrow(run, schema)


# --- rows ---------------------------------------------------------------------------------------------------------------


def _worded(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the stated damage: conv_id, turn, role, text; repeated rows follow one another."""
    name = F.concat(_worded(F.col("conv_id")), F.lit(":"), _worded(F.col("turn")))
    role, text = _worded(F.col("role")), _worded(F.col("text"))
    hit = F.crc32(name.cast("binary")) % 20
    return rows.select(
        F.col("conv_id"),
        F.col("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(hit == 0, F.array()).when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), conv_id.cast("string")), F.lit("0"))


def _judged(rows: DataFrame) -> DataFrame:
    """Places of the rows and what the lattice needs of them; texts stay behind."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    end = F.substring(trimmed, -1, 1)
    slim = rows.select(
        _conversation_key(F.col("conv_id")).alias("conv"), F.col("turn"), F.col("role"), F.sha2("text", 256).alias("digest"),
        F.when(trimmed == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("-").alias("fault"),
    )
    placed = numbered(slim, "conv", ["turn", "role", "digest"], "conversations")
    same = ["conv", "role", "digest"]
    repeated = placed.groupBy(*same).agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    initial = F.substring("role", 1, 1)
    return placed.join(repeated, same, "left").select(
        "conv", "turn", "pos", "n",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when((F.col("fault") != "b") & (F.col("pos") > F.col("seen")), "d").otherwise(F.col("fault")).alias("fault"),
    )


def _blocks(judged: DataFrame, block: int) -> DataFrame:
    """One row per block of a conversation: initials and faults of its rows in order."""
    rows = judged.groupBy("conv", F.expr(f"pos div {block}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("rows")
    )
    return rows.select(
        "conv", "block", "n", F.expr(f"block = (n - 1) div {block}").alias("last"),
        F.array_join(F.col("rows.initial"), "").alias("initials"), F.array_join(F.col("rows.fault"), "").alias("faults"),
    )


def _chained_back(key: tuple, blocks: pa.Table) -> pa.Table:
    """Costs that follow each block of a conversation, from its end to its start."""
    blocks = blocks.sort_by([("block", "descending")])
    after, found = list(CLOSED), []
    for costs in blocks.column("costs").to_pylist():
        found.append(after)
        after = [min(costs[4 * p + q] + after[q] for q in range(4)) for p in range(4)]
    return pa.table({"conv": blocks.column("conv"), "block": blocks.column("block"), "after": pa.array(found, pa.list_(pa.int64()))})


def _chained_on(key: tuple, blocks: pa.Table) -> pa.Table:
    """First state of each block, from the start of the conversation to its end."""
    blocks = blocks.sort_by([("block", "ascending")])
    state, found = START, []
    for ends in blocks.column("ends").to_pylist():
        found.append(state)
        state = ends[state]
    return pa.table({"conv": blocks.column("conv"), "block": blocks.column("block"), "first": pa.array(found, pa.int64())})


def _repaired(blocks: DataFrame, block: int) -> DataFrame:
    """Per conversation with rows: cost and audit."""
    single = _mapped(
        blocks.where(F.col("n") <= block), lambda r: search(r["initials"], r["faults"], START, CLOSED, True)[:2], cost=LongType(), audit=StringType()
    ).select("conv", "cost", "audit")
    several = blocks.where(F.col("n") > block)
    priced = staged(_mapped(several, lambda r: [transfer(r["initials"], r["faults"], r["last"])], costs=ArrayType(LongType())), "conversations-costs")
    following = priced.groupBy("conv").applyInArrow(_chained_back, "conv string, block long, after array<long>")

    def ends(r):
        return [[_reach(r, q)[2] for q in range(4)]]

    ended = staged(_mapped(priced.drop("costs").join(following, ["conv", "block"]), ends, ends=ArrayType(LongType())), "conversations-ends")
    firsts = ended.groupBy("conv").applyInArrow(_chained_on, "conv string, block long, first long")

    def walked(r):
        cost, letters, end = _reach(r, r["first"])
        return [letters, cost if r["block"] == 0 else None]

    letters = _mapped(ended.drop("ends").join(firsts, ["conv", "block"]), walked, letters=StringType(), cost=LongType())
    joined = letters.groupBy("conv").agg(
        F.max("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("block", "letters"))).letters, "").alias("audit")
    )
    return single.unionByName(joined)


def _reach(r: dict, first: int) -> tuple[int, str, int]:
    """``search`` from a first state; from a state that no way to the end leaves, anything will do."""
    return search(r["initials"], r["faults"], first, tuple(r["after"]), r["last"])


def repaired_lines(role: str, text: str, letters: Iterator[str], state: int) -> tuple[list[str], int]:
    """Lines that the letters up to the row's own one give, and the state after them."""
    lines = []
    for letter in letters:
        if letter == "D":
            break
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = KEPT[state, role[:1]]
            break
        state = NEXT[state]
        lines.append(f"{ROLES[state]}:{text if letter == 'R' else ''}")
        if letter == "R":
            break
    return lines, state


class _Digest:
    """Digest of lines joined by line feeds."""

    def __init__(self) -> None:
        self.hash, self.glue = hashlib.sha256(), ""

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.hash.update((self.glue + line).encode("utf-8", "surrogatepass"))
            self.glue = "\n"


def _digested(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): each conversation's audit, then its rows in order, streamed."""
    texts = rows.select(
        _conversation_key(F.col("conv_id")).alias("conv"), F.lit(1).alias("kind"), F.col("turn"), F.col("role"),
        F.sha2("text", 256).alias("digest"), F.col("text"),
    )
    nothing = F.lit(None).cast("string")
    heads = audits.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast(texts.schema["turn"].dataType).alias("turn"), nothing.alias("role"),
        nothing.alias("digest"), F.col("audit").alias("text"),
    )
    stream = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, letters, state = None, None, iter(""), START
        for batch in batches:
            done = []
            for key, kind, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text")], strict=True):
                if kind == 0:
                    if conv is not None:
                        digest.add(repaired_lines("", "", letters, state)[0])
                        done.append((conv, digest.hash.hexdigest()))
                    conv, digest, letters, state = key, _Digest(), iter(text), START
                    continue
                lines, state = repaired_lines(role, text, letters, state)
                digest.add(lines)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["conv", "repaired_sha256"])
        if conv is not None:
            digest.add(repaired_lines("", "", letters, state)[0])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (conv, digest.hash.hexdigest())], names=["conv", "repaired_sha256"])

    return stream.mapInArrow(run, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of the input: gaps, faults, illegal neighbours, cost and audit of its cheapest repair, digest of the repaired text."""
    rows = damaged(conversations)
    judged = staged(_judged(rows), "conversations-rows")
    blocks = staged(_blocks(judged, block), "conversations-blocks")
    audits = staged(_repaired(blocks, block), "conversations-audits")

    turns = judged.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("rows"))
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    in_order = Window.partitionBy("conv").orderBy("block")
    pairs = F.concat(F.coalesce(F.lag(F.right("initials", F.lit(1))).over(in_order), F.lit("")), F.col("initials"))
    neighbours = F.transform(F.sequence(F.lit(1), F.greatest(F.length("pairs") - 1, F.lit(1))), lambda i: F.substring(F.col("pairs"), i, F.lit(2)))
    legal = F.size(F.filter(neighbours, lambda p: p.isin("su", "ua", "au")))
    faults = {name: F.sum(F.length("faults") - F.length(F.replace("faults", F.lit(code)))) for name, code in
              (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
    counts = blocks.withColumn("pairs", pairs).groupBy("conv").agg(
        *[c.alias(name) for name, c in faults.items()], F.sum(F.length("pairs") - 1 - legal).alias("illegal")
    )
    all_ids = conversations.select("conv_id").distinct().withColumn("conv", _conversation_key(F.col("conv_id")))
    found = all_ids
    for part in (gaps, counts, audits.select("conv", "cost", "audit"), _digested(rows, audits)):
        found = found.join(part, "conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
