"""The Merkle manifest against trees built level by level in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from microfolio.llm import merkle
from microfolio.llm.places import numbered

from .conftest import AWKWARD, DOCUMENTS


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return hashed(*fields)


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashed(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        run = i // 3 * 3
        steps.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return steps


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    for group in groups.values():
        group.sort(key=lambda g: g[:3])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([g[2] for g in groups[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, digest, (doc_id, text, lang, source, n_chars)) in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(doc_id, text, lang, source, n_chars)
            for left, right in steps:
                node = hashed(left, node, right)
            root = top[-1][0]
            out.append((doc_id, digest, trees[s][-1][0], root, hashed(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=repr)


def random_rows(n, sources, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"a\nb {i}" if rng.random() < 0.8 else None, "en", rng.choice(sources), i if i % 3 else None) for i in range(n)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_trees(spark, levels):
    hot = random_rows(300, ["a"] * 20 + [None, "é", "z", "\U0001f600", "￮"])
    hot += [(5, "same\n", None, "a", None)] * 40 + [(None, "no id\n", "x", "a", 1)] * 30 + [(900, "alone", "", "only", 2)]
    got = merkle.verification(spark.createDataFrame(hot, DOCUMENTS).repartition(7), levels).collect()
    assert sorted(map(tuple, got), key=repr) == brute(hot)


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(i, t, "en", None, None) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("tree", "pos", "n", "path", "block", "digest", "lag1", "root", "uid__"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, merkle.verification(docs).collect()), key=repr) == brute(rows)


def test_one_row_and_empty_table(spark):
    rows = [(2, "x\n", "en", "s", 2)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert [tuple(r) for r in merkle.verification(docs).collect()] == brute(rows)
    assert merkle.verification(docs.where("false")).collect() == []


def test_tampering_is_found(spark):
    rows = random_rows(50, ["a", "b"])
    docs = spark.createDataFrame(rows, DOCUMENTS)
    whole = merkle.manifest(docs).withColumn("root_again", merkle.folded(F.col("leaf")))
    assert whole.where("root_again = root").count() == 50
    other = merkle.manifest(docs, F.lit("other")).withColumn("root_again", merkle.folded(F.col("changed")))
    assert other.where("root_again = root").count() == 0


def test_positions_of_ties_and_hot_groups(spark):
    rows = spark.range(2000).selectExpr("case when id % 3 > 0 then 'hot' else cast(id % 50 as string) end as g", "id % 2 as k").repartition(9)
    placed = numbered(rows, "g", ["k"], "test").collect()
    by = defaultdict(list)
    for r in placed:
        by[r.g].append((r.pos, r.k, r.n))
    for members in by.values():
        members.sort()
        assert [m[0] for m in members] == list(range(len(members)))
        assert [m[1] for m in members] == sorted(m[1] for m in members)
        assert {m[2] for m in members} == {len(members)}
