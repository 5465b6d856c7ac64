"""Mixing by weights: targets against plain sharing, sums and expected copies of the pivotal rounding, reruns."""

import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from microfolio.llm import mixing

from .conftest import AWKWARD, DOCUMENTS


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """The excess over three times a source's size is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: Fraction(left * weight[s], sum(weight[o] for o in open_)) for s in open_}
        above = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not above:
            return {s: float(target[s]) if s in target else 3.0 * sizes[s] for s in order}
        full |= above


def check(rows, got, slack=0.5):
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
        largest[r[3]] = max(largest[r[3]], count(r[1]))
    want = plain_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, count(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[(r.source_size, r.target)] += r.taken
    exact = defaultdict(float)
    room = defaultdict(float)
    for s in want:
        key = min(taken, key=lambda k: (k[0] != sizes[s], abs(k[1] - want[s])))
        assert key[0] == sizes[s] and key[1] == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        exact[key] += want[s]
        room[key] += slack * largest[s] + 1e-6
    for key in taken:
        assert abs(taken[key] - exact[key]) <= room[key]


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    names = ["hot", "b", "é", None, "tiny", "\U0001f600", "￮"]
    share = [0.5, 0.1, 0.1, 0.1, 0.01, 0.1, 0.09]
    rows = []
    for i in range(n):
        size = int(rng.choice([0, 1, 7, 40, 300])) if i else 5000
        rows.append((i, " w" * size, "en", names[rng.choice(7, p=share)], None))
    return rows + [(3, "same row", "en", "hot", None)] * 400


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_targets_and_sums(spark, block):
    rows = corpus(1500)
    check(rows, mixing.mix(spark.createDataFrame(rows, DOCUMENTS).repartition(5), block=block).collect())


def test_reruns_and_splits_agree(spark):
    docs = spark.createDataFrame(corpus(700), DOCUMENTS)
    first = sorted(map(tuple, mixing.mix(docs.repartition(2), block=64).collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(11), block=64).collect()))


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(i, t, "en", s, None) for i, t in AWKWARD for s in (None, "a")]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("size", "tree", "pos", "share", "node", "target", "n", "hash"):
        docs = docs.withColumn(name, F.lit("x"))
    check(rows, mixing.mix(docs).collect())


def test_empty_table_and_blank_source(spark):
    docs = spark.createDataFrame([(1, " ", "en", "a", None), (2, None, "en", None, None)], DOCUMENTS)
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix(docs.where("false")).collect() == []


def test_expected_copies_stay():
    sizes = np.array([50, 30, 20, 10, 5, 5, 1])
    start = np.array([0.3, 0.9, 0.5, 0.5, 0.2, 0.7, 0.4])
    total = np.zeros(7)
    for seed in range(4000):
        share = start.copy()
        left = mixing.pivot(sizes, share, np.random.default_rng(seed))
        assert abs((share * sizes).sum() - (start * sizes).sum()) < 1e-6
        assert all(s in (0.0, 1.0) for k, s in enumerate(share) if k != left)
        total += share
    assert np.abs(total / 4000 - start).max() < 0.03


def test_large_documents_are_settled_first():
    sizes = np.array([20_000, 3000] + [300] * 200)
    total = np.zeros(len(sizes))
    for seed in range(1500):
        share = np.full(len(sizes), 0.4)
        left = mixing.pivot(sizes, share, np.random.default_rng(seed))
        assert abs((share * sizes).sum() - 0.4 * sizes.sum()) < 1e-6
        assert left < 0 or sizes[left] == 300  # what remains is small
        total += share
    assert np.abs(total[:2] / 1500 - 0.4).max() < 0.05 and abs(total[2:].mean() / 1500 - 0.4) < 0.01
