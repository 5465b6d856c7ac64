"""Exact, near and passage copies against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from microfolio.llm import exact_dedup, fingerprints, near_dedup, suffix_dedup

from .conftest import AWKWARD


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_copies(docs_of, supplied):
    rows = supplied + [(5000 + i, "hot  copy\n") for i in range(300)] + [(9000, " "), (9001, "\t"), (9002, None), (9003, ""), (4, "hot copy "), (None, "hot copy"), (None, "alone")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_duplicates(docs_of(rows), shard_keys=16)
    assert table(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_perfect_hash_is_minimal():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    hashed = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(hashed.slots(keys)) == list(range(5000))


def test_exact_copies_of_nothing(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def near_components(rows, percent):
    sets = shingle_sets(rows)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in sets.items():
        common = Counter(j for x in own for j in holders[x])
        for x in own:
            holders[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), top(i), top(i) == i) for i in sets), key=repr)


def edited_copies(n, words, seed):
    """Copies of one text with some words changed, and chains of them."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, 5)):
            own[at] = f"e{k}_{at}"
        out.append((100_000 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("percent,small", [(85, 48), (85, 2), (80, 8)])
def test_near_copies(docs_of, supplied, percent, small):
    rows = supplied + edited_copies(120, 200, percent + small)
    got = near_dedup.near_duplicates(docs_of(rows), percent, small)
    assert table(got, "doc_id", "n_shingles", "component_id", "kept") == near_components(rows, percent)


def template_copies(n, own, shared, start):
    """Texts that share ``shared`` shingles of five words and have ``own`` others each."""
    head = " ".join(f"t{k}" for k in range(shared + 4))
    return [(start + i, head + " " + " ".join(f"x{i}_{k}" for k in range(own))) for i in range(n)]


def test_template_gives_no_pairs(spark, docs_of, monkeypatch):
    """Many texts of a similarity just below the threshold: candidates grow with the texts, not with their pairs."""
    confirmed = []

    def counting(pairs, sets, percent=85, original=near_dedup.links):
        confirmed[-1] += pairs.count()
        return original(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "links", counting)
    for n in (150, 300, 600):
        confirmed.append(0)
        got = near_dedup.near_duplicates(docs_of(template_copies(n, 10, 51, 0)))
        assert got.where("kept").count() == n
    print("candidates", confirmed)
    assert confirmed[2] <= 5 * confirmed[0]


def test_branches_of_large_nodes_lose_no_link(docs_of):
    """Mixtures of many texts above and below the threshold that share a template, with other lengths among them."""
    rows = template_copies(150, 10, 51, 0) + template_copies(60, 4, 51, 1000) + template_copies(40, 5, 60, 2000) + template_copies(30, 12, 51, 3000)
    rows += [(5000 + i, t + f" y{i}") for i, (_, t) in enumerate(rows[::5])]
    for percent, small in ((85, 4), (80, 4)):
        got = near_dedup.near_duplicates(docs_of(rows), percent, small)
        assert table(got, "doc_id", "n_shingles", "component_id", "kept") == near_components(rows, percent)


def test_near_copies_of_awkward_rows(docs_of):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(AWKWARD)).collect() if r.doc_id is not None}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[1].kept and got[3].component_id == 3
    assert got[5].component_id == 4 and not got[5].kept and got[4].kept and got[10].n_shingles == 1
    assert near_dedup.near_duplicates(docs_of([])).count() == 0
    assert near_dedup.near_duplicates(docs_of([(None, "a"), (None, "a")])).where("kept and component_id is null").count() == 2
    nulls = near_dedup.near_duplicates(docs_of([(None, "a"), (3, "a")])).collect()
    assert sorted((r.component_id, r.kept) for r in nulls) == [(3, False), (3, True)]


def test_different_texts_of_one_id_are_linked_each(docs_of):
    long = [" ".join(f"{c}{k}" for k in range(80)) for c in "abc"]
    rows = [(9, long[0]), (9, long[1]), (9, long[2]), (4, long[0] + " end"), (6, long[1] + " end"), (12, long[2] + " end")]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs_of(rows)).collect())
    assert got == [(4, 4), (6, 6), (9, 4), (9, 6), (9, 9), (12, 9)]


def test_chain_is_one_component(spark):
    ends = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.rep: r.component for r in near_dedup.components(spark.createDataFrame(ends, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def removed_by_hand(rows, width):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + width] for _, d in data for k in range(len(d) - width + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,seed,bucket", [(200, 24, 20_000), (40, 8, 20_000), (40, 8, 1), (200, 24, 3)])
def test_repeated_passages(docs_of, supplied, width, seed, bucket):
    rng = np.random.default_rng(width)
    passage = "".join(map(chr, rng.integers(97, 123, 260)))
    rows = supplied[:50] + [(7000 + k, "".join(map(chr, rng.integers(97, 123, 90))) + passage[k % 7 :] + "é" * k) for k in range(40)]
    rows += [(8000, "ab" * 400), (8001, "a" * 300), (8002, None), (8003, ""), (8004, "twice " * 60), (8004, "twice " * 60), (None, "twice " * 60), (8005, "x" * (width - 1))]
    got = suffix_dedup.removal_digests(docs_of(rows), width, seed, bucket)
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_hand(rows, width)


def test_large_group_of_one_passage_is_not_multiplied(docs_of, monkeypatch):
    """Texts of their own around a common passage: halving looks at each span a few times, not once per string."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, made = letters(330), []

    def counting(groups, width, original=suffix_dedup._halved):
        halves = original(groups, width)
        made[-1] += halves.count()
        return halves

    monkeypatch.setattr(suffix_dedup, "_halved", counting)
    for n in (60, 240):
        made.append(0)
        rows = [(k, letters(150) + passage + letters(150)) for k in range(n)]
        got = suffix_dedup.removal_digests(docs_of(rows), bucket=20)
        assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_hand(rows, 200)
    print("halves", made)
    assert made[1] <= 5 * made[0] and made[1] <= 25 * 240


def test_ids_play_no_part_in_removal(docs_of):
    """A thousand texts without an id and a thousand under one id: clean ones keep all their bytes."""
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = letters(300)
    texts = [letters(400) if k % 2 else letters(150) + passage + letters(150) for k in range(2000)] + [letters(700_000)]
    rows = [(None if k < 1000 else 7, t) for k, t in enumerate(texts)]
    got = suffix_dedup.removal_digests(docs_of(rows))
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_hand(rows, 200)
    assert got.where("n_bytes in (400, 700000) and n_removed > 0").count() == 0


def test_cuts_never_make_new_characters(docs_of):
    """Kept stretches are decoded one by one; neighbours share lead or continuation bytes."""
    rng = np.random.default_rng(3)
    passage = "".join(map(chr, rng.integers(0x4E00, 0x4E40, 90)))
    rows = [(k, chr(0x4E00 + k) * 3 + "é" + passage + "ü" + chr(0x5E00 + k) * 4) for k in range(30)]
    rows += [(100 + k, "é" + "z" * (9 + k) + "Ƽ" + passage) for k in range(5)]
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs_of(rows)).collect()}
    data = {i: t.encode() for i, t in rows}
    seen = Counter(d[k : k + 200] for d in data.values() for k in range(len(d) - 199))
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            gone[k : k + 200] |= seen[d[k : k + 200]] > 1
        edges = np.flatnonzero(np.diff(np.r_[1, gone.astype(int), 1]))
        want = "".join(d[a:b].decode(errors="ignore") for a, b in zip(edges[::2], edges[1::2]))
        assert got[i] == want


def test_repeated_passages_leave_other_columns(docs_of):
    docs = docs_of([(1, "é" * 150 + " own"), (2, "é" * 150), (3, None)]).withColumn("cuts", F.lit("clash"))
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].text.endswith(" own") and got[3].text is None and got[2].cuts == "clash" and got[2].text == ""
    assert suffix_dedup.removal_digests(docs_of([])).count() == 0


def test_fingerprints(docs_of, supplied):
    rows = supplied + [(9000 + i if i is not None else None, t) for i, t in AWKWARD if i != 4]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()))
    got = fingerprints.edited_fingerprints(docs_of(rows)).cache()
    assert table(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.collect())
    long = got.where("n_chars > 1000").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert 0.6 < long[0] < 0.9 and long[1] < 0.1
    same = got.join(docs_of(rows).select(F.col("doc_id"), "text"), "doc_id").where("text = 'one'")
    assert same.select("fingerprint").distinct().count() == 1
    assert got.where("n_chars = 0").select("fingerprint").distinct().collect()[0][0] == ""
    parsed = got.select(fingerprints.read("fingerprint").alias("h"), "fingerprint").select(fingerprints.written("h").alias("again"), "fingerprint")
    assert parsed.where("again <> fingerprint").count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        value = 42
        for word in words[k : k + 5]:
            value = xxhash.xxh64(word.encode(), seed=value).intdigest()
        hashes.add(value % (1 << 32))
    return sorted(h for h in hashes if h < 1 << 30) or sorted(hashes)[:1]


def plain_likeness(one, other):
    least = min(len(one), len(other))
    return len(set(one) & set(other)) / least if least else float(len(one) == len(other))


def test_fingerprints_against_plain_computation(docs_of, supplied):
    rows = supplied + [(9000 + i, t) for i, t in AWKWARD if i not in (4, None)]
    ordered = sorted(rows)
    want = []
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        own, edited, other = (plain_fingerprint(x) for x in (t, t[: len(t) - q] + following[:q], following))
        want.append((i, "".join(f"{h:08x}" for h in own), "".join(f"{h:08x}" for h in edited), plain_likeness(own, edited), plain_likeness(own, other)))
    got = fingerprints.edited_fingerprints(docs_of(rows))
    assert table(got, "doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(want, key=repr)


def test_fingerprint_ranges_of_many_documents(docs_of, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 5)
    rows = [(i * i, f"{i} " * (i % 9)) for i in range(120)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(docs_of(rows)).collect()}
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        assert got[i] == hashlib.sha256((t[: len(t) - q] + rows[(k + 1) % 120][1][:q]).encode()).hexdigest()
    assert fingerprints.edited_fingerprints(docs_of([])).count() == 0


def test_fingerprints_merge_and_contain(docs_of):
    words = [f"w{k}" for k in range(600)]
    df = docs_of([(1, " ".join(words)), (2, " ".join(words[:60])), (3, " ".join(words[300:]))])
    df = fingerprints.with_fingerprint(df, "text", "fp")
    a, b, c = (df.where(f"doc_id = {i}").select(F.col("fp").alias(n)) for i, n in ((1, "a"), (2, "b"), (3, "c")))
    row = a.join(b).join(c).select(fingerprints.likeness("a", "b").alias("x"), F.size(F.array_except("c", "a")).alias("y"), F.size(F.array_except(fingerprints.merge(F.col("b"), F.col("c")), "a")).alias("z")).first()
    assert row.x == 1 and row.y == 0 and row.z == 0
