"""Trained classifiers: held-out accuracy, awkward rows, gradients."""

import re
import tracemalloc
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from microfolio.llm import language, toxicity
from microfolio.llm.common import crc_of
from microfolio.llm.spans import _Roll

from .conftest import AWKWARD

LABELS = "doc_id long, quality int, toxic int"


def toxic_corpus(seed, n):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(int(rng.integers(20, 150)))]
        bad = int(i % 4 == 0)
        if bad:
            for at in rng.integers(0, len(words), 4):
                words[at] = rng.choice(["rotter", "knave", "scoundrel"]) if i % 8 else "grim" + words[at][:3]
        rows.append((i, " ".join(words)))
        labels.append((i, 0, bad))
    return rows, labels


def test_toxicity_learns_held_out_documents(spark, docs_of):
    rows, labels = toxic_corpus(1, 600)
    docs = docs_of(rows + [(10_000 + (i or 0), t) for i, t in AWKWARD] + [(None, "null id")])
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), crc_of("doc_id", 4) != 2)
    got = toxicity.score(docs, model).where(crc_of("doc_id", 4) == 2).collect()
    truth = {i: y for i, _, y in labels}
    known = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert np.mean([p == y for p, y in known]) > 0.9
    everything = toxicity.score(docs, model)
    assert everything.count() == docs.count() and everything.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_without_labels(spark, docs_of):
    docs = docs_of([(1, "x"), (2, None)])
    for labels in ([], [(1, 0, 0)], [(None, 0, 1), (1, 0, None)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), F.lit(True))
        assert model is None and toxicity.score(docs, model).where("score = 0 and predicted = 0").count() == 2
    assert toxicity.score(docs_of([]), None).count() == 0


def test_all_windows_are_scored():
    f = toxicity.Features(["", "a b", " ".join("w" * (k % 5 + 1) for k in range(100))])
    at, text = f.windows()
    assert f.words.tolist() == [0, 2, 100] and np.bincount(text).tolist() == [1, 1, 8]
    assert set(at[text == 2].ravel()) - {102} == set(range(2, 102))


def test_rare_words_are_found_in_bounded_memory():
    """All windows of a sample, some of one document in several chunks, without the bytes of all at once."""
    rng = np.random.default_rng(4)
    words = np.array(["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(900)])
    windows = [" ".join(words[np.minimum(rng.geometric(0.01, toxicity.WINDOW), 899)]) for _ in range(25_000)]
    owner = np.arange(25_000) // 500
    tracemalloc.start()
    rare = toxicity.GatedNetwork._rare(windows, owner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bucket_of = dict(zip(words.tolist(), toxicity.Features(words.tolist()).bucket.tolist()))
    seen = defaultdict(set)
    for w, o in zip(windows, owner.tolist()):
        for word in w.split():
            seen[bucket_of[word]].add(o)
    assert rare.tolist() == [len(seen[b]) < toxicity.LEAST_DOCUMENTS for b in range(toxicity.BUCKETS)]
    assert not all(len(s) > 2 for s in seen.values()) and peak < 80e6, peak


def test_network_gradient_is_the_slope():
    net = toxicity.GatedNetwork()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, y = ["one two three four", "five six " * 12, "x"], np.array([1.0, 0.0, 1.0])
    net.p["word"][:] = np.random.default_rng(2).normal(0, 0.3, net.p["word"].shape)
    f = toxicity.Features(rows)
    at = f.windows()[0]

    def loss():
        projected = np.vstack([net._inputs(f) @ net.p["x"] + net.p["xb"], np.zeros((1, 6 * toxicity.HIDDEN))])
        logit = net._forward(projected, at)
        return -np.mean(y * np.log(toxicity.sigmoid(logit)) + (1 - y) * np.log(1 - toxicity.sigmoid(logit)))

    got = net._gradient(f, at, y)
    for name, where in [("x", (3, 5)), ("xb", (20,)), ("gate0", (1, 2)), ("new0", (0, 1)), ("gate1", (2, 9)), ("new1", (3, 3)), ("att", (4, 4)), ("query", (2,)), ("out", (6,)), ("word", (int(f.bucket[1]), 2)), ("char", (int(f.trigram[f.trigram < toxicity.TRIGRAMS][0]), 1))]:
        kept, step = net.p[name][where], 1e-3
        net.p[name][where] = kept + step
        up = loss()
        net.p[name][where] = kept - step
        down = loss()
        net.p[name][where] = kept
        assert abs((up - down) / (2 * step) - got[name][where]) < 2e-4 + 0.02 * abs(got[name][where]), name


def language_corpus(seed, n):
    rng = np.random.default_rng(seed)
    stems = {"aa": "abcdeg", "bb": "rstuvy", "cc": "éèöüñß"}
    return [(i, " ".join("".join(rng.choice(list(stems[k]), rng.integers(2, 8))) for _ in range(int(rng.integers(3, 200)))), k) for i in range(n) for k in [list(stems)[i % 3]]]


def test_language_of_held_out_documents(docs_of):
    rows = language_corpus(3, 240)
    docs = docs_of(rows + [(900, None, "aa"), (901, "", "aa"), (902, "12 -- 34", "bb"), (903, "abc", None), (None, "srt", "bb")])
    model = language.train(docs, crc_of("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) + 5


def test_language_without_labels(docs_of):
    docs = docs_of([(1, "abc", None)])
    assert language.train(docs, F.lit(True)) is None
    assert language.identify(docs, None).first().lang_pred == "und"
    assert language.identify(docs_of([]), None).count() == 0


def test_windows_cover_whole_texts():
    assert language.cut("").shape == (1, 128) and language.cut("x" * 128).shape == (1, 128)
    rows = language.cut("x" * 300 + "é")
    assert len(rows) == 3 and rows[-1].tobytes().endswith("é".encode())


def test_tables_are_the_network():
    model = language.ByteCNN(["a", "b"])
    x = np.random.default_rng(4).integers(0, 256, (9, language.WINDOW)).astype(np.uint8)
    top, _ = model._pool(x)
    out = np.maximum(top, 0) @ model.p["o"] + model.p["b"]
    want = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    assert np.allclose(model.log_probabilities(x), want, atol=1e-4)


def test_signs_are_no_letters():
    for sign in ("²", "½", "Ⅷ", "①", "12 ⅓ _"):
        assert not language.has_letter(sign)
    assert language.has_letter("²ß") and language.has_letter("日")


def test_rare_language_is_learned(docs_of):
    rng = np.random.default_rng(4)
    text = lambda low, high: " ".join("".join(map(chr, rng.integers(low, high, 6))) for _ in range(60))
    rows = [(k, text(97, 123), "en") for k in range(3000)] + [(5000 + k, text(0x3B1, 0x3C9), "el") for k in range(4)]
    docs = docs_of(rows + [(9000 + k, text(0x3B1, 0x3C9), None) for k in range(5)] + [(1, text(97, 123), "en")] * 500 + [(None, "²½Ⅷ①", "en")])
    model = language.train(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(got[9000 + k] == "el" for k in range(5)) and got[None] == "und" and got[2] == "en"


def plain_score(net, text):
    """A document's score, word by word and step by step."""
    H, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    table, base = _Roll._constants(31)
    data = text.encode().translate(toxicity._TABLE)
    padded, inputs = b" " + data + b"  ", []
    for m in re.finditer(rb"[^ ]+", padded):
        value = sum(int(table[b]) * pow(base, k, 1 << 64) for k, b in enumerate(m.group())) % (1 << 64)
        for _ in range(2):
            value = (value ^ (value >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
        chars = np.zeros(toxicity.VECTOR)
        for at in range(m.start(), m.end()):
            x, y, z = padded[at - 1 : at + 2]
            chars += net.p["char"][((x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % (1 << 32)) >> 20]
        inputs.append(np.concatenate([net.p["word"][value % toxicity.BUCKETS], chars / len(m.group())]))
    logits, begin = [], 0
    while True:
        window = inputs[begin : begin + toxicity.WINDOW]
        states = np.zeros((len(window), 2 * H))
        for side, order in ((0, range(len(window))), (1, reversed(range(len(window))))):
            h = np.zeros(H)
            for t in order:
                x = (window[t] @ net.p["x"] + net.p["xb"])[3 * H * side : 3 * H * (side + 1)]
                gates = sig(x[: 2 * H] + h @ net.p[f"gate{side}"])
                new = np.tanh(x[2 * H :] + gates[H:] * (h @ net.p[f"new{side}"]))
                h = gates[:H] * h + (1 - gates[:H]) * new
                states[t, H * side : H * (side + 1)] = h
        weight = np.exp([np.tanh(s @ net.p["att"] + net.p["attb"]) @ net.p["query"] for s in states])
        pooled = (weight[:, None] * states).sum(axis=0) / weight.sum() if len(window) else np.zeros(2 * H)
        logits.append(float(np.clip(pooled @ net.p["out"] + net.p["outb"][0], -15, 15)))
        begin += toxicity.STRIDE
        if begin + toxicity.WINDOW - toxicity.STRIDE >= len(inputs):
            break
    first, second = (sorted(logits, reverse=True) * 2)[:2] if len(logits) == 1 else sorted(logits, reverse=True)[:2]
    return sig(net.document @ np.array([first, second, 1.0]))


def test_scores_against_plain_loops(docs_of, supplied):
    rows, labels = toxic_corpus(3, 40)
    net = toxicity.GatedNetwork().fit([[" ".join(t.split()[k : k + 24]) for k in range(0, 60, 12)] for _, t in rows], np.array([y for _, _, y in labels], np.float32), rounds=2)
    texts = [t or "" for _, t in supplied[:25]] + [t for _, t in rows[:5]] + ["", " ", "a", "Ünïcode 日本語 it's", " ".join(["w"] * 37)]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(list(enumerate(texts))), net).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(net, t)) < 1e-4
