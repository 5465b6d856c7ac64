"""Toxicity by a bidirectional gated recurrent network with attention, trained in numpy.

A word is a run of characters other than white space and ASCII punctuation, in ASCII lower case. Its
input is a learned vector of its hash, joined with the mean of learned vectors of its character
trigrams. Windows of ``WINDOW`` words overlap by half. Gated recurrent units read a window in both
directions, attention pools their states, and a logistic unit scores the window. A document's score
is a logistic function of its two highest windows, fitted on the same sample.

Labels are of documents: in each round the windows of toxic documents that score highest are the
examples for, and the highest and some random windows of clean documents those against.

The model is fitted on the driver on ``TOXIC`` and ``CLEAN`` labelled documents at most, with
``PER_TEXT`` windows of each at most, at random places; all windows of all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_pieces, named, pieces, texts
from .sampling import smallest_hashes
from .spans import _Roll, mixed

WINDOW, STRIDE = 24, 12
BUCKETS, TRIGRAMS, VECTOR, HIDDEN, ATTENTION = 1 << 15, 1 << 12, 8, 8, 8
TOXIC, CLEAN, PER_TEXT = 600, 900, 32
ROUNDS, BATCH, RATE = 6, 48, 0.02
THRESHOLD = 0.3
LEAST_DOCUMENTS = 3
AT_ONCE = 1 << 19
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Features:
    """Words of several texts: hash bucket, trigrams by byte, text number."""

    def __init__(self, rows: list[str]) -> None:
        data = [t.encode().translate(_TABLE) for t in rows]
        begins = 1 + np.r_[0, np.cumsum([len(d) + 1 for d in data])[:-1]]
        a = np.frombuffer(b" " + b" ".join(data) + b"  ", np.uint8)
        blank = a == 32
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        self.length = (ends - self.starts).astype(np.float32)
        self.bucket = (mixed(_Roll(a, 31).of(self.starts, ends)) % np.uint64(BUCKETS)).astype(np.int64)
        wide = a.astype(np.uint32)
        three = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        self.trigram = np.full(len(a), TRIGRAMS, np.int64)  # the last vector is zero
        self.trigram[1:-1] = three
        self.trigram[blank] = TRIGRAMS
        text = np.searchsorted(begins, self.starts, "right") - 1
        self.words = np.bincount(text, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word number or the number of words for filling, text number) of all windows; each text has one at least."""
        n = self.words
        count = 1 + np.maximum(-(-(n - WINDOW) // STRIDE), 0)
        text = np.repeat(np.arange(len(n)), count)
        within = np.arange(len(text)) - np.r_[0, np.cumsum(count)[:-1]][text]
        begin = np.r_[0, np.cumsum(n)[:-1]]
        at = within[:, None] * STRIDE + np.arange(WINDOW)
        return np.where(at < n[text][:, None], begin[text][:, None] + at, len(self.starts)), text


class GatedNetwork:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h = 2 * VECTOR, HIDDEN
        self.p = {
            "word": np.zeros((BUCKETS, VECTOR)), "char": rng.normal(0, 0.3, (TRIGRAMS + 1, VECTOR)),
            "x": rng.normal(0, d**-0.5, (d, 6 * h)), "xb": np.zeros(6 * h),
            "gate0": rng.normal(0, h**-0.5, (h, 2 * h)), "new0": rng.normal(0, h**-0.5, (h, h)),
            "gate1": rng.normal(0, h**-0.5, (h, 2 * h)), "new1": rng.normal(0, h**-0.5, (h, h)),
            "att": rng.normal(0, (2 * h) ** -0.5, (2 * h, ATTENTION)), "attb": np.zeros(ATTENTION), "query": rng.normal(0, 1, ATTENTION),
            "out": rng.normal(0, 0.3, 2 * h), "outb": np.full(1, -1.0),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["char"][TRIGRAMS] = 0
        self.document = np.array([1.0, 0.0, 0.0])

    def _inputs(self, f: Features) -> np.ndarray:
        if not len(f.starts):
            return np.zeros((0, 2 * VECTOR), np.float32)
        chars = np.add.reduceat(self.p["char"][f.trigram], f.starts, axis=0) / f.length[:, None]
        return np.hstack([self.p["word"][f.bucket], chars])

    def _forward(self, projected: np.ndarray, at: np.ndarray, keep: bool = False):
        """Window logits; with ``keep`` also what the gradient needs. ``projected`` ends with a row for filling."""
        h, (m, steps) = HIDDEN, at.shape
        mask = (at < len(projected) - 1).astype(np.float32)
        states, tape = np.zeros((steps, m, 2 * h), np.float32), []
        for side in (0, 1):
            state, gate, new = np.zeros((m, h), np.float32), self.p[f"gate{side}"], self.p[f"new{side}"]
            lanes = projected[:, 3 * h * side : 3 * h * (side + 1)]
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x = lanes[at[:, t]]
                g = sigmoid(x[:, : 2 * h] + state @ gate)
                z, r = g[:, :h], g[:, h:]
                inner = state @ new
                n = np.tanh(x[:, 2 * h :] + r * inner)
                if keep:
                    tape.append((side, t, state, z, r, n, inner))
                state = state + mask[:, t, None] * (1 - z) * (n - state)
                states[t, :, h * side : h * (side + 1)] = state
        u = np.tanh(states @ self.p["att"] + self.p["attb"])
        weight = u @ self.p["query"] + (mask.T - 1) * 1e4
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tm,tmh->mh", weight, states)
        logit = pooled @ self.p["out"] + self.p["outb"][0]
        return (logit, mask, states, tape, u, weight, pooled) if keep else logit

    def _gradient(self, f: Features, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        inputs = self._inputs(f)
        projected = np.vstack([inputs @ self.p["x"] + self.p["xb"], np.zeros((1, 6 * h), np.float32)])
        logit, mask, states, tape, u, weight, pooled = self._forward(projected, at, True)
        g: dict[str, np.ndarray] = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["out"], g["outb"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tmh,mh->tm", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tm,tma->a", d_score, u)
        d_u = d_score[:, :, None] * self.p["query"] * (1 - u * u)
        g["att"], g["attb"] = np.einsum("tmh,tma->ha", states, d_u), d_u.sum(axis=(0, 1))
        d_states += d_u @ self.p["att"].T
        d_projected = np.zeros_like(projected)
        carried, last_side = None, None
        for side, t, state, z, r, n, inner in reversed(tape):
            if side != last_side:
                carried, last_side = np.zeros((len(y), h), np.float32), side
            dh = carried + d_states[t, :, h * side : h * (side + 1)]
            step = mask[:, t, None] * dh
            d_n = step * (1 - z) * (1 - n * n)
            d_z = -step * (n - state) * z * (1 - z)
            d_r = d_n * inner * r * (1 - r)
            d_gate, d_inner = np.hstack([d_z, d_r]), d_n * r
            g[f"gate{side}"] += state.T @ d_gate
            g[f"new{side}"] += state.T @ d_inner
            carried = dh - step * (1 - z) + d_gate @ self.p[f"gate{side}"].T + d_inner @ self.p[f"new{side}"].T
            np.add.at(d_projected[:, 3 * h * side : 3 * h * (side + 1)], at[:, t], np.hstack([d_gate, d_n]))
        d_projected = d_projected[:-1]
        g["x"], g["xb"] = inputs.T @ d_projected, d_projected.sum(axis=0)
        d_inputs = d_projected @ self.p["x"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], f.bucket, d_inputs[:, :VECTOR])
        spread = np.zeros((len(f.trigram), VECTOR), np.float32)
        for_byte = np.repeat(np.arange(len(f.starts)), f.length.astype(np.int64))
        inside = np.flatnonzero(f.trigram < TRIGRAMS)
        spread[inside] = (d_inputs[:, VECTOR:] / f.length[:, None])[for_byte]
        np.add.at(g["char"], f.trigram, spread)
        g["char"][TRIGRAMS] = 0
        return g

    def window_logits(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text number) of all windows of the texts."""
        f = Features(rows)
        projected = np.vstack([self._inputs(f) @ self.p["x"] + self.p["xb"], np.zeros((1, 6 * HIDDEN), np.float32)])
        at, text = f.windows()
        return np.concatenate([self._forward(projected, at[i : i + 2048]) for i in range(0, len(at), 2048)] or [np.zeros(0)]), text

    def fit(self, documents: list[list[str]], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 8) -> GatedNetwork:
        """``documents`` are lists of windows, ``labels`` 0 or 1."""
        rng = np.random.default_rng(seed)
        windows = [w for d in documents for w in d]
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        rare = self._rare(windows, owner)
        for turn in range(rounds):
            logit = self._each(windows) if turn else rng.random(len(windows))
            order = np.lexsort((-logit, owner))
            rank = np.arange(len(order)) - np.r_[0, np.cumsum(np.bincount(owner))[:-1]][owner[order]]
            toxic = labels[owner[order]] == 1
            chosen = np.where(toxic, rank < (8 if turn == 0 else 2), (rank < 4) | (rng.random(len(order)) < 0.1))
            pick = rng.permutation(order[chosen])
            for i in range(0, len(pick), BATCH):
                step += 1
                part = pick[i : i + BATCH]
                f = Features([windows[k] for k in part])
                gradient = self._gradient(f, f.windows()[0], labels[owner[part]])
                gradient["word"][rare] = 0
                for k, g in gradient.items():
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        top = self._top_two(self._each(windows), owner, len(documents))
        for _ in range(500):  # logistic regression on the two highest windows
            miss = sigmoid(top @ self.document[:2] + self.document[2]) - labels
            self.document -= 0.05 * np.r_[(top * miss[:, None]).mean(axis=0), miss.mean()]
            self.document[:2] = np.maximum(self.document[:2], 0)
        return self

    @staticmethod
    def _rare(windows: list[str], owner: np.ndarray) -> np.ndarray:
        """Word buckets of fewer than ``LEAST_DOCUMENTS`` documents: learning them is learning the documents by heart."""
        seen = [np.zeros(0, np.int64)]
        for i in range(0, len(windows), 4096):
            f = Features(windows[i : i + 4096])
            text = owner[i : i + 4096][np.repeat(np.arange(len(f.words)), f.words)]
            seen.append(np.unique(text * BUCKETS + f.bucket))
        return np.bincount(np.unique(np.concatenate(seen)) % BUCKETS, minlength=BUCKETS) < LEAST_DOCUMENTS

    def _each(self, windows: list[str]) -> np.ndarray:
        return np.concatenate([self.window_logits(windows[i : i + 4096])[0] for i in range(0, len(windows), 4096)])

    @staticmethod
    def _top_two(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The two highest logits of each text; a single window counts twice."""
        order = np.lexsort((-logit, text))
        first = np.searchsorted(text[order], np.arange(n))
        count = np.bincount(text, minlength=n)
        return np.clip(np.stack([logit[order[first]], logit[order[first + (count > 1)]]], axis=1), -15, 15)

    def score(self, rows: list[str]) -> np.ndarray:
        logit, text = self.window_logits(rows)
        return sigmoid(self._top_two(logit, text, len(rows)) @ self.document[:2] + self.document[2])


def _sampled_windows(per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                words = words_of(text)
                begins = np.arange(0, max(len(words) - WINDOW + STRIDE, 1), STRIDE)
                pick = np.random.default_rng(abs(doc)).permutation(begins)[:per_text]
                out.append([b" ".join(words[b : b + WINDOW]).decode(errors="replace") for b in pick.tolist()])
            yield named(batch, ["doc_id", "toxic"], windows=pa.array(out, pa.list_(pa.string())))

    return run


def train(docs: DataFrame, labels: DataFrame, trainable: Column, toxic: int = TOXIC, clean: int = CLEAN, per_text: int = PER_TEXT) -> GatedNetwork | None:
    """A model from a bounded sample of labelled rows; None unless there are labels of both kinds.

    Of different texts of one id the smallest is learned from; rows without an id have no label.
    """
    known = labels.where(trainable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bad, good = known.where("toxic = 1"), known.where("toxic = 0")
    chosen = bad.where(smallest_hashes(bad, toxic)).limit(toxic).union(good.where(smallest_hashes(good, clean)).limit(clean))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = picked.mapInArrow(_sampled_windows(per_text), "doc_id long, toxic int, windows array<string>").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in got], np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return None
    return GatedNetwork().fit([list(r["windows"]) for r in got], y)


def score_rows(docs: DataFrame, model: GatedNetwork | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns and toxic_score__ and toxic_predicted__, see ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the network, whatever the input

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        network, rows = shared.value, texts(batch)
        got = np.zeros(len(rows))
        begin = size = 0
        for i, t in enumerate(rows if network is not None else ()):
            size += len(t)
            if size > AT_ONCE or i == len(rows) - 1:
                got[begin : i + 1] = network.score(rows[begin : i + 1])
                begin, size = i + 1, 0
        return named(batch, columns, toxic_score__=pa.array(got, pa.float64()), toxic_predicted__=pa.array(got >= threshold).cast(pa.int32()))

    columns = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("toxic_score__", T.DoubleType()), T.StructField("toxic_predicted__", T.IntegerType())])
    return map_pieces(docs, "text", run, schema)


def score(docs: DataFrame, model: GatedNetwork | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted (1 if score >= threshold).

    Null and empty texts get the score of a window without words; all scores are 0 without a model. Ids are only
    handed on, so null and repeated ids are rows like others; an empty table gives an empty result. Only doc_id and
    text are read.
    """
    return score_rows(docs.select("doc_id", "text"), model, threshold).select("doc_id", F.col("toxic_score__").alias("score"), F.col("toxic_predicted__").alias("predicted"))
