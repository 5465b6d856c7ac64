"""Language of a text by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of ``WINDOW`` bytes; each filter's
largest value passes a rectifier, and a softmax layer gives the languages. A text is cut into windows,
the last one ending with the text; its languages' probabilities are the normalised geometric mean of
its windows'. For application the filters become sums of table rows of byte pairs.

The model is fitted on the driver on ``SAMPLE`` labelled documents at most, with ``PER_TEXT`` windows
of each at most, at random places of the whole text; every window of every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_pieces, named, pieces, texts

WINDOW = 128
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
PER_LANGUAGE, PER_TEXT = 375, 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
AT_ONCE = 512


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter by its Unicode category; signs like ² or Ⅷ are none."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def cut(text: str) -> np.ndarray:
    """Windows of a text as rows of bytes; a short text is filled up with zeros."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < WINDOW:
        return np.pad(data, (0, WINDOW - len(data)))[None, :]
    whole = data[: len(data) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return whole if len(data) % WINDOW == 0 else np.vstack([whole, data[-WINDOW:]])


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS))
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["b"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: dict | None = None

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter, and where it is."""
        e, top, where = self.p["e"][x], [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            value = sum(e[:, j : j + n] @ self.p[f"w{w}"][j] for j in range(w))
            at = value.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(value, at[:, None], 1)[:, 0])
        return np.hstack(top), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> ByteCNN:
        rng = np.random.default_rng(seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                pick = order[i : i + BATCH]
                for k, g in self._gradient(x[pick], y[pick]).items():
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.tables = None
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        top, where = self._pool(x)
        hidden = np.maximum(top, 0)
        out = hidden @ self.p["o"] + self.p["b"]
        prob = np.exp(out - out.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        prob /= len(y)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["b"] = hidden.T @ prob, prob.sum(axis=0)
        back = (prob @ self.p["o"].T) * (top > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                byte = x[rows, where[k] + j]
                grad[f"w{w}"][j] = np.einsum("bfe,bf->ef", self.p["e"][byte], g)
                np.add.at(grad["e"], byte, g[:, :, None] * self.p[f"w{w}"][j].T[None])
        return grad

    def _pair_tables(self) -> dict:
        """Per width: (offset, table, over pairs) whose rows sum to a filter's value."""
        if self.tables is None:
            self.tables = {}
            for w in WIDTHS:
                one = self.p["e"] @ self.p[f"w{w}"]
                parts = [(j, (one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS), True) for j in range(0, w - 1, 2)]
                self.tables[w] = parts + ([(w - 1, one[w - 1], False)] if w % 2 else [])
        return self.tables

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for each window."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE].astype(np.int32)
            pairs, top = part[:, :-1] << 8 | part[:, 1:], []
            for w, tables in self._pair_tables().items():
                n = WINDOW - w + 1
                value = None
                for j, table, over_pairs in tables:
                    rows = table.take((pairs if over_pairs else part)[:, j : j + n], axis=0)
                    value = rows if value is None else np.add(value, rows, out=value)
                top.append(value.max(axis=1))
            score = np.maximum(np.hstack(top), 0) @ self.p["o"] + self.p["b"]
            score -= score.max(axis=1, keepdims=True)
            out[i : i + AT_ONCE] = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
        return out

    def predict(self, rows: list[str]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        cuts = [cut(t) for t in rows]
        logs = self.log_probabilities(np.concatenate(cuts))
        begins = np.r_[0, np.cumsum([len(c) for c in cuts])[:-1]]
        mean = np.add.reduceat(logs, begins, axis=0, dtype=np.float64) / np.array([[len(c)] for c in cuts])
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        return [(self.languages[k], float(p[k])) for k, p in zip(best.tolist(), prob)]


def _sampled_windows(per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            labels, windows = [], []
            for doc, label, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts(batch)):
                if not has_letter(text):
                    continue
                rows = cut(text)
                pick = np.random.default_rng(abs(doc or 0)).permutation(len(rows))[:per_text]
                windows += [r.tobytes() for r in rows[pick]]
                labels += [label] * len(pick)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    return run


def sampled(allowed: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang, text) of the ``per_language`` ids with the smallest hashes of each language, one text of each id.

    Hashes are spread evenly, so a threshold from the language's count leaves about twice as many; only these are ranked.
    """
    ids = allowed.select("lang", "doc_id", F.xxhash64("doc_id").alias("order")).distinct()
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(2.0 * per_language + 50) / F.col("n"), F.lit(1.0))
    low = ids.join(counts, "lang").where(F.col("order").cast("double") <= F.lit(-(2.0**63)) + share * 2.0**64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = low.withColumn("rank", rank).where(F.col("rank") <= per_language).select(F.col("lang").alias("of"), F.col("doc_id").alias("id"))
    rows = allowed.join(chosen.hint("broadcast"), (F.col("lang") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, trainable: Column, per_language: int = PER_LANGUAGE, per_text: int = PER_TEXT) -> ByteCNN | None:
    """A model from a bounded sample of each language among the rows that ``trainable`` allows; None without any letter to learn from.

    Null ids count as one id; of a repeated id, one text is learned from. A language of few rows gives all of them.
    """
    allowed = docs.select("doc_id", "lang", "text").where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = sampled(allowed, per_language)
    got = chosen.mapInArrow(_sampled_windows(per_text), "lang string, window binary").orderBy("lang", "window").collect()  # per_language * per_text for each language at most
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    number = {k: i for i, k in enumerate(languages)}
    x = np.frombuffer(b"".join(r["window"] for r in got), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(languages).fit(x, np.array([number[r["lang"]] for r in got]))


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, and so are all without a model. Ids are only
    handed on, so null and repeated ids are rows like others; an empty table gives an empty result.
    Only doc_id and text are read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = texts(batch)
        known = [i for i, t in enumerate(rows) if model is not None and has_letter(t)]
        got = dict(zip(known, model.predict([rows[i] for i in known]))) if known else {}
        found = [got.get(i, (UNKNOWN, 0.0)) for i in range(len(rows))]
        return named(batch, ["doc_id"], lang_pred=pa.array([f[0] for f in found], pa.string()), score=pa.array([f[1] for f in found], pa.float64()))

    return map_pieces(docs.select("doc_id", "text"), "text", run, "doc_id long, lang_pred string, score double")
