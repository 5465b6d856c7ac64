"""Token counts of a byte-pair model without emitting tokens.

The text becomes symbols (characters; those outside the vocabulary count as their bytes). A heap
holds the adjacent pairs whose joined string is a piece, lowest rank first, and a linked list holds
the symbols; the lowest pair is popped and merged until none is left. The count is the number of
symbols at the start minus the merges. No merge crosses two neighbouring characters that stand so in
no piece: there a text falls into parts that are counted one by one and remembered. Space marks stand
only at the start of pieces, so words always fall apart.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_pieces, named, texts

MARK = "▁"
REMEMBERED = 600_000
LIMIT = 4096


class PairMerger:
    """Counts for one vocabulary: piece -> rank, lower ranks merge first."""

    def __init__(self, ranks: dict[str, int], byte_fallback: bool = True) -> None:
        if any(MARK in piece.lstrip(MARK) for piece in ranks):
            raise ValueError("a piece holds a space mark after another character: words can't be counted apart")
        self.ranks = ranks
        self.byte_fallback = byte_fallback
        self.known: dict[str, int] = {}
        self.joined = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    @classmethod
    def from_file(cls, path: str) -> PairMerger:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)))
        order = sorted(plain, key=lambda i: -model.get_score(i))
        return cls({model.id_to_piece(i): rank for rank, i in enumerate(order)})

    def merges(self, symbols: list[str]) -> int:
        """How many merges the symbols allow."""
        n, rank = len(symbols), self.ranks.get
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i, pair in enumerate(map(add, symbols, symbols[1:])):
            if (r := rank(pair)) is not None:
                heap.append((r, i, pair))
        heapify(heap)
        done = 0
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] + symbols[j] != pair or not symbols[i]:
                continue  # one of them has been merged since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            done += 1
            if k < n:
                ahead[k] = i
                if (r := rank(longer := pair + symbols[k])) is not None:
                    heappush(heap, (r, i, longer))
            p = ahead[i]
            if p >= 0 and (r := rank(longer := symbols[p] + pair)) is not None:
                heappush(heap, (r, p, longer))
        return done

    def of_part(self, part: str) -> int:
        symbols = list(part)
        extra = 0
        if self.byte_fallback:
            extra = sum(len(c.encode()) - 1 for c in symbols if c not in self.ranks)
        return len(symbols) + extra - self.merges(symbols)

    def of_word(self, word: str) -> int:
        """Sum over the parts between which no merge is possible."""
        known, joined = self.known, self.joined
        total = begin = 0
        for end in [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined] + [len(word)]:
            part = word[begin:end]
            n = known.get(part)
            if n is None:
                n = self.of_part(part)
                self.remember(part, n)
            total += n
            begin = end
        return total

    def remember(self, part: str, n: int) -> None:
        if len(part) < 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = n

    def count(self, text: str) -> int:
        """Tokens of a text, with the model's mark before it; an empty text has none."""
        if not text:
            return 0
        known, total = self.known, 0
        for word in self.words(MARK + text.replace(" ", MARK)):
            n = known.get(word)
            if n is None:
                n = self.of_word(word)
                self.remember(word, n)
            total += n
        return total


@lru_cache(2)
def _merger(path: str) -> PairMerger:
    return PairMerger.from_file(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes and tokens. Null ids and repeated rows stay as they are,
    other columns are not read, an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        merger, rows = _merger(model_path), texts(batch)
        tokens = [merger.count(t) for t in rows]
        return named(
            batch,
            ["doc_id"],
            n_bytes=pa.array([len(t.encode()) for t in rows], pa.int64()),
            n_tokens=pa.array(tokens, pa.int64()),
            over_limit=pa.array([n > limit for n in tokens], pa.bool_()),
        )

    return map_pieces(docs.select("doc_id", "text"), "text", run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
