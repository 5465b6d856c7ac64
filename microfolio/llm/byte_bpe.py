"""Byte-level BPE with the tokenizers library, over Arrow batches.

A text is cut by the vocabulary's pattern; each part's bytes are written as the byte alphabet's
characters and encoded by the library's BPE model; parts are remembered. Decoding looks up each
id's characters and reverses the byte alphabet. A token may hold part of a character: offsets then
name the whole character for each token that touches it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from .common import map_pieces, named, texts

REMEMBERED = 600_000
#: Letters, digits, white space and the rest of the pattern, for characters below U+0530; other texts are cut by the library.
#: Named one by one, they are a table to the regular expression; what begins most parts comes first.
_NUMBER = "0123456789²³¹¼½¾"
_SPACE = "\t\n\v\f\r \x85\xa0"
_NEAR = "".join(map(chr, range(0x530)))
_LETTER = "".join(c for c in re.findall(r"[^\W_]", _NEAR) if c not in _NUMBER)
_OTHER = "".join(c for c in _NEAR if c not in _LETTER + _NUMBER + _SPACE)
_CUT = re.compile(
    rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{re.escape(_OTHER)}]+| ?[{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
).findall
_FAR = re.compile("[^\x00-ԯ]").search


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of more than a byte: what is left of it by lower ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            near = [ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)]
            best = min(near)
            if best >= rank:
                break
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) != 2:
            raise ValueError(f"{token!r} can't be made of two tokens of lower rank")
        out.append((parts[0], parts[1]))
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary; remembers parts of texts as little-endian ids.

    With ``added_tokens`` the vocabulary's added tokens are found in texts and get their own ids, as by
    the library's default; without, a special one's letters are text like any other.
    """

    def __init__(self, tokenizer: Tokenizer, added_tokens: bool = False) -> None:
        tokenizer.encode_special_tokens = not added_tokens
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else None
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        letters = byte_alphabet()
        self.letters = {chr(b): letters[b] for b in range(256)}
        self.table = str.maketrans(self.letters)
        back = {c: b for b, c in enumerate(letters)}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.known = _Known(self)

    @classmethod
    @lru_cache(2)
    def from_json(cls, path: str, added_tokens: bool = False) -> ByteBPE:
        return cls(Tokenizer.from_file(path), added_tokens)

    @classmethod
    @lru_cache(2)
    def from_ranks(cls, path: str) -> ByteBPE:
        """From a file of base64 tokens and ranks."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        letters = byte_alphabet()
        spell = lambda token: "".join(letters[b] for b in token)
        merges = [(spell(a), spell(b)) for a, b in merges_of(ranks)]
        tokenizer = Tokenizer(models.BPE({spell(t): i for t, i in ranks.items()}, merges))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        tokenizer.decoder = decoders.ByteLevel()
        return cls(tokenizer)

    def part(self, part: str) -> bytes:
        spelled = part.translate(self.table) if part.isascii() else "".join(map(self.letters.__getitem__, part.encode().decode("latin-1")))
        ids = [t.id for t in self.model.tokenize(spelled)]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text.isascii() and _FAR(text) or self.holds_added and self.holds_added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        return b"".join(map(known.__getitem__, _CUT(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[list[int], list[int]]:
        """First character and the one after the last of each token; shared characters count for both."""
        lengths = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[ends - lengths].tolist(), (character[ends - 1] + 1).tolist()


class _Known(dict):
    def __init__(self, owner: ByteBPE) -> None:
        self.owner = owner

    def __missing__(self, part: str) -> bytes:
        found = self.owner.part(part)
        if len(part) < 64:
            self[part] = found
        return found


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per row: doc_id, ids, starts, ends (character offsets of each token).

    Null text counts as empty and has no ids; null ids and repeated rows stay as they are; other
    columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = ByteBPE.from_ranks(ranks_path), texts(batch)
        ids = [bpe.encode(t) for t in rows]
        places = [bpe.offsets(t, i) for t, i in zip(rows, ids)]
        return named(
            batch,
            ["doc_id"],
            ids=pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64())),
            starts=pa.array([p[0] for p in places], pa.list_(pa.int64())),
            ends=pa.array([p[1] for p in places], pa.list_(pa.int64())),
        )

    return map_pieces(docs.select("doc_id", "text"), "text", run, "doc_id long, ids array<long>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The texts of (doc_id, ids); null ids give an empty text; bytes that are no character become U+FFFD."""

    def run(batches):
        for batch in batches:
            bpe = ByteBPE.from_ranks(ranks_path)
            rows = [np.array(i or [], "<u4").tobytes() for i in batch.column("ids").to_pylist()]
            yield named(batch, ["doc_id"], text=pa.array([bpe.decode(r).decode(errors="replace") for r in rows], pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, as ``encode`` and ``decode`` make them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = ByteBPE.from_ranks(ranks_path)
        ids = [bpe.encode(t) for t in texts(batch)]
        return named(
            batch,
            ["doc_id"],
            n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()),
            ids_sha256=pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            decoded_sha256=pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
        )

    return map_pieces(docs.select("doc_id", "text"), "text", run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
