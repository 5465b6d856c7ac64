"""Operators on tokens against the libraries themselves."""

import base64
import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from microfolio.llm import byte_bpe, catalog, packing, token_count, token_files

from .conftest import AWKWARD

JSON, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def rows(supplied):
    return supplied[:60] + [(i + 10_000 if i is not None else None, t) for i, t in AWKWARD]


@pytest.fixture(scope="module")
def ids(rows):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_counts_are_the_librarys(docs_of, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in token_count.token_counts(docs_of(rows), PIECES).collect()), key=repr) == want


def test_pair_merging_of_hard_words():
    merger, model = token_count.PairMerger.from_file(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("aaaaaaaaa", "abab" * 99, "x" * 2000, "  lead", "trail  ", "é" * 77, "\x00\x01", "▁", "a▁b", "ﷺﷺ", "they'll've"):
        assert merger.count(text) == len(model.encode(text)), text


def test_a_vocabulary_that_joins_words_is_refused():
    with pytest.raises(ValueError):
        token_count.PairMerger({"a▁b": 0})


def test_byte_bpe_is_tiktokens(docs_of, rows):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        got = own.encode_ordinary(t or "")
        want.append((i, len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.round_trip(docs_of(rows), RANKS).collect()), key=repr) == sorted(want, key=repr)


def test_text_cut_is_the_librarys():
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for code in range(0x530):
        c = chr(code)
        text = f"a{c}1{c} {c}-{c}b  {c}{c}\n\n{c}x'{c}'s"
        assert byte_bpe._CUT(text) == [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)], hex(code)


def test_offsets_share_split_characters(docs_of):
    row = byte_bpe.encode(docs_of([(1, "é😀x")]), RANKS).first()
    assert row.starts[0] == 0 and row.ends[-1] == 3 and row.starts == sorted(row.starts)
    assert all(a < b for a, b in zip(row.starts, row.ends)) and {1} <= set(row.starts)
    assert byte_bpe.decode(byte_bpe.encode(docs_of([(1, "é😀x"), (2, None)]), RANKS), RANKS).orderBy("doc_id").collect()[0].text == "é😀x"


def test_packing_holds_every_id_once(docs_of, rows, ids):
    got = packing.pack(docs_of(rows), JSON, group=16).collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    by_id = {}
    for (i, _), x in zip(rows, ids):
        by_id.setdefault(i, []).append(x)
    for i, texts in by_id.items():
        if len(texts) == 1:
            at = 0
            for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
                assert (r.start, r.ids_crc32, r.doc_tokens) == (at, crc(texts[0][at : at + r.length]), len(texts[0]))
                at += r.length
            assert at == len(texts[0])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WIDTH


def test_queries_give_the_librarys_own_ids(spark, docs_of, tmp_path):
    """Added tokens in texts get their ids, as where the library is loaded and nothing is set."""
    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, "x <|endoftext|><|endoftext|>\n it's"), (4, "日本 <|endoftext|> é"), (5, "<|endoftext"), (6, "plain text"), (7, None)]
    docs = docs_of(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(JSON)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert want[1] == [64, 50256, 65, 0]
    digests = {i: (len(x), crc(x)) for i, x in want.items()}
    files = catalog.op8_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in files} == digests
    assert [r.start for r in files] == np.r_[0, np.cumsum([len(want[i]) for i, _ in rows])[:-1]].tolist()
    for packed in (catalog.op6_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packed.collect()} == digests


def test_placing_pads_less_than_a_sequence():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 700):
        lengths = rng.integers(1, 1024, n)
        used = {}
        for _, _, length, k in packing.place(lengths):
            used[k] = used.get(k, 0) + length
        assert sum(used.values()) == lengths.sum() and all(v <= 1024 for v in used.values())
        assert sum(1024 - v for v in used.values()) < 1024


def test_files_give_back_the_ids(spark, docs_of, rows, ids):
    blocks, ranks = token_files.write(docs_of(rows), JSON)
    got = token_files.read(blocks, ranks, digest=True).orderBy("start").collect()
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][:2] == [None, None]
    want = sorted(((i, len(x), crc(x)) for (i, _), x in zip(rows, ids)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want


def test_rank_code_of_all_widths():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, 2**32 - 1, 7])
    control, data = token_files.pack_ranks(ranks)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    assert token_files.unpack_ranks(control, data, len(ranks)).tolist() == ranks.tolist()


def test_rank_code_takes_few_bytes_a_rank():
    """What the code holds per rank besides its input: a table lookup, not wide numbers for each byte."""
    ranks = np.random.default_rng(2).geometric(0.001, 1 << 18).astype(np.uint32)
    tracemalloc.start()
    control, data = token_files.pack_ranks(ranks)
    packed = tracemalloc.get_traced_memory()[1] / len(ranks)
    tracemalloc.reset_peak()
    back = token_files.unpack_ranks(control, data, len(ranks))
    unpacked = tracemalloc.get_traced_memory()[1] / len(ranks)
    tracemalloc.stop()
    assert (back == ranks).all()
    print("bytes a rank", packed, unpacked)
    assert packed < 20 and unpacked < 20


def test_empty_tables(docs_of):
    none = docs_of([])
    assert token_count.token_counts(none, PIECES).count() == 0
    assert byte_bpe.round_trip(none, RANKS).count() == 0
    assert packing.pack(none, JSON).count() == 0
    assert token_files.read(*token_files.write(none, JSON)).count() == 0
