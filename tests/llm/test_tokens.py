import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkweave.llm import bpe, packing, token_counts
from sparkweave.llm.pretokens import SPECIAL, pieces, vocabulary_path
from tests.llm import brute

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
HARD = [
    None, "", " ", "a", "a  b \n c\r\n\tд ", f"x{SPECIAL} y {SPECIAL}{SPECIAL}", "it's we'll IT'S é é ß Σας 日本語 😀😀",
    "word " * 3000, "x" * 3000, " " * 500 + "y", "\u0085a b c\x1cd", "1234567 ²Ⅷ٣", "\x00\x01�", "the the the",
    "a <|ENDOFTEXT|>b <|endoftext|> <|StartOfText|> <|startoftext|>c İİ ǅ ȺȾ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(5, HARD[5]), (None, "the end")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("piece", F.lit("x"))


@pytest.fixture(scope="module")
def given_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def reference(vocabulary, text):
    return Tokenizer.from_file(vocabulary_path(vocabulary)).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab tzé 日'sl\n1😀́!,ȺǅΣ<|>"), max_size=40), max_size=4))
def test_encodings_equal_the_library(parts):
    assert all("".join(pieces(x)) == x for x in parts)
    if not _LOADED:
        for name, make in ((BYTE, bpe.TextEncoder), (WORD, packing.WordIds)):
            _LOADED[name] = make(vocabulary_path(name)), Tokenizer.from_file(vocabulary_path(name))
    for encoder, tok in _LOADED.values():
        for x, ids in zip(parts, encoder.encode(parts)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


_LOADED: dict = {}


def test_bpe(docs, given_docs):
    tok = Tokenizer.from_file(vocabulary_path(BYTE))
    for table in (docs, given_docs):
        texts = {r.doc_id: r.text for r in table.collect()}
        rows = bpe.encode_digests(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes())
            assert r.decoded_sha256 == brute.sha(tok.decode(ids, skip_special_tokens=False))
    assert bpe.encode_digests(docs.limit(0)).count() == 0
    full = {r.doc_id: r for r in bpe.encode_texts(docs).collect()}
    assert full[6].decoded == HARD[6] and full[6].ids == reference(BYTE, HARD[6])


@pytest.mark.parametrize("heavy", [3, token_counts.HEAVY])
def test_token_counts(docs, given_docs, heavy, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAVY", heavy)  # almost everything takes the join
    tok = Tokenizer.from_file(vocabulary_path(BYTE))
    for table in (docs, given_docs):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
                      for r in table.collect())
        rows = token_counts.count_tokens(table).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def check_packing(table, rows, capacity):
    tok = Tokenizer.from_file(vocabulary_path(WORD))
    want = []
    for r in table.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r.doc_id or -1, i, at, len(p := ids[at:at + capacity]), zlib.crc32(p.tobytes()))
                 for i, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) * 1.02 + 2


@pytest.mark.parametrize("group", [16, packing.GROUP_PIECES])
def test_packing(docs, given_docs, group, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    for table, capacity in ((docs, 512), (given_docs, 4096)):
        if group < 100 and capacity == 4096:
            continue
        check_packing(table, packing.pack_documents(table, WORD, capacity).collect(), capacity)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_light_bins_meet_across_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    rows = packing.pack(spark.range(200).selectExpr("id AS doc_id", "1L AS length"), 4096).collect()
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == list(range(200))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_sum_of_squares(lengths):
    lengths = np.array(lengths, "i8")
    bins, offsets = packing.sum_of_squares(lengths, 50)
    for b in set(bins.tolist()):
        at = 0
        for o, n in sorted(zip(offsets[bins == b], lengths[bins == b])):
            assert o == at
            at += n
        assert at <= 50
