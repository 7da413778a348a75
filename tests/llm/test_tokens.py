import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm import piece_dropout as pd_
from evidentia.llm import token_files as t
from evidentia.llm.common import new_path

BPE = P.path("byte_bpe_50k.json")
ODD = ["a  b", " x", "x ", "don't 'tis it's,", "\n a b\n", "x\t y", "a b  c", " 12 3a, b4! ..", "<|endoftext|> hi <|endoftext|>", "ñandú, été! 日本 語", "", " ", "\n", "a\n b", "…a b…", "the'", "I'll 'll x's. it's", "x" * 3000 + " " + "y " * 500]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
def test_pack_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert (t.unpack(len(a), *t.pack(a)) == a).all()


def test_blocks_are_independent():
    a = np.arange(1000, dtype=np.uint64) % 37
    offsets, words, escapes = t.pack(a)
    k = 3
    own = words[offsets[k] : offsets[k + 1]]
    assert (t.unpack(128, np.zeros(1, np.uint32), own, escapes) == a[128 * k : 128 * (k + 1)]).all()


def test_encoder_is_the_library(spark, sf):
    lib = Tokenizer.from_file(BPE)
    enc = t.TextEncoder(BPE)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for x in texts * 2:
        assert np.frombuffer(enc(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, x[:50]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab Z'.,\n\t!é3 ", max_size=30), max_size=6))
def test_encoder_property(texts):
    lib = Tokenizer.from_file(BPE)
    enc = t.encoder(BPE)
    for x in texts:
        assert np.frombuffer(enc(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids


def test_memo_generations():
    enc = t.TextEncoder(BPE)
    enc.words.limit = 3
    text = "a b c d e f g b c d e f g the the, the."
    lib = Tokenizer.from_file(BPE)
    assert np.frombuffer(enc(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids and len(enc.words.new) <= 3 and len(enc.words.old) <= 3


def test_batches_of_any_texts(spark, sf):
    lib, enc = Tokenizer.from_file(BPE), t.TextEncoder(BPE)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for batch in (ODD, ["", ""], [], texts + ODD, ODD[::-1] + texts[::-1]):
        for end in (None, 0):
            ids, counts = enc.encode_many(batch, end)
            expected = [lib.encode(x, add_special_tokens=False).ids + ([] if end is None else [end]) for x in batch]
            assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_added_tokens_are_the_librarys():
    text = "one <|endoftext|>two three <|endoftext|>"
    ids = np.frombuffer(t.TextEncoder(BPE)(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids and ids.count(50256) == 2


def test_plain_chunks_of_every_latin_character():
    lib, enc = Tokenizer.from_file(BPE), t.TextEncoder(BPE)
    for c in map(chr, range(1, 0x260)):
        text = f"a{c}b {c} 1{c} {c}{c}, x.\n{c}y"
        assert np.frombuffer(enc(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_a_tokenizer_of_another_kind_is_not_cut():
    path = P.path("word_bpe_49k.json")
    lib, enc = Tokenizer.from_file(path), t.TextEncoder(path)
    for x in ODD:
        assert np.frombuffer(enc(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, x


def test_order_of_files_is_not_read_from_the_jobs_name(spark, tmp_path):
    """A job's UUID may hold what looks like a file's number."""
    docs = [(k, "x " * (7 * k % 5 + 1)) for k in range(8)]
    path = t.write_token_files(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), new_path(spark, "t"), BPE, record_bytes=1, records_per_file=1)
    names = sorted(f.path for f in spark.read.format("binaryFile").load(path).select("path").collect())
    for name in names:
        raw = open(name.removeprefix("file:"), "rb").read()
        tail = name.rsplit("/", 1)[1]
        part, piece = tail.split("-")[1], tail.rsplit("-c", 1)[1]
        (tmp_path / f"part-{part}-8f0e2a51-c12f-4c07-b-c3a1-{'%012d' % (97 - len(raw))}-c{piece}").write_bytes(raw)
    got = sorted(t.read_token_files(spark, f"file://{tmp_path}").collect(), key=lambda r: r.doc_id)
    ends = np.cumsum([r.n_tokens for r in got]).tolist()
    assert [r.start for r in got] == [0, *ends[:-1]] and any(n.rsplit("-c", 1)[1][:3] > "001" for n in names)


def test_query(spark, sf):
    lib = Tokenizer.from_file(BPE)
    got = sorted(t.op2_token_files(spark, sf).collect(), key=lambda r: r.start)
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    start = 0
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        ids = [*lib.encode(d.text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_edges(spark):
    rows = [(None, None, 1), (5, "", 2), (3, "x y", 3), (3, "x y", 3), (9, ODD[-1], 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted(t.read_token_files(spark, t.write_token_files(df, new_path(spark, "t"), BPE, record_bytes=10, records_per_file=1)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 3, 5, 9] and [r.start for r in got][:4] == [0, 1, 4, 7]
    assert t.read_token_files(spark, t.write_token_files(df.limit(0), new_path(spark, "t"), BPE)).count() == 0


# ---- pieces

MODEL = pd_.model_path()


def test_without_dropout_it_is_the_model(spark, sf):
    from sentencepiece import SentencePieceProcessor

    lib, own = SentencePieceProcessor(model_file=MODEL), pd_.PieceCoder(MODEL, 0.0)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert own.encode(r.text).tolist() == lib.encode(r.text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(0, 10))
def test_dropout_is_lossless(text, key):
    c = pd_.coder(MODEL, 0.3)
    assert c.decode(c.encode(text, key)) == text


@pytest.mark.parametrize("text", [*ODD, "▁", "a▁ ▁b▁▁", "\0\x01"])
def test_dropout_is_lossless_on_odd_texts(text):
    c = pd_.coder(MODEL, 0.3)
    assert c.decode(c.encode(text, 1)) == text


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_vector_and_agenda_agree(spark, sf, rate):
    pieces = pd_.Pieces(MODEL)
    chunks = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect() for w in pd_.PieceCoder._chunks((" " + r.text).replace(" ", pd_.SPACE))} | {"▁日本x", "a", "▁" * 9, "▁" + "ab" * 60})
    keys = np.arange(len(chunks), dtype=np.uint64) * np.uint64(7919)
    for c, k, got in zip(chunks, keys.tolist(), pieces.segment_many(chunks, rate, keys)):
        assert np.frombuffer(got, "<u4").tolist() == pieces.segment(c, rate, k), c


def test_dropout_varies_by_document_and_seed_and_repeats():
    text = "internationalization considerations everywhere " * 20
    a, b = pd_.PieceCoder(MODEL, 0.2, 1), pd_.PieceCoder(MODEL, 0.2, 2)
    assert a.encode(text, 1).tolist() == pd_.PieceCoder(MODEL, 0.2, 1).encode(text, 1).tolist()
    assert a.encode(text, 1).tolist() != a.encode(text, 2).tolist() and a.encode(text, 1).tolist() != b.encode(text, 1).tolist()
    assert len(a.encode(text, 1)) > len(pd_.PieceCoder(MODEL, 0.0).encode(text))


def test_piece_frames(spark):
    df = spark.createDataFrame([(1, "a b", 1), (None, None, 2), (1, "a b", 1), (2, "", 3)], "doc_id long, text string, ids int")
    got = pd_.decode(pd_.encode(df, MODEL), MODEL).collect()
    assert all(r.lossless and r.text_decoded == (r.text or "") and r.n_pieces == len(r.ids) for r in got) and len(got) == 4
    assert pd_.encode(df.limit(0), MODEL).count() == 0


def test_piece_query(spark, sf):
    got = pd_.op4_piece_dropout(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.filter("not lossless").count() == 0
