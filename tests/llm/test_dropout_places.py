import numpy as np

from evidentia.llm import piece_dropout as pd_

MODEL = pd_.model_path()


def _drawn(pieces, chunk, rate, times):
    """Segmentations where every candidate is skipped by a draw of its own."""
    draw = np.random.default_rng(1)
    salts = [pd_.salted(pieces.ids[chunk[i:j]], i) for i in range(len(chunk)) for j in range(i + 2, len(chunk) + 1) if chunk[i:j] in pieces.ids]
    return [tuple(pieces.segment(chunk, skips=tuple(s for s, x in zip(salts, draw.random(len(salts))) if x < rate), taken=[])) for _ in range(times)]


def test_a_word_is_split_at_the_rate_in_many_ways():
    coder = pd_.PieceCoder(MODEL, 0.1)
    for word in ("government", "the", "considerations"):
        whole = tuple(coder.pieces.segment(pd_.SPACE + word))
        found = [tuple(x.tolist()) for x in coder.encode_many([word] * 20_000, list(range(20_000)))]
        drawn = _drawn(coder.pieces, pd_.SPACE + word, 0.1, 20_000)
        for way in {whole, *sorted(set(drawn), key=drawn.count)[-3:]}:
            assert abs(found.count(way) - drawn.count(way)) < 0.02 * 20_000, (word, way)
    assert len(set(found)) > 20


def test_places_in_one_document_differ():
    coder = pd_.PieceCoder(MODEL, 0.1)
    chunks = [pd_.SPACE + "considerations"] * 5_000
    assert len(set(coder._coded(chunks[:1], np.zeros(5_000, np.int64), pd_.mix(np.arange(5_000, dtype=np.uint64)).astype(np.uint32)))) > 10


def test_tree_and_agenda_agree():
    words = ["▁government", "▁considerations", "▁the", "▁internationalization", "▁x", "▁日本x", "▁" + "ab" * 60, "▁" + "ab" * 28]
    for rate in (0.1, 0.6):
        coder = pd_.PieceCoder(MODEL, rate)
        chunks = words * 400
        keys = pd_.mix(np.arange(len(chunks), dtype=np.uint64)).astype(np.uint32)
        for _ in range(2):
            for c, k, got in zip(chunks, keys.tolist(), coder._coded(words, np.tile(np.arange(len(words)), 400), keys)):
                assert np.frombuffer(got, "<u4").tolist() == coder.pieces.segment(c, rate, k)
