import random

import pytest

from chronoreel.llm import queries, spm

from .helpers import EDGE_DOCS, documents, edge_docs


@pytest.fixture(scope="module")
def model():
    return spm.Model(spm.default_model())


def test_query_equals_library(spark, sf, model):
    texts = {d[0]: d[1] for d in documents(sf)}
    got = queries.QUERIES["op6_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = model.lib.encode(texts[r.doc_id] or "")
        assert list(r.ids or []) == want and r.n_tokens == len(want)
    decoded = spm.round_trip(spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert all(r.decoded == r.text for r in decoded)


def test_random_strings_equal_library(model):
    r = random.Random(1)
    texts = ["".join(r.choice("aab \n\té漢x▁th e<s>\x00\x85") for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["".join(r.choice("aeinst ") for _ in range(40)) for _ in range(500)] + ["x" * 3000, "aaaaaaa " * 20, "  ", " a", "hello  world\n\nfoo"]
    for t in texts:
        ids = [i for w in model.encode_words(model.words(t)) for i in w]
        assert ids == model.lib.encode(t) and model.decode(ids) == model.lib.decode(ids), t


def test_unigram_viterbi(model):
    """Under scores that add up, the best segmentation of all."""
    m = object.__new__(spm.Model)
    m.merges, m.byte, m.unknown, m.longest, m.least = False, {}, 0, 3, -20.0
    m.score = {"a": -3.0, "b": -3.0, "ab": -4.0, "ba": -2.5, "aba": -6.0}
    m.ids = {p: i + 1 for i, p in enumerate(m.score)}
    m._fit, m.live = {}, set(m.ids)

    def best(w):
        if not w:
            return 0.0
        return max(best(w[n:]) + (m.score[w[:n]] if w[:n] in m.score else -20.0) for n in range(1, 4) if n <= len(w) and (w[:n] in m.score or n == 1))

    r, name = random.Random(2), {i: p for p, i in m.ids.items()}
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(200)]
    for w, ids in zip(words, m.encode_words(words), strict=True):
        assert abs(sum(m.score[name[i]] if i else -20.0 for i in ids) - best(w)) < 1e-9


def test_edge_rows(spark, model):
    got = spm.round_trip(edge_docs(spark)).collect()
    assert len(got) == len(EDGE_DOCS)
    for r in got:
        assert (r.ids is None) == (r.text is None) and list(r.ids or []) == model.lib.encode(r.text or "") and r.n_tokens == len(r.ids or [])
    assert spm.round_trip(edge_docs(spark, [])).count() == 0


def test_words_side_by_side_equal_library(spark, model, monkeypatch):
    """Also where little is kept; new words don't go through the pass letter by letter."""
    r = random.Random(3)
    words = sorted({"▁" * r.randrange(3) + "".join(r.choice("aeinstrhéß漢😀xX0.") for _ in range(r.randrange(1, 40))) for _ in range(3_000)} | {"", "a", "▁", "x" * 65})
    want = {w: ids for w, ids in zip(words, model.encode_words(words), strict=True)}
    for steps, pairs in ((spm.STEPS, spm.PAIRS), (50, 50)):
        monkeypatch.setattr(spm, "STEPS", steps)
        monkeypatch.setattr(spm, "PAIRS", pairs)
        m = spm.Model(spm.default_model())
        alone, line = [], m.encode_words
        m.encode_words = lambda new, alone=alone, line=line: alone.extend(new) or line(new)
        order, flat, n = m.encode_many(words)
        assert sorted(order) == words and alone == ["x" * 65] and flat.dtype.kind == "i"
        at = 0
        for w, k in zip(order, n.tolist(), strict=True):
            assert flat[at : at + k].tolist() == want[w], w
            at += k
        assert at == len(flat) and len(m.side.fits.key) < 1 << 20
    assert [len(x) for x in m.encode_many([])] == [0, 0, 0]


def test_texts_decoded_at_once(model):
    import pyarrow as pa

    ids = [None, [], model.lib.encode("  a b"), model.lib.encode("é 漢😀"), model.lib.encode(" "), None]
    broken = [model.byte[0xE6], model.byte[0xBC]]  # two bytes of three, which the next text's first would end
    for lists in (ids, [*ids, broken, [model.byte[0xA2]]], [[]], [None], []):
        column = pa.array([[9], *lists, [9]], pa.list_(pa.int32())).slice(1, len(lists))
        assert model.decode_many(column).to_pylist() == [None if x is None else model.decode(x) for x in lists]
    for wrong in ([len(model.raw)], [None]):
        with pytest.raises((pa.ArrowException, IndexError, ValueError)):
            model.decode_many(pa.array([wrong], pa.list_(pa.int32())))
