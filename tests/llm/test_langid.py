import zlib

import numpy as np

from chronoreel.llm import langid, queries

from .helpers import EDGE_DOCS, documents, edge_docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d[0]: d for d in documents(sf)}
    got = queries.QUERIES["op5_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id][2] for r in held]) >= 0.97
    assert np.mean([r.accepted for r in got]) >= 0.99


def test_edge_rows(spark):
    model = langid.train([b"the cat sat on the mat and then ran " * 3, b"der hund und die katze sind nicht hier " * 3] * 10, ["en", "de"] * 10)
    got = langid.identify(edge_docs(spark), model).collect()
    assert len(got) == len(EDGE_DOCS) and {"node", "lang", "key"} <= set(got[0].asDict())
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    assert langid.learn(edge_docs(spark, [])) is None
    assert {r.lang_pred for r in langid.identify(edge_docs(spark), None).collect()} == {"und"}
    assert langid.learn(edge_docs(spark)) is not None


def test_subwords_stay_within_their_text():
    one = [b.tolist() for b, _ in langid.subwords([b"Abc d", b"", b"xyz"])]
    apart = [sum((b.tolist() for b, _ in [list(langid.subwords([t]))[k] for t in (b"Abc d", b"", b"xyz")]), []) for k in range(len(langid.SIZES))]
    assert one == apart


def test_learning_holds_little_beside_the_texts():
    import random
    import tracemalloc

    r = random.Random(4)
    texts = [" ".join("".join(r.choice("aeinstrhld") for _ in range(r.randrange(2, 9))) for _ in range(1_500)).encode() for _ in range(150)]
    tracemalloc.start()
    langid.train(texts, ["en", "de", "fr"] * 50, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
