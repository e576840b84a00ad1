import hashlib

import corpus_pipeline as cp
from chronoreel.llm import langid, spm

from .helpers import documents, edge_docs
from .test_mixing import brute as brute_mix
from .test_shingles import groups
from .test_substring import brute as brute_substring


def test_run_against_plain_stages(spark, sf):
    docs = [d for d in documents(sf)]
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    keep = []
    for d in docs:
        if langid.has_letter(d[1]):
            p = model.scores([d[1].encode()])[0]
            if p.max() >= model.accept:
                keep.append(d)
    assert len(keep) >= 0.98 * len(docs)
    group = groups(keep)
    once = [d for d in keep if group[d[0]] == d[0]]
    assert len(once) < len(keep)
    keep = once
    removed = {r[0]: r for r in brute_substring([d[:2] for d in keep])}
    rows = [(d[0], d[3], removed[d[0]][1] - removed[d[0]][2]) for d in keep if removed[d[0]][2] < removed[d[0]][1] or not removed[d[0]][1]]
    mixed = brute_mix(rows)
    want = {i: v[3] // v[0] for i, v in mixed.items() if v[3]}
    got = cp.run(spark, sf).collect()
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == want
    lib = spm.Model(spm.default_model())
    for r in got:
        text = lib.lib.decode(list(r.ids))
        assert hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
        line = b" ".join(text.encode().split())
        assert hashlib.sha256(line).hexdigest() == removed[r.doc_id][3]


def test_stages_on_edge_rows(spark):
    docs = edge_docs(spark)
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, "")
        if i < len(cp.STAGES) - 1:
            assert out.columns == list(cp.COLUMNS)
        assert out.count() <= (20 if stage is cp.mix_sources else 10)  # a mix may take a document twice
        assert stage(spark, edge_docs(spark, []), "").count() == 0
    near = cp.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in near if r.doc_id) == [1, 3, 5, 7, 9]


def test_mix_tells_rows_of_one_id_apart(spark):
    rows = [(1, "w " * 10, "en", "a", 1), (1, "v " * 1_000, "en", "a", 1), (2, "u " * 10, "en", "b", 1), (None, "t " * 5, "en", None, 1)]
    got = cp.mix_sources(spark, edge_docs(spark, rows), "").collect()
    words = sum(len(r.text.split()) for r in got)
    assert words <= 1.5 * 1_025 and all(sum(x.text == r.text for x in got) <= 2 for r in got)
