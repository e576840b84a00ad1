from fractions import Fraction
from itertools import combinations

import numpy as np

import corpus_pipeline as cp
from chronoreel.llm import shingles

from .helpers import DOC_SCHEMA, components, documents


def plain(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)) if words else frozenset()


def groups(docs):
    sets = {d[0]: plain(d[1]) for d in docs}
    near = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    return components(sorted(sets), [(a, b) for a, b in combinations(sorted(sets), 2) if near(sets[a], sets[b])])


def edited():
    """Texts and copies of a similarity of 0.8 exactly, a little below and above, short ones, and a frequent passage."""
    docs, i = [], 0
    for size in (9, 14, 49, 94, 304, 1004):
        base = [f"w{size}x{j}" for j in range(size)]
        n = size - 4
        for drop in (n // 9 - 1, n // 9, n // 9 + 1, n // 5, n // 5 + 1):
            docs.append((i, " ".join(base[max(0, drop) :])))
            docs.append((i + 1, " ".join(base[: size // 2] + [f"new{i}"] + base[size // 2 + 1 :])))
            i += 2
    line = " ".join(f"licence{j}" for j in range(40))
    docs += [(i + j, f"{line} own{j} of{j} it{j}") for j in range(6)]
    docs += [(i + 6 + j, f"{line} " + " ".join(f"{j}text{k}" for k in range(60))) for j in range(30)]
    return docs


def test_stage_keeps_what_a_jaccard_brute_force_keeps(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 2_000)
    docs = edited()
    group = groups(docs)
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], DOC_SCHEMA)
    got = cp.simhash_near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(group.values()))
    assert len(docs) > len(got) > 40


def test_stage_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(sf)
    got = cp.simhash_near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(groups(docs).values()))


def test_rows_of_repeated_and_null_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcd"}
    rows = [(1, "b"), (1, "a"), (2, "a"), (2, "c"), (None, "c"), (None, "d"), (None, "d")]
    df = spark.createDataFrame([(i, text[c], "en", "s", 1) for i, c in rows], DOC_SCHEMA)
    got = [(r.doc_id, r.text[0]) for r in cp.simhash_near_dedup(spark, df, "").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, "a"), (1, "b"), (2, "c"), (None, "d")]


def test_sets_and_other_similarities(spark):
    texts = [b"", b"  ", b"a b", b"A  b", b"a b c d e f", b"a b c d e a b c d e"]
    h, n = shingles.shingle_sets(texts)
    assert n.tolist() == [len(plain(t.decode())) for t in texts]
    names = shingles.set_names(h, n).tolist()
    assert names[0] == names[1] == 0 and names[2] == names[3] and len(set(names)) == 4
    df = spark.createDataFrame([(" ".join("abcdefghij"[:k]),) for k in range(5, 11)], "text string")
    found = {tuple(sorted((r.a, r.b))) for r in shingles.links(df, similarity=Fraction(1, 2)).collect()}
    names = shingles.set_names(*shingles.shingle_sets([" ".join("abcdefghij"[:k]).encode() for k in range(5, 11)])).tolist()
    alike = [(names[a - 1], names[b - 1]) for a, b in combinations(range(1, 7), 2) if 2 * a >= b]
    assert found <= {tuple(sorted(x)) for x in alike} and components(names, found) == components(names, alike)


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    """Each copy has a word of its own; no more links than a few for each."""
    base = [f"w{i}" for i in range(300)]
    rows = [(" ".join([*base[: i % 290], f"own{i}", *base[i % 290 + 1 :]]),) for i in range(400)]
    found = shingles.links(spark.createDataFrame(rows, "text string").repartition(4))
    assert found.count() < 1_600 and len({x for r in found.collect() for x in (r.a, r.b)}) == 400
    assert len(set(components(*[list({x for r in found.collect() for x in (r.a, r.b)}), [(r.a, r.b) for r in found.collect()]]).values())) == 1


def test_least_rows_are_one_of_each_group(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(3, long, "a"), (2, long.upper(), "b"), (None, long + " more", "c"), (5, None, None), (4, " ", "d"), (7, "other words here", "e"), (None, "alone", "f"), (7, "other words here", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r string")
    got = shingles.least_rows(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[1], rows[4], rows[5], rows[6]], key=repr)
    assert not shingles.least_rows(docs.limit(0)).collect()


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 64, 12_000, np.uint64)
    sets = [np.sort(hashes[a : a + n]) for a in (0, 40, 300) for n in (0, 1, 255, 256, 257, 300, 5_000)]
    made = shingles.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert {len(x) * 8 for x in made} == {256, 512, 8192}
    pairs = list(combinations(range(len(sets)), 2))
    d = shingles.sketch_distances([made[i] for i, _ in pairs], [made[j] for _, j in pairs])
    assert all(x <= len(np.setxor1d(sets[i], sets[j])) for x, (i, j) in zip(d, pairs, strict=True))
    assert len(shingles.sketch_distances([], [])) == 0


def test_whole_sets_move_for_pairs_alone_that_are_nearly_similar(spark, monkeypatch):
    line = " ".join(f"licence{j}" for j in range(60))
    docs = [(j, f"{line} " + " ".join(f"{j}text{k}" for k in range(60))) for j in range(30)] + [(99, f"{line} " + " ".join(f"3text{k}" for k in range(59)))]
    moved, cut = [], shingles.cut

    def kept(df, tag):
        out = cut(df, tag)
        moved.extend([out.count()] if tag == "sets" else [])
        return out

    monkeypatch.setattr(shingles, "cut", kept)
    monkeypatch.setattr(shingles, "SAMPLE", 0)  # no shingle is put last as frequent, so all the texts are candidates
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], DOC_SCHEMA)
    assert sorted(r.doc_id for r in cp.simhash_near_dedup(spark, df, "").collect()) == list(range(30))
    assert sum(moved) == 2


def test_shingles_of_a_fixed_number_of_texts_make_no_pairs_in_larger_tables(spark, monkeypatch):
    """Ten lines, of 60 texts each, that a sample of 20 texts can't tell; told apart one by one, or by the filter."""
    docs = [(60 * g + j, " ".join([*(f"line{g}x{k}" for k in range(40)), *(f"{g}own{j}x{k}" for k in range(60))])) for g in range(10) for j in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    made, cut = [], shingles.cut

    def kept(df, tag):
        out = cut(df, tag)
        made.extend([out.count()] if tag == "pairs" else [])
        return out

    monkeypatch.setattr(shingles, "cut", kept)
    monkeypatch.setattr(shingles, "SAMPLE", 20)
    for most in (50_000, 0):
        monkeypatch.setattr(shingles, "MOST", most)
        made.clear()
        assert shingles.links(df).count() == 0 and sum(made) < 600


def test_sets_alone_beside_a_large_group_make_few_pairs(spark, monkeypatch):
    """Copies with one word changed are linked, and others with eight are similar to none; all share most shingles."""
    rng = np.random.default_rng(3)
    base, docs = [f"w{i}" for i in range(300)], []
    for i in range(400):
        at = set(rng.choice(300, 8 if i % 2 else 1, replace=False).tolist())
        docs.append((i, " ".join(f"own{i}x{j}" if j in at else w for j, w in enumerate(base))))
    made, cut = [], shingles.cut

    def kept(df, tag):
        out = cut(df, tag)
        made.extend([out.count()] if tag == "pairs" else [])
        return out

    monkeypatch.setattr(shingles, "cut", kept)
    monkeypatch.setattr(shingles, "SAMPLE", 0)
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], DOC_SCHEMA).repartition(4)
    got = sorted(r.doc_id for r in cp.simhash_near_dedup(spark, df, "").collect())
    assert got == sorted(set(groups(docs).values())) and len(got) > 190
    assert sum(made) < 20 * len(docs)


def test_rounds_that_end_early_leave_no_link_out(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLE", 0)
    docs = edited()
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], DOC_SCHEMA)
    for rounds in (1, 2):
        monkeypatch.setattr(shingles, "ROUNDS", rounds)
        got = cp.simhash_near_dedup(spark, df, "").collect()
        assert sorted(r.doc_id for r in got) == sorted(set(groups(docs).values()))


def test_folded_sketches_are_as_far_apart_as_pair_by_pair():
    rng = np.random.default_rng(5)
    n = np.array([0, 3, 255, 257, 300, 600, 1_100, 5_000])
    made = shingles.sketches(np.sort(rng.integers(0, 1 << 64, n.sum(), np.uint64)), n, 4)
    assert [len(x) * 8 for x in made] == [1024, 1024, 1024, 2048, 2048, 4096, 8192, 32768]
    a, b = np.array(list(combinations(range(len(n)), 2))).T
    assert shingles.Folded(made).distances(a, b).tolist() == shingles.sketch_distances([made[i] for i in a], [made[i] for i in b]).tolist()
