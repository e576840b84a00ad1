import hashlib
import random

import numpy as np

from chronoreel.llm import queries, substring

from .helpers import EDGE_DOCS, documents, edge_docs


def brute(rows, window=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                hit[i : i + window] = [True] * window
        kept = [x for x, h in zip(w, hit, strict=True) if not h]
        out.append((-1 if d is None else d, len(w), sum(hit), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    got = rows_of(queries.QUERIES["op9_substring_dedup"](spark, sf))
    assert got == brute([d[:2] for d in documents(sf)]) and sum(r[2] for r in got)


def test_planted_passages_and_periodic_texts(spark):
    r = random.Random(4)
    word = lambda n=40: f"w{r.randrange(n)}"
    passages = [[word() for _ in range(r.choice([49, 50, 51, 60, 120]))] for _ in range(12)]
    passages += [["a"] * n for n in (50, 55, 70)] + [["a", "b"] * n for n in (26, 40)] + [["a"] * 20 + ["b"] * 31, ["a"] * 3 + [word() for _ in range(46)] + ["b"] * 2]
    rows = []
    for i in range(150):
        w = [word() for _ in range(r.randrange(0, 60))]
        for p in r.sample(passages, r.randrange(0, 3)):
            lo, hi = r.choice([(0, None), (0, None), (3, None), (0, -1)])
            at = r.randrange(len(w) + 1)
            w[at:at] = p[lo:hi]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = rows_of(substring.remove_repeats(df))
    assert got == brute(rows) and sum(x[2] for x in got) > 2000


def test_edge_rows(spark):
    got = rows_of(substring.remove_repeats(edge_docs(spark), keep=("source", "node", "size")))
    assert got == brute([d[:2] for d in EDGE_DOCS])
    long = " ".join(f"x{i}" for i in range(80))
    tied = [(5, long, "en", "a", 1), (5, long, "en", "a", 1), (5, long + " more", "en", "a", 1), (None, long, "en", "a", 1), (6, long, "en", "a", 1)]
    assert rows_of(substring.remove_repeats(edge_docs(spark, tied))) == brute([d[:2] for d in tied])
    assert substring.remove_repeats(edge_docs(spark, [])).count() == 0
    assert {r.text for r in substring.remove_repeats(edge_docs(spark, EDGE_DOCS[:2])).collect()} == {"", None}

def test_windows_of_any_length(spark):
    r = random.Random(8)
    passages = [[f"p{r.randrange(25)}" for _ in range(260)] for _ in range(4)] + [["a"] * 230, ["a", "b"] * 110, ["a"] * 5 + ["b"] * 3 + ["c"] * 200]
    for window in (1, 4, 20, 50, 200):
        rows = []
        for i in range(40):
            w = [f"w{r.randrange(9)}" for _ in range(r.randrange(12))]
            for p in r.sample(passages, r.randrange(3)):
                lo = r.randrange(20)
                at = r.randrange(len(w) + 1)
                w[at:at] = p[lo : lo + window + r.randrange(-2, 20)]
            rows.append((r.randrange(60), " ".join(w)))
        got = rows_of(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window))
        assert got == brute(rows, window) and sum(x[2] for x in got), window


def test_words_are_compared_not_their_hashes(spark, monkeypatch):
    """Words on which sums of powers of an odd number collide, and a window hash that always does."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rest = " ".join(f"x{i}" for i in range(49))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[2] for r in rows_of(substring.remove_repeats(df))] == [0, 0, 50]
    words = np.arange(100, dtype=np.uint64) % 51
    monkeypatch.setattr(substring, "_K", np.uint64(0))
    same = substring.earlier(np.zeros(3, np.uint64), np.concatenate([words[:50], words[1:51], words[:50]]) + np.uint64(0), np.array([0, 50, 100]), np.array([5, 3, 4]), 50)
    assert same.tolist() == [4, 3, 4]


def test_one_very_long_text(spark):
    big = "y" * 30_000_000 + " " + "z " * 200_000
    rows = [(1, big), (2, "z " * 60), (3, "y" * 30_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[:3] for r in rows_of(substring.remove_repeats(df))] == [(1, 200_001, 0), (2, 60, 60), (3, 1, 0)]


def test_words_are_gone_when_their_names_are_written(spark, monkeypatch):
    from pathlib import Path

    there, cut = [], substring.cut

    def kept(df, tag):
        out = cut(df, tag)
        folder = Path(out._cut_path.removeprefix("file://")).parent
        there.extend([p.name.split("-")[0] for p in folder.iterdir()] if tag == "round0" else [])
        return out

    monkeypatch.setattr(substring, "cut", kept)
    rows = [(i, " ".join(f"w{j + i // 2}" for j in range(80))) for i in range(6)]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == {0: 0, 1: 80, 2: 79, 3: 80, 4: 79, 5: 80}
    assert "round0" in there and "words" not in there
