"""Plain versions of what the operators share."""

import duckdb


def tables(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def documents(sf):
    return tables(sf).execute("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()


def components(ids, links):
    """ids: distinct; the smallest id that each reaches."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


EDGE_DOCS = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "one two three", None, None, 1),
    (4, "one two three", "fr", "b", 1),
    (5, "x" * 50_000, "en", "", 1),
    (6, " \t\n ", "de", "b", 1),
    (7, "w " * 30_000, "en", "a", 1),
    (None, "one two three", "en", "a", 1),
    (9, "é ü 漢字 \x85   a\x1cb", "en", "a", 1),
    (9, "é ü 漢字 \x85   a\x1cb", "en", "a", 1),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark, rows=None):
    """Nulls, empty and long texts, ties and repeated rows, and extra columns whose names operators use themselves."""
    extra = "node long, root string, class long, fp string, chunk int, size string, step int, key string"
    rows = [(*r, 1, "r", 2, "f", 3, "s", 4, "k") for r in (EDGE_DOCS if rows is None else rows)]
    return spark.createDataFrame(rows, f"{DOC_SCHEMA}, {extra}")
