"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled texts. As
the model is linear after its average, embeddings times output weights fold into one table
of scores per subword bucket, and a text's logits are the mean of its subwords' rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import as_bytes, release

#: Lengths of subwords in bytes, and buckets for each length.
SIZES, BUCKET_BITS = (2, 3, 4), 15
#: Labelled texts taken of each language, at most, and width of an embedding.
PER_LANGUAGE, WIDTH = 1_500, 12
CHUNK = 1_000_000

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)
_CLEAN[0] = 0


def subwords(texts: list[bytes]):
    """For each subword length: buckets of all texts' subwords, and how many each text has. ASCII other than letters reads as a space."""
    buf = _CLEAN[np.frombuffer(b"\0" + b"\0".join(b" " + t.replace(b"\0", b" ") + b" " for t in texts) + b"\0", np.uint8)]
    ends = np.flatnonzero(buf == 0)
    for n in SIZES:
        m = len(buf) - n + 1
        code, whole = np.zeros(m, np.uint32), np.ones(m, bool)
        for i in range(n):
            part = buf[i : m + i]
            code |= part.astype(np.uint32) << np.uint32(8 * i)
            whole &= part != 0
        if n > 1:  # runs of spaces say nothing
            whole &= (buf[:m] != 32) | (buf[1 : m + 1] != 32)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(12)
        code *= np.uint32(0x297A2D39)
        upto = np.cumsum(whole)
        yield (code[whole] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.diff(np.concatenate(([0], upto))[np.minimum(ends, m)])


class Model:
    """Languages, a table of logits per bucket, a bias, a temperature and the least score to accept."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray):
        self.languages, self.table, self.bias, self.temperature, self.accept = languages, table.astype(np.float32), bias, 1.0, 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for k, (bucket, count) in enumerate(subwords(texts)):
            some = np.flatnonzero(count)
            if len(some):
                begin = (np.cumsum(count) - count)[some]
                for j in range(len(self.languages)):
                    out[some, j] += np.add.reduceat(self.table[k, :, j][bucket], begin, dtype=np.float64)
            n += count
        return (out / np.maximum(n, 1)[:, None] + self.bias) / self.temperature

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 5) -> Model:
    """Fit on texts in the order given; every fifth is held back to set the temperature and the least score to accept."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    buckets = len(SIZES) << BUCKET_BITS
    held = np.arange(len(texts)) % 5 == 4
    e = rng.normal(0, 0.1, (buckets, WIDTH))
    w, bias = rng.normal(0, 0.3, (WIDTH, len(languages))), np.zeros(len(languages))
    features = []
    for t in texts:
        parts = [np.unique(b + (k << BUCKET_BITS), return_counts=True) for k, (b, _) in enumerate(subwords([t]))]
        at, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        features.append((at.astype(np.int32), n.astype(np.min_scalar_type(n.max(initial=0))), max(1, n.sum())))  # the most of the driver's memory
    own = np.flatnonzero(~held)
    weight = (len(own) / len(languages)) / np.maximum(1, np.bincount(y[own], minlength=len(languages)))
    for epoch in range(epochs):
        for i in rng.permutation(own):
            at, n, total = features[i]
            share = (n / np.float64(total)).astype(np.float32)[:, None]
            step = rate * (1 - epoch / epochs) * min(3.0, weight[y[i]])
            mean = (e[at] * share).sum(axis=0)
            g = softmax(mean @ w + bias)
            g[y[i]] -= 1
            back = w @ g
            w -= 0.1 * step * np.outer(mean, g)
            bias -= 0.01 * step * g
            e[at] -= step * share * back * 5
    model = Model(languages, (e @ w).reshape(len(SIZES), 1 << BUCKET_BITS, -1), bias)
    if held.any():
        z, t = np.concatenate([model.logits([texts[i]]) for i in np.flatnonzero(held)]), y[held]
        loss = lambda at: -np.log(np.maximum(softmax(z / at)[np.arange(len(t)), t], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.2, 8, 60), key=loss))
        best = softmax(z / model.temperature).max(axis=1)
        right = softmax(z).argmax(axis=1) == t
        # no more than one right answer in a thousand may be refused, and never one that is more likely than all others
        model.accept = float(min(0.5, np.quantile(best[right], 0.001) if right.any() else 0.0))
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from at most about ``per_language`` labelled texts of each language, chosen by a hash of the id."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")
    )
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # one row a language
    if not counts:
        return None
    chosen = None
    for label, n in sorted(counts.items()):
        part = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(1.0, per_language * 1.25 / n) * 1_000_000)
        one = (F.col("label") == label) & part
        chosen = one if chosen is None else chosen | one
    found = sorted((r for r in rows.where(chosen).select(F.xxhash64("id").alias("h"), "id", "label", "text").collect()), key=lambda r: (r.h, r.id, r.text))
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in found:
        if taken[r.label] < per_language and has_letter(r.text):
            taken[r.label] += 1
            texts.append(r.text.encode())
            labels.append(r.label)
    del found
    model = train(texts, labels) if texts else None
    del texts
    release()
    return model


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, accepted``; input columns of these names are replaced.

    The prediction reads the whole text and nothing else. Null texts, texts without a letter and all texts where nothing was
    learned are ``und`` with score 0 and not accepted.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages, whatever the corpus
    result = "`__pred` struct<lang_pred:string,score:double,accepted:boolean>"
    plain = docs.drop("lang_pred", "score", "accepted")
    names = plain.columns

    def run(batches):
        release()
        own = held.value
        for b in batches:
            column = b.column(names.index(text_col)).cast(pa.string())
            texts, values = as_bytes(column), column.to_pylist()
            live = [i for i, t in enumerate(values) if own is not None and has_letter(t)]
            pred, score, ok = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            i = 0
            while i < len(live):
                j, size = i, 0
                while j < len(live) and (j == i or size + len(texts[live[j]]) <= CHUNK):
                    size += len(texts[live[j]])
                    j += 1
                p = own.scores([texts[k] for k in live[i:j]])
                for k, row, best in zip(live[i:j], p, p.argmax(axis=1), strict=True):
                    pred[k], score[k] = own.languages[best], float(row[best])
                    ok[k] = score[k] >= own.accept
                i = j
            answer = pa.StructArray.from_arrays([pa.array(pred), pa.array(score), pa.array(ok)], ["lang_pred", "score", "accepted"])
            yield pa.RecordBatch.from_arrays([*b.columns, answer], [*names, "__pred"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + [result])
    return plain.mapInArrow(run, schema).select(*names, "__pred.*")
