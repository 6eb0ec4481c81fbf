"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean embedding of its subwords: hashed letter n-grams inside words and hashed whole
words. A linear layer with softmax gives the language. Both are trained by stochastic gradient descent in
numpy on a bounded sample. The softmax is calibrated by a temperature fitted on a part of the sample kept
out of training, and texts whose calibrated confidence is below what that part supports are *rejected*:
an operator's user reads `rejected`; the best language is named all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import handing_back, small_batches
from .textops import _NON_LETTER, Words, in_pieces, mix, slices

BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
#: Most documents that training reads.
TRAIN_ROWS = 4_000
#: Most bytes of a text that training reads; the language of longer ones is predicted but not learned from.
TRAIN_BYTES = 100_000
#: Temperatures that calibration of a model of counts tries.
TEMPERATURES = (0.01, 0.02, 0.035, 0.05, 0.07, 0.1, 0.14, 0.2, 0.3, 0.5, 1.0)
#: Share of texts with a known language that calibration may reject.
REJECT = 0.01


def _features(w: Words, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, feature) arrays: every letter n-gram inside a word, and every word."""
    n = len(w.lower)
    n64 = np.uint64(buckets)
    gap = np.concatenate(([0], np.cumsum(_NON_LETTER[w.lower])))
    code = w.lower.astype(np.uint64)
    for k in GRAMS:
        if n < k:
            continue
        packed = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            packed |= code[i : n - k + 1 + i] << np.uint64(8 * i)
        inside = np.flatnonzero(gap[k:] == gap[: n - k + 1])
        yield inside, (mix(packed[inside] + np.uint64(k)) % n64).astype(np.int64)
    yield w.start, (w.hash % n64).astype(np.int64)


def _summed(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's features, and their number."""
    w = Words(texts, letters_only=True)
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    columns = [np.ascontiguousarray(table[:, c]) for c in range(table.shape[1])]
    for at, feature in _features(w, len(table)):
        cut = np.searchsorted(at, limits)
        counts += np.diff(cut)
        for c, column in enumerate(columns):
            total = np.concatenate(([0.0], np.cumsum(column[feature], dtype=np.float64)))
            sums[:, c] += total[cut[1:]] - total[cut[:-1]]
    return sums, counts


class Model:
    """languages, scores of each feature bucket (embedding times output layer), bias, temperature, least confidence."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.least = 1.0, 0.0

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Row of calibrated probabilities for each text; texts without letters have equal ones."""
        rows = []
        for i, j in slices(texts) if texts else ():
            parts, first = in_pieces(texts[i:j], letters_only=True)
            sums, counts = np.zeros((j - i, self.table.shape[1])), np.zeros(j - i)
            for a, b in slices(parts):  # a very long text is summed up piece by piece
                s, c = _summed(parts[a:b], self.table)
                owner = np.searchsorted(first, np.arange(a, b), side="right") - 1
                np.add.at(sums, owner, s)
                np.add.at(counts, owner, c)
            z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
            z[counts == 0] = 0
            e = np.exp(z - z.max(1, keepdims=True))
            rows.append(e / e.sum(1, keepdims=True))
        return np.concatenate(rows) if rows else np.empty((0, len(self.languages)))


def train(texts: list[bytes], languages: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent over the texts; every tenth is kept out for calibration."""
    names = sorted(set(languages))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, max(len(names), 1)), np.float32), np.zeros(max(len(names), 1)))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in languages])
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    bags = []  # distinct features of each text with their shares
    for i, j in slices(texts):
        w = Words(texts[i:j], letters_only=True)
        limits = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        parts = [(np.searchsorted(at, limits), f) for at, f in _features(w, BUCKETS)]
        for k in range(j - i):
            f = np.concatenate([f[c[k] : c[k + 1]] for c, f in parts])
            ids, times = np.unique(f, return_counts=True)
            bags.append((ids, (times / max(len(f), 1)).astype(np.float32)))
    fit = [i for i in range(len(texts)) if i % 10 and len(bags[i][0])] or list(range(len(texts)))
    for epoch in range(epochs):
        lr = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(fit):
            ids, share = bags[i]
            v = share @ emb[ids]
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(v, p)
            bias -= lr * 0.1 * p
            emb[ids] -= (lr * 20 * share)[:, None] * back
    model = Model(names, (emb @ out).astype(np.float32), bias.astype(np.float64))
    kept = [i for i in range(len(texts)) if i % 10 == 0 and len(bags[i][0])]
    if kept:
        own, truth = [texts[i] for i in kept], y[kept]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(own)[np.arange(len(own)), truth], 1e-12)).mean()

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        model.least = float(np.quantile(model.probabilities(own).max(1), REJECT))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Model from at most `most` rows of a non-null language and at most `most_bytes` bytes whose crc32(id as text) mod 5 is not 0.

    The rows are those of least hash, an even sample of the whole table.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("l"))
    key = F.col("i").cast("string")
    rows = rows.where(F.col("l").isNotNull() & (F.octet_length("t") <= most_bytes) & (F.crc32(key) % 5 != 0))
    # ids first, so that only the chosen rows' texts are read into the sample; then rows, as ids may repeat
    chosen = F.broadcast(rows.select("i").distinct().orderBy(F.xxhash64(key), "i").limit(most))
    got = rows.join(chosen, "i").orderBy(F.xxhash64(key), "i", F.xxhash64("t"), "l").limit(most).select("i", "t", "l").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return train([r["t"].encode() for r in got], [r["l"] for r in got])


def fit_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from the feature counts of all rows of a non-null language whose crc32(id as text) mod 5 is not 0, their texts whole.

    A feature's scores are the logarithms of its smoothed shares in each language. Every tenth id is kept out of
    the counts and gives temperature and least confidence. Languages are few; counts and histograms are all
    that comes to the driver.
    """
    small_batches(docs.sparkSession)
    key = F.col(id_col).cast("string")
    rows = docs.where(F.col(lang_col).isNotNull() & (F.crc32(key) % 5 != 0))
    rows = rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(lang_col).alias("l"), (F.pmod(F.xxhash64(key), F.lit(10)) == 0).alias("kept"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            texts, names = [t.encode() for t in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), object)
            for name in set(names):
                own = [texts[i] for i in np.flatnonzero(names == name)]
                total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                parts, _ = in_pieces(own, letters_only=True)
                for a, b in slices(parts):
                    for _, f in _features(Words(parts[a:b], letters_only=True), BUCKETS):
                        total += np.bincount(f, minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["l", "f", "n"])

    counted = rows.where("not kept").withColumn("l", F.col("l").cast("string")).select("t", "l")
    got = counted.mapInArrow(handing_back(count), "l string, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("l").to_pylist()))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, max(len(names), 1)), np.float32), np.zeros(max(len(names), 1)))
    table = np.full((BUCKETS, len(names)), 0.5)
    place = {name: i for i, name in enumerate(names)}
    table[got.column("f").to_numpy(), [place[x] for x in got.column("l").to_pylist()]] += got.column("n").to_numpy()
    model = Model(names, np.log(table / table.sum(0)).astype(np.float32), np.zeros(len(names)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            truth = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            p = own.probabilities([t.encode() for t in batch.column(0).to_pylist()])
            some = (truth >= 0) & (p.max(1) > p.min(1))
            z = np.log(p[some])  # of temperature 1
            for t in range(len(TEMPERATURES)):
                q = np.exp((z - z.max(1, keepdims=True)) / TEMPERATURES[t])
                q /= q.sum(1, keepdims=True)
                loss = -np.log(np.maximum(q[np.arange(len(q)), truth[some]], 1e-12))
                bins = np.minimum(q.max(1) * 1000, 999).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), t, np.int32)), pa.array(bins), pa.array(np.rint(loss * 1e6).astype(np.int64))], ["t", "p", "loss"])

    kept = rows.where("kept").withColumn("l", F.col("l").cast("string")).select("t", "l")
    got = kept.mapInArrow(handing_back(tell), "t int, p int, loss long").groupBy("t", "p").agg(F.count("*").alias("n"), F.sum("loss").alias("loss")).collect()
    if got:
        t, p, n, loss = np.array(got, np.int64).T
        best = int(np.bincount(t, loss, len(TEMPERATURES)).argmin())
        sizes = np.bincount(p[t == best], n[t == best])
        model.temperature = TEMPERATURES[best]
        model.least = float(np.searchsorted(np.cumsum(sizes), REJECT * sizes.sum(), side="right")) / 1000
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score, rejected for each row of docs.

    lang_pred is `und`, with score 0, for texts that are null or have no letter, and where the model has
    learned no language. rejected: `und`, or less sure than calibration supports. Rows keep their number,
    repeated and null ids too. Very long texts are read whole, in pieces. Other columns, whatever their
    names, are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            p = own.probabilities([(t or "").encode() for t in texts])
            lettered = np.array([bool(own.languages) and bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
            best = p.argmax(1) if len(texts) else np.empty(0, int)
            score = np.where(lettered, p.max(1), 0.0) if len(texts) else np.empty(0)
            names = [own.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            rejected = ~lettered | (score < own.least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
