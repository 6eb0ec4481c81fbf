"""Toxicity scores of a convolutional text classifier, trained on all labelled rows by Spark's tasks.

A word's vector is the sum of hashed embeddings of the whole word and of its first 3 to 8 bytes, so
inflections of an unseen stem still count. Filters of several widths run over the words, each filter
keeps its largest response over the text, and a logistic layer reads these. Each language gets its own
threshold, calibrated on labelled rows kept out of training and shifted to score 0.5. The language is what
the language model (language_id) finds in the text alone; texts that it rejects, and languages with few
labelled rows, have the threshold of all rows.

Training, calibration and scoring read every row's whole text. Training goes over all rows in rounds: each
partition learns from the round's common weights, then its changes are averaged, a feature's over the
rows of those partitions that met it. Because the response of a filter is a sum over words, each distinct
word's responses are looked up once per batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language_id
from .storage import handing_back, small_batches
from .textops import Words, in_pieces, slices

BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Fewest and most rounds over all labelled rows; between them, so many that ROUND_ROWS texts are learned from.
ROUNDS = (3, 8)
ROUND_ROWS = 12_000
#: Labelled rows that a partition has for its share of a round; smaller partitions are put together.
SHARD_ROWS = 4_000
#: Rows of a mini-batch; rows and bytes that are put in random order at once.
BATCH = 32
BUFFER_ROWS, BUFFER_BYTES = 2_000, 8 << 20
#: Labels are mixed by a shuffle if this share of their variance lies between blocks of BUFFER_ROWS rows.
IN_ORDER = 0.1
#: A partition's changes are added up as whole numbers of 1/UNIT, in so many chunks.
UNIT = 1 << 16
CHUNKS = 16
#: Steps in which margins are counted for calibration.
MARGIN_STEPS = 1024
#: Most bytes of a text in a training sample (`most` of fit).
TRAIN_BYTES = 100_000
#: Of so many labelled rows one is kept out of training to calibrate thresholds.
KEPT_OUT = 5
#: Least rows, and least toxic ones, of a language that give it a threshold of its own.
LEAST_ROWS, LEAST_TOXIC = 50, 10


class _Text:
    """Word features of some texts: ids of features for each distinct word, words and bounds of each text."""

    def __init__(self, texts: list[bytes], buckets: int):
        self.texts = texts
        w = Words(texts, letters_only=True)
        self.first = w.first
        distinct, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.hash = distinct
        w.start, w.end = w.start[at], w.end[at]
        n = np.uint64(buckets)
        features = [(distinct % n).astype(np.int64)]
        for p in PREFIXES:
            h = w.prefix_hash(p)
            features.append(np.where(h != 0, (h % n).astype(np.int64), buckets))
        self.features = np.stack(features, 1)  # the row `buckets` of the embeddings stays 0

    def below(self, where: np.ndarray) -> np.ndarray:
        """Features of the words from each place on, as many as the widest filter reads."""
        if not len(self.word):
            return np.zeros((*where.shape, max(WIDTHS), self.features.shape[1]), np.int64)
        at = np.maximum(where, 0)[..., None] + np.arange(max(WIDTHS))
        return self.features[self.word[np.minimum(at, len(self.word) - 1)]]


def _in_rows(arrays: list[np.ndarray], width: int) -> np.ndarray:
    """The numbers of some arrays one after the other, in rows that zeros fill up."""
    flat = np.concatenate([np.ravel(a) for a in arrays])
    return np.append(flat, np.zeros(-len(flat) % width)).reshape(-1, width).astype(np.float32)


class Model:
    """Embeddings, filters, logistic layer, the language model, and a threshold for each language and the rest."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, filters: int = FILTERS, seed: int = 1, languages: language_id.Model | None = None):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (buckets + 1, dim)).astype(np.float32)
        self.emb[-1] = 0
        self.conv = [rng.normal(0, 0.3, (width, dim, filters)).astype(np.float32) for width in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * filters, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * filters).astype(np.float32)
        self.shift = np.float32(0)
        self.languages = languages
        self.thresholds = np.zeros(len(languages.languages) + 1 if languages else 1)

    def pooled(self, t: _Text, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter over each text (at least 0) and the word where it starts, or -1."""
        docs, n, k = len(t.first) - 1, len(t.word), self.conv[0].shape[2]
        best = np.zeros((docs, len(WIDTHS) * k), np.float32)
        where = np.full((docs, len(WIDTHS) * k), -1) if places else None
        if not n:
            return best, where
        vectors = self.emb[t.features].sum(1)
        counts = np.diff(t.first)
        for j, f in enumerate(self.conv):
            # the last words of a text start no window of this width
            late = np.concatenate([t.first[1:] - 1 - i for i in range(len(f) - 1)]) if len(f) > 1 else np.empty(0, int)
            late = late[late >= 0]
            tables = [np.ascontiguousarray((vectors @ f[i]).T) for i in range(len(f))]
            r = np.empty(n + 1, np.float32)
            for c in range(k):
                np.take(tables[0][c], t.word, out=r[:n])
                for i in range(1, min(len(f), n)):
                    r[: n - i] += tables[i][c][t.word[i:]]
                r[late] = r[n] = -np.inf
                top = np.maximum.reduceat(r, t.first[:-1])
                top[counts == 0] = -np.inf
                value = top + self.bias[j * k + c]
                best[:, j * k + c] = np.maximum(value, 0)
                if places:
                    found = np.flatnonzero(r[:n] == np.repeat(top, counts))
                    at = found[np.minimum(np.searchsorted(found, t.first[:-1]), max(len(found) - 1, 0))] if len(found) else np.zeros(docs, int)
                    where[:, j * k + c] = np.where(value > 0, at, -1)
        return best, where

    def margins(self, t: _Text) -> np.ndarray:
        return self.pooled(t)[0] @ self.out + self.shift

    def groups(self, texts: list[bytes]) -> np.ndarray:
        """Number of each text's language; the last number where it is not sure, and without a language model."""
        if not self.languages or not texts:
            return np.zeros(len(texts), int)
        p = self.languages.probabilities(texts)
        sure = (p.max(1) >= self.languages.least) & (p.max(1) > p.min(1))
        return np.where(sure, p.argmax(1), len(self.languages.languages))

    def scores(self, t: _Text) -> np.ndarray:
        """0 to 1; 0.5 at the language's threshold."""
        return self._sigmoid(self.margins(t), t.texts)

    def margin_texts(self, texts: list[bytes]) -> np.ndarray:
        """margins of texts of any length: very long ones are read in pieces that share a filter's width of words."""
        out = []
        for i, j in slices(texts) if texts else ():
            parts, first = in_pieces(texts[i:j], letters_only=True, overlap=max(WIDTHS) - 1)
            best = np.concatenate([self.pooled(_Text(parts[a:b], len(self.emb) - 1))[0] for a, b in slices(parts)])
            out.append(np.maximum.reduceat(best, first) @ self.out + self.shift)
        return np.concatenate(out) if out else np.empty(0)

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        """scores of texts of any length."""
        return self._sigmoid(self.margin_texts(texts), texts).astype(float)

    def responses(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter over each text of any length, whether there is one, and the features below it."""
        parts, first = in_pieces(texts, letters_only=True, overlap=max(WIDTHS) - 1)
        got = []
        for a, b in slices(parts):
            t = _Text(parts[a:b], len(self.emb) - 1)
            best, where = self.pooled(t, places=True)
            got.append((best, where >= 0, t.below(where)))
        best, found, words = (np.concatenate(x) for x in zip(*got, strict=True))
        if len(parts) == len(texts):
            return best, found, words
        # of a text in pieces, each filter has the piece with its largest response
        top = np.stack([a + best[a:b].argmax(0) for a, b in zip(first, [*first[1:], len(parts)], strict=True)])
        f = np.arange(best.shape[1])
        return best[top, f], found[top, f], words[top, f]

    def packed(self) -> np.ndarray:
        """All weights as rows of DIM numbers, the embeddings first."""
        return np.concatenate([self.emb, _in_rows([*self.conv, self.bias, self.out, self.shift], self.emb.shape[1])])

    def load(self, packed: np.ndarray) -> None:
        """Takes over what packed() has told."""
        self.emb = packed[: len(self.emb)].astype(np.float32)
        dense, at = packed[len(self.emb) :].ravel().astype(np.float32), 0
        for own in (*self.conv, self.bias, self.out):
            own[...] = dense[at : at + own.size].reshape(own.shape)
            at += own.size
        self.shift = dense[at]

    def calibrate(self, groups: np.ndarray, margins: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> None:
        """Thresholds from the number of rows, and of toxic ones, of each language's margins."""
        place, at = np.unique(margins, return_inverse=True)
        overall = _threshold(place, np.bincount(at, rows), np.bincount(at, toxic), 0.0)
        for c in range(len(self.thresholds)):
            own = (groups == c) & (c < len(self.thresholds) - 1)
            n, hits = rows[own].sum(), toxic[own].sum()
            few = n < LEAST_ROWS or hits < LEAST_TOXIC or hits == n
            self.thresholds[c] = overall if few else _threshold(margins[own], rows[own], toxic[own], overall)

    def _sigmoid(self, margins: np.ndarray, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins - self.thresholds[self.groups(texts)], -30, 30)))


class _Optimiser:
    """Adam over mini-batches; gradients reach only the words where a filter's largest response stands."""

    def __init__(self, model: Model, rng: np.random.Generator, decay: float = 2e-4):
        self.model, self.rng, self.decay, self.steps = model, rng, decay, 0
        self.get = {"emb": model.emb, "bias": model.bias, "out": model.out, "shift": np.array([model.shift]), **{f"conv{j}": f for j, f in enumerate(model.conv)}}
        self.one, self.two = ({n: np.zeros_like(x) for n, x in self.get.items()} for _ in range(2))

    def step(self, best: np.ndarray, found: np.ndarray, words: np.ndarray, target: np.ndarray, weight: np.ndarray, lr: float) -> None:
        """One step on the texts' largest responses, where there are any, and the features of the words below them."""
        model, get, buckets, k = self.model, self.get, len(self.model.emb) - 1, self.model.conv[0].shape[2]
        self.steps += 1
        keep = (self.rng.random(best.shape) > 0.2) / np.float32(0.8)
        z = (best * keep) @ model.out + get["shift"][0]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / len(target)
        grads = {n: np.zeros_like(x) for n, x in get.items() if n != "emb"}
        grads["out"] = (best * keep).T @ g + self.decay * model.out
        grads["shift"][0] = g.sum()
        back = g[:, None] * model.out[None, :] * keep
        d, f = np.nonzero(found)
        pull, words = back[d, f], words[d, f]
        grads["bias"] += np.bincount(f, pull, len(model.bias)).astype(np.float32)
        rows, deltas = [], []
        for j, conv in enumerate(model.conv):
            mine = (f >= j * k) & (f < (j + 1) * k)
            fj, pj, wj = f[mine] - j * k, pull[mine], words[mine]
            of_filter = (np.arange(k)[:, None] == fj) * pj.astype(np.float32)
            for i in range(len(conv)):
                features = wj[:, i]
                grads[f"conv{j}"][i] = (of_filter @ model.emb[features].sum(1)).T
                rows.append(features.ravel())
                deltas.append(np.repeat(pj[:, None] * conv[i].T[fj], features.shape[1], 0))
            grads[f"conv{j}"] += self.decay * conv
        rows, deltas = np.concatenate(rows), np.concatenate(deltas)
        c1, c2 = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for n, g_ in grads.items():
            self.one[n] = 0.9 * self.one[n] + 0.1 * g_
            self.two[n] = 0.999 * self.two[n] + 0.001 * g_**2
            get[n] -= (lr * (self.one[n] / c1) / (np.sqrt(self.two[n] / c2) + 1e-8)).astype(np.float32)
        # embeddings: adaptive steps for the touched rows only
        touched, inverse = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(inverse, own, len(touched)) for own in deltas.T], 1).astype(np.float32)
        total, touched = total[touched < buckets], touched[touched < buckets]
        self.two["emb"][touched] += total**2
        model.emb[touched] -= 3 * lr * total / (np.sqrt(self.two["emb"][touched]) + 1e-6)
        model.shift = np.float32(get["shift"][0])


def _weights(y: np.ndarray, mean: float) -> np.ndarray:
    """Of rows with these labels where `mean` of all are toxic."""
    # words that hardly vary between the labels crowd out the rare signs: no weighting, but a balanced start
    return np.where(y > 0, 0.5 / mean, 0.5 / (1 - mean)) ** 0.5


def _one_sided(model: Model, toxic: bool) -> Model:
    """Of no rows, or of one label only: every text on that label's side of 0.5."""
    model.out[:] = 0
    model.shift = np.float32(2 * toxic - 1)
    return model


def train(texts: list[bytes], labels: list[int], buckets: int = BUCKETS, epochs: int = 8, rate: float = 0.01, decay: float = 2e-4, seed: int = 1, languages: language_id.Model | None = None) -> Model:
    """Model of texts in memory.

    Every KEPT_OUT-th row, if both parts then hold both labels, only calibrates the thresholds.

    With no rows, or one label only, the model scores every text on that label's side of 0.5.
    """
    model = Model(buckets, seed=seed, languages=languages)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return _one_sided(model, len(y) > 0 and y.max() > 0)
    out = np.arange(len(y)) % KEPT_OUT == KEPT_OUT - 1
    if min(y[out].sum(), (1 - y[out]).sum(), y[~out].sum(), (1 - y[~out]).sum()) < 1 or y[out].sum() < LEAST_TOXIC:
        out[:] = False  # too few rows to keep any out
    kept = [texts[i] for i in np.flatnonzero(out)], y[out]
    texts, y = [texts[i] for i in np.flatnonzero(~out)], y[~out]
    rng = np.random.default_rng(seed)
    size = max(8, min(64, len(texts) // 40))
    model.shift = np.float32(np.log(y.mean() / (1 - y.mean())))
    order = np.arange(len(texts))
    parts = [order[i : i + size] for i in range(0, len(order), size)]
    rng.shuffle(order)
    ready = [(_Text([texts[i] for i in p], buckets), y[p], _weights(y[p], y.mean())) for p in parts]
    optimiser = _Optimiser(model, rng, decay)
    for epoch in range(epochs):
        for b in rng.permutation(len(ready)):
            t, target, weight = ready[b]
            best, where = model.pooled(t, places=True)
            optimiser.step(best, where >= 0, t.below(where), target, weight, rate * (1 - epoch / epochs))
    own_texts, target = kept if len(kept[1]) else (texts, y)
    margins = np.concatenate([model.margins(_Text(own_texts[i : i + 256], buckets)) for i in range(0, len(own_texts), 256)])
    model.calibrate(model.groups(own_texts), margins, np.ones(len(target)), target)
    return model


def _buffers(rows: Iterable) -> Iterator[list]:
    """Rows (text, label) in lists of at most BUFFER_ROWS, which end once they hold BUFFER_BYTES."""
    own, size = [], 0
    for r in rows:
        own.append((r[0].encode(), r[1]))
        size += len(own[-1][0])
        if len(own) == BUFFER_ROWS or size >= BUFFER_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def _round(number: int, rows: Iterable, start: np.ndarray, mean: float, size: int, lr: float) -> Iterator[tuple[int, np.ndarray]]:
    """One partition's pass from the common weights: (chunk, what its rows change and how many they are).

    A feature that the partition never touched has no part in its change. Whole numbers add up to the same
    sums in any order.
    """
    model = Model()
    model.load(start)
    rng = np.random.default_rng([number, int(lr * 1e6)])
    optimiser, n = _Optimiser(model, rng), 0
    for buffer in _buffers(rows):
        order = rng.permutation(len(buffer))
        for part in np.array_split(order, -(-len(order) // size)):
            y = np.array([buffer[i][1] for i in part], np.float32)
            optimiser.step(*model.responses([buffer[i][0] for i in part]), y, _weights(y, mean), lr)
        n += len(buffer)
    if n:
        change = np.rint((model.packed().astype(float) - start) * UNIT).astype(np.int64) * n
        change = np.column_stack([change, n * change.any(1)])
        yield from enumerate(np.array_split(change, CHUNKS))


def _threshold(margins: np.ndarray, rows: np.ndarray, toxic: np.ndarray, usual: float) -> float:
    """Middle of the cut with the best F1 over so many rows and toxic ones of each margin; the one nearest to `usual` of equally good ones."""
    order = np.argsort(-margins)
    m, hits = margins[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + toxic.sum())
    cut = np.append((m[1:] + m[:-1]) / 2, m[-1] - 1)
    f1[:-1][m[1:] == m[:-1]] = -1  # equal margins are not cut apart
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(cut[good[np.argmin(np.abs(cut[good] - usual))]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int | None = None, most_bytes: int = TRAIN_BYTES, lang_col: str | None = "lang") -> Model:
    """Model from all labelled rows whose crc32(id as text) mod 5 is not 0, their texts whole.

    Every pass is a job over the rows where they lie: partitions learn from the common weights, and Spark adds up
    what they changed. Where docs have lang_col, the language model that thresholds go by counts all rows of a
    known language first. An id with several labels counts as toxic if one of them says so.

    With `most`, the model is one of a sample instead: at most so many rows of least hash and of at most
    `most_bytes` bytes, trained on the driver.
    """
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("string")
    toxic = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(key) % 5 != 0)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    own = docs.where(F.crc32(key) % 5 != 0).select(F.col(id_col).alias("id"), text.alias("t"))
    has_languages = lang_col in docs.columns
    if most is not None:
        languages = language_id.fit(docs, id_col, text_col, lang_col) if has_languages else None
        return _fit_sample(own, toxic, most, most_bytes, languages)
    languages = language_id.fit_counts(docs, id_col, text_col, lang_col) if has_languages else None
    hashed = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(KEPT_OUT))
    # by sorted keys at any size, so that the rows' order does not hang on how the table lies in files
    rows = own.join(toxic.hint("merge"), own["id"] == toxic["i"]).select("i", "t", "y", (hashed == KEPT_OUT - 1).alias("kept"))
    blocks = rows.groupBy("kept", F.floor(F.monotonically_increasing_id() / BUFFER_ROWS)).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    found = {r[0]: r[1:] for r in blocks.groupBy("kept").agg(F.sum("n"), F.sum("y"), F.sum(F.col("y") * F.col("y") / F.col("n"))).collect()}
    (n, hits, squares), (n_kept, hits_kept, _) = found.get(False, (0, 0, 0)), found.get(True, (0, 0, 0))
    model = Model(languages=languages)
    if hits + hits_kept in (0, n + n_kept):
        return _one_sided(model, hits + hits_kept > 0)
    # share of the labels' variance that lies between blocks of rows: 1 if the table is in the order of its labels
    in_order = n > BUFFER_ROWS and squares - hits * hits / n > IN_ORDER * hits * (1 - hits / n)
    few = min(hits_kept, n_kept - hits_kept, hits, n - hits) < 1 or hits_kept < LEAST_TOXIC
    if few:  # too few rows to keep any out
        n, hits = n + n_kept, hits + hits_kept
    # one RDD for all rounds: where rows and labels meet by a shuffle, it is made once
    shards, cores = max(1, n // SHARD_ROWS), docs.sparkSession.sparkContext.defaultParallelism
    if in_order or shards < cores:  # mixed by a hash; otherwise only so where they are few
        rows = rows.repartition(shards).sortWithinPartitions(F.xxhash64(F.col("i").cast("string")), "i", "t")
    own = rows.select("t", "y", "kept").rdd
    own = own.coalesce(min(shards, own.getNumPartitions()))
    steps = _learn(model, own if few else own.filter(lambda r: not r[2]), n, hits / n)
    steps.append(_calibrate(model, own if few else own.filter(lambda r: r[2])))
    for step in steps:  # nothing reads the shuffled texts and changes again
        step._jrdd.rdd().cleanShuffleDependencies(True)
    return model


def _fit_sample(own: DataFrame, toxic: DataFrame, most: int, most_bytes: int, languages: language_id.Model | None) -> Model:
    # ids first, so that only the chosen rows' texts are read into the sample; then rows, as ids may repeat
    chosen = F.broadcast(toxic.orderBy(F.xxhash64(F.col("i").cast("string")), "i").limit(most))
    got = own.where(F.octet_length("t") <= most_bytes)
    got = got.join(chosen, got["id"] == chosen["i"]).orderBy(F.xxhash64(F.col("i").cast("string")), "i", F.xxhash64("t")).limit(most).select("i", "t", "y").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return train([r["t"].encode() for r in got], [int(r["y"]) for r in got], languages=languages)


def _learn(model: Model, rows: RDD, n: int, mean: float, rate: float = 0.01) -> list[RDD]:
    """Trains model on every one of the n rows (text, label) in rounds over all of them, and tells the jobs' last steps."""
    model.shift = np.float32(np.log(mean / (1 - mean)))
    rounds, size = min(max(-(-ROUND_ROWS // n), ROUNDS[0]), ROUNDS[1]), max(8, min(BATCH, n // 40))
    steps = []
    for r in range(rounds):
        state = model.packed()
        shared, lr = rows.context.broadcast(state), rate * (1 - r / rounds)

        def run(number: int, part: Iterator, shared: Broadcast = shared, lr: float = lr) -> Iterator[tuple[int, np.ndarray]]:
            return handing_back(lambda rows: _round(number, rows, shared.value, mean, size, lr))(part)

        steps.append(rows.mapPartitionsWithIndex(run).reduceByKey(np.add, CHUNKS))
        sums = np.concatenate([c for _, c in sorted(steps[-1].collect(), key=lambda x: x[0])])
        model.load(state + sums[:, :-1] / np.maximum(sums[:, -1:], 1) / UNIT)
        shared.destroy()
    return steps


def _calibrate(model: Model, rows: RDD) -> RDD:
    """Thresholds from all rows (text, label): rows and toxic ones of each language and margin, in steps of 1/MARGIN_STEPS."""
    shared = rows.context.broadcast(model)  # a fixed number of weights

    def run(part: Iterator) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for buffer in _buffers(part):
            texts = [t for t, _ in buffer]
            step = np.rint(np.clip(shared.value.margin_texts(texts), -30, 30) * MARGIN_STEPS).astype(int).tolist()
            for g, m, (_, y) in zip(shared.value.groups(texts).tolist(), step, buffer, strict=True):
                yield (g, m), np.array([1, y])

    counted = rows.mapPartitions(handing_back(run)).reduceByKey(np.add, CHUNKS)
    g, m, n, y = np.array([(*k, *v) for k, v in counted.collect()], np.int64).T
    model.calibrate(g, m / MARGIN_STEPS, n, y)
    return counted


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs.

    Null texts count as empty; empty texts have a score too. Very long texts are read whole, in pieces. Rows
    keep their number, repeated and null ids too; other columns, whatever their names, are not read; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            s = own.score_texts([(x.as_py() or "").encode() for x in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(handing_back(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns, whatever their names; null texts count as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(at).cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(own.score_texts(texts) < 0.5)) if texts else batch

    return docs.mapInArrow(handing_back(run), docs.schema)
