"""Operators without SQL against slow scalar versions of what they compute."""

import base64
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from watchframe.llm import fingerprints, language_id, textops, token_counts, toxicity
from watchframe.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
M = 2**64


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def mix(x):
    """The finaliser, on whole numbers."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 % M
    return x ^ (x >> 33)


def word_hash(word):
    """Sum of the bytes' table values by powers of the base, from the word's first byte on."""
    return mix(sum(int(textops._TABLE[b]) * pow(textops._P, i, M) for i, b in enumerate(word)) % M)


def lower(data):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def shingle_hashes(text):
    words = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", lower(text.encode()))]
    if len(words) >= 5:
        return {mix(sum(h * p for h, p in zip(words[i : i + 5], textops._PLACES, strict=True)) % M) for i in range(len(words) - 4)}
    if not words:
        return set()
    short = len(words)
    for h, p in zip(words, textops._PLACES, strict=False):
        short = (short ^ h) * p % M
    return {mix(short)}


def slow_fingerprint(text):
    """One-permutation MinHash with optimal densification, bin by bin."""
    hashes = shingle_hashes(text)
    if not hashes:
        return b""
    least = {}
    for h in hashes:
        b, low = h >> 56, h & (2**56 - 1)
        least[b] = min(low, least.get(b, low))
    out = []
    for b in range(256):
        source = b
        if b not in least:
            for turn in range(1, 65):
                source = mix((b * 0x9E3779B97F4A7C15 + turn * 0xD6E8FEB86659FD93) % M) % 256
                if source in least:
                    break
            else:
                source = min((x for x in least if x >= b), default=min(least))
        out.append(mix(least[source]) & 255)
    return bytes(out)


def slow_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_and_next_likeness(spark, docs, texts):
    order = sorted(range(len(texts)), key=lambda n: (-1 if texts[n][0] is None else texts[n][0], texts[n][1] is not None, texts[n][1] or ""))
    own = {n: slow_fingerprint(texts[n][1] or "") for n in order}
    want = []
    for p, n in enumerate(order):
        nxt = order[(p + 1) % len(order)]
        text, after = texts[n][1] or "", texts[nxt][1] or ""
        k = len(text) // 4
        edited = slow_fingerprint(text[: len(text) - k] + after[:k])
        want.append((str(texts[n][0]), base64.b64encode(own[n]).decode(), base64.b64encode(edited).decode(), round(slow_likeness(own[n], edited), 9), round(slow_likeness(own[n], own[nxt]), 9)))
    for run_rows in (4096, 7):
        got = fingerprints.edit_likeness(docs, run_rows=run_rows).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)


def letter_words(data):
    return re.findall(rb"[a-z\x80-\xff]+", lower(data))


def slow_margin(model, data):
    """The convolutional score of one text, window by window."""
    n = len(model.emb) - 1
    vectors = []
    for w in letter_words(data):
        ids = [word_hash(w) % n] + [mix_prefix(w, p) % n for p in toxicity.PREFIXES if len(w) >= p]
        vectors.append(sum(model.emb[i].astype(float) for i in ids))
    best = []
    for conv in model.conv:
        for c in range(conv.shape[2]):
            sums = [sum(float(vectors[i + j] @ conv[j][:, c]) for j in range(len(conv))) for i in range(len(vectors) - len(conv) + 1)]
            bias = float(model.bias[len(best)])
            best.append(max(max(sums) + bias, 0.0) if sums else 0.0)
    return float(np.dot(best, model.out) + model.shift)


def mix_prefix(word, p):
    return mix((sum(int(textops._TABLE[b]) * pow(textops._P, i, M) for i, b in enumerate(word[:p])) + p) % M)


def slow_language(model, data):
    """Mean weights of all letter n-grams inside words and of all words, through the softmax."""
    n, features = len(model.table), []
    for w in letter_words(data):
        for k in language_id.GRAMS:
            features += [mix((sum(w[i + j] << (8 * j) for j in range(k)) + k) % M) % n for i in range(len(w) - k + 1)]
        features.append(word_hash(w) % n)
    if not features:
        return np.full(len(model.languages), 1 / len(model.languages))
    z = (np.sum([model.table[f].astype(float) for f in features], 0) / len(features) + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_toxicity_scores_equal_a_slow_version(spark, table):
    model = toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    for i in sorted(rows)[::4]:
        data = rows[i].encode()
        p = slow_language(model.languages, data)
        sure = p.max() >= model.languages.least and p.max() > p.min()
        group = int(p.argmax()) if sure else len(p)
        want = 1 / (1 + np.exp(-np.clip(slow_margin(model, data) - model.thresholds[group], -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-3)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_languages_equal_a_slow_version(spark, table):
    model = language_id.fit(table)
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in language_id.predict(table, model).collect():
        text = rows[r["doc_id"]]
        if text is None or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        p = slow_language(model, text.encode())
        assert r["score"] == pytest.approx(p.max(), abs=1e-4)
        assert r["lang_pred"] == model.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4
        assert r["rejected"] == (r["score"] < model.least)


def test_language_counts_of_all_rows(spark, table):
    long = spark.createDataFrame([(1, "un deux trois " * 9_000, "fr")], "doc_id long, text string, lang string")
    model = language_id.fit_counts(table.select("doc_id", "text", "lang").union(long))
    rows = [r for r in [*table.collect(), *long.collect()] if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    kept = {r["i"] for r in table.select("doc_id").union(long.select("doc_id")).selectExpr("doc_id AS i", "pmod(xxhash64(cast(doc_id AS string)), 10) = 0 AS k").where("k").collect()}
    want = {x: np.full(language_id.BUCKETS, 0.5) for x in model.languages}
    for r in rows:
        times = Counter(letter_words((r["text"] or "").encode())) if r["doc_id"] not in kept else {}
        for w, n in times.items():
            for k in language_id.GRAMS:
                for i in range(len(w) - k + 1):
                    want[r["lang"]][mix((sum(w[i + j] << (8 * j) for j in range(k)) + k) % M) % language_id.BUCKETS] += n
            want[r["lang"]][word_hash(w) % language_id.BUCKETS] += n
    assert model.languages == sorted({r["lang"] for r in rows})
    for i, x in enumerate(model.languages):
        assert np.allclose(model.table[:, i], np.log(want[x] / want[x].sum()), atol=1e-5)
    assert language_id.fit_counts(table.where("false")).languages == []


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_brute_force(spark, table, docs, rule):
    import tiktoken

    file = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for source in (docs, table.limit(40)):
        want = []
        for r in source.collect():
            fields = [r["source"] or "", r["text"] or ""]
            sections, at = [], 0
            for name, field in zip(("source", "text"), fields, strict=True):
                parts = re.findall(r"[^\n]*\n|[^\n]+$", field) or [""]
                chars = 0
                for n, part in enumerate(parts):
                    start, at = at, at + len(part.encode())
                    sections.append([name, n, chars, chars + len(part), start, at, 0, 0])
                    chars += len(part)
                if name == "source":
                    at += 2
                    sections[-1][5] = at
            byte = 0
            for t in own.encode_ordinary("\n\n".join(fields)):
                low, byte = byte, byte + len(own.decode_single_token_bytes(t))
                share = [max(0, min(byte, s[5]) - max(low, s[4])) for s in sections]
                met = [k for k, x in enumerate(share) if x]
                k = {"first": met[0], "last": met[-1], "most": max(met, key=lambda k: (share[k], -k))}[rule]
                sections[k][6] += 1
                sections[k][7] += len(met) > 1
            want += [(str(r["doc_id"]), *s[:4], *s[6:]) for s in sections]
        got = token_counts.token_counts(source, file, public_tokenizers.PATTERN, fields=("source", "text"), rule=rule).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_long_texts_in_pieces_are_whole(monkeypatch):
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 12)).astype(np.uint8)) for _ in range(4000)]
    texts = [b" ".join(words), b"  " + b"-".join(words[:900]) + b"\n", b"x" * 9000, b"short one", b"", "é ".encode() * 3000]
    whole = list(textops.shingle_sets(texts))
    model = language_id.train([b"the cat and the dog", "le chat et les chiens".encode()] * 20, ["en", "fr"] * 20)
    toxic = toxicity.train([b"you are awful awful", b"a fine day in may"] * 30, [1, 0] * 30, languages=model)
    languages, scores = model.probabilities(texts), toxic.score_texts(texts)
    for most in (64, 1000):
        monkeypatch.setattr(textops, "SLICE_BYTES", most)
        assert all((a == b).all() for a, b in zip(whole, textops.shingle_sets(texts), strict=True))
        assert np.allclose(languages, model.probabilities(texts), atol=1e-6)
        assert np.allclose(scores, toxic.score_texts(texts), atol=1e-5)
        assert b"".join(textops.pieces(texts[0], textops.gaps(False))) == texts[0]


def test_clashing_columns_and_empty_tables(spark, docs, empty, texts):
    names = ["fingerprint", "score", "held_out", "predicted", "lang_pred", "text64", "run", "ahead"]
    clash = docs.selectExpr("*", *[f"k AS {n}" for n in names])
    model = language_id.train([b"one two", b"un deux"] * 10, ["en", "fr"] * 10)
    toxic = toxicity.train([b"bad", b"good"] * 10, [1, 0] * 10)
    assert fingerprints.edit_likeness(clash).count() == toxicity.score(clash, toxic).count() == language_id.predict(clash, model).count() == len(texts)
    kept = toxicity.drop_toxic(clash, toxic)
    assert kept.columns == clash.columns
    assert fingerprints.edit_likeness(empty).count() == toxicity.score(empty, toxic).count() == toxicity.drop_toxic(empty, toxic).count() == 0
