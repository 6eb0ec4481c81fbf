import base64
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from watchframe.llm import bpe_chunks, fingerprints, language_id, mixing, textops, token_counts, toxicity
from watchframe.llm.queries import tokenizer_file


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_edit_likeness_equals_brute_force(docs, texts, empty):
    for run_rows in (4096, 7):
        got = fingerprints.edit_likeness(docs, run_rows=run_rows).collect()
        order = sorted(range(len(texts)), key=lambda n: (-1 if texts[n][0] is None else texts[n][0], texts[n][1] is not None, texts[n][1] or ""))
        want = []
        for p, n in enumerate(order):
            t, nxt = texts[n][1] or "", texts[order[(p + 1) % len(order)]][1] or ""
            k = len(t) // 4
            edited = t[: len(t) - k] + nxt[:k]
            want.append((str(texts[n][0]), len(t), hashlib.sha256(edited.encode()).hexdigest()))
            row = [r for r in got if (str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) == want[-1]]
            assert row, want[-1]
            a, b = shingles(t), shingles(edited)
            truth = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(row[0]["near_edited"] - truth) < 5 * math.sqrt(0.25 / 256) + 0.02
        assert len(got) == len(texts)
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert fingerprints.edit_likeness(empty).count() == 0
    assert fingerprints.edit_likeness(docs.where("doc_id = 3")).count() == 1


def test_fingerprints_are_unbiased_at_every_width():
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in rng.integers(0, 10**9, 900)]
    a, b = common[:700], common[200:]
    truth = len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))
    for bits in (1, 2, 4, 8):
        x, y = fingerprints.signatures([" ".join(a).encode(), " ".join(b).encode()], bins=2048, bits=bits)
        assert len(x) == 2048 * bits // 8
        assert abs(fingerprints.likeness(x, y, bits) - truth) < 0.08
    one, two, none = fingerprints.signatures([b"a b c d e f", b"A b c d e f", b""])
    assert one == two and none == b"" and fingerprints.likeness(none, none) == 1 and fingerprints.likeness(one, none) == 0


def test_fingerprint_column(docs, texts):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(texts)
    assert all(len(base64.b64decode(r["fingerprint"])) in (0, fingerprints.BINS) for r in rows)


def brute_mix(rows, repeats=3):
    """Queues served by a sequential simulation. rows: (id, source, size); what each row is taken for."""
    total, size = sum(r[2] for r in rows), {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        rest = sum(w for s, w in weight.items() if s not in full)
        level = (total - sum(repeats * size[s] for s in full)) / rest if rest else 0
        more = {s for s in size if s not in full and level * weight[s] > repeats * size[s]}
        if not more:
            break
        full |= more
    target = {s: float(repeats * size[s]) if s in full else level * weight[s] for s in size}
    queues = {s: [] for s in size}
    for n, (i, s, words) in enumerate(rows):
        turn = hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()
        queues[s].append((turn, i is not None, i or 0, words, n))
    uses = []
    for s, q in queues.items():
        clock = 0
        for use in range(repeats):
            for turn, known, i, words, n in sorted(q):
                clock += words
                uses.append((clock / target[s] if target[s] else math.inf, s is None, s or "", use, turn, known, i, words, n))
    taken, served = [0] * len(rows), 0
    for *_, words, n in sorted(uses):
        served += words
        if 2 * served - words <= 2 * total:
            taken[n] += words
    return [(i, words, size[s], round(target[s], 6), taken[n]) for n, (i, s, words) in enumerate(rows)]


AWKWARD = [(1, "a b c", "s1"), (1, "a b c", "s1"), (2, "d e f", "s1"), (2, "g h i", "s2"), (None, "j k l", "s1"), (None, "m n", None), (None, None, None), (4, "", "s3"), (5, "x " * 40, "s2")]


def test_mix_equals_a_sequential_queue(spark, docs, texts, empty):
    schema = "doc_id long, text string, source string"
    for table in (docs, spark.createDataFrame(AWKWARD, schema), spark.createDataFrame(AWKWARD[:1], schema), spark.createDataFrame([(9, None, "s")], schema)):
        rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in table.collect()]
        got = mixing.fair_mix(table).collect()
        want = brute_mix(rows)
        assert sorted(str((*r[:3], round(r["target"], 6), r["taken"])) for r in got) == sorted(map(str, want))
        assert sorted(map(str, got)) == sorted(map(str, mixing.fair_mix(table.repartition(3)).collect()))
        assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in got)
    assert len(mixing.fair_mix(docs).collect()) == len(texts) and mixing.fair_mix(empty).count() == 0


def test_mixed_documents_hold_what_the_mix_takes(spark, docs, empty):
    table = spark.createDataFrame([(*r, *range(n, n + 9)) for n, r in enumerate(AWKWARD)], "doc_id long, text string, source string, target int, total int, taken int, finish int, use int, mix_id int, mix_words int, key int, row int")
    for t in (docs, table):
        taken, got = {}, {}
        for r in mixing.fair_mix(t).where("taken > 0").collect():
            taken.setdefault(r["doc_id"], []).extend([r["size"]] * (r["taken"] // r["size"]))
        rows = mixing.mixed_documents(t)
        assert rows.columns == t.columns and rows.dtypes == t.dtypes
        rows = rows.collect()
        for r in rows:
            got.setdefault(r["doc_id"], []).append(len(r["text"].encode().split()))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in taken.items()}
        assert set(map(str, rows)) <= set(map(str, t.collect()))
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns


def test_bpe_equals_the_library(docs, texts, empty):
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        file = tokenizer_file(name)
        own = Tokenizer.from_file(file)
        rows = bpe_chunks.bpe_digests(docs, file).collect()
        want = []
        for i, t in texts:
            ids = own.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe_chunks.bpe_digests(empty, file).count() == 0


def test_codec_on_awkward_texts():
    import random

    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    own, codec = Tokenizer.from_file(file), bpe_chunks.Codec(open(file, encoding="utf-8").read())
    assert codec.by_fragments
    rng = random.Random(2)
    texts = ["", " ", "<|endoftext|> x<|endoftext|>y <|EndOfText|>", "it's DON'T we'll", "日本語" * 900, "x" * 5000, "H̱ ẖ é É ̈a", "İstanbul ΣΑΣ ǅ ½", "a\x00b\x1cc"]
    texts += ["".join(rng.choice("ab É×÷.,'<|endoftext|>\ń !1２🇩") for _ in range(rng.randint(1, 6000))) for _ in range(40)]
    for t, (ids, decoded) in zip(texts, codec.encode_batch([t.encode() for t in texts]), strict=True):
        want = own.encode(t, add_special_tokens=False).ids
        assert np.array(want, "<u4").tobytes() == ids, t[:80]
        assert own.decode(want, skip_special_tokens=False).encode() == decoded


def test_chunks_follow_the_content():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 123, 60_000).astype(np.uint8))
    a = {data[i:j] for i, j in zip(bpe_chunks.cuts(data), bpe_chunks.cuts(data)[1:], strict=False)}
    moved = b"a few bytes more" + data
    b = {moved[i:j] for i, j in zip(bpe_chunks.cuts(moved), bpe_chunks.cuts(moved)[1:], strict=False)}
    assert len(a & b) >= len(a) - 2 and len(a) > 10


def test_token_counts_add_up(docs, texts, empty):
    import tiktoken

    file = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = token_counts.token_counts(docs, file, public_tokenizers.PATTERN, fields=("source", "text"))
    total, spans = {}, {}
    for r in rows.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        spans.setdefault((r["doc_id"], r["field"]), []).append((r["start_char"], r["end_char"]))
    for i, t in texts:
        if i not in (0, 5, None):
            source = f"s{i % 3}" if i != 7 else ""
            assert total[i] == len(own.encode_ordinary(f"{source}\n\n{t or ''}"))
            assert sum(e - s for s, e in spans[i, "text"]) == len(t or "")
    assert token_counts.token_counts(empty, file, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, file, public_tokenizers.PATTERN, rule="half")


def test_rules_of_tokens_across_borders():
    ends, borders = np.array([3, 7, 10]), np.array([4, 5, 10])  # the second token lies over all three sections
    assert token_counts.attribute(ends, borders, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(ends, borders, "last")[0].tolist() == [1, 0, 2]
    assert token_counts.attribute(ends, borders, "most")[0].tolist() == [1, 0, 2]
    assert token_counts.attribute(ends, borders, "first")[1].tolist() == [1, 0, 0]


def test_toxicity_learns_and_holds_out(spark, docs, texts):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert np.mean(right) > 0.85
    assert np.mean([r["score"] for r in rows if r["toxic"]]) > np.mean([r["score"] for r in rows if not r["toxic"]]) + 0.2
    own = toxicity.score(docs, model).collect()
    assert len(own) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in own)
    assert toxicity.score(docs.where("false"), model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in own)


def test_toxicity_without_usable_labels():
    assert toxicity.train([], []).scores(toxicity._Text([b"a", b""], toxicity.BUCKETS)).tolist() == pytest.approx([0.269, 0.269], abs=0.01)
    assert (toxicity.train([b"x y", b"z"], [1, 1]).scores(toxicity._Text([b"q"], toxicity.BUCKETS)) > 0.5).all()


def test_toxicity_learns_from_every_labelled_row(spark):
    # before, 5,000 rows of least hash were learned from and calibrated on: signs of all other rows were unknown
    ids = spark.range(9_000).where("crc32(cast(id AS string)) % 5 <> 0")
    rank = F.row_number().over(Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id"))
    sign = F.when(rank <= 5_000, "awful").otherwise("zorgle")
    rows = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"), sign.alias("sign"))
    rows = rows.withColumn("text", F.concat(F.lit("a fine day number "), F.col("doc_id") % 50, F.when(F.col("toxic") == 1, F.concat(F.lit(" you "), "sign")).otherwise(F.lit(" in may"))))
    for order in ("doc_id", "toxic"):  # the second is in the order of the labels
        table = spark.createDataFrame(rows.orderBy(order, "doc_id").toPandas()).coalesce(2)
        model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
        assert (model.score_texts([b"a fine day number 3 you zorgle", b"a fine day number 3 you awful"]) >= 0.5).all()
        assert (model.score_texts([b"a fine day number 3 in may", b"a fine day number 8 in may"]) < 0.5).all()
    # thresholds go by all rows kept out
    kept = table.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(toxicity.KEPT_OUT)) == toxicity.KEPT_OUT - 1).collect()
    margins, y = np.round(model.margin_texts([r["text"].encode() for r in kept]) * 1024) / 1024, np.array([r["toxic"] for r in kept])
    assert len(kept) > 1_300 and model.thresholds[0] == toxicity._threshold(margins, np.ones(len(y)), y, 0.0)


def test_toxicity_learns_from_long_texts(spark):
    # before, texts above 100,000 bytes were scored but not learned from
    rows = [(i, "plain words " * 10_000 + ("awful" if i % 2 else "fine"), i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table.select("doc_id", "toxic"))
    assert (model.score_texts([b"awful words", b"fine words"]) >= 0.5).tolist() == [True, False]
    again = toxicity.fit(table, table.select("doc_id", "toxic"))
    assert (again.packed() == model.packed()).all() and (again.thresholds == model.thresholds).all()


def test_toxicity_responses_of_texts_in_pieces(monkeypatch):
    texts = [b" ".join(b"word%d tail" % (n * n % 97) for n in range(40)).translate(bytes.maketrans(b"0123456789", b"abcdefghij")), b"", b"eight nine"]
    model = toxicity.Model()
    whole = model.responses(texts)
    assert (whole[0] == model.pooled(toxicity._Text(texts, toxicity.BUCKETS))[0]).all()
    monkeypatch.setattr(textops, "SLICE_BYTES", 64)
    best, found, words = model.responses(texts)
    f, used = toxicity.FILTERS, whole[1]
    assert np.allclose(best, whole[0], atol=1e-5) and (found == used).all()
    for j, width in enumerate(toxicity.WIDTHS):
        mine = np.zeros_like(used)
        mine[:, j * f : (j + 1) * f] = used[:, j * f : (j + 1) * f]
        assert (words[mine][:, :width] == whole[2][mine][:, :width]).all()


def test_language_id(spark, docs, texts, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(table)
    rows = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    own = {n: r for n, r in enumerate(language_id.predict(docs.coalesce(1), model).collect())}
    assert len(own) == len(texts) and {r["lang_pred"] for r in own.values()} <= {"und", "de", "en", "es", "fr"}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "日本")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und" and got[1]["rejected"]
    assert language_id.predict(empty, model).count() == 0
    assert language_id.predict(odd, language_id.train([], [])).where("lang_pred <> 'und'").count() == 0


def test_fits_read_bounded_rows_of_repeated_ids(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"text {n} of {i}", "en") for i in (1, 2, 3) for n in range(30)] + [(4, "x" * 200_000, "de")], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, **_: seen.append(texts))
    monkeypatch.setattr(language_id, "train", lambda texts, labels, **_: seen.append(texts))
    toxicity.fit(table, spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int"), most=8, lang_col=None)
    language_id.fit(table, most=8)
    assert len(seen) == 2 and all(len(t) == 8 and max(map(len, t)) < 100 for t in seen)
