import hashlib
from collections import defaultdict

import numpy as np
import pytest

from watchframe.llm import exact_dedup, ngram_join, skew
from watchframe.llm.components import connected_components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def test_exact_groups_equal_brute_force(docs, texts, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t in texts:
        groups[lower(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        want += [(i, keep, len(ids), n == first, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_chunks_make_up_the_text(docs, texts):
    from pyspark.sql import functions as F

    rows = docs.where("text is not null").select("text", F.array_join(exact_dedup.chunks(F.col("text"), 16, 64), "").alias("again"), exact_dedup.chunks(F.col("text"), 16, 64).alias("c")).collect()
    assert all(r["text"] == r["again"] for r in rows)
    assert all(len(x) <= 64 for r in rows for x in r["c"])


def test_colliding_hashes_do_not_join_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(1, "s1", 0, 3, "abc"), (2, "s2", 0, 3, "abd"), (3, "s3", 0, 3, "abc")], "id long, text_sha256 string, digest long, bytes int, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {r["id"]: r["recipe"] for r in exact_dedup._recipes(texts, 256, 4096).collect()}
    assert got[1] == got[3] != got[2]


def test_drop_exact_copies_keeps_rows_whole(docs, texts):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({lower(t) for _, t in texts})


def test_copies_with_hot_groups_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rows = [(i, "Same Text" if i and i % 3 else None, n, n, n, n) for n, i in enumerate([*range(40), 7, 7, None, None])]
    table = spark.createDataFrame([*rows, (99, "alone", 0, 0, 0, 0)], "doc_id long, text string, row_sha int, row_turn int, id int, row int")
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(table).collect()}
    same, none = sum(t is not None for _, t, *_ in rows), sum(t is None for _, t, *_ in rows)
    for i, t, *_ in rows:
        assert got[i, hashlib.sha256((t or "").lower().encode()).hexdigest()] == ((38, same) if t else (39, none))
    kept = exact_dedup.drop_exact_copies(table)
    assert kept.columns == table.columns and sorted(map(tuple, kept.collect())) == [tuple(rows[38]), tuple(rows[39]), (99, "alone", 0, 0, 0, 0)]


def test_copies_with_maps_inside_other_types(spark):
    schema = "doc_id long, text string, s struct<a:int,m:map<string,int>>, m map<string,int>, l array<struct<m:map<string,int>>>"
    rows = [(1, "T", (2, {"k": 1}), {"z": 1}, []), (1, "t", (1, {"k": 2}), {"z": 2}, [({"q": 1},)]), (1, "t", (1, {"k": 3}), {"z": 3}, None), (2, "u", None, None, None)]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, schema))
    assert kept.count() == 2 and kept.columns == ["doc_id", "text", "s", "m", "l"]
    # a row is returned whole, its parts are never mixed
    first = kept.where("doc_id = 1").first()
    assert any(first["s"]["m"] == r[2][1] and first["m"] == r[3] for r in rows[:3])


def test_a_hot_text_without_ids_is_spread(spark, monkeypatch):
    """A third of all rows have no id and one text: they are combined where they are read."""
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    rows = [(None if n % 3 == 0 else n, "hot text" if n % 3 == 0 else f"own text {n}", n) for n in range(6_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(8)
    kept = exact_dedup.drop_exact_copies(table)
    assert kept.count() == 4_001 and kept.where("doc_id IS NULL").select("n").collect() == [(0,)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_split_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    rows = spark.createDataFrame([(k, n) for n, k in enumerate([None] * 9 + ["a"] * 9 + ["b", "c", "c", "d"])], "k string, n int")
    lookup = spark.createDataFrame([(None, 0), ("a", 1), ("c", 2), ("z", 3)], "k string, v int")
    keep = {None: 0, "a": 1, "c": 2}
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = {tuple(r) for r in skew.join_split(rows, lookup, ["k"], how).collect()}
        want = {(r["k"], r["n"], *([keep.get(r["k"])] if how in ("inner", "left") else [])) for r in rows.collect() if how == "left" or (r["k"] in keep) == (how != "left_anti")}
        assert got == want, how


def sets(texts):
    out = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(texts, groups=False):
    """(id, size, component) of each text; with groups, a number of the component in place of its least id."""
    own = sets(texts)
    top = list(range(len(own)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                top[find(a)] = find(b)
    if groups:
        return [(i, len(own[n]), find(n)) for n, (i, _) in enumerate(texts)]
    ids = defaultdict(list)
    for n, (i, _) in enumerate(texts):
        if i is not None:
            ids[find(n)].append(i)
    return [(i, len(own[n]), min(ids[find(n)], default=None) if own[n] else i) for n, (i, _) in enumerate(texts)]


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 150])
def test_jaccard_components_equal_brute_force(docs, texts, block):
    got = ngram_join.jaccard_components(docs, block=block).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, brute(texts)))


def test_jaccard_of_an_empty_table(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_keep_one_of_each(spark, docs, texts):
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {}
    for (i, _), (_, n, c) in zip(texts, brute(texts, True), strict=True):
        groups.setdefault(c if n else object(), []).append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in kept.collect())
    rows = [(None, "a b c d e f", 1, 1, 1), (7, "a b c d e f", 2, 2, 2), (8, "A b c d e f", 3, 3, 3), (7, "a b c d e f", 4, 4, 4), (None, None, 5, 5, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key int, row int, gone int")
    got = ngram_join.keep_one_of_each(table)
    assert got.columns == table.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["7", "None"]
    assert ngram_join.keep_one_of_each(table.where("false")).count() == 0


def test_hot_sets_and_labels(spark, monkeypatch, texts, docs):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ngram_join.jaccard_components(docs).collect())) == sorted(map(key, brute(texts)))


def test_a_passage_in_a_third_of_all_rows(spark, monkeypatch):
    """Its shingles are hot keys of the join with the frequencies: no task gets them all."""
    import random

    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew, "HOT_SHARE", 400)  # as with a few hundred partitions
    asked = []
    real = ngram_join.hot_keys
    monkeypatch.setattr(ngram_join, "hot_keys", lambda *a: asked.append(real(*a)) or asked[-1])
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(f"p{i}" for i in range(30))
    rows, at = [], 0
    for n in range(150):
        own = [word() for _ in range(120)]
        for _ in range(2):  # every text has a near copy, so that all of them are candidates
            near = list(own)
            near[rng.randrange(120)] = word()
            rows.append((at, " ".join(near) + (f" {passage}" if n % 3 == 0 else "")))
            at += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(table).collect()}
    want = {i: c for i, _, c in brute(rows)}
    assert got == want and len(set(want.values())) < 200
    tokens = [h for h in asked if h.columns == ["token"]]
    assert tokens and tokens[0].count() >= 26


def test_trie_is_fast_on_unlinked_sets():
    import time

    rng = np.random.default_rng(5)
    # neighbours share a part of their rare shingles, but no two sets link
    own = [np.unique(np.concatenate((rng.integers(0, 1 << 40, 100), np.arange(60 * i, 60 * i + 100)))) for i in range(2000)]
    began = time.time()
    assert not ngram_join.trie_links(np.arange(2000), np.arange(2000), [len(x) for x in own], own, 75, 100)
    assert time.time() - began < 2


def test_trie_finds_every_component():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = [set(rng.integers(0, 60, rng.integers(3, 14)).tolist()) for _ in range(4)]
        own = [s ^ set(rng.integers(0, 60, rng.integers(0, 3)).tolist()) for s in base for _ in range(4)]
        own = [s or {1} for s in own]
        counts = [np.array([t % 7 for t in sorted(s)]) for s in own] if rng.random() < 0.5 else None
        links = ngram_join.trie_links(np.arange(16), np.arange(16), np.array([len(s) for s in own]), [np.array(sorted(s)) for s in own], 75, 100, counts=counts)
        top = list(range(16))

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in links:
            assert 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])
            top[find(a)] = find(b)
        for a in range(16):
            for b in range(a):
                if 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                    assert find(a) == find(b)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102)}
