import hashlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from watchframe.llm import toxicity
from watchframe.llm.mixing import fair_mix
from watchframe.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def near_copies(rows):
    own = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        own[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top, holders = {i: i for i in own}, defaultdict(list)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(own):
        shared = defaultdict(int)
        for s in own[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own[i]) + len(own[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i for i in own if find(i) == i}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fine = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    one = stage["toxicity"](spark, docs, SF).cache()
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == fine
    keep = {}
    for r in one.collect():
        keep[lower(r["text"])] = max(keep.get(lower(r["text"]), -1), r["doc_id"])
    two = stage["exact_dedup"](spark, one, SF).cache()
    assert two.columns == docs.columns and sorted(r["doc_id"] for r in two.collect()) == sorted(keep.values())
    three = stage["ngram_jaccard_join"](spark, two, SF).cache()
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == near_copies(two.collect())
    four = stage["mixing"](spark, three, SF).cache()
    assert four.columns == docs.columns
    want = defaultdict(int)
    for r in fair_mix(three).where("taken > 0").collect():
        want[r["doc_id"]] += r["taken"] // r["size"]
    uses, rows = defaultdict(int), {r["doc_id"]: r for r in three.collect()}
    for r in four.collect():
        uses[r["doc_id"]] += 1
        assert r == rows[r["doc_id"]]
    assert uses == want
    five = stage["bpe"](spark, four, SF)
    own = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for r in four.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in five.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_pipeline_is_registered(spark):
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    assert corpus_pipeline.run(spark, SF).count() > 0
