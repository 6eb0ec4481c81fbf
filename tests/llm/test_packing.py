import json
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from watchframe.llm import packing
from watchframe.llm.queries import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
ODD = [
    "", " ", "\n\n  \t x  y  z", "it's we'll 'S", "<|endoftext|> is a word <|endoftext|>", "x" * 30_000, " " * 9_000 + "end", "  wide　space \x85 next", "\U0001f600 ok ́",
    "字漢 한글 кир", "a\x1c b\x1f  c", "1 234² Ⅷ x½", ("word, and\n more  text. " * 90_000), ("café   naïve  " * 90_000),
]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library(texts):
    own = packing.Encoder(open(FILE, encoding="utf-8").read())
    assert own.fast is not None
    for t in [t or "" for _, t in texts] + ODD:
        assert own.ids(t).tolist() == library_ids(t), t[:50]


def test_other_tokenizers_go_to_the_library():
    file = tokenizer_file("word_bpe_49k.json")
    own = packing.Encoder(open(file, encoding="utf-8").read())
    assert own.fast is None
    assert own.ids("Some words, here").tolist() == Tokenizer.from_file(file).encode("Some words, here", add_special_tokens=False).ids
    changed = json.load(open(FILE, encoding="utf-8"))
    changed["model"]["merges"] = changed["model"]["merges"][1:] + changed["model"]["merges"][:1]
    assert packing._byte_ranks(changed) is None


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def test_bins_equal_a_plain_search():
    rng = np.random.default_rng(5)
    for most in (1, 3, 40):
        bins, open_, opened = packing.OpenBins(64, most), [], 0
        for n in rng.integers(1, 65, 2_000).tolist():
            fitting = [b for b in open_ if b[0] >= n]
            if fitting:
                free = min(b[0] for b in fitting)
                best = [b for b in open_ if b[0] == free][-1]
                open_.remove(best)
            else:
                if len(open_) == most:
                    free = min(b[0] for b in open_)
                    open_.remove([b for b in open_ if b[0] == free][-1])
                best = (64, opened)
                opened += 1
            assert bins.place(n) == (best[1], 64 - best[0])
            if best[0] > n:
                open_.append((best[0] - n, best[1]))
            assert bins.open == len(open_) <= most
        assert bins.opened == opened


def check_packed(rows, want, capacity):
    """Pieces are those of the texts, sequences are gapless and hold at most `capacity`."""
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted(want)
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


def test_documents_are_packed_whole(spark, docs, texts, empty):
    for capacity, open_bins in ((64, 3), (2048, 4096)):
        want = []
        for i, t in texts:
            ids = [*library_ids(t or ""), 0]
            first = len(ids) % capacity or min(len(ids), capacity)
            for k, s in enumerate([0, *range(first, len(ids), capacity)]):
                part = ids[s : first if not k else s + capacity]
                want.append((str(i), k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        rows = packing.pack_documents(docs, FILE, capacity=capacity, open_bins=open_bins).collect()
        n = check_packed(rows, want, capacity)
        least = math.ceil(sum(w[3] for w in want) / capacity)
        assert n <= least * (1.02 if open_bins > 3 else 1.5) + 1
    assert packing.pack_documents(empty, FILE).count() == 0


def test_sequences_hold_the_ids(docs, texts):
    rows = packing.packed_sequences(docs, FILE, capacity=256).collect()
    told = {}
    for r in rows:
        assert len(r["ids"]) <= 256
        for p in r["pieces"]:
            told.setdefault(str(p["doc_id"]), []).append((p["piece"], r["ids"][p["offset"] : p["offset"] + p["length"]]))
    ids_of = {}
    for i, t in texts:
        ids_of.setdefault(str(i), []).extend([*library_ids(t or ""), 0])
    for i, parts in told.items():
        if [t for j, t in texts if str(j) == i][1:]:  # ids that come twice
            assert sum(len(p) for _, p in parts) == len(ids_of[i])
        else:
            assert [x for _, p in sorted(parts) for x in p] == ids_of[i]


def test_best_fit_of_any_table(spark):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 2049, 30_000)]
    rows = spark.createDataFrame([(None if k % 7 == 0 else 3, n, k, k) for k, n in enumerate(lengths)], "id long, n long, task_ long, sequence_id long")
    placed = packing.best_fit(rows, "n", piece_rows=40_000).collect()
    assert sorted(r["task_"] for r in placed) == list(range(len(lengths)))
    assert len({r["sequence_id"] for r in placed}) <= 1.006 * math.ceil(sum(lengths) / 2048)
    tasks = packing.best_fit(rows, "n", piece_rows=5_000).collect()
    assert len({r["sequence_id"] >> 33 for r in tasks}) == 6
    assert len({r["sequence_id"] for r in tasks}) <= 1.02 * math.ceil(sum(lengths) / 2048)
    for wrong in (0, 2049, None):
        with pytest.raises(Exception, match="lengths must be"):
            packing.best_fit(spark.createDataFrame([(1, wrong)], "id long, n long"), "n").collect()
