import hashlib
import random
import zlib

import pytest

from watchframe.llm import turn_trie


def rebuilt(rows):
    """conv_id -> tuple of (role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    return found


def expected(rows):
    found = rebuilt(rows)
    members = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], set()).add(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ended = sorted(c for c in own if found[c] == node)
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(y[:-1] == x for y in below if y) for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key binary").repartition(4)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in [*range(300, 520), *range(7), 1000, 1201]:
        for turn in range(rng.randrange(1, 8)):
            text = rng.choice(["Yes.", "No.", None, "", "\U0001f600 é", f"{rng.randrange(4)} words"])
            rows.append((conv, None if rng.random() < 0.05 else rng.choice([turn, turn, turn + 1]), rng.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "nobody"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]
    # copies without a block's first conversation, and a long one
    for conv in range(2101, 2160):
        rows += [(conv, t, "user", f"copy {t}") for t in range(8)]
    return rows + [(3_001, t, "user", f"{t}") for t in range(400)]


def test_tree_equals_brute_force(spark, talks, monkeypatch):
    for piece in (turn_trie.PIECE_IDS, 3):
        monkeypatch.setattr(turn_trie, "PIECE_IDS", piece)
        got = sorted((tuple(r) for r in turn_trie.prefix_tree(table(spark, talks)).collect()), key=str)
        assert got == expected(talks)


def test_hot_first_turn_and_copies(spark):
    rows = [(100 * c + 1, 0, "user", "hello" if c % 3 else f"start {c}") for c in range(3_000)]
    rows += [(100 * c + 1, t, "user", f"{c % 50} {t}") for c in range(3_000) for t in range(1, 8)]
    tree = turn_trie.prefix_tree(table(spark, rows)).cache()
    found = rebuilt(rows)
    assert tree.count() == len({x[:d] for x in found.values() for d in range(len(x) + 1)})
    root = tree.where("depth = 0").first()
    assert root["n_convs"] == 3_000 and root["n_leaves"] == len({x for x in found.values() if not any(y != x and y[: len(x)] == x for y in set(found.values()))})
    assert tree.where("depth > 0 AND parent_conv_id IS NULL").count() == 0


def test_turnless_and_empty(spark):
    none = turn_trie.prefix_tree(table(spark, [(1, 1, "user", "x")]).where("false"))
    assert none.count() == 0 and none.columns[0] == "conv_id"
    one = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert [tuple(r) for r in turn_trie.prefix_tree(table(spark, [(one, 1, "user", "x")])).collect()] == expected([(one, 1, "user", "x")])
