import hashlib
import itertools
import random
import re
import zlib

import pytest

from watchframe.llm import turn_repair


def damaged(rows):
    """conv_id -> damaged turns in order. rows: (conv_id, turn, role, text)."""
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        found[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for turns in found.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
    return found


def grammar(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def expected(turns):
    """By trying every edit of every turn, with the cheapest remainder of each place and roles so far."""
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults, seen = [], set()
    for _, role, text in turns:
        last = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    known = {}

    def state(initials):  # all that a grammar of pairs needs to know of what came before
        return initials if len(initials) < 2 else initials[-1] + "+"

    def open_to(initials):
        return any(grammar(initials + more) for more in ("", "a", "ua"))

    def best(i, initials, inserted):
        key = i, state(initials), inserted
        if key not in known:
            ways = []
            if i == len(turns) and grammar(initials):
                ways.append((0, "", ()))
            if inserted < 3:
                for role in ("user", "assistant"):
                    if open_to(initials + role[0]) and (rest := best(i, initials + role[0], inserted + 1)):
                        ways.append((2 + rest[0], "I" + rest[1], ((role, ""), *rest[2])))
            if i < len(turns):
                _, role, text = turns[i]
                if rest := best(i + 1, initials, 0):
                    ways.append((3 + rest[0], "D" + rest[1], rest[2]))
                if faults[i] not in ("blank", "duplicate"):
                    for new, cost, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                        if new and open_to(initials + new[0]) and (rest := best(i + 1, initials + new[0], 0)):
                            ways.append((cost + (faults[i] == "truncated") + rest[0], letter + rest[1], ((new, text), *rest[2])))
            known[key] = min(ways) if ways else None
        return known[key]

    cost, audit, repaired = best(0, "", 0)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def table(spark, rows):
    extra = [(*r, 1, True) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, place int, present boolean").repartition(3)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "  ", "", None, "Done. \n", " "]
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(0, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.05 else rng.choice([turn, turn + 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"{conv} says {turn}."))
    rows += [(None, t, "user", f"no id {t}.") for t in range(5)] + [(7, 3, "user", "Yes.")] * 3
    return rows + [(1000, t, ["user", "assistant"][t % 2], f"long {t}{'.' * (t % 3)}") for t in range(3_000)]


def test_digests_equal_brute_force(spark, talks, monkeypatch):
    import sys

    monkeypatch.setattr(sys, "setrecursionlimit", sys.setrecursionlimit)
    sys.setrecursionlimit(50_000)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_digests(table(spark, talks)).collect()}
    want = {conv: expected(turns) for conv, turns in damaged(talks).items()}
    assert got == want
    assert any(not turns for turns in damaged(talks).values())


def test_repaired_turns_have_the_digest(spark, talks):
    turns = turn_repair.damage(table(spark, talks))
    planned = turn_repair.plans(turn_repair.signatures(turns))
    rows = turn_repair.repaired_turns(turns, planned).collect()
    told = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"])):
        own = told.setdefault(r["conv_id"], [])
        assert r["place"] == len(own)
        own.append((r["edit"], r["role"], r["text"]))
    for r in turn_repair.repair_digests(table(spark, talks)).collect():
        own = told.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(f"{b}:{c}" for _, b, c in own).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(e for e, _, _ in own) == r["audit"].replace("D", "")


def test_every_short_signature():
    """All signatures of up to four symbols against all edit strings of up to ten letters' worth of cost."""
    automaton = turn_repair.Automaton()
    for n in range(5):
        for symbols in sorted("".join(s) for s in itertools.product("xsuaoSUAO", repeat=n)):
            automaton.read(symbols)
            turns = [(k, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "other"), "" if c == "x" else f"{k}{'' if c.isupper() else '.'}") for k, c in enumerate(symbols[::-1])]
            assert automaton.best() == expected(turns)[5:7], symbols


def test_nodes_are_made_once():
    rng = random.Random(4)
    signatures = sorted("".join(rng.choice("uaUAsx") for _ in range(rng.randrange(12))) for _ in range(5_000))
    automaton = turn_repair.Automaton()
    for s in signatures:
        automaton.read(s)
    assert automaton.made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_a_hot_signature_is_spread(spark):
    rows = [(c, t, ["user", "assistant"][t], "Fine.") for c in range(3_000) for t in range(2)]
    signed = turn_repair.signatures(turn_repair.damage(table(spark, rows)))
    dealt = turn_repair.plans(signed).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert max(r["count"] for r in dealt) < 1_500


def test_empty_tables(spark):
    none = table(spark, [(1, 1, "user", "x")]).where("false")
    assert turn_repair.repair_digests(none).count() == 0
    assert turn_repair.repair_digests(none).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
