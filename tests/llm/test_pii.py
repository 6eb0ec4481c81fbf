import hashlib
import random
import re

from pyspark.sql import functions as F

from watchframe.llm.pii import CONTEXT, LEAST_SCORE, SCORES, find_spans, luhn, mod97, span_digests

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}


def iban_ok(v):
    v = v.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def brute_added(text):
    """(kind, start, end, score) of the added kinds, with the context of both sides."""
    out = []
    for kind, p in ADDED.items():
        for m in re.finditer(p, text or ""):
            base, extra, words = SCORES[kind]
            around = [text[max(0, m.start() - CONTEXT) : m.start()].lower(), text[m.end() : m.end() + CONTEXT].lower()]
            score = base + extra * any(re.search(rf"(?<![a-z])(?:{words})(?![a-z])", x) for x in around)
            if (kind != "iban" or iban_ok(m[0])) and score >= LEAST_SCORE:
                out.append((kind, m.start(), m.end(), round(score, 6)))
    return out


def luhn_ok(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn_ok(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(5)
    fixed = [
        None, "", "x", "a@b.c_d@e.f a@b@c.d x.y@z", "1.2.3.4.5.6.7.8 256.1.1.1 0010.1.1.255", "4111 1111 1111 1111, 4111-1111-1111-1112",
        "é😀 +49 (30) 1234-567 call +1", "a.a@" + "b." * 3000 + "c", "9" * 40, "mail ab@cd.ef" * 50, "IBAN DE89 3704 0044 0532 0130 00 ok", "x" * 20000 + "@a.b",
    ]
    parts = ["call 555-123-4567 ", "123-45-6789", " SSN ", "DE89 3704 0044 0532 0130 00", " GB82WEST12345698765432 ", "DE00370400440532013000", "telephone", " (555) 123 4567 ", "x" * 50, " and ", "9"]
    fixed += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return fixed + ["".join(rng.choice("a1.@+-% ()_é9") for _ in range(rng.randint(1, 80))) for _ in range(400)]


def test_base_spans_equal_brute_force(spark):
    data = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in span_digests(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(got) == len(data)
    for i, t in data:
        want = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, r["spans"], joined)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in want) for x in BASE]
        assert r["spans"].startswith(joined)


def test_added_spans_equal_brute_force(spark):
    data = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in find_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, t in data:
        assert [(k, a, b, round(s, 6)) for k, a, b, _, s in got[i] if k in ADDED] == brute_added(t), t
        assert all(v == t[a:b] for _, a, b, v, _ in got[i])


def test_many_matches_and_no_rows(spark):
    import time

    text = " ".join(f"user{i}@mail{i}.example.org" for i in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = span_digests(df).collect()[0]
    assert time.time() - began < 20
    assert row["n_email"] == 16_000
    assert row["base_sha256"] == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(BASE["email"], text)).encode()).hexdigest()
    assert span_digests(df.where("false")).count() == 0


def test_checksums(spark):
    rows = spark.createDataFrame([("4111111111111111", True), ("4111111111111112", False)], "d string, ok boolean")
    assert all(r["x"] == r["ok"] for r in rows.select("ok", luhn(F.col("d")).alias("x")).collect())
    rows = spark.createDataFrame([("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("DE88370400440532013000", False)], "d string, ok boolean")
    assert all(r["x"] == r["ok"] for r in rows.select("ok", mod97(F.col("d")).alias("x")).collect())


def test_method_adds_spans_and_context_adjusts_scores(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00; my ssn 123-45-6789; id 123-45-6788", 0), (2, "call 555-123-4567 now", 0)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r["spans"] for r in find_spans(df).collect()}
    assert [(s["kind"], s["value"]) for s in got[1]] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("ssn", "123-45-6788")]
    assert [(s["kind"], s["start"], s["end"], round(s["score"], 2)) for s in got[2]] == [("tel", 5, 17, 0.7)]
