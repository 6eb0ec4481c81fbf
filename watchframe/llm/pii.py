"""Personal data in texts: patterns propose spans, checksums confirm, nearby words adjust a score.

DataFrame expressions only. A pattern's matches and the pieces between them (a split by the same
pattern) have the same order, so running sums of their lengths are the matches' positions in code
points. The patterns are possessive and anchored where a run of their characters starts (or at the
end of the last match), which gives the same leftmost non-overlapping matches in linear time.

Kinds `email`, `ip`, `card` and `phone` are base kinds: a match that passes its check always stays, and
the score only says how sure it is. The other kinds are reported from a score of LEAST_SCORE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
LEAST_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT = 48

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (a character that every match holds or None, pattern)
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "tel": (None, r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
}
#: kind: (score of a match that passed its check, what a context word adds, context words)
SCORES = {
    "email": (0.9, 0.1, "mail|email|e-mail|contact|write"),
    "ip": (0.6, 0.3, "ip|host|server|address|from|login"),
    "card": (0.8, 0.2, "card|credit|debit|visa|mastercard|amex|pay|payment|carte|karte|tarjeta"),
    "phone": (0.7, 0.3, "phone|tel|telephone|call|mobile|fax|whatsapp|telefon|appel|llama"),
    "iban": (0.9, 0.1, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (0.3, 0.5, "ssn|social security|security number"),
    "tel": (0.3, 0.4, "phone|tel|telephone|call|mobile|fax|telefon"),
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(F.reverse(digits), i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1)
        ),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether a bank account number (letters and digits) leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc),
    )
    return rest == 1


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(value, " ", "")
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
#: Matches whose positions are added up at once.
_RUN = 256


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _sums_before(lengths: Column, at) -> Column:
    """For each length, `at` and all lengths before it. Copies its list for each one: for short lists."""
    begin = F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _offsets(lengths: Column) -> Column:
    """Sums of the lengths before each one: those of runs of _RUN first, then those within the runs."""
    runs = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int"))
    run = lambda b: F.slice(lengths, b * _RUN + 1, F.lit(_RUN))
    totals = F.transform(runs, lambda b: F.aggregate(run(b), F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, _sums_before(totals, F.lit(0)), lambda b, at: _sums_before(run(b), at)))


#: Matches that CONTEXT characters can hold, as none is shorter than two.
_NEAR = CONTEXT // 2


def _placed(v: Column) -> Column:
    """v: struct of the matches (found) and the pieces between them (gaps). Starts, values, and text around.

    Running sums of the pieces' and matches' lengths are the positions. The CONTEXT characters on both sides
    are put together from the pieces and matches next to it. Nearly linear in the number of matches.
    """
    n, wide = F.size(v["found"]), F.lit(CONTEXT)
    before, after = F.slice(v["gaps"], F.lit(1), n), F.slice(v["gaps"], F.lit(2), n)
    parts = F.struct(
        F.zip_with(before, v["found"], lambda g, x: F.char_length(g) + F.char_length(x)).alias("lengths"),
        F.zip_with(before, v["found"], lambda g, x: F.right(F.concat(g, x), wide)).alias("back"),
        F.zip_with(v["found"], after, lambda x, g: F.left(F.concat(x, g), wide)).alias("ahead"),
        F.zip_with(before, after, lambda a, b: F.struct(F.char_length(a).alias("n"), F.right(a, wide).alias("left"), F.left(b, wide).alias("right"))).alias("gaps"),
    )

    def place(p):
        def one(x, i):
            left = F.right(F.concat(F.array_join(F.slice(p["back"], F.greatest(i - _NEAR + 1, F.lit(1)), F.least(i, F.lit(_NEAR))), ""), x["gap"]["left"]), wide)
            right = F.left(F.concat(x["gap"]["right"], F.array_join(F.slice(p["ahead"], i + 2, F.lit(_NEAR)), "")), wide)
            return F.struct((x["at"] + x["gap"]["n"]).alias("start"), x["value"].alias("value"), F.lower(F.concat(left, F.lit("\n"), right)).alias("around"))

        return F.transform(F.arrays_zip(_offsets(p["lengths"]).alias("at"), v["found"].alias("value"), p["gaps"].alias("gap")), one)

    return _let(parts, place)


def _spans(kind: str, text: Column) -> Column:
    sign, pattern = PATTERNS[kind]
    base, extra, words = SCORES[kind]
    none = F.array().cast(_SPAN)

    def scored(v):
        spans = F.transform(
            F.filter(_placed(v), lambda x: _passes(kind, x["value"])),
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                x["start"].alias("start"),
                (x["start"] + F.char_length(x["value"])).alias("end"),
                x["value"].alias("value"),
                (F.lit(base) + F.when(x["around"].rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), extra).otherwise(0.0)).alias("score"),
            ),
        )
        if kind not in BASE:
            spans = F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
        return F.when(F.size(v["found"]) > 0, spans.cast(_SPAN)).otherwise(none)

    may = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(may, _let(both, scored)).otherwise(none)


def _is(kind: str):
    return lambda x: x == kind


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column `spans`: kind, start, end (code points, end exclusive), value, score.

    Kinds in the order of PATTERNS, each by start. Null and empty texts have none; very long ones are read
    whole, in time linear in their length. Replaces a column of that name; rows keep their number, and an
    empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c != "spans"]
    return docs.select(*kept, F.concat(*[_spans(kind, text) for kind in PATTERNS]).alias("spans"))


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text, and the mean score.

    Other columns, whatever their names, are not read; repeated and null ids are rows of their own.
    Columns: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, mean_score (null without spans).
    """
    found = find_spans(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text")
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, name), ",")
    spans = F.col("spans")
    return found.select(
        id_col,
        *[F.size(F.filter(F.col("spans.kind"), _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(F.filter(spans, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.when(F.size(spans) > 0, F.aggregate(spans, F.lit(0.0), lambda a, x: a + x["score"]) / F.size(spans)).alias("mean_score"),
    )
