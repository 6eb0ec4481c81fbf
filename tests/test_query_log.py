import re

from watchframe.operators.query_log import parse_query_log

CASES = [
    ("unknown person in a red shirt and blue jeans near the gate", {"roles": ["unknown"], "upper_color": "red", "lower_color": "blue", "zones": ["gate"], "entity": "person"}),
    ("guard in the resident parking", {"roles": ["staff"], "zones": ["resident_parking"]}),
    ("residents in red and black", {"roles": ["resident"], "upper_color": "red", "lower_color": "black"}),
    ("shirt in navy", {"upper_color": "blue", "lower_color": None}),
    ("someone 180 cm", {"height_min": 175.0, "height_max": 185.0}),
    ("5'8\" man", {"height_min": 168.0, "height_max": 178.0}),
    ("six foot stranger", {"height_min": 175.0, "height_max": 190.0, "roles": ["unknown"]}),
    ("tall man", {"height_min": 180.0, "height_max": None}),
    ("where is tn-09 ab 1234", {"plate": "TN09AB1234", "entity": "vehicle"}),
    ("red car at the main gate", {"entity": "vehicle", "upper_color": None, "cameras": ["cam_1"], "zones": []}),
    (None, {"plate": None, "entity": "person", "roles": [], "zones": []}),
]


NOW = 1_790_000_000.0
MIDNIGHT = NOW - (NOW + 19800) % 86400  # in Asia/Kolkata, five and a half hours ahead


def hours(*marks):
    return tuple(MIDNIGHT + 3600 * m for m in marks)


TIMES = [
    ("men at the pool after 9 pm", hours(21, 24), "men pool"),
    ("men at the pool after 7", hours(19, 24), "men pool"),
    ("since 10 am a man with a ladder", hours(10, 24), "man ladder"),
    ("ladder yesterday after 11", hours(11 - 24, 0), "ladder"),
    ("today from 8", (MIDNIGHT + 8 * 3600, NOW), None),
    ("cart before 7:45 am", hours(0, 7.75), "cart"),
    ("cart between 6 and 8 pm", hours(18, 20), "cart"),
    ("cart between 11 am to 1 pm yesterday", hours(11 - 24, 13 - 24), "cart"),
    ("cart between 9 - 10:30", hours(9, 10.5), "cart"),
    ("lady around 8:30 pm yesterday", hours(20 - 24, 21 - 24), None),
    ("cart around 8 this morning", (None, None), "cart"),
    ("cart at 12 am", hours(-0.5, 0.5), "cart"),
    ("cart in the last 2 hours", (NOW - 7200, NOW), "cart"),
    ("cart in the past hour", (NOW - 3600, NOW), "cart"),
    ("cart within the last three mins", (NOW - 180, NOW), "cart within three mins"),
    ("anyone tonight", (MIDNIGHT, NOW), None),
    ("all people yesterday", hours(-24, 0), None),
    ("staff this afternoon", hours(12, 17), None),
    ("kid at night with umbrella", hours(21, 30), "kid umbrella"),
    ("five foot eight boy in a cap", (None, None), "boy cap"),
    ("six foot man", (None, None), None),
    ("green kurta", (None, None), "green kurta"),
    ("trucks last hour", (NOW - 3600, NOW), None),
    ("about 150 cm man in the evening", hours(17, 21), None),
]


def test_times_and_free_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TIMES)], "query_id long, text string")
    got = {r["query_id"]: r for r in parse_query_log(df, ["gate"], {}, NOW).collect()}
    for i, (text, span, free) in enumerate(TIMES):
        r = got[i]
        assert ((r["time_from"], r["time_to"]), r["free_text"]) == (span, free), (text, r)


def test_registered_log(spark):
    """Every row of the registered query against what its sentence was made of."""
    from watchframe.operators.query_log import PERSON_WORDS, ROLE_WORDS, STOP_WORDS, VEHICLE_WORDS
    from watchframe.plans import queries

    sf, day = "/root/testdata/sf0.001", 86400
    log = {r["query_id"]: r for r in queries.query_log(spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/conversations.parquet")).collect()}
    part = {f"p{r['p_partkey']}": r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = {r["query_id"]: r for r in queries.QUERIES["f16_parse_query_log"](spark, sf).collect()}
    assert got.keys() == log.keys() and len(got) > 200
    taken = {*STOP_WORDS, *VEHICLE_WORDS, *(w for ws in ROLE_WORDS.values() for w in ws.split()), "gate", "gates", "lobby", "lobbys", "parking", "parkings"}
    for i, r in got.items():
        now = log[i]["now"]
        start = now + 19800 - (now + 19800) % day - 19800
        if i in part:
            k, size = part[i]["p_partkey"], part[i]["p_size"]
            said = ["red", "navy", "grey", "black", "olive"][size % 5]
            color = {"navy": "blue", "grey": "gray", "olive": "green"}.get(said, said)
            a, b = k % 12 + 1, (k % 11 + 1, k % 9 + 2)
            pm = lambda h: (h % 12 + 12) * 3600
            want = [
                {"roles": ["unknown"], "upper_color": color, "lower_color": None, "zones": ["gate"], "time_from": start + pm(a), "time_to": start + day, "free_text": f"{said} shirt jeans"},
                {"roles": ["staff"], "zones": ["resident_parking", "visitor_parking"][:1], "time_from": start - 7 * 3600, "time_to": start - 3 * 3600, "height_min": None},
                {"plate": f"TN09AB{k % 10000:04d}", "entity": "vehicle", "cameras": ["cam_1"], "time_from": start, "time_to": now, "free_text": None},
                {"roles": ["unknown"], "upper_color": color, "height_min": 180.0, "time_from": start + pm(b[0]), "time_to": start + pm(b[1]) + 900, "free_text": f"{said} {part[i]['p_name']}"},
                {"height_min": round((k % 4 + 4) * 30.48 + k % 12 * 2.54 - 5), "cameras": ["cam_2"], "time_from": now - 60 * size, "time_to": now, "free_text": None},
                {"lower_color": color, "upper_color": None, "time_from": start + a * 3600, "time_to": start + (a + 1) * 3600, "free_text": f"trousers {said}"},
            ][k % 6]
            if k % 6 == 3 and "plate" in part[i]["p_name"]:  # a word for vehicles
                want |= {"entity": "vehicle", "upper_color": None, "free_text": None}
            if k % 6 == 5 and a == 12:
                want |= {"time_from": start + 12 * 3600, "time_to": start + 13 * 3600}
            assert {n: r[n] for n in want} == want, (log[i]["text"], r)
        else:
            words = [w for w in re.findall(r"[a-z][a-z'\-]*", log[i]["text"].lower()) if w not in taken]
            assert (r["plate"], r["roles"], r["upper_color"]) == (None, [], None)
            assert r["free_text"] == (" ".join(words) if r["entity"] == "person" and set(words) - set(PERSON_WORDS) else None), log[i]["text"]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "query_id long, text string")
    got = {r["query_id"]: r for r in parse_query_log(df, ["resident_parking", "visitor_parking", "gate"], {"cam_1": "Main gate"}).collect()}
    for i, (text, want) in enumerate(CASES):
        assert {k: got[i][k] for k in want} == want, text


def plain_parser(text, now, zones, cameras):
    """The parser's rules one after the other, for one sentence: every output field."""
    from watchframe.functions.scalar import PLATE_MENTION
    from watchframe.operators import query_log as ql

    text = text or ""
    q = text.lower().replace("’", "'")
    plate = None
    if m := re.search(PLATE_MENTION, text):
        p = re.sub("[^A-Z0-9]", "", m[1].upper())
        if re.fullmatch("[A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{4}|[0-9]{2}BH[0-9]{4}[A-Z]{1,2}", p):
            plate, q = p, q.replace(m[1].lower(), " ")
    local = now + 19800
    day = local // 86400 * 86400 - (86400 if re.search(r"\byesterday\b", q) else 0)
    whole = (None, None)
    if re.search(r"\byesterday\b", q):
        whole = day, day + 86400
    elif re.search(r"\b(today|tonight)\b", q):
        whole = day, local

    def clock(hour, minute, half):
        hour = int(hour)
        hour += 12 if half == "pm" and hour < 12 else -12 if half == "am" and hour == 12 else 0
        return day + hour % 24 * 3600 + int(minute or 0) * 60

    c, found = r"([0-9]{1,2})(?::([0-9]{2}))?(?:\s*(am|pm))?", None
    if m := re.search(rf"\bbetween\s+{c}\s+(?:and|to|-)\s+{c}", q):
        found = clock(m[1], m[2], m[3] or m[6]), clock(m[4], m[5], m[6])
    elif m := re.search(rf"\b(?:after|since|from)\s+{c}", q):
        found = clock(m[1], m[2], m[3] or ("pm" if int(m[1]) < 8 else None)), day + 86400 if whole[1] is None else whole[1]
    elif m := re.search(rf"\bbefore\s+{c}", q):
        found = day, clock(*m.groups())
    elif m := re.search(rf"\b(?:around|at|about)\s+{c}(?!\w)", q):
        if m[2] or m[3]:
            found = clock(*m.groups()) - 1800, clock(*m.groups()) + 1800
    elif m := re.search(r"\b(?:last|past)\s+(?:([0-9]+|an?|one|two|three)\s*)?(hour|minute|min)s?\b", q):
        n = {"two": 2, "three": 3}.get(m[1]) or (int(m[1]) if (m[1] or "").isdigit() else 1)
        found = local - n * (3600 if m[2] == "hour" else 60), local
    else:
        for word, a, b in (("morning", 6, 12), ("afternoon", 12, 17), ("evening", 17, 21), ("night", 21, 30)):
            if re.search(rf"\b{word}\b", q):
                found = day + a * 3600, day + b * 3600
                break
    if found:
        e = r"[0-9]{1,2}(?::[0-9]{2})?\s*(?:am|pm)?"
        q = re.sub(rf"\b(?:between|after|since|from|before|around|at|about)\s+{e}(?:\s+(?:and|to|-)\s+{e})?", " ", q)
    span = found or whole

    marks = re.findall("[a-z]+|[0-9]+", q.replace("'", " ft ").replace('"', " in "))
    value = lambda t, low, high, n: int(t) if re.fullmatch(f"[0-9]{{1,{n}}}", t) else ql.NUMBERS.index(t) if t in ql.NUMBERS[low : high + 1] else None
    height = (None, None)
    metric = [int(a) for a, b in zip(marks, marks[1:], strict=False) if re.fullmatch("[0-9]{3}", a) and b == "cm"]
    imperial = [i for i in range(len(marks) - 1) if value(marks[i], 4, 7, 1) is not None and marks[i + 1] in ("ft", "foot", "feet")]
    if metric:
        height = metric[0] - 5.0, metric[0] + 5.0
    elif imperial:
        i = imperial[0]
        feet, inch = value(marks[i], 4, 7, 1) * 30.48, value(marks[i + 2], 1, 11, 2) if i + 2 < len(marks) else None
        height = (round(feet - 8), round(feet + 7)) if inch is None else (round(feet + inch * 2.54 - 5), round(feet + inch * 2.54 + 5))
    elif re.search(r"\btall\b", q):
        height = 180.0, None
    elif re.search(r"\bshort\b", q):
        height = None, 162.0

    names = [(k, i) for i, n in cameras.items() for k in (i.lower(), n.lower())]
    met = list(dict.fromkeys(i for k, i in names if re.search(rf"\b{re.escape(k)}\b", q)))
    phrases = {z.replace("_", " "): z for z in zones if "_" in z}
    places = {z for p, z in phrases.items() if re.search(rf"\b{re.escape(p)}\b", q)}
    for k in sorted({k for k, _ in names} | set(phrases), key=lambda k: (-len(k), k)):
        q = re.sub(rf"\b{re.escape(k)}\b", " ", q)
    tokens = re.findall(r"[a-z][a-z'\-]*|[0-9]+", q)
    role_of = {w: r for r, ws in ql.ROLE_WORDS.items() for w in ws.split()}
    keys = {w: [z for z in zones if w in z.split("_")] for z in zones for w in z.split("_") if len(w) > 2 and w not in role_of and w not in ("floor", "zone", "area")}
    for t in tokens:
        places |= {z for w, own in keys.items() if t in (w, w + "s") for z in own}
    person = plate is None and not set(tokens) & set(ql.VEHICLE_WORDS)
    worn, loose = {}, []
    for i, t in enumerate(tokens):
        if t in ql.COLOR_WORDS:
            part = lambda w: "upper" if w in ql.UPPER_WORDS else "lower" if w in ql.LOWER_WORDS else None
            near = [p for p in map(part, tokens[i + 1 : i + 4]) if p][:1] or [p for p in map(part, tokens[max(0, i - 3) : i]) if p][-1:]
            if near:
                worn.setdefault(near[0], ql.COLOR_WORDS[t])
            else:
                loose.append(ql.COLOR_WORDS[t])
    for color in loose:
        free = [p for p in ("upper", "lower") if p not in worn]
        if free:
            worn[free[0]] = color
    taken = {*ql.STOP_WORDS, *ql.VEHICLE_WORDS, *role_of, *keys, *(k + "s" for k in keys)}
    feet = ("ft", "foot", "feet")
    measured = lambda i: value(tokens[i], 1, 11, 2) is not None and (tokens[i + 1 : i + 2] and tokens[i + 1] in feet or i and tokens[i - 1] in feet)
    words = [t for i, t in enumerate(tokens) if not t.isdigit() and t not in taken and not measured(i)]
    return {
        "plate": plate, "entity": "person" if person else "vehicle", "roles": sorted({role_of[t] for t in tokens if t in role_of}),
        "upper_color": worn.get("upper") if person else None, "lower_color": worn.get("lower") if person else None,
        "height_min": height[0], "height_max": height[1], "cameras": met, "zones": sorted(places),
        "time_from": span[0] and span[0] - 19800, "time_to": span[1] and span[1] - 19800,
        "free_text": " ".join(words) if person and set(words) - set(ql.PERSON_WORDS) else None,
    }


def test_every_field_of_the_registered_log_equals_a_plain_parser(spark):
    from watchframe.plans import queries

    sf = "/root/testdata/sf0.01"
    log = {r["query_id"]: r for r in queries.query_log(spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/conversations.parquet")).collect()}
    got = {r["query_id"]: r.asDict() for r in queries.QUERIES["f16_parse_query_log"](spark, sf).collect()}
    assert got.keys() == log.keys() and len(got) > 2_000
    for i, r in got.items():
        del r["query_id"]
        assert r == plain_parser(log[i]["text"], log[i]["now"], queries._ZONES, queries._CAMERAS), log[i]["text"]
    said = [t for t, _, _ in TIMES] + [t for t, _ in CASES]
    df = spark.createDataFrame(list(enumerate(said)), "query_id long, text string")
    for r in parse_query_log(df, queries._ZONES, queries._CAMERAS, NOW).collect():
        own = r.asDict()
        text = said[own.pop("query_id")]
        assert own == plain_parser(text, NOW, queries._ZONES, queries._CAMERAS), text


def test_the_plan_stays_small(spark):
    """Steps are bound, not inlined into every field that uses them."""
    df = spark.createDataFrame([("x", "y")], "query_id string, text string")
    plan = parse_query_log(df, ["resident_parking", "gate"], {"cam_1": "Main gate"}, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000
