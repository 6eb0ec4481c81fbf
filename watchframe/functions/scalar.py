"""Column functions: plates, colours, geometry, vectors, names and payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registration codes of states and territories, current and former ones still in use.
STATE_CODES = (
    "AN AP AR AS BR CG CH CT DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TG TN TR TS UK UP UT WB"
).split()
# Digits read for letters, and letters read for digits.
READ_AS_LETTER = ("01245678", "OIZASGTB")
READ_AS_DIGIT = ("ODQUILJZASGTB", "0000111245678")


# --- plates


def clean_plate(text: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Layouts of a plate: L a letter, D a digit; the BH series has these letters themselves.
_LAYOUTS = ["LL" + "D" * d + "L" * n + "DDDD" for d in (1, 2) for n in range(4)] + ["DDBHDDDD" + "L" * n for n in (1, 2)]


def normalize_plate(raw: Column) -> Column:
    """struct(text, kind, corrections, valid_state) of a plate as it was read.

    Every layout of the text's length is tried, confusable characters are swapped at a cost of 1 each;
    the least (cost, unknown state) wins, the first layout of equal ones. Text that fits none is invalid
    and stays cleaned. Null gives null.
    """
    one = F.lit(1)
    of_length = lambda s: F.filter(F.array(*[F.lit(x) for x in _LAYOUTS]), lambda x: F.length(x) == F.length(s))
    kinds = lambda text: F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "L" * 26 + "D" * 10)

    def best(s):
        def fit(layout, turn):
            bh = F.contains(layout, F.lit("BH"))
            read = lambda i: F.when(F.substr(layout, i, one) == "D", F.translate(F.substr(s, i, one), *READ_AS_DIGIT)).otherwise(F.translate(F.substr(s, i, one), *READ_AS_LETTER))
            places = F.sequence(one, F.length(s))

            def scored(text):
                cost = F.size(F.filter(places, lambda i: F.substr(s, i, one) != F.substr(text, i, one)))
                penalty = (~bh & ~F.left(text, F.lit(2)).isin(STATE_CODES)).cast("int")
                fits = (kinds(text) == F.replace(layout, F.lit("BH"), F.lit("LL"))) & (~bh | (F.substr(text, F.lit(3), F.lit(2)) == "BH"))
                return F.when(fits, F.struct(cost.alias("cost"), penalty.alias("penalty"), turn.alias("turn"), text.alias("text"), F.when(bh, "bh").otherwise("standard").alias("kind")))

            return let(F.array_join(F.transform(places, read), ""), scored)

        return F.struct(s.alias("s"), F.array_min(F.filter(F.transform(of_length(s), fit), lambda t: t.isNotNull())).alias("b"))

    def named(x):
        b = x["b"]
        return F.struct(
            F.coalesce(b["text"], x["s"]).alias("text"),
            F.coalesce(b["kind"], F.lit("invalid")).alias("kind"),
            F.coalesce(b["cost"], F.lit(0)).alias("corrections"),
            F.coalesce(b["penalty"] == 0, F.lit(False)).alias("valid_state"),
        )

    return F.when(raw.isNotNull(), let(let(clean_plate(raw), best), named))


def bounded_levenshtein(a: Column, b: Column, limit: int) -> Column:
    """Edit distance, or limit + 1 where it is above the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


# Fixed value: how a plate is written in free text.
PLATE_MENTION = r"(?i)\b([0-9]{2}\s?BH\s?[0-9]{4}\s?[A-Z]{1,2}|[A-Z]{2}[\s-]?[0-9]{1,2}[\s-]?[A-Z]{0,3}[\s-]?[0-9]{4})\b"


def extract_plates(text: Column) -> Column:
    """Array of the valid plates mentioned in free text, normalised, in their order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PLATE_MENTION), F.lit(1)), normalize_plate)
    return F.transform(F.filter(found, lambda p: p["kind"] != "invalid"), lambda p: p["text"])


def vehicle_label(plate: Column, status: Column) -> Column:
    """Text drawn over a vehicle."""
    word = F.when(status == "registered", "reg").when(status == "likely_registered", "verify").otherwise("UNREG")
    return F.concat(plate, F.lit(" "), word)


# --- colours and quality


def hsv_to_name(h: Column, s: Column, v: Column) -> Column:
    """Colour name of hue 0-180, saturation and value 0-255."""
    s, v, deg = s / 255.0, v / 255.0, h * 2.0
    return (
        F.when(v < 0.22, "black")
        .when((s < 0.18) & (v > 0.78), "white")
        .when((s < 0.18) & (v > 0.3), "gray")
        .when(s < 0.18, "black")
        .when(((deg < 12) | (deg >= 340)) & (s < 0.45) & (v > 0.6), "pink")
        .when((deg < 12) | (deg >= 340), "red")
        .when(deg < 40, F.when(v < 0.6, "brown").otherwise("orange"))
        .when(deg < 70, F.when(v < 0.45, "brown").otherwise("yellow"))
        .when(deg < 165, "green")
        .when(deg < 255, "blue")
        .when(deg < 290, "purple")
        .otherwise("pink")
    )


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def face_quality(score: Column, height: Column, left_eye_x: Column, right_eye_x: Column, nose_x: Column, min_px: float = 24, good_px: float = 80) -> Column:
    """Detection score times a size ramp times how frontal the face is (null eyes or nose: fully)."""
    size = clip((height - min_px) / max(1, good_px - min_px), 0.0, 1.0)
    apart = F.abs(right_eye_x - left_eye_x)
    turned = F.abs(nose_x - (left_eye_x + right_eye_x) / 2) / F.when(apart > 1e-3, apart)
    return score * size * F.coalesce(clip(1.0 - turned, 0.2, 1.0), F.lit(1.0))


# --- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; vectors without length are at 0 to everything."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def gallery_similarity(sims: Column) -> Column:
    """Mean of the three largest similarities of an array; null for an empty one."""
    top = F.slice(F.sort_array(sims, asc=False), 1, 3)
    return F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top))


# --- boxes and cameras


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / F.greatest(union, F.lit(1e-9))


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def project(p: Column, x: Column, y: Column, z: Column) -> Column:
    """Pixel struct(u, v) of a world point through a flat 3x4 matrix."""
    row = lambda r: p[r * 4] * x + p[r * 4 + 1] * y + p[r * 4 + 2] * z + p[r * 4 + 3]
    return F.struct(F.try_divide(row(0), row(2)).alias("u"), F.try_divide(row(1), row(2)).alias("v"))


def image_to_ground(p: Column, u: Column, v: Column) -> Column:
    """Ground struct(x, y) seen at a pixel: the inverse of the matrix's columns 0, 1 and 3."""
    a, b, c = p[0], p[1], p[3]
    d, e, f = p[4], p[5], p[7]
    g, h, i = p[8], p[9], p[11]
    # rows of the adjugate; the determinant cancels out in the ratio
    x = (e * i - f * h) * u + (c * h - b * i) * v + (b * f - c * e)
    y = (f * g - d * i) * u + (a * i - c * g) * v + (c * d - a * f)
    w = (d * h - e * g) * u + (b * g - a * h) * v + (a * e - b * d)
    return F.struct(F.try_divide(x, w).alias("x"), F.try_divide(y, w).alias("y"))


def height_m(p: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Height in metres of a standing person's box; null where the box touches the border or the view is degenerate."""
    at = image_to_ground(p, (x1 + x2) / 2, y2)
    a = [p[4 + k] - y1 * p[8 + k] for k in range(4)]
    inside = (y1 > 2) & (y2 < height - 2) & (x1 > 2) & (x2 < width - 2)
    return F.when(inside & (F.abs(a[2]) >= 1e-9), F.try_divide(-(a[0] * at["x"] + a[1] * at["y"] + a[3]), a[2]))


# --- names, times and payloads


def in_window(seconds: Column, start: int, end: int) -> Column:
    """Whether a local time of day (seconds) is in [start, end), which may cross midnight."""
    if start <= end:
        return (seconds >= start) & (seconds < end)
    return (seconds >= start) | (seconds < end)


def local_seconds(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """Seconds since local midnight of an epoch-seconds time."""
    t = F.from_utc_timestamp(F.timestamp_seconds(ts), zone)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def parse_clip_name(name: Column) -> Column:
    """struct(date, start, end, site, camera) of names like 2018-03-11.11-25-00.11-30-00.school.G420; null parts if it is none."""
    pattern = r"(\d{4}-\d{2}-\d{2})\.(\d{2}-\d{2}-\d{2})\.(\d{2}-\d{2}-\d{2})\.([a-z]+)\.(G\d+)"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return F.struct(*[part(i + 1).alias(n) for i, n in enumerate(("date", "start", "end", "site", "camera"))])


def namespaced_id(camera: Column, track: Column) -> Column:
    """Camera number x 1000 + track: track ids of several cameras never meet."""
    return F.regexp_extract(camera, r"(\d+)$", 1).cast("long") * 1000 + track


# Nouns after which a prompt needs no "person".
PERSON_NOUNS = ("person", "man", "woman", "guy", "lady", "boy", "girl", "kid", "child", "people")


def clip_prompt(text: Column) -> Column:
    """Prompt for an image-text encoder."""
    words = F.split(F.lower(text), r"\s+")
    has = F.arrays_overlap(words, F.array(*[F.lit(w) for w in PERSON_NOUNS]))
    return F.concat(F.when(has, "a cctv photo of ").otherwise("a cctv photo of a person, "), text)


def event_payload(rule_type: Column, zone: Column, role: Column, track: Column, dwell: Column, gid: Column) -> Column:
    """JSON payload of an alert; null fields are left out."""
    return F.to_json(F.struct(zone.alias("zone"), role.alias("role"), track.alias("track_id"), dwell.alias("dwell_s"), rule_type.alias("rule_type"), gid.alias("global_id")))


def should_blur(role: Column, roles: tuple[str, ...] = ("unknown", "pending"), enabled: bool = True) -> Column:
    return F.lit(enabled) & F.coalesce(role, F.lit("pending")).isin(*roles)
