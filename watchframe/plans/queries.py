"""Registered queries over the derived views, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..helpers.tables import write_again
from ..operators import boxes, evaluation, identity, maintenance, plates, presence, search, tracks
from ..operators.vectors import nearest_vectors
from .views import view, with_views

WIDTH, HEIGHT = 1280, 720
GAP, COOLDOWN, DWELL, TAILGATE = 43200.0, 172800.0, 21600.0, 600.0
RULES = [
    {"id": "unknown", "type": "unknown_in_zone", "severity": "high", "zones": []},
    {"id": "loiter", "type": "loitering", "severity": "medium", "zones": ["a", "b"], "dwell_s": DWELL},
    {"id": "night", "type": "after_hours", "severity": "low", "zones": ["a"], "start": 22 * 3600, "end": 6 * 3600},
    {"id": "tail", "type": "tailgating", "severity": "high", "zones": ["a", "b"], "window_s": TAILGATE},
]
#: A flat 3x4 projection for the derived cameras: 8 m above ground, looking down and ahead.
MATRIX = [900.0, 640.0, 20.0, 3200.0, 10.0, 260.0, -880.0, 7300.0, 0.02, 1.0, 0.05, 9.0]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers f(*view DataFrames) under a name, with its SQL over the same views."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return keep


def zones_df(edges: DataFrame) -> DataFrame:
    """Zone table from its edges: camera_id, zone, restricted, polygon."""
    points = edges.groupBy("camera_id", "zone", "restricted").agg(F.sort_array(F.collect_list(F.struct("e", "ax", "ay"))).alias("p"))
    return points.select("camera_id", "zone", "restricted", F.transform("p", lambda q: F.struct(q["ax"].alias("x"), q["ay"].alias("y"))).alias("polygon"))


def calib_df(det: DataFrame) -> DataFrame:
    cams = det.select("camera_id").distinct()
    return cams.select("camera_id", F.array(*[F.lit(x) for x in MATRIX]).alias("p"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def _r(name: str, digits: int = 4):
    return (F.round(name, digits) + F.lit(0.0)).alias(name)  # no negative zeros


# --- projections and filters


@query("p1_scale_boxes", "v_det", sql="""
    SELECT camera_id, frame, track_id, round_even(x1 * 0.5, 1) AS x1, round_even(y1 * 0.5, 1) AS y1, round_even(y2 * 0.5, 1) AS y2
    FROM v_det WHERE frame < (SELECT max(frame) FROM v_det)""")
def _p1(det):
    return boxes.scale_boxes(det, 0.5, 0.5, det.agg(F.coalesce(F.max("frame"), F.lit(0))).first()[0]).select("camera_id", "frame", "track_id", "x1", "y1", "y2")


@query("p2_output_size", "v_det", sql="""
    SELECT DISTINCT w, h, CAST(round_even(w * least(1.0, 480.0 / h) / 2, 0) * 2 AS INTEGER) AS out_w, CAST(round_even(h * least(1.0, 480.0 / h) / 2, 0) * 2 AS INTEGER) AS out_h
    FROM (SELECT CAST(floor(x2) AS INTEGER) + 300 AS w, CAST(y2 AS INTEGER) + 200 AS h FROM v_det) AS t""")
def _p2(det):
    rows = det.select((F.floor("x2").cast("int") + 300).alias("w"), (F.col("y2").cast("int") + 200).alias("h")).distinct()
    return rows.withColumn("o", boxes.output_size(F.col("w"), F.col("h"), 480)).select("w", "h", F.col("o.width").alias("out_w"), F.col("o.height").alias("out_h"))


@query("p3_scale_calibration", "v_det", sql=f"""
    SELECT camera_id, pos AS at, round(v * CASE WHEN pos < 4 THEN 0.5 WHEN pos < 8 THEN 0.25 ELSE 1.0 END, 6) AS v
    FROM (SELECT camera_id, SEQ(12) AS pos, unnest({MATRIX}) AS v FROM (SELECT DISTINCT camera_id FROM v_det))""")
def _p3(det):
    rows = calib_df(det).select("camera_id", F.posexplode(boxes.scale_calibration(F.col("p"), 0.5, 0.25)).alias("at", "v"))
    return rows.select("camera_id", "at", _r("v", 6))


@query("p4_foot_point", "v_det", sql="SELECT camera_id, frame, track_id, floor((x1 + x2) / 2 / 1280 * 1e6 + 0.3) AS foot_x, floor(y2 / 720 * 1e6 + 0.3) AS foot_y FROM v_det")
def _p4(det):
    return boxes.foot_point(det, WIDTH, HEIGHT).select("camera_id", "frame", "track_id", *[F.floor(F.col(c) * 1e6 + 0.3).cast("double").alias(c) for c in ("foot_x", "foot_y")])


@query("p5_min_height", "v_det", sql="SELECT camera_id, frame, track_id FROM v_det WHERE y2 - y1 >= 140")
def _p5(det):
    return boxes.filter_min_height(det, 140).select("camera_id", "frame", "track_id")


# shares of the frame as whole numbers of 1e-4: x1 is a whole number of halves, so x1 / 1280 is a * 125 / 32 of
# them, which can lie halfway; y / 720 is y * 125 / 9 and cannot
@query("p6_normalize_boxes", "v_det", sql="""
    SELECT camera_id, track_id, frame, (DIV(a | 32) + CASE WHEN a % 32 > 16 OR (a % 32 = 16 AND DIV(a | 32) % 2 = 1) THEN 1 ELSE 0 END) / 1e4 AS x1,
           DIV(b * 250 + 9 | 18) / 1e4 AS y1, DIV(c * 250 + 9 | 18) / 1e4 AS y2
    FROM (SELECT *, CAST(x1 * 2 AS BIGINT) * 125 AS a, CAST(y1 AS BIGINT) AS b, CAST(y2 AS BIGINT) AS c FROM v_det) AS t""")
def _p6(det):
    return boxes.normalize_boxes(det, WIDTH, HEIGHT).select("camera_id", "track_id", "frame", "x1", "y1", "y2")


@query("p7_head_box", "v_det", sql="""
    SELECT camera_id, track_id, frame, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.1) AS INTEGER)) AS head_x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.1) AS INTEGER)) AS head_y1,
           least(1280, CAST(ceil(x2 + (x2 - x1) * 0.1) AS INTEGER)) AS head_x2, least(720, CAST(ceil(y1 + (y2 - y1) * 0.24) AS INTEGER)) AS head_y2 FROM v_det""")
def _p7(det):
    return boxes.head_box(det, WIDTH, HEIGHT).select("camera_id", "track_id", "frame", "head_x1", "head_y1", "head_x2", "head_y2")


@query("p7_head_region", "v_det", sql="""
    SELECT camera_id, track_id, frame, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.15) AS INTEGER)) AS region_x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.1) AS INTEGER)) AS region_y1,
           least(1280, CAST(trunc(x2 + (x2 - x1) * 0.15) AS INTEGER)) AS region_x2, least(720, CAST(trunc(y1 + (y2 - y1) * 0.45) AS INTEGER)) AS region_y2 FROM v_det""")
def _p7c(det):
    return boxes.head_region(det, WIDTH, HEIGHT).select("camera_id", "track_id", "frame", "region_x1", "region_y1", "region_x2", "region_y2")


@query("p7_plate_expand", "v_det", sql="""
    SELECT camera_id, track_id, frame, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.05) AS INTEGER)) AS plate_x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.05) AS INTEGER)) AS plate_y1,
           least(1280, CAST(trunc(x2 + (x2 - x1) * 0.05) AS INTEGER)) AS plate_x2, least(720, CAST(trunc(y2 + (y2 - y1) * 0.05) AS INTEGER)) AS plate_y2 FROM v_det WHERE label = 'car'""")
def _p7d(det):
    return boxes.plate_expand(boxes.filter_labels(det, ["car"]), WIDTH, HEIGHT).select("camera_id", "track_id", "frame", "plate_x1", "plate_y1", "plate_x2", "plate_y2")


@query("p7_crop_box", "v_det", sql="""
    SELECT camera_id, track_id, frame, CAST(trunc(least(greatest(x1, 0), 1280)) AS INTEGER) AS x1, CAST(trunc(least(greatest(y1, 0), 720)) AS INTEGER) AS y1,
           CAST(trunc(least(greatest(x2, 0), 1280)) AS INTEGER) AS x2, CAST(trunc(least(greatest(y2, 0), 720)) AS INTEGER) AS y2
    FROM v_det WHERE trunc(least(x2, 1280)) > trunc(least(x1, 1280)) AND trunc(least(y2, 720)) > trunc(least(y1, 720))""")
def _p7b(det):
    return boxes.crop_box(det, WIDTH, HEIGHT).select("camera_id", "track_id", "frame", "x1", "y1", "x2", "y2")


@query("p8_frame_ts", "v_det", sql="SELECT camera_id, track_id, frame, 1000 + frame / 30.0e0 AS ts FROM v_det")
def _p8(det):
    return boxes.frame_ts(det, 30.0, 1000.0).select("camera_id", "track_id", "frame", "ts")


@query("p9_should_blur", "v_tracks", sql="SELECT role, coalesce(role, 'pending') IN ('unknown', 'pending') AS blur, count(*) AS n FROM v_tracks GROUP BY ALL")
def _p9(tr):
    return tr.groupBy("role", fn.should_blur(F.col("role")).alias("blur")).agg(F.count("*").alias("n"))


@query("p10_filter_labels", "v_det", sql="SELECT camera_id, track_id, frame FROM v_det WHERE label IN ('car', 'truck')")
def _p10(det):
    return boxes.filter_labels(det, ["car", "truck"]).select("camera_id", "track_id", "frame")


# --- plates (the layouts' fit as SQL, used by several oracles)

_LAYOUTS = [(f"standard{d}{s}", "standard", [("L", 2), ("D", d), ("L", s), ("D", 4)]) for d in (1, 2) for s in range(4)] + [(f"bh{t}", "bh", [("D", 2), ("B", 2), ("D", 4), ("L", t)]) for t in (1, 2)]


def _plate_sql(source: str, text: str, keep: str) -> str:
    """SQL for normalize_plate: rows of `source` with plate, kind, corrections, valid_state."""
    tries = []
    for turn, (_, kind, parts) in enumerate(_LAYOUTS):
        at, fixed, cost, good = 1, [], [], []
        for p, n in parts:
            if not n:
                continue
            piece = f"substring(s, {at}, {n})"
            at += n
            if p == "B":
                good.append(f"({piece} IN ('BH', '8H'))")
                fixed.append("'BH'")
                cost.append(f"CASE WHEN {piece} = '8H' THEN 1 ELSE 0 END")
            else:
                swap = fn.READ_AS_LETTER if p == "L" else fn.READ_AS_DIGIT
                cls = "[A-Z]" if p == "L" else "[0-9]"
                f = f"translate({piece}, '{swap[0]}', '{swap[1]}')"
                good.append(f"regexp_replace({f}, '{cls}', '', 'g') = ''")
                fixed.append(f)
                cost.append(f"length(regexp_replace({piece}, '{cls}', '', 'g'))")
        whole = " || ".join(fixed)
        states = ", ".join(f"'{x}'" for x in fn.STATE_CODES)
        penalty = "0" if kind == "bh" else f"CASE WHEN substring({whole}, 1, 2) IN ({states}) THEN 0 ELSE 1 END"
        tries.append(f"CASE WHEN length(s) = {at - 1} AND {' AND '.join(good)} THEN {{'cost': {' + '.join(cost)}, 'penalty': {penalty}, 'turn': {turn}, 'plate': {whole}, 'kind': '{kind}'}} END")
    return f"""
        SELECT {keep}, coalesce(b.plate, s) AS plate, coalesce(b.kind, 'invalid') AS kind, coalesce(b.cost, 0) AS corrections, coalesce(b.penalty = 0, FALSE) AS valid_state
        FROM (SELECT *, list_min(list_filter([{', '.join(tries)}], lambda x: x IS NOT NULL)) AS b
              FROM (SELECT *, regexp_replace(upper({text}), '[^A-Z0-9]', '', 'g') AS s FROM {source}) AS c) AS n"""


@query("f1_clean_plate", "v_reads", sql="SELECT track_id, frame, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS cleaned FROM v_reads")
def _f1(reads):
    return reads.select("track_id", "frame", fn.clean_plate(F.col("text")).alias("cleaned"))


@query("f2_normalize_plate", "v_reads", sql=_plate_sql("v_reads", "text", "track_id, frame"))
def _f2(reads):
    rows = reads.withColumn("p", fn.normalize_plate(F.col("text")))
    return rows.select("track_id", "frame", F.col("p.text").alias("plate"), "p.kind", "p.corrections", "p.valid_state")


@query("f3_levenshtein", "v_reads", sql="SELECT track_id, frame, least(levenshtein(text, label), 3) AS distance FROM v_reads")
def _f3(reads):
    return reads.select("track_id", "frame", fn.bounded_levenshtein(F.col("text"), F.col("label"), 2).alias("distance"))


@query("p11_filter_reads", "v_reads", sql=f"""
    WITH n AS ({_plate_sql('v_reads', 'text', 'camera_id, track_id, frame, min_char_conf')})
    SELECT camera_id, track_id, frame, plate FROM n WHERE min_char_conf >= 0.4 AND kind <> 'invalid'""")
def _p11(reads):
    return plates.filter_reads(reads).select("camera_id", "track_id", "frame", "plate")


@query("a4_plate_vote", "v_reads", sql=f"""
    WITH n AS (SELECT * FROM ({_plate_sql('v_reads', 'text', 'camera_id, track_id, frame, text, conf, min_char_conf')}) WHERE min_char_conf >= 0.4 AND kind <> 'invalid'),
    p AS (SELECT camera_id, track_id, plate, sum(conf) AS weight, count(*) AS reads, min(frame) AS first, avg(conf) AS mean_conf FROM n GROUP BY ALL),
    b AS (SELECT *, sum(weight) OVER (PARTITION BY camera_id, track_id) AS total,
                 row_number() OVER (PARTITION BY camera_id, track_id ORDER BY weight DESC, reads DESC, first, plate DESC) AS place FROM p),
    r AS (SELECT camera_id, track_id, string_agg(text, ',' ORDER BY frame, text) AS raw_texts FROM (
            SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame, text) AS turn FROM n) WHERE turn <= 5 GROUP BY ALL)
    SELECT camera_id, track_id, plate, reads, round(weight / total, 4) AS share, round(weight / total * mean_conf, 4) AS confidence, raw_texts
    FROM b JOIN r USING (camera_id, track_id) WHERE place = 1""")
def _a4(reads):
    out = plates.plate_vote(plates.filter_reads(reads))
    return out.select("camera_id", "track_id", "plate", "reads", _r("share"), _r("confidence"), "raw_texts")


@query("w8_plate_decisions", "v_reads", sql=f"""
    WITH n AS (SELECT camera_id, track_id, frame, conf, CASE WHEN kind <> 'invalid' THEN plate END AS plate
               FROM ({_plate_sql('v_reads', 'text', 'camera_id, track_id, frame, conf, min_char_conf')}) WHERE min_char_conf >= 0.4),
    t AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame, plate) AS turn FROM n),
    s AS (SELECT * FROM t WHERE turn <= 20 AND plate IS NOT NULL),
    v AS (SELECT a.camera_id, a.track_id, a.turn AS upto, a.frame AS at_frame, b.plate, sum(b.conf) AS weight, count(*) AS n, min(b.turn) AS first
          FROM s a JOIN s b ON a.camera_id = b.camera_id AND a.track_id = b.track_id AND b.turn <= a.turn GROUP BY ALL),
    l AS (SELECT *, sum(weight) OVER w AS total, row_number() OVER (PARTITION BY camera_id, track_id, upto ORDER BY weight DESC, n DESC, first) AS place
          FROM v WINDOW w AS (PARTITION BY camera_id, track_id, upto)),
    d AS (SELECT *, n >= 3 AND weight / total >= 0.5 AS enough FROM l WHERE place = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY enough DESC, CASE WHEN enough THEN upto ELSE -upto END) AS pick FROM d)
    SELECT camera_id, track_id, at_frame AS frame, plate, n AS reads, enough AS early FROM o WHERE pick = 1""")
def _w8(reads):
    rows = reads.where("min_char_conf >= 0.4").withColumn("p", fn.normalize_plate(F.col("text")))
    return plates.plate_decisions(rows.withColumn("plate", F.when(F.col("p.kind") != "invalid", F.col("p.text"))))


@query("j7_registry_match", "v_reads", "v_vehicles", sql="""
    WITH q AS (SELECT DISTINCT label AS plate FROM v_reads), v AS (SELECT DISTINCT plate AS matched FROM v_vehicles),
    m AS (SELECT q.plate, v.matched, levenshtein(q.plate, v.matched) AS distance FROM q JOIN v ON substring(q.plate, 1, 4) = substring(v.matched, 1, 4) OR substring(q.plate, 6, 5) = substring(v.matched, 6, 5)
          OR q.plate = v.matched WHERE levenshtein(q.plate, v.matched) <= 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY distance, matched) AS place FROM m)
    SELECT q.plate, matched, distance, CASE WHEN distance = 0 THEN 'registered' WHEN distance = 1 THEN 'likely_registered' ELSE 'unregistered' END AS status
    FROM q LEFT JOIN (SELECT * FROM b WHERE place = 1) b ON q.plate = b.plate""")
def _j7(reads, vehicles):
    return plates.registry_match(reads.select(F.col("label").alias("plate")).distinct(), vehicles)


@query("a14_plate_text_metrics", "v_reads", sql=f"""
    WITH n AS ({_plate_sql('v_reads', 'text', 'label, text')})
    SELECT count(*) AS n, round(avg(CASE WHEN plate = label THEN 1.0 ELSE 0.0 END), 6) AS exact,
           round(avg(CASE WHEN regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') = label THEN 1.0 ELSE 0.0 END), 6) AS exact_raw,
           round(1 - sum(levenshtein(plate, label)) / sum(length(label)), 6) AS char_accuracy, round(avg(CASE WHEN kind <> 'invalid' THEN 1.0 ELSE 0.0 END), 6) AS valid_rate FROM n""")
def _a14(reads):
    m = plates.plate_text_metrics(reads)
    return m.select("n", *[_r(c, 6) for c in ("exact", "exact_raw", "char_accuracy", "valid_rate")])


@query("x13_training_mix", "v_reads", "v_vehicles", sql="""
    WITH s AS (SELECT label AS plate FROM v_reads), r AS (SELECT regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') AS plate FROM v_vehicles),
    t AS (SELECT greatest(1, floor(0.3 * (SELECT count(*) FROM s) / (SELECT count(*) FROM r)))::INTEGER AS times)
    SELECT plate, count(*) AS n FROM (SELECT plate FROM s UNION ALL SELECT plate FROM (SELECT plate, SEQ(times) AS i FROM r, t)) GROUP BY plate""")
def _x13(reads, vehicles):
    return plates.training_mix(reads.select(F.col("label").alias("plate")), vehicles.select("plate")).groupBy("plate").agg(F.count("*").alias("n"))


@query("f15_extract_plates", "documents", sql=f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') || ' seen tn 09 ab 12' || lpad((doc_id % 100)::VARCHAR, 2, '0') || ' and 22BH1234A.' AS text FROM documents),
    m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{fn.PLATE_MENTION}', 1)) AS mention FROM d)
    SELECT doc_id, plate, count(*) AS n FROM ({_plate_sql('m', 'mention', 'doc_id')}) WHERE kind <> 'invalid' GROUP BY doc_id, plate""")
def _f15(docs):
    rows = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" seen tn 09 ab 12"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" and 22BH1234A.")))
    return rows.select("doc_id", F.explode(fn.extract_plates(F.col("text"))).alias("plate")).groupBy("doc_id", "plate").agg(F.count("*").alias("n"))


@query("f17_vehicle_label", "v_plate_reads", sql="SELECT plate || CASE status WHEN 'registered' THEN ' reg' WHEN 'likely_registered' THEN ' verify' ELSE ' UNREG' END AS label, count(*) AS n FROM v_plate_reads GROUP BY 1")
def _f17(reads):
    return reads.groupBy(fn.vehicle_label(F.col("plate"), F.col("status")).alias("label")).agg(F.count("*").alias("n"))


# --- zones and ground


_IN_ZONE = """
    SELECT d.camera_id, d.frame, d.track_id, z.zone, z.restricted FROM (
        SELECT *, (x1 + x2) / 2 / 1280 AS fx, y2 / 720 AS fy FROM v_det WHERE frame % 5 = 0) d JOIN v_edges z USING (camera_id)
    GROUP BY ALL
    HAVING sum(CASE WHEN (ay > fy) <> (by_ > fy) AND fx < (bx - ax) * (fy - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) % 2 = 1
        OR max(CASE WHEN (bx - ax) * (fy - ay) - (by_ - ay) * (fx - ax) = 0 AND fx BETWEEN least(ax, bx) AND greatest(ax, bx) AND fy BETWEEN least(ay, by_) AND greatest(ay, by_) THEN 1 ELSE 0 END) = 1
"""


@query("j1_zone_membership", "v_det", "v_edges", sql=f"SELECT camera_id, frame, track_id, zone, restricted FROM ({_IN_ZONE.replace('GROUP BY ALL', 'GROUP BY d.camera_id, d.frame, d.track_id, z.zone, z.restricted').replace('WHERE frame % 5 = 0', '')})")
def _j1(det, edges):
    out = boxes.zone_membership(det.select("camera_id", "frame", "track_id", "x1", "x2", "y2"), zones_df(edges), WIDTH, HEIGHT)
    return out.select("camera_id", "frame", "track_id", "zone", "restricted")


_G = "((x1 + x2) / 2)"
_INV = (
    f"(({MATRIX[5]} * {MATRIX[11]} - {MATRIX[7]} * {MATRIX[9]}) * u + ({MATRIX[3]} * {MATRIX[9]} - {MATRIX[1]} * {MATRIX[11]}) * v + ({MATRIX[1]} * {MATRIX[7]} - {MATRIX[3]} * {MATRIX[5]}))",
    f"(({MATRIX[7]} * {MATRIX[8]} - {MATRIX[4]} * {MATRIX[11]}) * u + ({MATRIX[0]} * {MATRIX[11]} - {MATRIX[3]} * {MATRIX[8]}) * v + ({MATRIX[3]} * {MATRIX[4]} - {MATRIX[0]} * {MATRIX[7]}))",
    f"(({MATRIX[4]} * {MATRIX[9]} - {MATRIX[5]} * {MATRIX[8]}) * u + ({MATRIX[1]} * {MATRIX[8]} - {MATRIX[0]} * {MATRIX[9]}) * v + ({MATRIX[0]} * {MATRIX[5]} - {MATRIX[1]} * {MATRIX[4]}))",
)
_GROUND = f"SELECT *, {_INV[0].replace('.0 ', '.0e0 ')} / nullif({_INV[2]}, 0) AS gx, {_INV[1]} / nullif({_INV[2]}, 0) AS gy FROM (SELECT *, (x1 + x2) / 2 AS u, y2 AS v FROM v_det) AS t"


@query("j2_ground_positions", "v_det", sql=f"SELECT camera_id, track_id, count(*) AS n, round(avg(gx), 4) AS gx, round(avg(gy), 4) AS gy FROM ({_GROUND}) GROUP BY ALL")
def _j2(det):
    out = boxes.ground_positions(det, calib_df(det))
    return out.groupBy("camera_id", "track_id").agg(F.count("*").alias("n"), F.round(F.avg("gx"), 4).alias("gx"), F.round(F.avg("gy"), 4).alias("gy"))


_HEIGHT = f"""
    SELECT camera_id, track_id, CASE WHEN y1 > 2 AND y2 < 718 AND x1 > 2 AND x2 < 1278 AND abs({MATRIX[6]} - y1 * {MATRIX[10]}) >= 1e-9
        THEN -(({MATRIX[4]} - y1 * {MATRIX[8]}) * gx + ({MATRIX[5]} - y1 * {MATRIX[9]}) * gy + ({MATRIX[7]} - y1 * {MATRIX[11]})) / ({MATRIX[6]} - y1 * {MATRIX[10]}) * 100 END AS cm
    FROM ({_GROUND}) AS g
"""


@query("a6_track_height", "v_det", sql=f"""
    WITH h AS (SELECT camera_id, track_id, CASE WHEN cm BETWEEN 20 AND 2200 THEN cm END AS cm FROM ({_HEIGHT})),
    m AS (SELECT camera_id, track_id, median(cm) AS mid, count(cm) AS n FROM h GROUP BY ALL),
    d AS (SELECT h.camera_id, h.track_id, any_value(mid) AS mid, any_value(n) AS n, median(abs(cm - mid)) AS mad FROM h JOIN m USING (camera_id, track_id) GROUP BY ALL)
    SELECT camera_id, track_id, CASE WHEN n >= 3 THEN round(mid, 1) END AS height_cm, CASE WHEN n >= 3 THEN round(greatest(mad * 1.4826, 2.0), 1) END AS error_cm FROM d""")
def _a6(det):
    return boxes.track_height(det, calib_df(det), 20.0, 2200.0)


@query("f13_height_m", "v_det", sql=f"SELECT camera_id, track_id, frame, round(cm, 3) AS cm FROM ({_HEIGHT.replace('track_id,', 'track_id, frame,')})")
def _f13(det):
    rows = det.join(calib_df(det), "camera_id").withColumn("cm", fn.height_m(F.col("p"), *fn.box(), F.col("width"), F.col("height")) * 100)
    return rows.select("camera_id", "track_id", "frame", _r("cm", 3))


@query("f10_project_round_trip", "v_det", sql=f"SELECT camera_id, track_id, frame, CASE WHEN gx IS NOT NULL THEN CAST(0.0 AS DOUBLE) END AS error FROM ({_GROUND})")
def _f10(det):
    rows = boxes.ground_positions(det, calib_df(det)).join(calib_df(det), "camera_id")
    rows = rows.withColumn("q", fn.project(F.col("p"), F.col("gx"), F.col("gy"), F.lit(0.0)))
    off = F.abs(F.col("q.u") - (F.col("x1") + F.col("x2")) / 2) + F.abs(F.col("q.v") - F.col("y2"))
    return rows.select("camera_id", "track_id", "frame", F.abs(F.round(off, 5)).alias("error"))


# boxes of a frame meet by equal keys alone; whether they overlap is asked of the result
_PAIRS = """
    WITH met AS MATERIALIZED (
        SELECT g.camera_id, g.frame, g.id AS gt_id, p.id AS pred_id, g.x1, g.y1, g.x2, g.y2, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2
        FROM v_gt g JOIN v_pred p ON g.camera_id = p.camera_id AND g.frame = p.frame
    ), inside AS (
        SELECT *, greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1)) AS shared FROM met
    )
    SELECT camera_id, frame, gt_id, pred_id, shared / greatest((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - shared, 1e-9) AS iou FROM inside WHERE shared > 0
"""


@query("j3_iou_pairs", "v_gt", "v_pred", sql=f"SELECT camera_id, frame, gt_id, pred_id, round(iou, 5) AS iou FROM ({_PAIRS}) WHERE iou >= 0.5")
def _j3(gt, pred):
    return boxes.iou_pairs(gt, pred).select("camera_id", "frame", "gt_id", "pred_id", _r("iou", 5))


@query("f9_iou", "v_gt", "v_pred", sql=f"SELECT camera_id, frame, gt_id, pred_id, round(iou, 5) AS iou FROM ({_PAIRS}) WHERE iou >= 0.3")
def _f9(gt, pred):
    return boxes.iou_pairs(gt, pred, 0.3).select("camera_id", "frame", "gt_id", "pred_id", _r("iou", 5))


@query("j4_crop_quality", "v_det", sql="""
    WITH met AS MATERIALIZED (
        SELECT d.*, o.track_id AS o_track, o.x1 AS ox1, o.y1 AS oy1, o.x2 AS ox2, o.y2 AS oy2 FROM v_det d JOIN v_det o ON d.camera_id = o.camera_id AND d.frame = o.frame
    ), h AS (SELECT camera_id, frame, track_id, max(greatest(0, least(x2, ox2) - greatest(x1, ox1)) * greatest(0, least(y2, oy2) - greatest(y1, oy1)) / ((x2 - x1) * (y2 - y1))) AS hidden
               FROM met WHERE track_id <> o_track GROUP BY ALL)
    SELECT d.camera_id, d.frame, d.track_id, floor(least(greatest((y2 - y1 - 64) / 192, 0), 1) * conf * CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 1278 OR y2 >= 718 THEN 0.5 ELSE 1 END
        * CASE WHEN (x2 - x1) / (y2 - y1) BETWEEN 0.25 AND 0.65 THEN 1 ELSE 0.5 END * greatest(0, 1 - coalesce(hidden, 0)) * 1e6 + 0.2718) AS quality
    FROM v_det d LEFT JOIN h USING (camera_id, frame, track_id)""")
def _j4(det):
    return boxes.crop_quality(det, WIDTH, HEIGHT).select("camera_id", "frame", "track_id", F.floor(F.col("quality") * 1e6 + 0.2718).cast("double").alias("quality"))


@query("j11_nearest_position", "v_obs", sql="""
    WITH a AS (SELECT DISTINCT zone AS key, ts FROM v_obs WHERE role = 'unknown'), b AS (SELECT zone AS key, ts AS b_ts, min(CAST(event_id AS DOUBLE)) AS x FROM v_obs WHERE role = 'resident' GROUP BY ALL),
    m AS (SELECT a.*, b_ts, x, row_number() OVER (PARTITION BY a.key, ts ORDER BY abs(ts - b_ts), b_ts) AS place FROM a JOIN b ON a.key = b.key AND b_ts BETWEEN ts - 600 AND ts + 600)
    SELECT key, ts, b_ts, x FROM m WHERE place = 1""")
def _j11(obs):
    a = obs.where("role = 'unknown'").select(F.col("zone").alias("key"), "ts").distinct()
    b = obs.where("role = 'resident'").groupBy(F.col("zone").alias("key"), "ts").agg(F.min(F.col("event_id").cast("double")).alias("x")).withColumn("y", F.lit(0.0))
    return boxes.nearest_position(a, b, 600.0).drop("y")


@query("j16_travel_feasible", "v_samples", sql="""
    WITH s AS (SELECT gid, ts, lag(ts) OVER w AS t0, sample_id % 13 AS x, lag(sample_id % 13) OVER w AS x0, sample_id % 17 AS y, lag(sample_id % 17) OVER w AS y0 FROM v_samples WINDOW w AS (PARTITION BY gid ORDER BY ts))
    SELECT gid, ts, NOT (ts - t0 > 1 AND sqrt((x - x0) ** 2 + (y - y0) ** 2) / (ts - t0) > 0.2) AS ok FROM s WHERE t0 IS NOT NULL""")
def _j16(samples):
    from pyspark.sql import Window

    w = Window.partitionBy("gid").orderBy("ts")
    x, y = F.col("sample_id") % 13, F.col("sample_id") % 17
    rows = samples.select("gid", "ts", F.lag("ts").over(w).alias("t0"), x.alias("x"), F.lag(x).over(w).alias("x0"), y.alias("y"), F.lag(y).over(w).alias("y0")).where("t0 is not null")
    return rows.select("gid", "ts", boxes.travel_feasible(F.col("t0"), F.col("x0"), F.col("y0"), F.col("ts"), F.col("x"), F.col("y"), 0.2).alias("ok"))


# --- presences and alerts

_MARKED = f"""
    m0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > {GAP} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM v_obs WINDOW w AS (PARTITION BY person, zone ORDER BY ts)),
    m1 AS (SELECT *, sum(fresh) OVER (PARTITION BY person, zone ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS presence FROM m0),
    marked AS (SELECT *, min(ts) OVER p AS entered, ts - min(ts) OVER p AS dwell FROM m1 WINDOW p AS (PARTITION BY person, zone, presence))
"""
_LOCAL = "CAST((ts + 19800) % 86400 AS BIGINT)"
_TAIL = f"""
    e AS (SELECT DISTINCT person, zone, presence, ts, role FROM marked WHERE ts = entered),
    t AS (SELECT DISTINCT e.* FROM e JOIN e h ON e.zone = h.zone AND e.person <> h.person AND h.role IN ('resident', 'staff') AND e.ts - h.ts BETWEEN 0 AND {TAILGATE})
"""
_TRIGGERS = f"""
    c AS (
        SELECT 'unknown' AS rule, 'high' AS severity, person, zone, presence, ts, role, dwell FROM marked WHERE restricted AND role = 'unknown'
        UNION ALL SELECT 'loiter', 'medium', person, zone, presence, ts, role, dwell FROM marked WHERE role = 'unknown' AND dwell >= {DWELL}
        UNION ALL SELECT 'night', 'low', person, zone, presence, ts, role, dwell FROM marked WHERE zone = 'a' AND role IN ('resident', 'unknown') AND ({_LOCAL} >= 79200 OR {_LOCAL} < 21600)
        UNION ALL SELECT 'tail', 'high', m.person, m.zone, m.presence, m.ts, m.role, m.dwell FROM marked m JOIN t USING (person, zone, presence, ts, role) WHERE m.ts = m.entered AND m.role = 'unknown'),
    fired AS (SELECT rule, severity, person, zone, presence, ts, role, round(dwell, 1) AS dwell FROM (
        SELECT *, row_number() OVER (PARTITION BY rule, person, zone, presence ORDER BY ts, role, dwell) AS place FROM c) WHERE place = 1)
"""
_KEPT = f"""
    u AS (SELECT rule, person, list(DISTINCT ts ORDER BY ts) AS all_ts FROM fired GROUP BY ALL),
    k AS (SELECT rule, person, unnest(list_reduce([[x] for x in all_ts], lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= {COOLDOWN} THEN acc || x ELSE acc END)) AS ts FROM u),
    kept AS (SELECT * EXCLUDE (place) FROM (SELECT f.*, row_number() OVER (PARTITION BY f.rule, f.person, f.ts ORDER BY f.severity, f.zone, f.presence, f.role, f.dwell) AS place FROM fired f JOIN k USING (rule, person, ts)) WHERE place = 1)
"""


@query("w1_presences", "v_obs", sql=f"WITH {_MARKED} SELECT person, zone, presence, min(ts) AS entered, max(ts) AS last, count(*) AS observations FROM marked GROUP BY ALL")
def _w1(obs):
    return presence.presences(obs, GAP)


@query("j8_tailgating", "v_obs", sql=f"WITH {_MARKED}, {_TAIL} SELECT * FROM t")
def _j8(obs):
    return presence.tailgating_entries(presence.mark_presences(obs, GAP), TAILGATE)


@query("w2_first_triggers", "v_obs", sql=f"WITH {_MARKED}, {_TAIL}, {_TRIGGERS} SELECT * FROM fired")
def _w2(obs):
    return presence.first_triggers(presence.mark_presences(obs, GAP), RULES)


@query("w4_alerts", "v_obs", sql=f"WITH {_MARKED}, {_TAIL}, {_TRIGGERS}, {_KEPT} SELECT * FROM kept")
def flagship(obs):
    return presence.alerts(obs, RULES, GAP, COOLDOWN)


@query("w3_cooldown", "v_alerts", sql="""
    WITH u AS (SELECT rule, gid, list(DISTINCT ts ORDER BY ts) AS all_ts FROM v_alerts GROUP BY ALL),
    k AS (SELECT rule, gid, unnest(list_reduce([[x] for x in all_ts], lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 86400 THEN acc || x ELSE acc END)) AS ts FROM u)
    SELECT rule, gid, ts, min(event_id) AS event_id FROM v_alerts JOIN k USING (rule, gid, ts) GROUP BY ALL""")
def _w3(alerts):
    return presence.cooldown(alerts.select("rule", "gid", "ts", "event_id"), ["rule", "gid"], 86400.0)


@query("a16_incident_tally", "v_obs", sql=f"""
    WITH {_MARKED}, {_TAIL}, {_TRIGGERS}, {_KEPT},
    s AS (SELECT person, zone, presence, min(ts) AS entered, max(ts) AS last FROM marked GROUP BY ALL),
    i AS (SELECT rule, person, zone, s.presence, count(*) AS n FROM kept k JOIN s USING (person, zone) WHERE ts BETWEEN entered AND last GROUP BY ALL),
    g AS (SELECT rule, ts - lag(ts) OVER (PARTITION BY rule, person ORDER BY ts) AS gap FROM kept)
    SELECT i.rule, count(*) AS incidents, sum(n)::BIGINT AS alerts, count(*) FILTER (n > 1) AS alerted_twice, (SELECT count(*) FILTER (gap < {COOLDOWN}) FROM g WHERE g.rule = i.rule) AS cooldown_violations FROM i GROUP BY i.rule""")
def _a16(obs):
    marked = presence.mark_presences(obs, GAP)
    return presence.incident_tally(marked, presence.alerts(obs, RULES, GAP, COOLDOWN), COOLDOWN)


@query("f4_in_window", "v_obs", sql=f"SELECT event_id, ({_LOCAL} >= 79200 OR {_LOCAL} < 21600) AS night FROM v_obs")
def _f4(obs):
    return obs.select("event_id", fn.in_window(fn.local_seconds(F.col("ts")), 79200, 21600).alias("night"))


@query("f14_event_payload", "v_obs", sql="""
    SELECT event_id, '{"zone":"' || zone || '","role":"' || role || '","track_id":' || event_id || ',"rule_type":"loitering","global_id":"' || person || '"}' AS payload FROM v_obs""")
def _f14(obs):
    none = F.lit(None).cast("double")
    return obs.select("event_id", fn.event_payload(F.lit("loitering"), F.col("zone"), F.col("role"), F.col("event_id"), none, F.col("person")).alias("payload"))


@query("x5_rule_zones", "v_edges", sql="""
    SELECT DISTINCT r.rule, e.camera_id, e.zone FROM (VALUES ('own', ['yard', 'nowhere']), ('all', CAST([] AS VARCHAR[]))) AS r(rule, zones) JOIN v_edges e
    ON list_contains(r.zones, e.zone) OR (len(r.zones) = 0 AND e.restricted)""")
def _x5(edges):
    rules = edges.sparkSession.createDataFrame([("own", ["yard", "nowhere"]), ("all", [])], "rule string, zones array<string>")
    return presence.rule_zones(rules, edges.select("camera_id", "zone", "restricted").distinct())


# --- tracks


_FOLD = "list_reduce([[x] for x in all_f], lambda acc, x: CASE WHEN x[1] < acc[len(acc)] OR x[1] - acc[len(acc)] >= {n} THEN acc || x ELSE acc END)"


@query("w5_thin", "v_det", sql=f"""
    WITH u AS (SELECT camera_id, track_id, list(DISTINCT frame ORDER BY frame) AS all_f FROM v_det GROUP BY ALL)
    SELECT camera_id, track_id, unnest({_FOLD.format(n=5)}) AS frame FROM u""")
def _w5(det):
    return tracks.thin(det, ["camera_id", "track_id"], "frame", 5).select("camera_id", "track_id", "frame")


@query("w6_segment_tracks", "v_det", sql="""
    WITH g AS (SELECT camera_id, track_id, frame, CASE WHEN frame - lag(frame) OVER w > 1 OR lag(frame) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM v_det WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame)),
    p AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_id, track_id ORDER BY frame) AS part FROM g),
    u AS (SELECT camera_id, track_id, part, list(DISTINCT frame ORDER BY frame) AS all_f FROM p GROUP BY ALL),
    f AS (SELECT camera_id, track_id, part, list_reduce([[x] for x in all_f], lambda acc, x: CASE WHEN (x[1] - acc[len(acc)]) / 30.0 > 0.25 THEN acc || x ELSE acc END) AS starts FROM u),
    s AS (SELECT p.camera_id, p.track_id, p.frame, f.part, list_max(list_filter(starts, lambda y: y <= frame)) AS start FROM p JOIN f USING (camera_id, track_id, part)),
    l AS (SELECT *, (max(frame) OVER (PARTITION BY camera_id, track_id, start) - start) / 30.0 AS len_s FROM s)
    SELECT camera_id, track_id, frame, dense_rank() OVER (PARTITION BY camera_id, track_id ORDER BY start) AS segment FROM l WHERE len_s >= 0.2""")
def _w6(det):
    out = tracks.segment_tracks(det, 30.0, grace=0, longest_s=0.25, least_s=0.2)
    return out.select("camera_id", "track_id", "frame", "segment")


@query("w7_best_crops", "v_crops", sql="""
    SELECT camera_id, track_id, frame, place FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY quality DESC, frame) AS place FROM v_crops WHERE quality > 0) WHERE place <= 3""")
def _w7(crops):
    return tracks.best_crops(crops, 3).select("camera_id", "track_id", "frame", "place")


@query("a5_color_vote", "v_crops", sql="""
    WITH p AS (SELECT camera_id, track_id, color, sum(round(quality, 2) * round(share, 2)) AS w FROM v_crops WHERE color <> 'unknown' GROUP BY ALL),
    b AS (SELECT *, sum(w) OVER (PARTITION BY camera_id, track_id) AS total, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY w DESC, color DESC) AS place FROM p)
    SELECT camera_id, track_id, color, round(w / nullif(total, 0), 5) AS share FROM b WHERE place = 1 AND total > 0""")
def _a5(crops):
    out = tracks.color_vote(crops.withColumns({"quality": F.round("quality", 2), "share": F.round("share", 2)}))
    return out.where("share is not null").select("camera_id", "track_id", "color", _r("share", 5))


@query("f5_hsv_to_name", "v_crops", sql="""
    SELECT camera_id, track_id, frame, h, s, v, CASE WHEN v / 255 < 0.22 THEN 'black' WHEN s / 255 < 0.18 THEN CASE WHEN v / 255 > 0.78 THEN 'white' WHEN v / 255 > 0.3 THEN 'gray' ELSE 'black' END
        WHEN h * 2 < 12 OR h * 2 >= 340 THEN CASE WHEN s / 255 < 0.45 AND v / 255 > 0.6 THEN 'pink' ELSE 'red' END WHEN h * 2 < 40 THEN CASE WHEN v / 255 < 0.6 THEN 'brown' ELSE 'orange' END
        WHEN h * 2 < 70 THEN CASE WHEN v / 255 < 0.45 THEN 'brown' ELSE 'yellow' END WHEN h * 2 < 165 THEN 'green' WHEN h * 2 < 255 THEN 'blue' WHEN h * 2 < 290 THEN 'purple' ELSE 'pink' END AS name FROM v_crops""")
def _f5(crops):
    return crops.select("camera_id", "track_id", "frame", "h", "s", "v", fn.hsv_to_name(F.col("h"), F.col("s"), F.col("v")).alias("name"))


@query("f6_face_quality", "v_crops", sql="""
    SELECT camera_id, track_id, frame, round(share / 10 * least(greatest((v - 24) / 56, 0), 1) * coalesce(least(greatest(1 - abs(h - (s + s + 20) / 2) / 20, 0.2), 1), 1), 8) AS quality FROM v_crops""")
def _f6(crops):
    q = fn.face_quality(F.col("share") / 10, F.col("v"), F.col("s"), F.col("s") + 20, F.col("h"))
    return crops.select("camera_id", "track_id", "frame", F.round(q, 8).alias("quality"))


_EMB = """
    SELECT {keys}, pos, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY {keys})), 1e-12), 5) + 0.0e0 AS v FROM (
        SELECT {keys}, pos, sum({w} * e) AS v FROM (SELECT *, unnest(emb)::DOUBLE AS e, SEQ(len(emb)) AS pos FROM {src}) GROUP BY ALL)
"""


def _spread(df: DataFrame, keys: list[str], emb: str = "emb") -> DataFrame:
    return df.select(*keys, F.posexplode(emb).alias("pos", "v")).select(*keys, "pos", _r("v", 5))


@query("a7_sighting_embedding", "v_samples", sql=_EMB.format(keys="camera_id, track_id", w="greatest(quality, 1e-3)", src="(SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY quality DESC, frame) AS place FROM v_samples QUALIFY place <= 10)"))
def _a7(samples):
    return _spread(tracks.sighting_embedding(samples), ["camera_id", "track_id"])


@query("a8_track_embeddings", "v_samples", sql=f"""
    WITH c AS ({_EMB.format(keys='camera_id, track_id', w='1.0', src='(SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY quality DESC, frame) AS place FROM v_samples WHERE quality > 0 QUALIFY place <= 3)')}),
    b AS ({_EMB.format(keys='camera_id, track_id', w='1.0', src="(SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame) AS place FROM v_samples WHERE kind = 'body' QUALIFY place <= 30)")})
    SELECT camera_id, track_id, pos, c.v AS clip, b.v AS body FROM c FULL JOIN b USING (camera_id, track_id, pos)""")
def _a8(samples):
    out = tracks.track_embeddings(samples, samples.where("kind = 'body'"))
    keys = ["camera_id", "track_id"]
    clip, body = _spread(out, keys, "clip").withColumnRenamed("v", "clip"), _spread(out, keys, "body").withColumnRenamed("v", "body")
    return clip.join(body, [*keys, "pos"], "full")


@query("a20_segment_summary", "v_det", "v_tracks", sql="""
    WITH r AS (SELECT d.camera_id, d.track_id, d.frame, d.frame / 30.0e0 AS ts, d.conf AS quality, CASE WHEN d.frame % 2 = 0 THEN t.gid END AS gid, t.role, CASE WHEN d.x1 < 400 THEN 'left' ELSE 'right' END AS zone FROM v_det d JOIN v_tracks t USING (track_id))
    SELECT camera_id, track_id, min(ts) AS start_ts, max(ts) AS end_ts, min(frame) AS start_frame, max(frame) AS end_frame, array_to_string(list(DISTINCT zone ORDER BY zone), ',') AS zones, max(quality) AS quality,
           arg_max(gid, frame) FILTER (gid IS NOT NULL) AS gid, arg_max(role, frame) FILTER (gid IS NOT NULL) AS role FROM r GROUP BY ALL""")
def _a20(det, tr):
    rows = det.join(tr.select("track_id", "gid", "role"), "track_id").withColumns({
        "ts": F.col("frame") / 30.0, "quality": F.col("conf"), "gid": F.when(F.col("frame") % 2 == 0, F.col("gid")), "zone": F.when(F.col("x1") < 400, "left").otherwise("right")})
    return tracks.segment_summary(rows, ["camera_id", "track_id"]).withColumn("zones", F.array_join("zones", ","))


@query("w12_sightings", "v_samples", sql="""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY ts) AS place FROM v_samples)
    SELECT camera_id, track_id, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + 2 AS end_ts, min(CASE WHEN place = 3 THEN ts END) AS assign_ts, count(*) AS n_samples FROM n GROUP BY ALL""")
def _w12(samples):
    det = samples.withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0)})
    return tracks.sightings(det, samples).select("camera_id", "track_id", "first_ts", "last_ts", "end_ts", "assign_ts", "n_samples")


@query("j15_attach_samples", "v_samples", sql="""
    SELECT camera_id, frame, track_id, quality FROM v_samples UNION ALL SELECT camera_id, -1 - frame, track_id, NULL FROM v_samples""")
def _j15(samples):
    det = samples.select("camera_id", "frame", "track_id")
    det = det.unionByName(det.withColumn("frame", -1 - F.col("frame")))  # as many rows without a sample
    return tracks.attach_samples(det, samples.select("camera_id", "frame", "track_id", "quality"))


@query("j10_time_overlap", "v_tracks", sql="SELECT camera_id, track_id FROM v_tracks WHERE end_ts >= 8e8 AND start_ts <= 8.5e8")
def _j10(tr):
    return tr.where(tracks.time_overlap(F.col("start_ts"), F.col("end_ts"), F.lit(8e8), F.lit(8.5e8))).select("camera_id", "track_id")


# --- identities

_COS = "list_sum([x[1]::DOUBLE * x[2]::DOUBLE for x in list_zip({a}, {b})]) / greatest(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in {a}])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in {b}])), 1e-12)"
_BEST = f"""
    SELECT sample_id, gid, ts, kind, quality, person_id, sim FROM (
        SELECT s.*, g.person_id, {_COS.format(a='s.emb', b='g.emb')} AS sim, row_number() OVER (PARTITION BY sample_id ORDER BY {_COS.format(a='s.emb', b='g.emb')} DESC, person_id) AS place FROM v_samples s LEFT JOIN v_gallery g ON s.kind = g.kind) WHERE place = 1
"""


@query("j6_gallery_best_match", "v_samples", "v_gallery", sql=f"SELECT sample_id, person_id, round(sim, 5) AS sim FROM ({_BEST})")
def _j6(samples, gallery):
    return identity.gallery_best_match(samples, gallery).select("sample_id", "person_id", _r("sim", 5))


@query("f8_cosine", "v_samples", "v_gallery", sql=f"SELECT sample_id, count(*) AS n, round(max({_COS.format(a='s.emb', b='g.emb')}), 5) AS best FROM v_samples s JOIN v_gallery g ON s.kind = g.kind GROUP BY sample_id")
def _f8(samples, gallery):
    best = nearest_vectors(samples, gallery, 1, "sample_id", "vec_id", by="kind").select("sample_id", F.round("sim", 5).alias("best"))
    return samples.select("sample_id", "kind").join(gallery.groupBy("kind").agg(F.count("*").alias("n")), "kind").join(best, "sample_id").select("sample_id", "n", "best")


@query("f7_l2_normalize", "v_samples", sql=f"""
    SELECT sample_id, pos, round(e / greatest(n, 1e-12), 5) + 0.0e0 AS v FROM (SELECT sample_id, SEQ(len(emb)) AS pos, unnest(emb)::DOUBLE AS e, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in emb])) AS n FROM v_samples)""")
def _f7(samples):
    return _spread(samples.withColumn("emb", fn.l2_normalize(F.col("emb"))), ["sample_id"])


@query("f18_gallery_similarity", "v_samples", "v_gallery", sql=f"""
    SELECT sample_id, round(list_avg(list_sort(list({_COS.format(a='s.emb', b='g.emb')}), 'DESC')[1:3]), 5) AS sim FROM v_samples s JOIN v_gallery g ON s.kind = g.kind GROUP BY sample_id""")
def _f18(samples, gallery):
    rows = nearest_vectors(samples, gallery, 3, "sample_id", "vec_id", by="kind").groupBy("sample_id").agg(F.collect_list("sim").alias("sims"))
    return rows.select("sample_id", F.round(fn.gallery_similarity(F.col("sims")), 5).alias("sim"))


@query("j13_load_gallery", "v_people", "v_gallery", sql="SELECT g.person_id, g.kind, g.vec_id FROM v_gallery g JOIN v_people p USING (person_id) WHERE consent")
def _j13(people, gallery):
    return identity.load_gallery(people, gallery).select("person_id", "kind", "vec_id")


def _roles(samples, gallery, people):
    return identity.identity_roles(identity.gallery_best_match(samples, gallery), people, t_face=0.28, t_body=0.28)


@query("w9_identity_roles", "v_samples", "v_gallery", "v_people")
def _w9(samples, gallery, people):
    return _roles(samples, gallery, people)


@query("w13_role_transitions", "v_samples", "v_gallery", "v_people")
def _w13(samples, gallery, people):
    return identity.role_transitions(_roles(samples, gallery, people))


@query("w10_rescore", "v_samples", "v_gallery", "v_people")
def _w10(samples, gallery, people):
    states = _roles(samples, gallery, people).groupBy("gid").agg(F.max_by(F.struct("role", "role_person"), F.struct("ts", "observations")).alias("s"), F.max("observations").alias("observations"))
    states = states.select("gid", "s.role", "s.role_person", "observations")
    left = people.where("person_id <> 3")
    matched = identity.gallery_best_match(samples, gallery.where("person_id <> 3"))
    return identity.rescore(matched, states, left, t_face=0.28, t_body=0.28)


#: A camera's samples in so many numbers are one track; so many tracks of each camera are one site.
TRACK_RUN, SITE_RUN = 40, 10


def sightings_of(samples: DataFrame) -> DataFrame:
    """Sightings with their embeddings and site, from the samples of each camera's runs."""
    samples = samples.withColumn("track_id", F.expr(f"sample_id div {TRACK_RUN}"))
    det = samples.withColumns({"gx": F.lit(None).cast("double"), "gy": F.lit(None).cast("double")})
    from pyspark.sql import Window

    early = samples.withColumn("turn", F.row_number().over(Window.partitionBy("camera_id", "track_id").orderBy("ts"))).where("turn <= 3")
    keys = ["camera_id", "track_id"]
    rows = tracks.sightings(det, samples).join(tracks.sighting_embedding(early), keys).join(tracks.sighting_embedding(samples).withColumnRenamed("emb", "end_emb"), keys)
    return rows.withColumn("site", F.concat(F.lit("s"), F.expr(f"track_id div {SITE_RUN}")))


@query("w11_assign_global_ids", "v_samples")
def _w11(samples):
    return identity.assign_global_ids(sightings_of(samples), threshold=0.3)


@query("a17_merge_identities", "v_identities", "v_alerts", sql="""
    WITH u AS (SELECT gid, min(ts) AS u_first, max(ts) AS u_last, arg_max(CASE WHEN rule = 'click' THEN 'resident' WHEN rule = 'view' THEN 'unknown' END, {'t': ts, 'r': CASE WHEN rule = 'click' THEN 'resident' WHEN rule = 'view' THEN 'unknown' END}) FILTER (rule IN ('click', 'view')) AS u_role FROM v_alerts GROUP BY gid)
    SELECT coalesce(i.gid, u.gid) AS gid, coalesce(u_role, role_state, 'pending') AS role_state, person_id, coalesce(first_seen, u_first) AS first_seen, greatest(last_seen, u_last) AS last_seen FROM v_identities i FULL JOIN u ON i.gid = u.gid""")
def _a17(existing, alerts):
    role = F.when(F.col("rule") == "click", "resident").when(F.col("rule") == "view", "unknown")
    return identity.merge_identities(existing, alerts.select("gid", "ts", role.alias("role_state"), F.lit(None).cast("long").alias("person_id")))


@query("a21_identity_stats", "v_identities", "v_gallery", "v_plate_reads", "v_vehicles", sql="""
    SELECT 'roles' AS section, role_state AS name, count(*) AS n FROM v_identities GROUP BY ALL UNION ALL SELECT 'identities', 'global_ids', count(*) FROM v_identities
    UNION ALL SELECT 'identities', 'gallery_people', count(DISTINCT person_id) FROM v_gallery UNION ALL SELECT 'plates', 'decided', count(*) FROM (SELECT DISTINCT camera_id, plate FROM v_plate_reads)
    UNION ALL SELECT 'plates', 'registry', count(DISTINCT plate) FROM v_vehicles""")
def _a21(ids, gallery, reads, vehicles):
    return identity.identity_stats(ids, gallery, reads.select("camera_id", F.col("plate").alias("track_id")), vehicles)


# --- evaluation


@query("a1_camera_stats", "v_gt", sql="SELECT camera_id, count(*) AS boxes, count(DISTINCT id) AS ids FROM v_gt GROUP BY ALL")
def _a1(gt):
    return evaluation.camera_stats(gt)


@query("a2_identity_sets", "v_gt", sql="SELECT DISTINCT camera_id, id FROM v_gt")
def _a2(gt):
    return evaluation.identity_sets(gt)


@query("a3_dataset_summary", "v_gt", sql="""
    SELECT camera_id, count(*) AS boxes, count(DISTINCT CASE WHEN label = 'person' THEN id END) AS persons, count(DISTINCT CASE WHEN label <> 'person' THEN id END) AS vehicles, (max(frame) + 1) / 30.0e0 AS seconds,
           (SELECT count(DISTINCT id) FROM v_gt) AS identities, (SELECT count(*) FROM (SELECT id FROM v_gt GROUP BY id HAVING count(DISTINCT camera_id) > 1)) AS shared FROM v_gt GROUP BY camera_id""")
def _a3(gt):
    return evaluation.dataset_summary(gt, 30.0)


@query("x2_shared_identities", "v_gt", sql="""
    WITH i AS (SELECT DISTINCT camera_id, id FROM v_gt) SELECT a.camera_id AS camera_a, b.camera_id AS camera_b, count(*) AS shared FROM i a JOIN i b ON a.id = b.id AND a.camera_id < b.camera_id GROUP BY ALL""")
def _x2(gt):
    return evaluation.shared_identities(gt)


@query("t9_pick_cameras", "v_gt", sql="""
    WITH i AS (SELECT DISTINCT camera_id, id FROM v_gt),
    c1 AS (SELECT camera_id FROM i GROUP BY camera_id ORDER BY count(*) DESC, camera_id LIMIT 1), s1 AS (SELECT DISTINCT id FROM i WHERE camera_id IN (SELECT camera_id FROM c1)),
    c2 AS (SELECT camera_id FROM i WHERE camera_id NOT IN (SELECT camera_id FROM c1) GROUP BY camera_id ORDER BY count(CASE WHEN id IN (SELECT id FROM s1) THEN 1 END) DESC, count(*) DESC, camera_id LIMIT 1),
    c AS (SELECT camera_id FROM c1 UNION SELECT camera_id FROM c2), s2 AS (SELECT DISTINCT id FROM i WHERE camera_id IN (SELECT camera_id FROM c)),
    c3 AS (SELECT camera_id FROM i WHERE camera_id NOT IN (SELECT camera_id FROM c) GROUP BY camera_id ORDER BY count(CASE WHEN id IN (SELECT id FROM s2) THEN 1 END) DESC, count(*) DESC, camera_id LIMIT 1)
    SELECT camera_id, count(*) AS ids FROM i WHERE camera_id IN (SELECT camera_id FROM c UNION SELECT camera_id FROM c3) GROUP BY camera_id""")
def _t9(gt):
    chosen = evaluation.pick_cameras(gt, 3)
    return gt.where(F.col("camera_id").isin(chosen)).groupBy("camera_id").agg(F.countDistinct("id").alias("ids"))


@query("j5_match_frame", "v_gt", "v_pred")
def _j5(gt, pred):
    return evaluation.match_frame(gt, pred)


@query("a12_id_metrics", "v_gt", "v_pred")
def _a12(gt, pred):
    return evaluation.id_metrics(gt, pred)


@query("a13_mtmc_report", "v_gt", "v_pred")
def _a13(gt, pred):
    return evaluation.mtmc_report(gt, pred.withColumn("gid", F.when(F.col("frame") % 3 > 0, F.col("id"))))


@query("g3_sweep", "v_gt", "v_pred", sql=f"SELECT t AS threshold, camera_id, count(*) AS n FROM ({_PAIRS}), (VALUES (0.5), (0.7), (0.9)) AS v(t) WHERE iou >= t GROUP BY ALL")
def _g3(gt, pred):
    rows = evaluation.sweep(boxes.iou_pairs(gt, pred), gt.sparkSession, "threshold", [0.5, 0.7, 0.9])
    return rows.where("iou >= threshold").groupBy("threshold", "camera_id").agg(F.count("*").alias("n"))


_CONF = "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'resident' WHEN c_custkey % 3 = 1 THEN 'staff' ELSE 'unknown' END AS true_role, role_state AS role FROM v_identities JOIN customer ON gid = c_custkey"


def _confusion_rows(ids):
    return ids.select(F.when(F.col("gid") % 3 == 0, "resident").when(F.col("gid") % 3 == 1, "staff").otherwise("unknown").alias("true_role"), F.col("role_state").alias("role"))


@query("a10_role_confusion", "v_identities", sql=f"""
    SELECT true_role, count(*) AS matched, count(*) FILTER (role <> 'pending') AS decided, count(*) FILTER (role = true_role) AS correct,
           round(count(*) FILTER (role = true_role) / count(*) FILTER (role <> 'pending'), 6) AS accuracy, round(count(*) FILTER (role <> 'pending') / count(*), 6) AS coverage FROM ({_CONF}) GROUP BY true_role""")
def _a10(ids):
    out = evaluation.role_confusion(_confusion_rows(ids))
    return out.select("true_role", "matched", "decided", "correct", _r("accuracy", 6), _r("coverage", 6))


@query("a10_role_matrix", "v_identities", sql=f"""
    SELECT true_role, count(*) FILTER (role = 'pending') AS pending, count(*) FILTER (role = 'resident') AS resident, count(*) FILTER (role = 'staff') AS staff, count(*) FILTER (role = 'unknown') AS unknown FROM ({_CONF}) GROUP BY true_role""")
def _a10b(ids):
    return evaluation.role_matrix(_confusion_rows(ids))


@query("a11_unknown_alert_metrics", "v_alerts", sql="""
    WITH a AS (SELECT DISTINCT gid FROM v_alerts WHERE rule = 'signup'), v AS (SELECT gid, event_id % 20 AS gt_id, count(*) AS n FROM v_alerts GROUP BY ALL),
    p AS (SELECT gid, gt_id FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, gt_id) AS place FROM v) WHERE place = 1), j AS (SELECT a.gid, gt_id, gt_id < 8 AS ok FROM a LEFT JOIN p USING (gid))
    SELECT count(*) AS alerts, count(*) FILTER (ok) AS correct, 8::BIGINT AS unknowns, round(count(*) FILTER (ok) / count(*), 6) AS precision, round(count(DISTINCT gt_id) FILTER (ok) / 8, 6) AS recall FROM j""")
def _a11(alerts):
    moves = alerts.where("rule = 'signup'").select("gid", F.lit("pending").alias("before"), F.lit("unknown").alias("role"))
    matches = alerts.select("gid", (F.col("event_id") % 20).alias("gt_id"))
    out = evaluation.unknown_alert_metrics(moves, matches, alerts.sparkSession.range(8).withColumnRenamed("id", "gt_id"))
    return out.select("alerts", "correct", "unknowns", _r("precision", 6), _r("recall", 6))


@query("a15_det_metrics", "v_gt", "v_pred", sql=f"""
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame, pred_id ORDER BY iou DESC, gt_id) AS place FROM ({_PAIRS})), t AS (SELECT DISTINCT camera_id, frame, gt_id FROM p WHERE place = 1 AND iou >= 0.5)
    SELECT count(*) AS tp, (SELECT count(*) FROM v_pred) - count(*) AS fp, (SELECT count(*) FROM v_gt) - count(*) AS fn FROM t""")
def _a15(gt, pred):
    return plates.det_metrics(gt, pred)


@query("a18_live_role_counts", "v_det", "v_tracks", sql="""
    WITH o AS (SELECT d.camera_id, d.frame, d.label, t.role FROM v_det d LEFT JOIN v_tracks t USING (track_id)), m AS (SELECT camera_id, max(frame) AS frame FROM o GROUP BY ALL)
    SELECT camera_id, CASE WHEN label <> 'person' THEN 'vehicle' ELSE coalesce(role, 'pending') END AS kind, count(*) AS n FROM o JOIN m USING (camera_id, frame) GROUP BY ALL""")
def _a18(det, tr):
    return evaluation.live_role_counts(det.join(tr.select("track_id", "role"), "track_id", "left"))


@query("a19_headline_metrics", "v_alerts", sql="""
    WITH r AS (SELECT CASE WHEN gid % 2 = 0 THEN 'plates' ELSE 'tracking' END AS kind, lpad(event_id::VARCHAR, 8, '0') AS name, rule AS metric, ts AS value, gid % 4 = 0 AS synthetic FROM v_alerts),
    l AS (SELECT kind, metric, arg_max(value, name) AS value, max(name) AS report FROM r WHERE NOT (kind = 'plates' AND synthetic) GROUP BY ALL)
    SELECT w.kind, w.metric, value, report FROM (VALUES ('plates', 'click'), ('tracking', 'view'), ('tracking', 'absent')) AS w(kind, metric) LEFT JOIN l USING (kind, metric)""")
def _a19(alerts):
    reports = alerts.select(F.when(F.col("gid") % 2 == 0, "plates").otherwise("tracking").alias("kind"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("name"), F.col("rule").alias("metric"), F.col("ts").alias("value"), (F.col("gid") % 4 == 0).alias("synthetic"))
    wanted = alerts.sparkSession.createDataFrame([("plates", "click"), ("tracking", "view"), ("tracking", "absent")], "kind string, metric string")
    return evaluation.headline_metrics(reports, wanted)


@query("x1_unknown_people", "v_gt", sql="SELECT DISTINCT id FROM v_gt WHERE frame >= 500 AND id NOT IN (SELECT id FROM v_gt WHERE id % 5 = 0)")
def _x1(gt):
    return evaluation.unknown_people(gt, gt.where("id % 5 = 0").select("id").distinct(), 500)


@query("x12_select_enrolment", "v_gt", sql="""
    WITH f AS (SELECT id, count(*) AS boxes FROM v_gt WHERE frame < (SELECT max(frame) + 1 FROM v_gt) * 0.25 AND label = 'person' AND y2 - y1 >= 100 GROUP BY id HAVING count(*) >= 30),
    o AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || id::VARCHAR), id) AS place FROM f)
    SELECT id, CASE WHEN place <= 40 THEN 'resident' ELSE 'staff' END AS role, boxes FROM o WHERE place <= 60""")
def _x12(gt):
    return evaluation.select_enrolment(gt, gt.agg(F.coalesce(F.max("frame"), F.lit(0))).first()[0] + 1, 40, 20, "7")


@query("t8_pick_shots", "v_gt")
def _t8(gt):
    return evaluation.pick_shots(gt.where("label = 'person'").withColumn("height", F.col("y2") - F.col("y1")))


@query("p12_evaluable_datasets", "region", sql="SELECT r_name, TRUE AS exhaustive, TRUE AS cross_camera_ids FROM region WHERE r_regionkey % 2 = 0")
def _p12(region):
    return evaluation.evaluable_datasets(region.select("r_name", (F.col("r_regionkey") % 2 == 0).alias("exhaustive"), F.lit(True).alias("cross_camera_ids")))


@query("f11_namespaced_id", "v_pred", sql="SELECT camera_id, track_id, count(*) AS n, right(camera_id, 1)::BIGINT * 1000 + track_id AS id FROM v_pred GROUP BY ALL")
def _f11(pred):
    return pred.groupBy("camera_id", "track_id", fn.namespaced_id(F.col("camera_id"), F.col("track_id")).alias("id")).agg(F.count("*").alias("n"))


@query("f11_parse_clip_name", "v_det", sql="""
    SELECT track_id, '2018-03-' || lpad((track_id % 28 + 1)::VARCHAR, 2, '0') AS date, lpad((track_id % 24)::VARCHAR, 2, '0') || '-05-00' AS start, lpad((track_id % 24)::VARCHAR, 2, '0') || '-10-00' AS end,
           CASE WHEN track_id % 2 = 0 THEN 'school' ELSE 'bus' END AS site, 'G' || (track_id % 500) AS camera FROM (SELECT DISTINCT track_id FROM v_det)""")
def _f11b(det):
    k, two = F.col("track_id"), lambda c: F.lpad(c.cast("string"), 2, "0")
    site = F.when(k % 2 == 0, "school").otherwise("bus")
    name = F.concat(F.lit("/clips/2018-03-"), two(k % 28 + 1), F.lit("."), two(k % 24), F.lit("-05-00."), two(k % 24), F.lit("-10-00."), site, F.lit(".G"), (k % 500).cast("string"), F.lit(".r13.avi"))
    rows = det.select("track_id").distinct().withColumn("c", fn.parse_clip_name(name))
    return rows.select("track_id", "c.date", "c.start", "c.end", "c.site", "c.camera")


# --- search

_ROLE = "coalesce(i.role_state, t.role)"


@query("j9_person_search", "v_tracks", "v_identities", sql=f"""
    SELECT t.track_id, {_ROLE} AS role FROM v_tracks t LEFT JOIN v_identities i USING (gid)
    WHERE {_ROLE} IN ('unknown', 'pending') AND upper_color = 'red' AND height_cm + coalesce(height_error, 0) >= 170 AND height_cm - coalesce(height_error, 0) <= 185 AND end_ts >= 7.5e8""")
def _j9(tr, ids):
    return search.person_search(tr.withColumn("zones", F.array()), ids, roles=["unknown", "pending"], upper_color="red", height_min=170, height_max=185, since=7.5e8).select("track_id", "role")


_QVEC = [round(0.1 * ((i * 7) % 11 - 5), 1) for i in range(64)]


def _clip(samples):
    return samples.select(F.col("sample_id").alias("track_id"), F.col("emb").alias("clip"))


_DIST = f"1 - {_COS.format(a='e.emb', b=str(_QVEC))}"


@query("t4_rank_by_vector", "v_tracks", "v_samples", sql=f"""
    SELECT t.track_id, round({_DIST.replace('1 - ', '', 1)}, 4) AS score FROM v_tracks t LEFT JOIN v_samples e ON e.sample_id = t.track_id ORDER BY {_DIST} NULLS LAST, start_ts DESC, t.track_id LIMIT 20""")
def _t4(tr, samples):
    return search.rank_by_vector(tr.join(_clip(samples), "track_id", "left"), _QVEC, 20).select("track_id", "score")


@query("t4_rank_many", "v_tracks", "v_samples", "embeddings", sql="""
    WITH q AS (SELECT vec_id AS query_id, [x::DOUBLE for x in embedding] AS v, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS n FROM embeddings WHERE vec_id % 20 = 0),
    t AS (SELECT t.track_id, start_ts, [x::DOUBLE for x in e.emb] AS v, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in e.emb])) AS n FROM v_tracks t LEFT JOIN v_samples e ON e.sample_id = t.track_id),
    m AS (SELECT query_id, track_id, start_ts, CASE WHEN t.v IS NOT NULL THEN list_dot_product(q.v, t.v) / greatest(q.n * t.n, 1e-12) END AS sim FROM q JOIN t ON TRUE)
    SELECT query_id, track_id, round(sim, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC NULLS LAST, start_ts DESC, track_id) AS place FROM m) WHERE place <= 10""")
def _t4_many(tr, samples, embeddings):
    """Every vector whose id is divisible by 20 against all tracks."""
    wanted = embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("clip"))
    return search.rank_many(tr.join(_clip(samples), "track_id", "left"), wanted, 10)


@query("t5_search_people", "v_tracks", "v_identities", "v_samples", sql=f"""
    SELECT t.track_id, round({_DIST.replace('1 - ', '', 1)}, 4) AS score, TRUE AS relaxed FROM v_tracks t LEFT JOIN v_identities i USING (gid) LEFT JOIN v_samples e ON e.sample_id = t.track_id
    WHERE {_ROLE} = 'unknown' ORDER BY {_DIST} NULLS LAST, start_ts DESC, t.track_id LIMIT 15""")
def _t5(tr, ids, samples):
    out = search.search_people(tr.withColumn("zones", F.array()), ids, _clip(samples), 15, _QVEC, roles=["unknown"], upper_color="plaid")
    return out.select("track_id", "score", "relaxed")


@query("t6_search_vehicles", "v_plate_reads", "v_edges", sql="""
    SELECT read_id, plate, ts, 'all' AS match FROM v_plate_reads WHERE status IN ('registered', 'likely_registered') AND ts >= 7.5e8 ORDER BY ts DESC, read_id DESC LIMIT 50""")
def _t6(reads, edges):
    zones = edges.select("camera_id", "zone").distinct()
    return search.search_vehicles(reads, zones, 50, zone_names=["yard"], roles=["resident"], since=7.5e8).select("read_id", "plate", "ts", "match")


@query("t7_batch_search", "part", "v_tracks", sql="""
    WITH q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('cam_', (p_partkey % 8)::VARCHAR) END AS camera_id, CASE WHEN p_partkey % 2 = 0 THEN 'unknown' END AS role,
                      PICK(p_partkey % 5 | 'red', 'blue', NULL, 'white', 'green') AS upper_color, CASE WHEN p_partkey % 7 = 0 THEN 7.5e8 END AS since FROM part WHERE p_partkey % 20 = 0),
    m AS (SELECT query_id, track_id, row_number() OVER (PARTITION BY query_id ORDER BY start_ts DESC, track_id) AS place FROM q JOIN v_tracks t
          ON (q.camera_id IS NULL OR q.camera_id = t.camera_id) AND (q.role IS NULL OR q.role = t.role) AND (q.upper_color IS NULL OR q.upper_color = t.upper_color) AND (since IS NULL OR end_ts >= since))
    SELECT query_id, track_id, place FROM m WHERE place <= 5""")
def _t7(part, tr):
    k = F.col("p_partkey")
    color = F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit(None).cast("string"), F.lit("white"), F.lit("green")), (k % 5 + 1).cast("int"))
    q = part.where(k % 20 == 0).select(
        k.alias("query_id"), F.when(k % 3 != 0, F.concat(F.lit("cam_"), (k % 8).cast("string"))).alias("camera_id"), F.when(k % 2 == 0, "unknown").alias("role"),
        color.alias("upper_color"), F.when(k % 7 == 0, 7.5e8).alias("since"), F.lit(None).cast("double").alias("until"))
    return search.batch_search(q, tr, 5)


@query("j12_zone_cameras", "v_edges", sql="SELECT DISTINCT camera_id FROM v_edges WHERE zone = 'yard'")
def _j12(edges):
    return search.zone_cameras(edges, ["yard"])


@query("t1_event_history", "v_alerts", sql="SELECT event_id, rule, ts, json_extract_string(payload, '$.k') AS k FROM v_alerts WHERE rule = 'click' AND NOT acknowledged ORDER BY ts DESC, event_id DESC LIMIT 100")
def _t1(alerts):
    out = search.event_history(alerts, 100, "click", True)
    return out.select("event_id", "rule", "ts", F.get_json_object("payload", "$.k").alias("k"))


@query("t2_audit_history", "v_alerts", sql="SELECT event_id AS audit_id, rule AS action, ts FROM v_alerts WHERE rule = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _t2(alerts):
    return search.audit_history(alerts.select(F.col("event_id").alias("audit_id"), F.col("rule").alias("action"), "ts"), 50, "view")


@query("t3_plate_history", "v_plate_reads", sql="SELECT read_id, plate, ts FROM v_plate_reads WHERE plate = 'MH12SB5838' ORDER BY ts DESC, read_id DESC LIMIT 20")
def _t3(reads):
    return search.plate_history(reads, 20, "mh-12-sb-5838").select("read_id", "plate", "ts")


@query("t10_list_vehicles", "v_vehicles", sql="SELECT plate, owner FROM v_vehicles")
def _t10(vehicles):
    return search.list_vehicles(vehicles.select("plate", "owner"))


@query("f12_clip_prompt", "conversations", sql="""
    SELECT conv_id, turn, CASE WHEN len(list_intersect(regexp_split_to_array(lower(trim(text)), '\\s+'), ['person', 'man', 'woman', 'guy', 'lady', 'boy', 'girl', 'kid', 'child', 'people'])) > 0
        THEN 'a cctv photo of ' ELSE 'a cctv photo of a person, ' END || text AS prompt FROM conversations""")
def _f12(rows):
    return rows.select("conv_id", "turn", fn.clip_prompt(F.col("text")).alias("prompt"))


@query("j14_blur_worklist", "v_det", "v_tracks", sql="""
    WITH d AS (SELECT camera_id, track_id, frame / 30.0e0 AS ts FROM v_det WHERE label = 'person'), c AS (SELECT track_id AS clip_id, camera_id, min(ts) - 0.1e0 AS low, max(ts) + 0.1e0 AS high FROM d GROUP BY ALL),
    b AS (SELECT clip_id, low, high, camera_id, unnest(range(CAST(floor(low / 60) AS BIGINT), CAST(floor(high / 60) AS BIGINT) + 1)) AS bucket FROM c),
    h AS (SELECT DISTINCT clip_id, d.camera_id, ts, d.track_id FROM d JOIN b ON d.camera_id = b.camera_id AND floor(ts / 60) = bucket AND ts BETWEEN low AND high LEFT JOIN v_tracks t ON t.track_id = d.track_id WHERE coalesce(t.role, 'pending') IN ('unknown', 'pending'))
    SELECT clip_id, camera_id, track_id, count(*) AS boxes, min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY ALL""")
def _j14(det, tr):
    d = det.where("label = 'person'").select("camera_id", "track_id", (F.col("frame") / 30.0).alias("ts"))
    clips = d.groupBy("camera_id", "track_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    rows = search.blur_worklist(clips.withColumnRenamed("track_id", "clip_id"), d, tr.select("camera_id", "track_id", "role"), 0.1)
    return rows.groupBy("clip_id", "camera_id", "track_id").agg(F.count("*").alias("boxes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- maintenance


@query("x3_upsert_cameras", "v_edges", sql="""
    WITH e AS (SELECT DISTINCT camera_id FROM v_edges), n AS (SELECT * FROM (VALUES ('cam_1', 'gate'), ('cam_99', 'roof')) AS v(camera_id, name))
    SELECT camera_id, name, CASE WHEN camera_id = 'cam_99' THEN 9 ELSE 1 END AS created_at FROM n UNION ALL SELECT camera_id, 'old', 1 FROM e WHERE camera_id NOT IN (SELECT camera_id FROM n)""")
def _x3(edges):
    old = edges.select("camera_id", F.lit("old").alias("name"), F.lit(1).alias("created_at")).distinct()
    new = edges.sparkSession.createDataFrame([("cam_1", "gate", 9), ("cam_99", "roof", 9)], "camera_id string, name string, created_at int")
    return maintenance.upsert_cameras(old, new)


@query("x4_replace_tracks", "v_tracks", "v_samples", sql="SELECT camera_id, track_id FROM v_tracks WHERE camera_id <> 'cam_3' OR end_ts < 8e8")
def _x4(tr, samples):
    out, _ = maintenance.replace_tracks(tr, _clip(samples), tr.where("camera_id = 'cam_3' and end_ts < 8e8"), ["cam_3"])
    return out.select("camera_id", "track_id")


@query("x4_delete_unit", "v_people", "v_gallery", sql="SELECT g.kind, count(*) AS n FROM v_gallery g WHERE person_id NOT IN (SELECT person_id FROM v_people WHERE unit = 'unit1') GROUP BY ALL")
def _x4b(people, gallery):
    return maintenance.delete_unit(people, gallery, "unit1")[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("x6_next_ids", "v_identities", "nation", sql="SELECT n_name, (SELECT max(gid) FROM v_identities) + row_number() OVER (ORDER BY n_name) AS gid FROM nation")
def _x6(ids, nation):
    return maintenance.next_ids(ids, nation.select("n_name"), "gid", ["n_name"]).select("n_name", "gid")


_DUE = f"SELECT t.track_id, t.thumb FROM v_tracks t LEFT JOIN v_identities i USING (gid) WHERE end_ts < 8.2e8 AND coalesce(i.role_state, t.role, 'pending') IN ('unknown', 'pending')"


def _retention(tr, ids, samples, alerts):
    return maintenance.retention(tr, ids, _clip(samples), alerts.select("event_id", "gid", "ts", "thumb"), 8.2e8 + 7 * 86400)


@query("x7_retention_files", "v_tracks", "v_identities", "v_samples", "v_alerts", sql=f"""
    WITH l AS (SELECT event_id FROM v_alerts a LEFT JOIN v_identities i USING (gid) WHERE ts < 8.2e8 AND thumb AND coalesce(role_state, 'pending') IN ('unknown', 'pending'))
    SELECT thumb AS file FROM ({_DUE}) WHERE thumb IS NOT NULL UNION ALL SELECT 'event-' || event_id FROM l""")
def _x7(tr, ids, samples, alerts):
    return _retention(tr, ids, samples, alerts)["files"]


@query("x7_retention_embeddings", "v_tracks", "v_identities", "v_samples", "v_alerts", sql=f"SELECT sample_id AS track_id FROM v_samples WHERE sample_id NOT IN (SELECT track_id FROM ({_DUE}))")
def _x7b(tr, ids, samples, alerts):
    return _retention(tr, ids, samples, alerts)["embeddings"].select("track_id")


@query("x7_retention_tracks", "v_tracks", "v_identities", "v_samples", "v_alerts", sql=f"SELECT count(*) AS n, count(CASE WHEN track_id NOT IN (SELECT track_id FROM ({_DUE})) THEN thumb END) AS thumbs FROM v_tracks")
def _x7c(tr, ids, samples, alerts):
    return _retention(tr, ids, samples, alerts)["tracks"].agg(F.count("*").alias("n"), F.count("thumb").alias("thumbs"))


@query("x8_enroll_batch", "v_samples", "customer", sql="""
    WITH r AS (SELECT c_custkey AS request_id, c_custkey % 4 <> 0 AS consent, PICK(c_custkey % 3 | 'resident', 'staff', 'guest') AS role FROM customer),
    n AS (SELECT gid AS request_id, count(*) FILTER (kind = 'face') AS f, count(*) FILTER (kind = 'body') AS b FROM v_samples GROUP BY ALL)
    SELECT r.request_id, CASE WHEN NOT consent THEN 'no consent' WHEN role NOT IN ('resident', 'staff') THEN 'role' ELSE 'too few shots' END AS reason FROM r LEFT JOIN n USING (request_id)
    WHERE NOT consent OR role NOT IN ('resident', 'staff') OR (coalesce(f, 0) < 3 AND coalesce(b, 0) < 3)""")
def _x8(samples, customer):
    k = F.col("c_custkey")
    role = F.element_at(F.array(F.lit("resident"), F.lit("staff"), F.lit("guest")), (k % 3 + 1).cast("int"))
    requests = customer.select(k.alias("request_id"), "c_name", (k % 4 != 0).alias("consent"), role.alias("role"))
    return maintenance.enroll_batch(requests, samples.select(F.col("gid").alias("request_id"), "kind", "emb"))[2]


@query("x9_delete_people", "v_people", "v_gallery", sql="SELECT person_id, role FROM v_people WHERE person_id % 3 <> 0")
def _x9(people, gallery):
    return maintenance.delete_people(people, gallery, people.where("person_id % 3 = 0"))[0].select("person_id", "role")


@query("a9_people_summary", "v_people", "v_gallery", sql="SELECT p.person_id, p.role, count(*) FILTER (g.kind = 'face') AS face, count(*) FILTER (g.kind = 'body') AS body FROM v_people p LEFT JOIN v_gallery g USING (person_id) GROUP BY ALL")
def _a9(people, gallery):
    return maintenance.people_summary(people, gallery).select("person_id", "role", "face", "body")


@query("x10_register_vehicles", "v_vehicles", "v_reads", sql=f"""
    WITH b AS ({_plate_sql("v_reads", "text", "track_id * 1000 + frame AS row, text")}),
    t AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY row) AS turn FROM b)
    SELECT row, CASE WHEN kind = 'invalid' THEN 'invalid' ELSE 'duplicate' END AS reason FROM t WHERE kind = 'invalid' OR turn > 1 OR plate IN (SELECT plate FROM v_vehicles)""")
def _x10(vehicles, reads):
    batch = reads.select((F.col("track_id") * 1000 + F.col("frame")).alias("row"), F.col("text").alias("plate"), F.lit("x").alias("owner"))
    return maintenance.register_vehicles(vehicles.dropDuplicates(["plate"]), batch)[1].select("row", "reason")


@query("x11_acknowledge", "v_alerts", sql="SELECT event_id, acknowledged OR event_id % 3 = 0 AS acknowledged FROM v_alerts")
def _x11(alerts):
    acks = alerts.where("event_id % 3 = 0").select("event_id", F.lit("me").alias("actor"), F.lit(1.0).alias("ts"))
    return maintenance.acknowledge(alerts, acks)[0].select("event_id", "acknowledged")


@query("x11_acknowledge_audit", "v_alerts", sql="SELECT 'me' AS actor, 'acknowledge' AS action, event_id::VARCHAR AS target, CAST(1 AS DOUBLE) AS ts FROM v_alerts WHERE event_id % 3 = 0 AND NOT acknowledged")
def _x11b(alerts):
    acks = alerts.where("event_id % 3 = 0").select("event_id", F.lit("me").alias("actor"), F.lit(1.0).alias("ts"))
    return maintenance.acknowledge(alerts, acks)[1]


_ZONES, _CAMERAS = ["resident_parking", "visitor_parking", "gate", "lobby"], {"cam_1": "main gate", "cam_2": "north lobby"}


def query_log(part: DataFrame, talk: DataFrame) -> DataFrame:
    """query_id, text, now: a log put together from the parts' names and sizes, and every turn of the conversations."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    color = F.element_at(F.array(*[F.lit(c) for c in ("red", "navy", "grey", "black", "olive")]), (F.col("p_size") % 5 + 1).cast("int"))
    text = F.when(F.lit(False), "")
    shapes = [
        lambda c: F.concat(F.lit("unknown people in "), c, F.lit(" shirt and jeans near the gate after "), (k % 12 + 1).cast("string"), F.lit(" pm")),
        lambda c: F.concat(F.lit("guard about "), (k % 40 + 150).cast("string"), F.lit(" cm in the resident parking yesterday evening")),
        lambda c: F.concat(F.lit("car tn 09 ab "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" at main gate today")),
        lambda c: F.concat(F.lit("tall visitor wearing "), c, F.lit(" between "), (k % 11 + 1).cast("string"), F.lit(" and "), (k % 9 + 2).cast("string"), F.lit(":15 pm with a "), F.col("p_name")),
        lambda c: F.concat((k % 4 + 4).cast("string"), F.lit("'"), (k % 12).cast("string"), F.lit('" man on cam_2 in the last '), size, F.lit(" minutes")),
        lambda c: F.concat(F.lit("anyone with trousers in "), c, F.lit(" around "), (k % 12 + 1).cast("string"), F.lit(":30 this morning")),
    ]
    for n, shape in enumerate(shapes):
        text = F.when(k % len(shapes) == n, shape(color)).otherwise(text)
    now = F.lit(1.79e9)
    parts = part.select(F.concat(F.lit("p"), k.cast("string")).alias("query_id"), text.alias("text"), (now + k * 3600.0).alias("now"))
    turns = talk.select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("query_id"), "text", (now + F.col("turn") * 60.0).alias("now"))
    return parts.unionByName(turns)


@query("f16_parse_query_log", "part", "conversations")
def _f16(part, talk):
    from ..operators.query_log import parse_query_log

    # the log is a table of its own, so the parser's plan stands in it once
    return parse_query_log(write_again(query_log(part, talk)), _ZONES, _CAMERAS)


# readers, writers and streams register themselves with these
from . import round_trips as _round_trips  # noqa: E402, F401
