"""Known cases: plates, registry, votes, presences, heights, identities, metrics."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchframe.functions import scalar as fn
from watchframe.operators import boxes, evaluation, identity, plates, presence


@pytest.mark.parametrize(
    "raw, text, kind, fixes",
    [
        ("mh 14 xz 0042", "MH14XZ0042", "standard", 0),
        ("KL-O7-CQ-5510", "KL07CQ5510", "standard", 1),
        ("AP16BQ5521ZZZ", "AP16BQ5521ZZZ", "invalid", 0),
        ("DL3CQ9087", "DL3CQ9087", "standard", 0),
        ("TN22BM4B07", "TN22BM4807", "standard", 1),
        ("8R05PK7713", "BR05PK7713", "standard", 1),
        ("21BH0007C", "21BH0007C", "bh", 0),
        ("24 8H 9001 DE", "24BH9001DE", "bh", 1),
        ("GARAGE", "GARAGE", "invalid", 0),
        ("", "", "invalid", 0),
    ],
)
def test_normalize_plate(spark, raw, text, kind, fixes):
    p = spark.createDataFrame([(raw,)], "t string").select(fn.normalize_plate(F.col("t")).alias("p")).first()["p"]
    assert (p["text"], p["kind"], p["corrections"]) == (text, kind, fixes)


def test_unknown_state_is_valid_but_told(spark):
    p = spark.createDataFrame([("ZZ09AB1234",), (None,)], "t string").select(fn.normalize_plate(F.col("t")).alias("p")).collect()
    assert p[0]["p"]["kind"] == "standard" and not p[0]["p"]["valid_state"] and p[1]["p"] is None


def test_registry(spark):
    asked = spark.createDataFrame([("TN09AB1234",), ("TN09AB1284",), ("MH12AB1234",)], "plate string")
    got = {r["plate"]: (r["status"], r["matched"]) for r in plates.registry_match(asked, spark.createDataFrame([("TN09AB1234",)], "plate string")).collect()}
    assert got == {"TN09AB1234": ("registered", "TN09AB1234"), "TN09AB1284": ("likely_registered", "TN09AB1234"), "MH12AB1234": ("unregistered", None)}


def test_plate_pipeline(spark):
    texts = ["TN09AB1234", "TN-O9AB1234", "TN09A81234", "TN09AB1234", "TN09AB1234"]
    rows = [("c", 1, i, t, 0.9, 0.9) for i, t in enumerate(texts)] + [("c", 2, i, "KA05MJ8821", 0.9, 0.9) for i in range(2)] + [("c", 3, 0, "HELLO", 0.9, 0.9), ("c", 4, 0, "TN09AB1234", 0.1, 0.1)]
    reads = plates.filter_reads(spark.createDataFrame(rows, "camera_id string, track_id long, frame long, text string, conf double, min_char_conf double"))
    got = {r["track_id"]: (r["plate"], r["reads"], r["early"]) for r in plates.plate_decisions(reads).collect()}
    assert got == {1: ("TN09AB1234", 3, True), 2: ("KA05MJ8821", 2, False)}


RULE = [{"id": "r", "type": "unknown_in_zone", "zones": ["z"]}]


def obs(spark, times, person="p", role="unknown"):
    return spark.createDataFrame([(person, "z", float(t), role, True) for t in times], "person string, zone string, ts double, role string, restricted boolean")


def test_one_alert_per_incident(spark):
    count = lambda times: presence.alerts(obs(spark, times), RULE, 5.0, 300.0).count()
    assert count(range(200)) == 1
    assert count([t for t in range(100) if t % 5 not in (3, 4)]) == 1
    assert count([0, 1, 2, 32, 33]) == 1
    assert count([0, 1, 2, 402, 403]) == 2


def test_loitering_counts_from_entry(spark):
    rule = [{"id": "l", "type": "loitering", "zones": ["z"], "dwell_s": 60.0}]
    rows = presence.alerts(obs(spark, range(0, 90, 2)), rule, 5.0).collect()
    assert [(r["ts"], r["dwell"]) for r in rows] == [(60.0, 60.0)]
    assert presence.alerts(obs(spark, [*range(0, 40, 2), *range(50, 90, 2)]), rule, 5.0).count() == 0


def test_after_hours_window(spark):
    rule = [{"id": "n", "type": "after_hours", "zones": ["z"], "start": 22 * 3600, "end": 6 * 3600}]
    at = lambda h, m: [h * 3600 + m * 60 - 19800 + 86400 * 3]
    fires = lambda h, m, role: presence.alerts(obs(spark, at(h, m), role=role), rule).count()
    assert [fires(14, 0, "unknown"), fires(23, 30, "staff"), fires(23, 30, "resident"), fires(23, 30, "unknown"), fires(22, 0, "unknown"), fires(6, 0, "unknown")] == [0, 0, 1, 1, 1, 0]


def test_tailgating(spark):
    rule = [{"id": "t", "type": "tailgating", "zones": ["z"], "window_s": 3.0}]
    follow = lambda dt: presence.alerts(obs(spark, [100], "host", "resident").unionByName(obs(spark, [100 + dt], "guest")), rule).count()
    assert [follow(2), follow(4.5)] == [1, 0]


def test_height_round_trip(spark):
    p = [900.0, 640.0, 20.0, 3200.0, 10.0, 260.0, -880.0, 7300.0, 0.02, 1.0, 0.05, 9.0]

    def pixel(x, y, z):
        u, v, w = (sum(p[4 * r + k] * q for k, q in enumerate((x, y, z, 1.0))) for r in range(3))
        return u / w, v / w

    for h in (1.55, 1.75, 1.92):
        u, v = pixel(0.5, 2.0, 0.0)
        _, top = pixel(0.5, 2.0, h)
        df = spark.createDataFrame([(p, u - 20, top, u + 20, v)], "p array<double>, x1 double, y1 double, x2 double, y2 double")
        got = df.select(fn.height_m(F.col("p"), *fn.box(), F.lit(10**6), F.lit(10**6)).alias("h")).first()["h"]
        assert got is None or abs(got - h) < 0.05


@pytest.mark.parametrize(
    "pairs, want",
    [([("face", 0.9, 1.0)], "resident"), ([("body", 0.9, 0.5)] * 3, "pending"), ([("body", 0.9, 0.5)] * 4, "resident"), ([("body", 0.1, 0.5)] * 7, "pending"), ([("body", 0.1, 0.5)] * 8, "unknown"), ([("body", 0.1, 0.2)] * 20, "pending")],
)
def test_identity_roles(spark, pairs, want):
    rows = [(1, float(i), k, q, 5, s) for i, (k, s, q) in enumerate(pairs)]
    matched = spark.createDataFrame(rows, "gid long, ts double, kind string, quality double, person_id long, sim double")
    out = identity.identity_roles(matched, spark.createDataFrame([(5, "resident")], "person_id long, role string")).orderBy(F.desc("ts")).first()
    assert out["role"] == want


def sighting(camera, track, first, last, emb, at=None, spots=()):
    return {"camera_id": camera, "track_id": track, "first_ts": first, "last_ts": last, "end_ts": last + 2.0, "assign_ts": first + 1.0 if at is None else at, "emb": emb, "end_emb": emb, "positions": list(spots)}


def test_global_ids():
    a, b = [1.0, 0.0], [0.0, 1.0]
    run = lambda *rows, **kw: dict(((r.camera_id, r.track_id), r.number) for r in identity.assign_epoch(pd.DataFrame(rows), **kw).itertuples())
    assert run(sighting("A", 1, 0, 10, a), sighting("B", 1, 20, 30, a), sighting("B", 2, 20, 30, b)) == {("A", 1): 1, ("B", 1): 1, ("B", 2): 2}
    assert len(set(run(sighting("A", 1, 0, 10, a), sighting("A", 2, 0.5, 10, a)).values())) == 2  # never two live tracks of one camera
    near = [(float(t), 0.0, 0.0) for t in range(10)]
    far = [(float(t), 10.0, 0.0) for t in range(10)]
    assert len(set(run(sighting("A", 1, 0, 9, a, 2.0, near), sighting("B", 1, 0, 9, a, 3.0, far)).values())) == 2
    weak = [0.3, math.sqrt(1 - 0.09)]
    assert len(set(run(sighting("A", 1, 0, 9, a, 2.0, near), sighting("B", 1, 0, 9, weak, 3.0, near)).values())) == 1
    gone = [(14.0 + t, 100.0, 0.0) for t in range(5)]
    assert len(set(run(sighting("A", 1, 0, 9, a, 2.0, near), sighting("B", 1, 14, 19, a, 15.0, gone)).values())) == 2


def tracks_of(spark, rows):
    return spark.createDataFrame([("c", f, i, float(x), 0.0, float(x) + 10, 10.0) for f, i, x in rows], "camera_id string, frame long, id long, x1 double, y1 double, x2 double, y2 double")


def test_idf1(spark):
    gt = tracks_of(spark, [(f, i, 100 * i) for f in range(10) for i in (0, 1)])
    m = evaluation.id_metrics(gt, gt).first()
    assert (m["idtp"], m["idf1"]) == (20, 1.0)
    one = tracks_of(spark, [(f, 0, 0) for f in range(10)])
    split = tracks_of(spark, [(f, 5 + (f >= 5), 0) for f in range(10)])
    assert evaluation.id_metrics(one, split).first()["idf1"] == 0.5
    assert evaluation.id_metrics(one, one.where("false")).first()["idf1"] == 0.0
    shifted = tracks_of(spark, [(f, 0, 5) for f in range(10)])
    assert [evaluation.id_metrics(one, shifted, t).first()["idtp"] for t in (0.5, 0.3)] == [0, 10]


def test_match_frame_is_one_to_one(spark):
    gt, pred = tracks_of(spark, [(0, 1, 0), (0, 2, 4)]), tracks_of(spark, [(0, 7, 1), (0, 8, 2)])
    assert sorted((r["gt_id"], r["pred_id"]) for r in evaluation.match_frame(gt, pred, 0.3).collect()) == [(1, 7), (2, 8)]


def test_pick_cameras(spark):
    sets = {1: range(1, 6), 2: (1, 2, 3), 3: range(10, 14), 4: (4, 5, 6)}
    gt = spark.createDataFrame([(c, i) for c, s in sets.items() for i in s], "camera_id int, id int")
    assert [evaluation.pick_cameras(gt, 2), evaluation.pick_cameras(gt, 3), evaluation.pick_cameras(gt, 2, (1,))] == [[1, 2], [1, 2, 4], [3, 2]]


def test_output_size(spark):
    df = spark.createDataFrame([(1920, 1080), (641, 481)], "w int, h int")
    assert [tuple(r["o"]) for r in df.select(boxes.output_size(F.col("w"), F.col("h"), 720).alias("o")).collect()] == [(1280, 720), (640, 480)]


def test_empty_inputs(spark):
    none = obs(spark, [1]).where("false")
    assert presence.alerts(none, RULE).count() == 0 and presence.presences(none).count() == 0
    gt = tracks_of(spark, [(0, 1, 0)]).where("false")
    assert evaluation.match_frame(gt, gt).count() == 0 and evaluation.id_metrics(gt, gt).first()["idtp"] == 0


def test_clip_name_and_labels(spark):
    df = spark.createDataFrame([("2018-03-11.11-25-00.11-30-00.school.G420.r13.avi",), ("other",)], "n string")
    got = [r["c"] for r in df.select(fn.parse_clip_name(F.col("n")).alias("c")).collect()]
    assert tuple(got[0]) == ("2018-03-11", "11-25-00", "11-30-00", "school", "G420") and got[1]["camera"] is None
    roles = spark.createDataFrame([("resident",), ("staff",), ("unknown",), ("pending",), (None,)], "r string")
    assert [r["b"] for r in roles.select(fn.should_blur(F.col("r")).alias("b")).collect()] == [False, False, True, True, True]
