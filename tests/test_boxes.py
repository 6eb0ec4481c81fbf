"""Boxes of one frame: blocks of frames, packed rows, plans, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchframe.operators import boxes, evaluation, plates
from watchframe.plans import queries
from watchframe.plans.views import view

SF = "/root/testdata/sf0.001"
COLUMNS = "camera_id string, frame long, id long, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if min(w, h) <= 0 or a[:2] != b[:2]:
        return 0.0
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    return w * h / (area(a) + area(b) - w * h)


def drawn(rng, n):
    """Boxes of all sizes in few frames, on both sides of block borders and of 0, some without an area."""
    x, y, w, h = rng.integers(-60, 300, n) / 2, rng.integers(-40, 150, n) / 2, 2.0 ** rng.integers(-2, 10, n), 2.0 ** rng.integers(2, 9, n)
    w[rng.random(n) < 0.05] = 0
    frame = rng.choice([-129, -1, 0, 127, 128, 5_000_000_000], n)
    return [(f"cam_{c}", int(f), int(i), *map(float, (a, b, a + c2, b + d))) for c, f, i, a, b, c2, d in zip(rng.integers(0, 2, n), frame, rng.integers(0, 40, n), x, y, w, h, strict=True)]


def test_pairs_of_any_boxes(spark):
    rng = np.random.default_rng(3)
    gt, pred = drawn(rng, 500), drawn(rng, 600)
    want = sorted((a[0], a[1], a[2], b[2], round(o, 9)) for a in gt for b in pred if (o := overlap(a, b)) >= 0.2 and a[3] < a[5] and b[3] < b[5])
    nulls = [("cam_0", 0, 1, None, 0.0, 1.0, 1.0), (None, 0, 1, 0.0, 0.0, 900.0, 900.0)]
    got = boxes.iou_pairs(spark.createDataFrame(gt + nulls, COLUMNS), spark.createDataFrame(pred + nulls, COLUMNS), 0.2).collect()
    assert sorted((*r[:4], round(r[4], 9)) for r in got) == want and len(want) > 50


def test_steps_of_few_candidates(monkeypatch):
    rng = np.random.default_rng(4)
    frame, other = rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    sides = [tuple(np.stack([a, b, a + w, b + h])) for a, b, w, h in (rng.random((4, 300)) * 9 + 0.1 for _ in range(2))]
    whole = boxes.overlapping(frame, sides[0], other, sides[1], 0.1)
    monkeypatch.setattr(boxes, "STEP", 5)
    assert sorted(zip(*boxes.overlapping(frame, sides[0], other, sides[1], 0.1), strict=True)) == sorted(zip(*whole, strict=True))


def test_packed_rows_come_back(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(boxes, "PACK_ROWS", 7)
    rows = [r[:2] + (r[2] if r[2] % 9 else None,) + r[3:] for r in drawn(np.random.default_rng(5), 200)]
    table = spark.createDataFrame(rows, COLUMNS).toArrow()
    kind = pa.schema([("id", pa.int64())])
    packed = pa.Table.from_batches(boxes._pack(iter(table.to_batches(max_chunksize=5)), kind, True))
    assert packed.num_rows > 20
    _, frame, ids, sides = boxes._unpack(packed, np.arange(packed.num_rows), kind)
    assert sorted(map(repr, zip(frame.tolist(), ids.to_pylist(), *sides.tolist(), strict=True))) == sorted(repr(r[1:]) for r in rows)


def test_packed_tracks_take_few_bytes(spark):
    """A box of a track that goes on evenly moves in less than 12 bytes, where its columns have 56."""
    import pyarrow as pa

    det = view(spark, SF, "v_gt").select("camera_id", "frame", "id", "x1", "y1", "x2", "y2").toArrow()
    out = list(boxes._pack(iter(det.to_batches()), pa.schema([("id", pa.int64())]), True))
    assert sum(b.column("data").nbytes for b in out) < 12 * det.num_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j3_iou_pairs", "f9_iou", "g3_sweep", "j5_match_frame", "a15_det_metrics", "j1_zone_membership", "j14_blur_worklist"])
def test_detections_are_never_broadcast(spark, name):
    """Spark takes rows made by explode() for as many as they were made of; a broadcast of all boxes ends the driver."""
    text = plan(queries.QUERIES[name](spark, SF))
    for part in text.split("BroadcastExchange")[1:]:
        depth = len(part.split("\n")[1]) - len(part.split("\n")[1].lstrip(" :+-"))
        below = []
        for line in part.split("\n")[1:]:
            if len(line) - len(line.lstrip(" :+-")) < depth:
                break
            below.append(line)
        assert not any("explode(sequence" in x and "Aggregate" not in "".join(below) for x in below), name


def test_views_are_dealt_before_they_grow(spark):
    assert "REPARTITION_BY_NUM" in plan(view(spark, SF, "v_det"))


def test_det_metrics_by_image_or_frame(spark):
    gt, pred = (view(spark, SF, v) for v in ("v_gt", "v_pred"))
    image = F.concat_ws(":", "camera_id", "frame")
    by_frame = plates.det_metrics(gt, pred).first()
    assert by_frame == plates.det_metrics(*[v.withColumn("image", image).select("image", "id", "x1", "y1", "x2", "y2") for v in (gt, pred)]).first() and by_frame["tp"] > 1000


def test_stars_need_no_components(spark):
    """Only chains of confusions go to the components: here one of four, beside stars on both sides."""
    rows = [("a", 1, 11, 5), ("a", 1, 12, 7), ("a", 2, 13, 4), ("a", 3, 13, 6), ("a", 4, 14, 3), ("a", 4, 15, 5), ("a", 5, 15, 4), ("b", 1, 11, 2)]
    got = {r["mode"]: r["idtp"] for r in evaluation._matched_frames(spark.createDataFrame(rows, "mode string, gt_id long, pred_id long, n long")).collect()}
    assert got == {"a": 7 + 6 + 3 + 4, "b": 2}


def test_repeated_rows_and_clips_are_told_once(spark):
    from watchframe.operators import search

    det = spark.createDataFrame([("c", 1, t / 2) for t in (0, 1, 1, 4, 9, 300)] + [("c", 2, 1.0), ("c", 3, 1.0)], "camera_id string, track_id long, ts double")
    clips = spark.createDataFrame([(7, "c", 0.0, 1.0), (7, "c", 0.0, 1.0), (7, "c", 0.5, 2.0), (7, "c", 149.0, 151.0), (8, "c", 4.0, 4.4), (9, "d", 0.0, 9.0)], "clip_id long, camera_id string, start_ts double, end_ts double")
    roles = spark.createDataFrame([("c", 2, "resident"), ("c", 3, "unknown"), ("c", 3, "pending")], "camera_id string, track_id long, role string")
    got = sorted(map(tuple, search.blur_worklist(clips, det, roles, 0.1).collect()))
    assert got == [(7, "c", 0.0, 1), (7, "c", 0.5, 1), (7, "c", 1.0, 3), (7, "c", 2.0, 1), (7, "c", 150.0, 1), (8, "c", 4.5, 1)]


def test_long_ground_truth_is_several_documents(spark, tmp_path):
    """No document holds more than it may, unless a frame does; what is read is what was written."""
    import glob
    import json

    from watchframe.sources import io

    boxes_ = [("d", f"cam_{c}", None, 1280, 720, 0, True, False, f, i, f + 0.5, 1.0, 9.0, 8.0, "car") for c, n in ((1, 90), (2, 5)) for f in range(n) for i in range(1 + 9 * (f == 50))]
    columns = "dataset string, camera string, fps double, width int, height int, num_frames int, exhaustive boolean, cross_camera_ids boolean, frame long, global_id long, x1 double, y1 double, x2 double, y2 double, class string"
    io.write_ground_truth(spark.createDataFrame(boxes_, columns), str(tmp_path / "gt"), most=16)
    found = [json.load(open(f)) for f in glob.glob(str(tmp_path / "gt/part*"))]
    sizes = {c: [len(d["rows"]) for d in found if d["camera"] == c] for c in ("cam_1", "cam_2")}
    assert sizes["cam_2"] == [5] and max(sizes["cam_1"]) <= 17 and len(sizes["cam_1"]) > 5 and all("fps" not in d and d["columns"] == io.COLUMNS for d in found)
    assert all([int(r[0]) for r in d["rows"]] == sorted(int(r[0]) for r in d["rows"]) for d in found)
    got = io.read_ground_truth_json(spark, str(tmp_path / "gt"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, boxes_))


@pytest.mark.parametrize("name", ["s1_read_mtmc_ground_truth", "s2_read_kpf", "s3_read_ground_truth_json"])
def test_text_of_boxes_is_written_small(spark, name):
    """What a round trip leaves on the disk takes less than 20 bytes a box."""
    import os

    from watchframe.helpers.tables import step_folder

    folder = step_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    n = queries.QUERIES[name](spark, SF).count()
    used = sum(os.path.getsize(f"{d}/{f}") for new in set(os.listdir(folder)) - before for d, _, files in os.walk(f"{folder}/{new}") for f in files if f.startswith("part-"))
    assert 0 < used < 20 * n
