"""Boxes, zones and ground positions of detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.scalar import box, clip, height_m, image_to_ground
from ..helpers.folds import codes, numbers, whole_groups

#: Polygons of at most so many points are tested edge by edge in plain expressions.
UNROLLED = 12
#: So many zones are sent to every task.
MOST_ZONES = 20_000


def scale_boxes(df: DataFrame, sx: float, sy: float, num_frames: int | None = None) -> DataFrame:
    """Boxes times (sx, sy), one decimal; frames from num_frames on are dropped."""
    scaled = df.withColumns({c: F.bround(F.col(c) * F.lit(sx if c[0] == "x" else sy), 1) for c in ("x1", "y1", "x2", "y2")})
    return scaled if num_frames is None else scaled.where(F.col("frame") < num_frames)


def output_size(width: Column, height: Column, max_h: int) -> Column:
    """struct(width, height) at most max_h high, the aspect kept, both even."""
    scale = F.least(F.lit(1.0), max_h / height)
    even = lambda x: (F.bround(x * scale / 2) * 2).cast("int")
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def scale_calibration(p: Column, sx: float, sy: float) -> Column:
    """diag(sx, sy, 1) times a flat 3x4 matrix."""
    return F.transform(p, lambda x, i: x * F.when(i < 4, sx).when(i < 8, sy).otherwise(1.0))


def foot_point(df: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Adds foot_x, foot_y: the middle of the lower edge, as shares of the frame when its size is given."""
    return df.withColumns({"foot_x": (F.col("x1") + F.col("x2")) / 2 / (width or 1), "foot_y": F.col("y2") / (height or 1)})


def filter_min_height(df: DataFrame, pixels: float = 24) -> DataFrame:
    return df.where(F.col("y2") - F.col("y1") >= pixels)


def normalize_boxes(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes as shares of the frame, four decimals."""
    return df.withColumns({c: F.bround(F.col(c) / (width if c[0] == "x" else height), 4) for c in ("x1", "y1", "x2", "y2")})


# Shares of a box. A head is its upper part, with a margin; a face is looked for in a larger part with
# margins at the sides and above; a plate is read with a margin all around.
HEAD_SHARE, HEAD_MARGIN = 0.24, 0.1
REGION_SHARE, REGION_SIDES, REGION_ABOVE = 0.45, 0.15, 0.1
PLATE_MARGIN = 0.05


def head_box(df: DataFrame, width: int, height: int, share: float = HEAD_SHARE, pad: float = HEAD_MARGIN) -> DataFrame:
    """Adds head_*: the top part of each box, padded, cut to the frame, in whole pixels."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return df.withColumns(
        {
            "head_x1": F.greatest(F.lit(0), (F.col("x1") - w * pad).cast("int")),
            "head_y1": F.greatest(F.lit(0), (F.col("y1") - h * pad).cast("int")),
            "head_x2": F.least(F.lit(width), F.ceil(F.col("x2") + w * pad).cast("int")),
            "head_y2": F.least(F.lit(height), F.ceil(F.col("y1") + h * share).cast("int")),
        }
    )


def head_region(df: DataFrame, width: int, height: int, share: float = REGION_SHARE) -> DataFrame:
    """Adds region_*: the upper part of each person box, wider by REGION_SIDES on both sides and REGION_ABOVE above, in whole pixels."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return _inside(df, "region", width, height, F.col("x1") - w * REGION_SIDES, F.col("y1") - h * REGION_ABOVE, F.col("x2") + w * REGION_SIDES, F.col("y1") + h * share)


def plate_expand(df: DataFrame, width: int, height: int, share: float = PLATE_MARGIN) -> DataFrame:
    """Adds plate_*: each box larger by a share of its size on all sides, in whole pixels."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return _inside(df, "plate", width, height, F.col("x1") - w * share, F.col("y1") - h * share, F.col("x2") + w * share, F.col("y2") + h * share)


def _inside(df: DataFrame, name: str, width: int, height: int, x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """Adds name_x1 .. name_y2: whole pixels cut off towards zero, kept within the frame."""
    low, high = lambda c: F.greatest(F.lit(0), c.cast("int")), lambda c, n: F.least(F.lit(n), c.cast("int"))
    return df.withColumns({f"{name}_x1": low(x1), f"{name}_y1": low(y1), f"{name}_x2": high(x2, width), f"{name}_y2": high(y2, height)})


def crop_box(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the frame in whole pixels; empty ones are dropped."""
    cut = {c: clip(F.col(c), 0, width if c[0] == "x" else height).cast("int") for c in ("x1", "y1", "x2", "y2")}
    return df.withColumns(cut).where("x2 > x1 and y2 > y1")


def frame_ts(df: DataFrame, fps: float, base: Column | float = 0.0) -> DataFrame:
    """Adds ts: base + frame / fps in seconds."""
    start = base if isinstance(base, Column) else F.lit(base)
    return df.withColumn("ts", start + F.col("frame") / fps)


def filter_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.where(F.col("label").isin(labels))


def zone_membership(det: DataFrame, zones: DataFrame, width: int, height: int) -> DataFrame:
    """Detections with each zone of their camera whose polygon holds the foot point or has it on an edge.

    det: camera_id, x1..y2 and any other columns; zones: camera_id, zone, polygon (array of struct x, y as
    shares of the frame), restricted. A bounding box goes before the ray cast. Zones are counted first: up to
    MOST_ZONES of them go to every task, which tests a camera's detections by columns; more are shuffled by camera
    with the detections. Spark's own choice could send the detections, whose number it cannot tell after an explode().
    """
    n, most = zones.agg(F.count("*"), F.coalesce(F.max(F.size("polygon")), F.lit(0))).first()
    if n <= MOST_ZONES:
        return _zones_by_camera(foot_point(det, width, height), zones)
    ends = zones.select(
        "camera_id",
        "zone",
        "restricted",
        "polygon",
        F.array_min("polygon.x").alias("zx1"),
        F.array_max("polygon.x").alias("zx2"),
        F.array_min("polygon.y").alias("zy1"),
        F.array_max("polygon.y").alias("zy2"),
        F.zip_with("polygon", F.concat(F.slice("polygon", F.lit(2), F.size("polygon")), F.slice("polygon", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("edges"),
    )
    x, y = F.col("foot_x"), F.col("foot_y")
    rows = foot_point(det, width, height).join(ends.hint("merge"), "camera_id").where(x.between(F.col("zx1"), F.col("zx2")) & y.between(F.col("zy1"), F.col("zy2")))

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    def on(e):
        a, b = e["a"], e["b"]
        side = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (side == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    if most <= UNROLLED:  # one plain expression for each edge stays inside generated code
        edges = [F.get("edges", F.lit(i)) for i in range(most)]
        met = reduce(lambda a, e: a | F.coalesce(on(e), F.lit(False)), edges, F.lit(False))
        crossed = reduce(lambda a, e: a + F.coalesce(crosses(e), F.lit(False)).cast("int"), edges, F.lit(0))
        inside = met | (crossed % 2 == 1)
    else:
        inside = F.exists("edges", on) | (F.size(F.filter("edges", crosses)) % 2 == 1)
    return rows.where(inside).drop("polygon", "edges", "zx1", "zx2", "zy1", "zy2")


def _zones_by_camera(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """rows (camera_id, foot_x, foot_y, ...) with zone and restricted of each zone that holds the foot."""
    of: dict = {}
    for z in zones.select("camera_id", "zone", "restricted", "polygon").where("camera_id IS NOT NULL AND size(polygon) > 0").collect():
        of.setdefault(z["camera_id"], []).append((z["zone"], z["restricted"], np.array([(p["x"], p["y"]) for p in z["polygon"]], float)))
    added = [zones.schema[c] for c in ("zone", "restricted")]
    kinds = to_arrow_schema(StructType(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("foot_x", "foot_y"))
            cameras = batch.column("camera_id").dictionary_encode()
            own, at, told = pc.fill_null(cameras.indices, -1).to_numpy(), [np.empty(0, np.int64)], ([], [])
            for k, camera in enumerate(cameras.dictionary.to_pylist()):
                here = np.flatnonzero(own == k) if camera in of else at[0]
                for zone, restricted, polygon in of.get(camera, ()):
                    at.append(here[inside_polygon(x[here], y[here], polygon)])
                    told[0].extend([zone] * len(at[-1]))
                    told[1].extend([restricted] * len(at[-1]))
            more = [pa.array(v, f.type) for v, f in zip(told, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(np.concatenate(at))).columns, *more], names=[*batch.schema.names, *kinds.names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added]))


def inside_polygon(x: np.ndarray, y: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Places of the points that a polygon holds or has on an edge."""
    low, high = polygon.min(axis=0), polygon.max(axis=0)
    near = np.flatnonzero((x >= low[0]) & (x <= high[0]) & (y >= low[1]) & (y <= high[1]))
    x, y, met, odd = x[near], y[near], np.zeros(len(near), bool), np.zeros(len(near), bool)
    for (ax, ay), (bx, by) in zip(polygon, np.roll(polygon, -1, axis=0), strict=True):
        met |= ((bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return near[met | odd]


def ground_positions(det: DataFrame, calib: DataFrame) -> DataFrame:
    """Adds gx, gy: the ground point at each foot. calib: camera_id, p (flat 3x4), width, height."""
    at = image_to_ground(F.col("p"), (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    return det.join(calib.select("camera_id", "p"), "camera_id").withColumn("g", at).select(*det.columns, F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))


def track_height(det: DataFrame, calib: DataFrame, least: float = 120.0, most: float = 220.0, samples: int = 3) -> DataFrame:
    """Median height and error (1.4826 MAD, 2 cm at least) of each track in cm; fewer samples give nulls."""
    rows = det.join(calib, "camera_id").withColumn("cm", height_m(F.col("p"), *box(), F.col("width"), F.col("height")) * 100)
    rows = rows.withColumn("cm", F.when(F.col("cm").between(least, most), F.col("cm"))).select("camera_id", "track_id", "cm")
    # a track's samples are at most a segment's frames, so they fit one array
    each = rows.groupBy("camera_id", "track_id").agg(F.median("cm").alias("mid"), F.collect_list("cm").alias("all"))
    away = each.select("camera_id", "track_id", "mid", F.size("all").alias("n"), F.explode_outer("all").alias("cm"))
    out = away.groupBy("camera_id", "track_id").agg(F.max("mid").alias("mid"), F.max("n").alias("n"), F.median(F.abs(F.col("cm") - F.col("mid"))).alias("mad"))
    enough = F.col("n") >= samples
    return out.select(
        "camera_id",
        "track_id",
        F.when(enough, F.bround("mid", 1)).alias("height_cm"),
        F.when(enough, F.bround(F.greatest(F.col("mad") * 1.4826, F.lit(2.0)), 1)).alias("error_cm"),
    )


#: Frames that travel and meet as one block, and rows that a task holds before it packs them.
BLOCK_FRAMES, PACK_ROWS = 128, 400_000
#: Candidate pairs that are looked at in one step.
STEP = 1_000_000
_BOX = ("x1", "y1", "x2", "y2")


def iou_pairs(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs (gt_id, pred_id) of one frame whose boxes overlap enough. Both: camera_id, frame, id, x1..y2.

    threshold is above 0; boxes without an area or with nulls overlap nothing.
    """
    return frame_pairs(gt, pred, threshold, lambda pairs, _: pairs, _pair_schema(gt, pred))


def _pair_schema(gt: DataFrame, pred: DataFrame) -> StructType:
    of = lambda df, c, name=None: StructField(name or c, df.schema[c].dataType)
    return StructType([of(gt, "camera_id"), of(gt, "frame"), of(gt, "id", "gt_id"), of(pred, "id", "pred_id"), StructField("iou", DoubleType())])


def frame_pairs(gt: DataFrame, pred: DataFrame, threshold: float, then: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """What `then` makes of the pairs (camera_id, frame, gt_id, pred_id, iou) of boxes of one frame that overlap enough.

    `then` gets the pairs of whole frames, in no order, with numbers that tell the frames apart. Boxes of both sides move once, packed: a task gathers the rows
    of each camera and block of frames and compresses them by column (ids as codes, bytes by place), so a track's even
    course takes a few bytes a box. A block meets in one task, and there a box meets those of its frame that
    overlap it along x, found by order; steps of bounded size hold the candidates.
    """
    ids = {"gt": gt.schema["id"].dataType, "pred": pred.schema["id"].dataType}
    kinds = {side: to_arrow_schema(StructType([StructField("id", t)])) for side, t in ids.items()}
    camera, frame = gt.schema["camera_id"].dataType, gt.schema["frame"].dataType
    outer = to_arrow_schema(_pair_schema(gt, pred))

    def packed(df: DataFrame, side: str) -> DataFrame:
        rows = df.where("x1 < x2 AND y1 < y2").select("camera_id", F.col("frame").cast("long").alias("frame"), "id", *[F.col(c).cast("double").alias(c) for c in _BOX])
        return rows.where("camera_id IS NOT NULL AND frame IS NOT NULL").mapInArrow(lambda batches: _pack(batches, kinds[side], side == "gt"), StructType([StructField("camera_id", camera), StructField("block", LongType()), StructField("gt", BooleanType()), StructField("data", BinaryType())]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["camera_id", "block"], 1):
            rows = np.array([int.from_bytes(x[:8], "little") for x in table.column("data").to_pylist()])
            first = np.flatnonzero(np.diff(group, prepend=-1))
            before = np.concatenate([[0], np.cumsum(rows)])[first]
            for at in np.split(np.arange(len(group)), first[np.flatnonzero(np.diff(before // PACK_ROWS)) + 1]):
                part, number = table.take(at), group[at] - group[at[0]]
                mine = part.column("gt").to_numpy()
                g, p = (_unpack(part.filter(pa.array(m)), number[m], kinds[side]) for side, m in (("gt", mine), ("pred", ~mine)))
                if not len(g[0]) or not len(p[0]):
                    continue
                # frames of all cameras and blocks at once, told apart by number
                i, j, over = overlapping(g[0], g[3], p[0], p[3], threshold)
                camera = part.column("camera_id").take(pa.array(np.flatnonzero(np.diff(number, prepend=-1))))
                columns = [camera.take(pa.array(g[0][i] // BLOCK_FRAMES)).cast(outer.field(0).type), pa.array(g[1][i]).cast(outer.field(1).type), g[2].take(pa.array(i)), p[2].take(pa.array(j)), pa.array(over)]
                yield from then(pa.Table.from_arrays(columns, schema=outer), g[0][i]).to_batches(100_000)

    both = packed(gt, "gt").unionByName(packed(pred, "pred"))
    assert pred.schema["camera_id"].dataType == camera and frame.typeName() in ("integer", "long", "short", "byte")
    return both.repartition("camera_id", "block").sortWithinPartitions("camera_id", "block").mapInArrow(meet, schema)


def _pack(batches: Iterator[pa.RecordBatch], kind: pa.Schema, gt: bool) -> Iterator[pa.RecordBatch]:
    """Rows (camera_id, frame, id, x1..y2) as rows (camera_id, block, gt, data)."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        cameras = table.column("camera_id").combine_chunks().dictionary_encode()
        cameras = cameras.chunk(0) if isinstance(cameras, pa.ChunkedArray) else cameras
        camera, frame = cameras.indices.to_numpy(zero_copy_only=False), table.column("frame").to_numpy()
        block = frame // BLOCK_FRAMES
        order = np.lexsort((block, camera))
        camera, block, frame = camera[order], block[order], frame[order]
        sides = [table.column(c).to_numpy()[order] for c in _BOX]
        own = table.column("id")
        own = (own.to_numpy() if pa.types.is_int64(own.type) and not own.null_count else numbers(own))[order]
        ids = table.column("id").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(camera) != 0) | (np.diff(block) != 0)) + 1, [len(order)]])
        data = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            _, first, code = np.unique(own[a:b], return_index=True, return_inverse=True)
            known = pa.RecordBatch.from_arrays([ids.take(pa.array(order[a:b][first]))], schema=kind).serialize().to_pybytes()
            planes = [np.diff(x[a:b], prepend=x[a:b][:1] * 0).astype(np.int64) for x in (frame,)] + [np.diff(code, prepend=0).astype(np.int64)] + [x[a:b].view(np.int64) for x in sides]
            body = known + np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.ravel() for x in planes]).tobytes()
            data.append(np.array([b - a, len(known), len(body)], np.int64).tobytes() + pa.compress(body, "zstd", asbytes=True))
        at = pa.array(camera[cuts[:-1]])
        return pa.RecordBatch.from_arrays([cameras.dictionary.take(at), pa.array(block[cuts[:-1]]), pa.array(np.full(len(data), gt)), pa.array(data, pa.binary())], names=["camera_id", "block", "gt", "data"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def _unpack(part: pa.Table, number: np.ndarray, kind: pa.Schema) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of packed rows with the numbers of their blocks: numbers of frames, frames, ids and sides."""
    codes_, frames, ids, boxes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [pa.array([], kind.field(0).type)], [np.empty((4, 0))]
    for data, k in zip(part.column("data").to_pylist(), number.tolist(), strict=True):
        n, split, size = np.frombuffer(data[:24], np.int64).tolist()
        body = pa.decompress(data[24:], size, "zstd", asbytes=True)
        known = pa.ipc.read_record_batch(pa.py_buffer(body[:split]), kind).column(0)
        planes = np.ascontiguousarray(np.frombuffer(body[split:], np.uint8).reshape(6, 8, n).transpose(0, 2, 1)).view(np.int64)[..., 0]
        frames.append(np.cumsum(planes[0]))
        codes_.append(k * BLOCK_FRAMES + frames[-1] % BLOCK_FRAMES)
        ids.append(known.take(pa.array(np.cumsum(planes[1]))))
        boxes.append(planes[2:].view(np.float64))
    return np.concatenate(codes_), np.concatenate(frames), pa.concat_arrays(ids), np.concatenate(boxes, axis=1)


def overlapping(frame: np.ndarray, box: tuple[np.ndarray, ...], o_frame: np.ndarray, other: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, places of the other side, iou) of boxes of one frame with that overlap at least; frames count from 0.

    The other side is sorted by frame and x1, by classes of width that differ by a factor of 2, so those that can reach
    a box stand together: from its left side less the width of the class to its right side.
    """
    (x1, y1, x2, y2), (u1, v1, u2, v2) = box, other
    width = np.frexp(u2 - u1)[1]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for k in np.unique(width):
        own = np.flatnonzero(width == k)
        values, place = np.unique(np.concatenate([u1[own], x1 - (u2 - u1)[own].max(), x2]), return_inverse=True)
        n, step = len(own), len(values) + 1
        key = o_frame[own] * step + place[:n]
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        low = np.searchsorted(key, frame * step + place[n : n + len(frame)])
        high = np.searchsorted(key, frame * step + place[n + len(frame) :])
        count = np.maximum(0, high - low)
        ends = np.cumsum(count)
        start = 0
        while start < len(frame):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
            many = count[start:stop]
            i = np.repeat(np.arange(start, stop), many)
            j = own[np.repeat(low[start:stop] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(i))]
            w = np.minimum(x2[i], u2[j]) - np.maximum(x1[i], u1[j])
            h = np.minimum(y2[i], v2[j]) - np.maximum(y1[i], v1[j])
            both = (w > 0) & (h > 0)
            i, j, shared = i[both], j[both], (w * h)[both]
            over = shared / np.maximum((x2[i] - x1[i]) * (y2[i] - y1[i]) + (u2[j] - u1[j]) * (v2[j] - v1[j]) - shared, 1e-9)
            enough = over >= threshold
            found.append((i[enough], j[enough], over[enough]))
            start = stop
    i, j, over = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, over


def hidden_shares(frame: np.ndarray, track: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """The largest share of each box that one box of another track in its frame covers; rows sorted by frame and x1.

    A sweep along x, for all frames at once: in step k each box that is still open meets the k-th box after
    it, and closes at the first one that begins behind its right side. Time is that of boxes and overlaps along x.
    """
    area = np.maximum(1.0, x2 - x1) * np.maximum(1.0, y2 - y1)
    hidden, open_, k = np.zeros(len(x1)), np.arange(len(x1)), 1
    while len(open_):
        open_ = open_[open_ + k < len(x1)]
        after = open_ + k
        open_ = open_[(frame[open_] == frame[after]) & (x1[after] < x2[open_])]
        after = open_ + k
        w = np.minimum(x2[open_], x2[after]) - x1[after]
        h = np.minimum(y2[open_], y2[after]) - np.maximum(y1[open_], y1[after])
        met = (w > 0) & (h > 0) & (track[open_] != track[after])
        a, b, both = open_[met], after[met], (w * h)[met]
        np.maximum.at(hidden, a, both / area[a])
        np.maximum.at(hidden, b, both / area[b])
        k += 1
    return hidden


def crop_quality(det: DataFrame, width: int, height: int, least: float = 64.0, full: float = 256.0) -> DataFrame:
    """Adds quality: size ramp x confidence x border x aspect x the least visible share among the frame's others.

    Frames are sorted by x1 and swept (hidden_shares), several in one batch; a frame's boxes are in one task.
    Nulls in a box give a null quality; a row never hides another of its own track.
    """
    rows = det.repartition("camera_id", "frame").sortWithinPartitions("camera_id", "frame", "x1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, frame in whole_groups(batches, ["camera_id", "frame"]):
            sides = [table.column(c).cast(pa.float64()).to_numpy() for c in ("x1", "y1", "x2", "y2")]
            yield from table.append_column("hidden", pa.array(hidden_shares(frame, codes(table.column("track_id")), *sides))).to_batches()

    w, h = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    size = clip((h - least) / max(1.0, full - least), 0.0, 1.0)
    cut = (F.col("x1") <= 2) | (F.col("y1") <= 2) | (F.col("x2") >= width - 2) | (F.col("y2") >= height - 2)
    seen = F.greatest(F.lit(0.0), 1.0 - F.col("hidden"))
    whole_box = reduce(lambda a, c: a & F.col(c).isNotNull(), ("x1", "y1", "x2", "y2"), F.lit(True))
    quality = size * F.col("conf") * F.when(cut, 0.5).otherwise(1.0) * F.when((w / h).between(0.25, 0.65), 1.0).otherwise(0.5) * seen
    return rows.mapInArrow(run, StructType([*det.schema.fields, StructField("hidden", DoubleType())])).withColumn("quality", F.when(whole_box, quality)).select(*det.columns, "quality")


def nearest_position(a: DataFrame, b: DataFrame, max_dt: float = 1.0) -> DataFrame:
    """For each row of a (key, ts) the position of b (key, ts, x, y) nearest in time within max_dt; the earlier of equal ones.

    Times are cut into buckets of max_dt, so a row only meets its own and the two bordering buckets.
    """
    left = a.withColumn("bucket", F.explode(F.array(*[(F.floor(F.col("ts") / max_dt) + k) for k in (-1, 0, 1)])))
    right = b.select(F.col("key"), F.col("ts").alias("b_ts"), "x", "y", F.floor(F.col("ts") / max_dt).alias("bucket"))
    near = left.join(right, ["key", "bucket"]).where(F.abs(F.col("ts") - F.col("b_ts")) <= max_dt)
    best = near.groupBy(*a.columns).agg(F.min_by(F.struct("b_ts", "x", "y"), F.struct(F.abs(F.col("ts") - F.col("b_ts")), F.col("b_ts"))).alias("p"))
    return best.select(*a.columns, "p.b_ts", "p.x", "p.y")


def travel_feasible(last_ts: Column, last_x: Column, last_y: Column, ts: Column, x: Column, y: Column, max_speed: float = 3.0, live_gap: float = 1.0) -> Column:
    """False where a person would have moved faster than max_speed m/s between two sightings."""
    gap = F.abs(ts - last_ts)
    distance = F.sqrt((x - last_x) ** 2 + (y - last_y) ** 2)
    return ~((gap > live_gap) & (distance / F.when(gap > 0, gap) > max_speed))


