"""Metrics of tracking, roles and plates against ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import namespaced_id
from ..helpers.assignment import heaviest_pairs
from ..helpers.components import connected_components
from ..helpers.folds import codes, numbers
from ..helpers.tables import write_again
from .boxes import frame_pairs, iou_pairs


def match_frame(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches (camera_id, frame, gt_id, pred_id, iou) of the largest total overlap in each frame.

    Pairs under the threshold are dropped after the assignment. A frame's pairs of overlapping boxes are matched where
    they meet; of a pair of ids that occurs several times the largest overlap counts.
    """

    def solve(pairs: pa.Table, frame: np.ndarray) -> pa.Table:
        if not pairs.num_rows:
            return pairs
        # ids of different frames are different nodes, so one matching does for all frames
        left, right = (frame << 32 | codes(pairs.column(c)).astype(np.int64) for c in ("gt_id", "pred_id"))
        once = [n[at] == 1 for _, at, n in (np.unique(x, return_inverse=True, return_counts=True) for x in (left, right))]
        over = pairs.column("iou").to_numpy()
        # a pair whose boxes overlap no other is matched as it stands; only the rest needs an assignment
        rest = np.flatnonzero(~(once[0] & once[1]))
        kept = rest[heaviest_pairs(left[rest], right[rest], over[rest])] if len(rest) else rest
        kept = np.sort(np.concatenate([np.flatnonzero(once[0] & once[1]), kept]))
        return pairs.take(pa.array(kept[over[kept] >= threshold]))

    return frame_pairs(gt, pred, 1e-12, solve, iou_pairs(gt, pred).schema)


def camera_stats(gt: DataFrame) -> DataFrame:
    return gt.groupBy("camera_id").agg(F.count("*").alias("boxes"), F.countDistinct("id").alias("ids"))


def identity_sets(gt: DataFrame) -> DataFrame:
    """Distinct (camera_id, id) pairs."""
    return gt.select("camera_id", "id").distinct()


def dataset_summary(gt: DataFrame, fps: float) -> DataFrame:
    """Per camera: boxes, persons, vehicles, seconds; with the set's identities and those seen by two cameras or more."""
    per = gt.groupBy("camera_id").agg(
        F.count("*").alias("boxes"),
        F.countDistinct(F.when(F.col("label") == "person", F.col("id"))).alias("persons"),
        F.countDistinct(F.when(F.col("label") != "person", F.col("id"))).alias("vehicles"),
        ((F.max("frame") + 1) / fps).alias("seconds"),
    )
    ids = gt.groupBy("id").agg(F.countDistinct("camera_id").alias("cameras"))
    total = ids.agg(F.count("*").alias("identities"), F.count(F.when(F.col("cameras") >= 2, 1)).alias("shared"))
    return per.join(total, F.lit(True))


def shared_identities(gt: DataFrame) -> DataFrame:
    """How many identities each pair of cameras shares: camera_a < camera_b, shared."""
    ids = identity_sets(gt)
    other = ids.select(F.col("camera_id").alias("camera_b"), "id")
    rows = ids.withColumnRenamed("camera_id", "camera_a").join(other, "id").where("camera_a < camera_b")
    return rows.groupBy("camera_a", "camera_b").agg(F.count("*").alias("shared"))


def pick_cameras(gt: DataFrame, n: int, exclude: tuple = ()) -> list:
    """Cameras that see each other's people: first the one with most ids, then most ids shared with those seen, then size.

    Camera ids sort as they are. Each of the n steps is one aggregate; only camera names come to the driver.
    """
    ids = identity_sets(gt).where(~F.col("camera_id").isin(*exclude)) if exclude else identity_sets(gt)
    chosen: list = []
    while len(chosen) < n:
        seen = ids.where(F.col("camera_id").isin(*chosen)).select("id").distinct().withColumn("known", F.lit(1)) if chosen else None
        rows = ids if seen is None else ids.where(~F.col("camera_id").isin(*chosen)).join(seen, "id", "left")
        known = F.lit(0) if seen is None else F.count("known")
        top = rows.groupBy("camera_id").agg(known.alias("shared"), F.count("*").alias("size")).orderBy(F.desc("shared"), F.desc("size"), "camera_id").first()
        if top is None:
            break
        chosen.append(top["camera_id"])
    return chosen


def trajectory_pairs(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(gt_id, pred_id, n): frames in which their boxes overlap enough. Several pairs of a frame may count."""
    return _tallies(gt, pred, threshold).groupBy("gt_id", "pred_id").agg(F.sum("n").alias("n"))


def _tallies(gt: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """trajectory_pairs by blocks of frames: a pair may come several times."""

    def tally(pairs: pa.Table, _: np.ndarray) -> pa.Table:
        both = np.stack([numbers(pairs.column(c)) for c in ("gt_id", "pred_id")])
        _, first, n = np.unique(both, axis=1, return_index=True, return_counts=True) if both.size else (0, [], [])
        return pairs.select(["gt_id", "pred_id"]).take(pa.array(first, pa.int64())).append_column("n", pa.array(n, pa.int64()))

    schema = iou_pairs(gt, pred).select("gt_id", "pred_id", F.lit(0).cast("long").alias("n")).schema
    return frame_pairs(gt, pred, threshold, tally, schema)


def _matched_frames(pairs: DataFrame) -> DataFrame:
    """pairs (mode, gt_id, pred_id, n): for each mode idtp, the frames of the heaviest one-to-one match of trajectories.

    A trajectory whose partners have no other partner is matched with the one of most frames, and whoever is left
    belongs to chains of confusions. Those that share frames are one component, told for all modes at once: lists of
    pairs, one for each task, matched by shortest augmenting paths.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = heaviest_pairs(pdf.gt_id.to_numpy(), pdf.pred_id.to_numpy(), pdf.n.to_numpy())
        return pd.DataFrame({"mode": [pdf["mode"].iloc[0]], "idtp": [int(pdf.n.to_numpy()[chosen].sum())]})

    node = lambda side, c: F.struct("mode", F.lit(side).alias("side"), F.col(c).cast("long").alias("id"))
    of_gt, of_pred = Window.partitionBy("mode", "gt_id"), Window.partitionBy("mode", "pred_id")
    pairs = pairs.withColumn("gts", F.count("*").over(of_pred))
    # the partners of a ground-truth trajectory have no other: it is the middle of a star
    pairs = write_again(pairs.withColumns({"preds": F.count("*").over(of_gt), "star": F.max("gts").over(of_gt) == 1}))
    stars = pairs.where("star").groupBy("mode", "gt_id").agg(F.max("n").alias("most"))
    rest = pairs.where("not star").withColumn("star", F.max("preds").over(of_pred) == 1)
    stars = stars.select("mode", "most").unionByName(rest.where("star").groupBy("mode", "pred_id").agg(F.max("n").alias("most")).select("mode", "most"))
    mixed = write_again(rest.where("not star").select("mode", "gt_id", "pred_id", "n"))
    each = stars.select("mode", F.col("most").alias("idtp"))
    if not mixed.isEmpty():
        labels = connected_components(mixed.select(node(0, "gt_id").alias("a"), node(1, "pred_id").alias("b"))).select(F.col("node").alias("a"), "label")
        comps = mixed.withColumn("a", node(0, "gt_id")).join(labels, "a").drop("a")
        each = each.unionByName(comps.groupBy("label").applyInPandas(solve, "mode string, idtp long"))
    return each.groupBy("mode").agg(F.sum("idtp").alias("idtp"))


def _metrics(sizes: DataFrame, matched: DataFrame) -> DataFrame:
    """sizes: mode, ng, gt_ids, np, pred_ids; matched: mode, idtp."""
    rows = sizes.join(matched, "mode", "left").withColumn("idtp", F.coalesce("idtp", F.lit(0)))
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    return rows.select(
        "mode",
        "idtp",
        (F.col("np") - F.col("idtp")).alias("fp"),
        (F.col("ng") - F.col("idtp")).alias("fn"),
        share(2 * F.col("idtp"), F.col("ng") + F.col("np")).alias("idf1"),
        share(F.col("idtp"), F.col("np")).alias("idp"),
        share(F.col("idtp"), F.col("ng")).alias("idr"),
        "gt_ids",
        "pred_ids",
    )


def _sizes(gt: DataFrame, pred: DataFrame, modes: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (n: how many a row stands for) and ids of both sides for each mode, which names the id columns."""
    of = lambda rows, n, ids, at: rows.agg(*[F.coalesce(F.sum("n"), F.lit(0)).alias("n_"), *[F.countDistinct(c[at]).alias(m) for m, c in modes.items()]]).select(F.col("n_").alias(n), F.explode(F.create_map(*[x for m in modes for x in (F.lit(m), F.col(m))])).alias("mode", ids))
    return of(gt, "ng", "gt_ids", 0).join(of(pred, "np", "pred_ids", 1), "mode")


def id_metrics(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: idtp, fp, fn, idf1, idp, idr, gt_ids, pred_ids, from the best one-to-one match of trajectories."""
    pairs = trajectory_pairs(gt, pred, threshold).withColumn("mode", F.lit("all"))
    sizes = _sizes(*[rows.groupBy("id").agg(F.count("*").alias("n")) for rows in (gt, pred)], {"all": ("id", "id")})
    return _metrics(sizes, _matched_frames(pairs)).drop("mode")


def mtmc_report(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """id_metrics by mode: `single` (ids kept apart by camera), `online` (gid, pending rows their own id), `tracklet` (each track's last gid).

    pred: camera_id, frame, track_id, gid (may be null), x1..y2. Boxes meet once, and a track's last gid meets
    the counts of its pairs and not its boxes.
    """
    own = -namespaced_id(F.col("camera_id"), F.col("track_id")) - 1
    modes = {"single": ("id_single", "id_single"), "online": ("id", "id_online"), "tracklet": ("id", "id_tracklet")}
    track = ["camera_id", "track_id"]
    # what a track's boxes say of it: one row for each of its gids
    said = write_again(pred.groupBy(*track, "gid").agg(F.count("*").alias("n"), F.max("frame").alias("frame")))
    known = F.when(F.col("gid").isNotNull(), F.struct("frame", "gid"))
    last = said.groupBy(*track).agg(F.max(known)["gid"].alias("last"))
    named = {
        "id_single": namespaced_id(F.col("camera_id"), F.col("track_id")),
        "id_online": F.coalesce(F.col("gid"), own),
        "id_tracklet": F.coalesce(F.col("last"), own),
    }
    gt = gt.withColumn("id_single", namespaced_id(F.col("camera_id"), F.col("id")))
    sizes = _sizes(gt.groupBy("id_single", "id").agg(F.count("*").alias("n")), said.withColumn("last", F.max(known).over(Window.partitionBy(*track))["gid"]).withColumns(named), modes)
    ids = lambda rows, names: rows.withColumn("id", F.struct(*names))
    met = _tallies(ids(gt, ["id_single", F.col("id").cast("long").alias("id")]), ids(pred, [*track, F.col("gid").cast("long").alias("gid")]), threshold)
    met = met.select(F.col("gt_id.id_single").alias("gt_single"), F.col("gt_id.id").alias("gt_id"), "pred_id.*", "n").join(last, track, "left").withColumns(named)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col("gt_single" if g == "id_single" else "gt_id").alias("gt_id"), F.col(p).cast("long").alias("pred_id")) for m, (g, p) in modes.items()]))
    pairs = met.select(each.alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).select("k.*", "n")
    return _metrics(sizes, _matched_frames(pairs))


def role_confusion(rows: DataFrame) -> DataFrame:
    """rows (true_role, role): matched, decided (not pending), correct, accuracy and coverage by true role."""
    decided = F.col("role") != "pending"
    out = rows.groupBy("true_role").agg(F.count("*").alias("matched"), F.count(F.when(decided, 1)).alias("decided"), F.count(F.when(F.col("role") == F.col("true_role"), 1)).alias("correct"))
    return out.withColumns({"accuracy": F.col("correct") / F.when(F.col("decided") > 0, F.col("decided")), "coverage": F.col("decided") / F.col("matched")})


def role_matrix(rows: DataFrame, roles: tuple[str, ...] = ("pending", "resident", "staff", "unknown")) -> DataFrame:
    """Counts of predicted roles for each true one."""
    return rows.groupBy("true_role").pivot("role", list(roles)).count().fillna(0)


def unknown_alert_metrics(transitions: DataFrame, matches: DataFrame, unknown_ids: DataFrame) -> DataFrame:
    """Precision and recall of first pending-to-unknown changes. transitions: gid, before, role; matches: gid, gt_id; unknown_ids: gt_id.

    An alert's person is the ground-truth id most often matched to its gid, the least of equal ones.
    """
    alerted = transitions.where("before = 'pending' and role = 'unknown'").select("gid").distinct()
    votes = matches.groupBy("gid", "gt_id").agg(F.count("*").alias("n"))
    person = votes.groupBy("gid").agg(F.max_by("gt_id", F.struct("n", (-F.col("gt_id")).alias("k"))).alias("gt_id"))
    judged = alerted.join(person, "gid", "left").join(unknown_ids.select("gt_id", F.lit(True).alias("right")), "gt_id", "left")
    hits = judged.agg(F.count("*").alias("alerts"), F.count("right").alias("correct"), F.countDistinct(F.when(F.col("right"), F.col("gt_id"))).alias("found"))
    total = unknown_ids.agg(F.countDistinct("gt_id").alias("unknowns"))
    rows = hits.join(total, F.lit(True))
    return rows.select("alerts", "correct", "unknowns", (F.col("correct") / F.when(F.col("alerts") > 0, F.col("alerts"))).alias("precision"), (F.col("found") / F.when(F.col("unknowns") > 0, F.col("unknowns"))).alias("recall"))


def live_role_counts(obs: DataFrame) -> DataFrame:
    """Of each camera's newest frame: how many boxes of each role; vehicles count apart."""
    newest = obs.groupBy("camera_id").agg(F.max("frame").alias("frame"))
    rows = obs.join(newest, ["camera_id", "frame"], "left_semi")
    kind = F.when(F.col("label") != "person", "vehicle").otherwise(F.coalesce("role", F.lit("pending")))
    return rows.groupBy("camera_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def headline_metrics(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    """The last report's value for each wanted metric; synthetic plate reports never count; absent ones are null.

    reports: kind, name, metric, value, synthetic; metrics: kind, metric.
    """
    rows = reports.where(~((F.col("kind") == "plates") & F.col("synthetic")))
    last = rows.groupBy("kind", "metric").agg(F.max_by("value", "name").alias("value"), F.max("name").alias("report"))
    return metrics.join(last, ["kind", "metric"], "left")


def unknown_people(gt: DataFrame, enrolled: DataFrame, after: int) -> DataFrame:
    """Ids seen from frame `after` on that are not enrolled."""
    return gt.where(F.col("frame") >= after).select("id").distinct().join(enrolled.select("id"), "id", "left_anti")


def pick_shots(boxes: DataFrame, n: int = 8, apart: int = 15) -> DataFrame:
    """Up to n shots of each person: tallest first, at least `apart` frames from the chosen ones of the same camera.

    boxes: id, camera_id, frame, height; of several boxes of a person in one frame the tallest counts. A shot that is
    chosen rules out fewer than 2 x apart frames, so all n are among the tallest n x (2 x apart - 1), which is all
    that is gathered.
    """
    one = boxes.groupBy("id", "camera_id", "frame").agg(F.max("height").alias("height"))
    tall = Window.partitionBy("id").orderBy(F.desc("height"), "camera_id", "frame")
    rows = one.withColumn("place", F.row_number().over(tall)).where(F.col("place") <= n * (2 * apart - 1))
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "camera_id", "frame"))).alias("all"))
    none = F.array().cast(lists.schema["all"].dataType.simpleString())

    def step(acc, x):
        near = F.exists(acc, lambda y: (y["camera_id"] == x["camera_id"]) & (F.abs(y["frame"] - x["frame"]) < apart))
        return F.when((F.size(acc) < n) & ~near, F.concat(acc, F.array(x))).otherwise(acc)

    return lists.select("id", F.posexplode(F.aggregate("all", none, step)).alias("place", "s")).select("id", "place", "s.camera_id", "s.frame", (-F.col("s.h")).alias("height"))


def select_enrolment(gt: DataFrame, num_frames: int, residents: int, staff: int, seed: str = "0", least: int = 30, height: float = 100.0) -> DataFrame:
    """Persons with enough tall boxes in the first quarter; the first by a seeded hash are residents, the next staff."""
    early = gt.where((F.col("frame") < num_frames * 0.25) & (F.col("label") == "person") & (F.col("y2") - F.col("y1") >= height))
    fit = early.groupBy("id").agg(F.count("*").alias("boxes")).where(F.col("boxes") >= least)
    first = fit.withColumn("turn", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))).orderBy("turn", "id").limit(residents + staff)
    place = F.row_number().over(Window.orderBy("turn", "id"))  # residents + staff rows are all there are
    return first.withColumn("place", place).select("id", F.when(F.col("place") <= residents, "resident").otherwise("staff").alias("role"), "boxes")


def evaluable_datasets(datasets: DataFrame) -> DataFrame:
    """Sets whose ground truth is exhaustive with ids across cameras; an error if there is none."""
    out = datasets.where("exhaustive and cross_camera_ids")
    if out.isEmpty():
        raise ValueError("no data set has exhaustive ground truth with ids across cameras")
    return out


def sweep(rows: DataFrame, spark: SparkSession, name: str, values: list) -> DataFrame:
    """rows once for each value of a parameter, which becomes a column to group by."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
