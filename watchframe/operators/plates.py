"""Plate reads: filtering, votes, decisions, the registry and text metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalar import bounded_levenshtein, clean_plate, normalize_plate
from .boxes import frame_pairs

TRACK = ["camera_id", "track_id"]


def filter_reads(reads: DataFrame, min_char_conf: float = 0.4) -> DataFrame:
    """Reads whose weakest character is sure enough and whose text is a valid plate; adds plate."""
    fit = reads.where(F.col("min_char_conf") >= min_char_conf).withColumn("p", normalize_plate(F.col("text")))
    return fit.where("p.kind <> 'invalid'").withColumn("plate", F.col("p.text")).drop("p")


def plate_vote(reads: DataFrame) -> DataFrame:
    """Winner of each track's votes: plate, reads, share of the weight, confidence, first five raw texts.

    reads: camera_id, track_id, frame, plate, text, conf. Weight is conf; the leader has the most weight,
    then reads; of full ties the one read first, then by name.
    """
    per = reads.groupBy(*TRACK, "plate").agg(F.sum("conf").alias("weight"), F.count("*").alias("reads"), F.min("frame").alias("first"), F.avg("conf").alias("mean_conf"))
    lead = F.struct("weight", "reads", (-F.col("first")).alias("early"), "plate")
    best = per.groupBy(*TRACK).agg(F.max_by(F.struct("plate", "reads", "weight", "mean_conf"), lead).alias("b"), F.sum("weight").alias("total"))
    raw = reads.withColumn("turn", F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame", "text"))).where("turn <= 5")
    raw = raw.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("raw"))
    share = F.col("b.weight") / F.col("total")
    out = best.join(raw, TRACK)
    return out.select(*TRACK, "b.plate", "b.reads", share.alias("share"), (share * F.col("b.mean_conf")).alias("confidence"), F.array_join("raw.text", ",").alias("raw_texts"))


def plate_decisions(reads: DataFrame, min_reads: int = 3, min_share: float = 0.5, max_reads: int = 20) -> DataFrame:
    """The running vote's decision for each track: frame, plate, reads so far and whether it came early.

    reads: camera_id, track_id, frame, plate (null if invalid), conf; only the first max_reads count,
    invalid ones too. The first read after which the leader has enough reads and share decides; a track
    that never gets there settles with its last vote. Tracks without a valid read have no row.
    """
    turn = Window.partitionBy(*TRACK).orderBy("frame", "plate")
    rows = reads.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max_reads)
    # at most max_reads states of at most max_reads plates for each track
    state = rows.where("plate is not null").select(*TRACK, "turn", "frame", "plate", "conf")
    later = state.select(*TRACK, F.col("turn").alias("at"), F.col("frame").alias("at_frame"))
    upto = later.join(state, TRACK).where("turn <= at")
    per = upto.groupBy(*TRACK, "at", "at_frame", "plate").agg(F.sum("conf").alias("weight"), F.count("*").alias("n"), F.min("turn").alias("first"))
    lead = F.struct("weight", "n", (-F.col("first")).alias("early"))
    votes = per.groupBy(*TRACK, "at", "at_frame").agg(F.max_by(F.struct("plate", "n", "weight"), lead).alias("b"), F.sum("weight").alias("total"))
    enough = (F.col("b.n") >= min_reads) & (F.col("b.weight") / F.col("total") >= min_share)
    votes = votes.withColumn("enough", enough)
    first = F.min_by(F.struct("at_frame", "b"), F.when(F.col("enough"), F.col("at")))
    last = F.max_by(F.struct("at_frame", "b"), F.col("at"))
    out = votes.groupBy(*TRACK).agg(first.alias("f"), last.alias("l")).withColumn("d", F.coalesce("f", "l"))
    return out.select(*TRACK, F.col("d.at_frame").alias("frame"), F.col("d.b.plate").alias("plate"), F.col("d.b.n").alias("reads"), F.col("f").isNotNull().alias("early"))


def _deletions(text):
    """The text and all texts with one character less: equal for texts at most one edit apart."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    less = F.transform(spots, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), less))


def registry_match(plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """plates (plate) against vehicles (plate): status, matched plate and distance.

    Exact is registered; the nearest within one edit (then the least plate) is likely_registered; the rest
    is unregistered. Only misses look further, through keys with one character deleted, so neither side is
    compared row by row.
    """
    known = vehicles.select(F.col("plate").alias("matched")).distinct()
    asked = plates.select("plate").distinct()
    exact = asked.join(known, asked["plate"] == known["matched"]).select("plate", "matched", F.lit(0).alias("distance"))
    miss = asked.join(known, asked["plate"] == known["matched"], "left_anti")
    near = miss.withColumn("key", F.explode(_deletions(F.col("plate")))).join(known.withColumn("key", F.explode(_deletions(F.col("matched")))), "key")
    near = near.select("plate", "matched").distinct().withColumn("distance", bounded_levenshtein(F.col("plate"), F.col("matched"), 1)).where("distance <= 1")
    near = near.groupBy("plate").agg(F.min(F.struct("distance", "matched")).alias("m")).select("plate", "m.matched", "m.distance")
    found = plates.join(exact.unionByName(near), "plate", "left")
    status = F.when(F.col("distance") == 0, "registered").when(F.col("distance") == 1, "likely_registered").otherwise("unregistered")
    return found.withColumn("status", status)


def plate_text_metrics(pairs: DataFrame) -> DataFrame:
    """pairs (label, text): exact after correction, exact as read, character accuracy, valid share."""
    p, clean = normalize_plate(F.col("text")), clean_plate(F.col("label"))
    rows = pairs.withColumn("p", p).withColumn("clean", clean)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.agg(
        F.count("*").alias("n"),
        share(F.col("p.text") == F.col("clean")).alias("exact"),
        share(clean_plate(F.col("text")) == F.col("clean")).alias("exact_raw"),
        (1 - F.sum(F.levenshtein("p.text", "clean")) / F.sum(F.length("clean"))).alias("char_accuracy"),
        share(F.col("p.kind") != "invalid").alias("valid_rate"),
    )


def det_metrics(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy box matching per image: tp, fp, fn. Both: image (or camera_id and frame), id, x1..y2.

    Each prediction goes for its best box; the best overlaps first, each box once.
    """

    def hits(pairs: pa.Table, frame: np.ndarray) -> pa.Table:
        g, p = pairs.column("gt_id").to_numpy(), pairs.column("pred_id").to_numpy()
        over = pairs.column("iou").to_numpy()
        order = np.lexsort((g, -over, p, frame))  # of equal overlaps the least id
        p, frame, g = p[order], frame[order], g[order]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (frame[1:] != frame[:-1])
        return pa.table({"tp": pa.array([np.unique(np.stack([frame[first], g[first]]), axis=1).shape[1] if len(g) else 0], pa.int64())})

    framed = lambda df: df.withColumns({"camera_id": F.col("image"), "frame": F.lit(0).cast("long")}) if "image" in df.columns else df
    tp = frame_pairs(framed(gt), framed(pred), threshold, hits, StructType([StructField("tp", LongType())])).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    return tp.join(pred.agg(F.count("*").alias("np")), F.lit(True)).join(gt.agg(F.count("*").alias("ng")), F.lit(True)).select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def training_mix(synthetic: DataFrame, real: DataFrame, share: float = 0.3) -> DataFrame:
    """Synthetic rows and the real ones (text cleaned), the latter repeated max(1, int(share * n_syn / n_real)) times."""
    counts = synthetic.agg(F.count("*").alias("s")).join(real.agg(F.count("*").alias("r")), F.lit(True))
    times = counts.select(F.greatest(F.lit(1), F.floor(share * F.col("s") / F.greatest(F.col("r"), F.lit(1)))).cast("int").alias("times"))
    again = real.withColumn("plate", clean_plate(F.col("plate"))).join(times, F.lit(True)).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return synthetic.unionByName(again.select(*synthetic.columns))
