"""Queries that take derived rows through files and streams: readers, writers and streaming jobs against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..helpers.tables import step_folder, write_again
from ..operators import maintenance
from ..sources import io
from ..streaming import jobs
from .queries import _KEPT, _MARKED, _TAIL, _TRIGGERS, COOLDOWN, GAP, MATRIX, ORACLE_SQL, RULES, calib_df, query, sightings_of, zones_df

#: Times and frames of the closing rows, far behind all others: they move the watermark past them.
END = 4e9
#: Text of boxes takes about a tenth so; it is read by file and not by parts of one.
PACKED = "gzip"


def _scratch(spark: SparkSession) -> str:
    return f"{step_folder(spark)}/{uuid.uuid4().hex}"


# --- readers and writers


@query("s1_read_mtmc_ground_truth", "v_gt", sql="SELECT right(camera_id, 1) AS camera, id, frame, x1, y1, x1 + (x2 - x1) AS x2, y1 + (y2 - y1) AS y2 FROM v_gt")
def _s1(gt):
    path = _scratch(gt.sparkSession)
    line = F.concat_ws(" ", F.regexp_extract("camera_id", r"(\d+)$", 1), *[F.col(c).cast("string") for c in ("id", "frame", "x1", "y1")], (F.col("x2") - F.col("x1")).cast("string"), (F.col("y2") - F.col("y1")).cast("string"), F.lit("0 0"))
    gt.select(line.alias("value")).write.text(path, compression=PACKED)
    return io.read_mtmc_ground_truth(gt.sparkSession, path)


@query("s2_read_kpf", "v_det", sql="SELECT track_id AS id, frame, x1, y1, x2, y2, CASE WHEN label = 'car' THEN 'vehicle' ELSE label END AS label FROM v_det")
def _s2(det):
    geom, types = _scratch(det.sparkSession), _scratch(det.sparkSession)
    box = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    det.select(F.concat(F.lit("- { geom: { id1: "), F.col("track_id"), F.lit(", id0: 0, ts0: "), F.col("frame"), F.lit(", ts1: 1, g0: "), box, F.lit(" , src: truth } }")).alias("value")).write.text(geom, compression=PACKED)
    kind = F.when(F.col("label") == "car", "Vehicle").otherwise("Person")
    det.select("track_id", kind.alias("kind")).distinct().select(F.concat(F.lit("- { types: { id1: "), F.col("track_id"), F.lit(" , cset3: { "), F.col("kind"), F.lit(": 1.0 } } }")).alias("value")).write.text(types, compression=PACKED)
    return io.read_kpf(det.sparkSession, geom, types)


@query("s3_read_ground_truth_json", "v_gt", sql="SELECT camera_id AS camera, frame, id AS global_id, x1, y1, x2, y2, label AS class FROM v_gt")
def _s3(gt):
    path = _scratch(gt.sparkSession)
    head = {"dataset": F.lit("site"), "camera": F.col("camera_id"), "fps": F.lit(30.0), "width": F.lit(1280), "height": F.lit(720), "num_frames": F.lit(0), "exhaustive": F.lit(True), "cross_camera_ids": F.lit(True), "global_id": F.col("id"), "class": F.col("label")}
    io.write_ground_truth(gt.withColumns(head), path, compression=PACKED)
    return io.read_ground_truth_json(gt.sparkSession, path).select("camera", "frame", "global_id", "x1", "y1", "x2", "y2", "class")


@query("s4_read_calibration", "v_det", sql=f"SELECT right(camera_id, 1)::INTEGER AS camera, SEQ(12) AS at, unnest({MATRIX}) AS v FROM (SELECT DISTINCT camera_id FROM v_det)")
def _s4(det):
    path = _scratch(det.sparkSession)
    sensor = F.struct(F.col("camera_id").alias("id"), F.array(*[F.slice("p", 4 * r + 1, 4) for r in range(3)]).alias("cameraMatrix"))
    # the settings of a site's cameras are one document by their format
    calib_df(det).agg(F.collect_list(sensor).alias("sensors")).coalesce(1).write.json(path)
    return io.read_calibration(det.sparkSession, path, None).select("camera", F.posexplode("p").alias("at", "v"))


@query("s5_read_plate_reads", "v_reads", sql="SELECT track_id, frame, text, conf, min_char_conf, frame + 0.5e0 AS x1, 4::BIGINT AS sides FROM v_reads")
def _s5(reads):
    path = _scratch(reads.sparkSession)
    io.write_plate_reads(reads.withColumn("plate_xyxy", F.array(F.col("frame") + 0.5, F.lit(1.0), F.col("frame") + 2.0, F.lit(3.0))), path)
    return io.read_plate_reads(reads.sparkSession, path).select("track_id", "frame", "text", "conf", "min_char_conf", F.col("plate_xyxy")[0].alias("x1"), F.size("plate_xyxy").cast("long").alias("sides"))


@query("s6_write_detections", "v_det", sql="SELECT camera_id, frame, track_id, x1::FLOAT AS x1, y1::FLOAT AS y1, x2::FLOAT AS x2, y2::FLOAT AS y2, conf::FLOAT AS conf, label FROM v_det")
def _s6(det):
    path = _scratch(det.sparkSession)
    io.write_detections(det.withColumns({c: F.col(c).cast("float") for c in ("x1", "y1", "x2", "y2", "conf")}), path)
    return io.read_detections(det.sparkSession, path)


@query("s7_read_plate_labels", "v_vehicles", sql="SELECT vehicle_id || '.jpg' AS filename, plate FROM v_vehicles")
def _s7(vehicles):
    path = _scratch(vehicles.sparkSession)
    vehicles.select(F.concat(F.col("vehicle_id").cast("string"), F.lit(".jpg")).alias("filename"), "plate").write.option("header", True).csv(path)
    return io.read_plate_labels(vehicles.sparkSession, path)


@query("s8_zones_df", "v_edges", sql="SELECT camera_id, zone, restricted, e - 1 AS at, ax AS x, ay AS y FROM v_edges")
def _s8(edges):
    return zones_df(edges).select("camera_id", "zone", "restricted", F.posexplode("polygon").alias("at", "p")).select("camera_id", "zone", "restricted", "at", "p.x", "p.y")


@query("s9_write_report", "v_gt", sql="SELECT camera_id, count(*) AS boxes, count(DISTINCT id) AS ids FROM v_gt GROUP BY ALL")
def _s9(gt):
    path = _scratch(gt.sparkSession)
    io.write_report(gt.groupBy("camera_id").agg(F.count("*").alias("boxes"), F.countDistinct("id").alias("ids")), path)
    return gt.sparkSession.read.schema("camera_id string, boxes long, ids long").json(path)


@query("s10_write_tables", "v_alerts", sql="SELECT event_id, rule, gid, floor(ts / 86400)::BIGINT AS day FROM v_alerts")
def _s10(alerts):
    path = _scratch(alerts.sparkSession)
    day = F.floor(F.col("ts") / 86400)
    io.write_tables({"events": alerts.select("event_id", "rule", "gid", (day % 7).alias("date"), day.alias("day"))}, path)
    return alerts.sparkSession.read.parquet(f"{path}/events").select("event_id", "rule", "gid", "day")


@query("x4_overwrite_cameras", "v_tracks", "v_samples", sql="""
    WITH t AS (SELECT t.*, e.sample_id AS emb_id FROM v_tracks t LEFT JOIN v_samples e ON e.sample_id = t.track_id WHERE t.camera_id NOT IN ('cam_3', 'cam_5') OR (t.camera_id = 'cam_3' AND end_ts < 8e8))
    SELECT camera_id, count(*) AS tracks, count(emb_id) AS embeddings, camera_id <> 'cam_3' AS same_files FROM t GROUP BY camera_id""")
def _x4(tr, samples):
    """cam_3 gets part of its tracks anew and cam_5 none; the other cameras' files are the ones that were there."""
    spark, folder = tr.sparkSession, _scratch(tr.sparkSession)
    emb = tr.select("camera_id", "track_id").join(samples.select(F.col("sample_id").alias("track_id"), "emb"), "track_id")
    cameras = [r["camera_id"] for r in tr.select("camera_id").distinct().collect()]  # a site's cameras
    maintenance.overwrite_cameras(tr, emb, folder, cameras)
    read = lambda name, like: spark.read.schema(like.schema).parquet(f"{folder}/{name}")
    files = lambda: read("tracks", tr).select("camera_id", F.col("_metadata.file_path").alias("f")).unionByName(read("embeddings", emb).select("camera_id", F.col("_metadata.file_path").alias("f"))).distinct()
    before = write_again(files())
    new = write_again(tr.where("camera_id = 'cam_3' AND end_ts < 8e8"))
    maintenance.overwrite_cameras(new, emb.join(new.select("track_id"), "track_id", "left_semi"), folder, ["cam_3", "cam_5"])
    kept = before.join(files(), ["camera_id", "f"], "full").groupBy("camera_id").agg(F.count("*").alias("all"))
    both = before.join(files(), ["camera_id", "f"]).groupBy("camera_id").agg(F.count("*").alias("same"))
    same = kept.join(both, "camera_id", "left").select("camera_id", F.coalesce(F.col("same") == F.col("all"), F.lit(False)).alias("same_files"))
    found = read("tracks", tr).groupBy("camera_id").agg(F.count("*").alias("tracks")).join(read("embeddings", emb).groupBy("camera_id").agg(F.count("*").alias("embeddings")), "camera_id", "left")
    return found.join(same, "camera_id").select("camera_id", "tracks", F.coalesce("embeddings", F.lit(0)).alias("embeddings"), "same_files")


@query("g1_random_plates", "v_vehicles", sql="SELECT count(*) AS n, count(*) AS valid, count(*) AS again FROM v_vehicles")
def _g1(vehicles):
    """As many plates as there are vehicles: all are valid, and drawn anew they are the same."""
    n, spark = vehicles.count(), vehicles.sparkSession
    draw = lambda: io.random_plates(spark, n, seed=3).withColumn("at", F.monotonically_increasing_id())
    known = fn.normalize_plate(F.col("plate"))
    return draw().join(draw().withColumnRenamed("plate", "other"), "at").agg(F.count("*").alias("n"), F.count_if((known["kind"] != "invalid") & (known["corrections"] == 0)).alias("valid"), F.count_if(F.col("plate") == F.col("other")).alias("again"))


@query("g2_train_val_split", "v_vehicles", sql="SELECT vehicle_id, CASE WHEN row_number() OVER (ORDER BY vehicle_id) <= floor((SELECT count(*) FROM v_vehicles) * 0.25) THEN 'val' ELSE 'train' END AS split FROM v_vehicles")
def _g2(vehicles):
    return io.train_val_split(vehicles.select("vehicle_id"), ["vehicle_id"], 0.25)


# --- streams: the rows go to files with closing rows behind them, the job runs over all that is there


def _run(df: DataFrame, close: list[tuple], make, late: str = "1 second") -> DataFrame:
    """What a streaming job makes of df (with ts) and its closing rows, read from the files that it wrote."""
    spark = df.sparkSession
    source, out, state = _scratch(spark), _scratch(spark), _scratch(spark)
    df.unionByName(spark.createDataFrame(close, df.schema)).write.parquet(source)
    rows = make(jobs.with_event_time(spark.readStream.schema(df.schema).parquet(source), late=late))
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _closed(obs: DataFrame) -> tuple[DataFrame, list[tuple]]:
    rows = obs.select("person", "zone", "ts", "role", "restricted")
    return rows, [("end", "end", END, "staff", False), ("end", "end", END + 1e6, "staff", False)]


@query("st1_stream_presences", "v_obs", sql=f"WITH {_MARKED} SELECT person, zone, min(ts) AS entered, max(ts) AS last, count(*) AS observations FROM marked GROUP BY person, zone, presence")
def _st1(obs):
    return _run(*_closed(obs), lambda s: jobs.stream_presences(s, GAP)).where("person <> 'end'")


@query("s11_stream_once", "v_obs", sql=f"WITH {_MARKED} SELECT person, zone, min(ts) AS entered, max(ts) AS last, count(*) AS observations FROM marked GROUP BY person, zone, presence")
def _s11(obs):
    """Observations in two files, most of them twice and the second with repeats of the first's end, then rows that come too late."""
    spark = obs.sparkSession
    source, out, state = (_scratch(spark) for _ in range(3))
    rows = obs.select("event_id", "person", "zone", "ts")
    low, high = rows.agg(F.coalesce(F.min("ts"), F.lit(0.0)), F.coalesce(F.max("ts"), F.lit(0.0))).first()
    middle = (low + high) / 2
    # rows are told late by the watermark of the batch before, so two batches of closing rows stand ahead of them
    close, again = (spark.createDataFrame([(-n, "end", "end", END + n * 1e6)], rows.schema) for n in (1, 2))
    first, second = rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle)
    first = first.unionByName(first.where("event_id % 3 <> 0"))
    second = second.unionByName(second.where("event_id % 3 <> 1")).unionByName(rows.where(F.col("ts").between(middle - 1800, middle)))
    late = rows.where("event_id % 5 = 0").withColumns({"event_id": F.col("event_id") + 10_000_000_000, "person": F.concat(F.lit("late "), "person")})
    for part in (first, second, close, again, late):  # a file each, read in this order
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    job = jobs.stream_presences(io.once(stream, ["event_id"], "1 hour"), GAP)
    job.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(job.schema).parquet(out).where("person <> 'end'")


@query("st2_stream_alerts", "v_obs", sql=f"WITH {_MARKED}, {_TAIL}, {_TRIGGERS}, {_KEPT} SELECT rule, severity, person, zone, ts, role, dwell FROM kept")
def _st2(obs):
    spark, (rows, close) = obs.sparkSession, _closed(obs)
    source, middle, out, one, two = (_scratch(spark) for _ in range(5))
    rows.unionByName(spark.createDataFrame(close, rows.schema)).write.parquet(source)
    stream = jobs.with_event_time(spark.readStream.schema(rows.schema).parquet(source), late="1 second")
    running, alerts = jobs.start_alerts(stream, RULES, middle, one, GAP, COOLDOWN, availableNow=True)
    running.awaitTermination()
    alerts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", two).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(out)


@query("st7_write_latest_frame", "v_det", sql="SELECT camera_id, frame, track_id FROM v_det JOIN (SELECT camera_id, max(frame) AS frame FROM v_det GROUP BY ALL) USING (camera_id, frame)")
def _st7(det):
    spark = det.sparkSession
    source, out, state = (_scratch(spark) for _ in range(3))
    det.write.parquet(source)
    jobs.write_latest_frame(spark.readStream.schema(det.schema).parquet(source), out, state).awaitTermination()
    return spark.read.parquet(out).select("camera_id", "frame", "track_id")


@query("st3_stream_plate_votes", "v_reads")
def _st3(reads):
    rows = reads.where("min_char_conf >= 0.4").withColumn("p", fn.normalize_plate(F.col("text")))
    rows = rows.select("camera_id", "track_id", F.col("frame").cast("long").alias("frame"), (F.col("frame") + 1000.0).alias("ts"), F.when(F.col("p.kind") != "invalid", F.col("p.text")).alias("plate"), "conf")
    return _run(rows, [("end", -1, 1, END, None, 0.1), ("end", -1, 2, END + 1e6, None, 0.1)], jobs.stream_plate_votes)


@query("st5_stream_track_segments", "v_det")
def _st5(det):
    rows = det.select("camera_id", "track_id", F.col("frame").cast("long").alias("frame"), (F.col("frame") / 30.0 + 1000.0).alias("ts"))
    close = [("end", -1, 1, END), ("end", -1, 2, END + 1e6)]
    return _run(rows, close, lambda s: jobs.stream_track_segments(s, 30.0, 0, 0.25, 0.2)).where("camera_id <> 'end'")


@query("st4_stream_identity_roles", "v_samples", "v_gallery", "v_people")
def _st4(samples, gallery, people):
    """The gallery before all samples (not before the epoch, where watermarks begin), and without person 3 after them: W9's rows, then W10's."""
    spark = samples.sparkSession
    one, two, out, state = (_scratch(spark) for _ in range(4))
    rows = samples.select("gid", "ts", "kind", "quality", "emb")
    rows.write.parquet(one)
    known = gallery.join(people, "person_id").select("person_id", "role", "kind", "emb")
    versions = known.withColumn("ts", F.lit(0.5)).unionByName(known.where("person_id <> 3").withColumn("ts", F.lit(END)))
    versions.write.parquet(two)
    source = lambda path, like: jobs.with_event_time(spark.readStream.schema(like.schema).parquet(path))
    job = jobs.stream_identity_roles(source(one, rows), source(two, versions), t_face=0.28, t_body=0.28)
    job.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(job.schema).parquet(out).withColumn("ts", F.when(F.col("kind") != "gallery", F.col("ts")))


@query("st6_stream_global_ids", "v_samples")
def _st6(samples):
    rows = sightings_of(samples).withColumn("ts", F.col("end_ts"))
    last = lambda at: tuple({"site": "end", "camera_id": "end", "track_id": -1, "positions": [], "emb": [0.0], "end_emb": [0.0], "n_samples": 0}.get(f.name, at if f.dataType.typeName() == "double" else None) for f in rows.schema)
    return _run(rows, [last(END), last(END + 1e6)], lambda s: jobs.stream_global_ids(s, longest_s=END, threshold=0.3)).where("site <> 'end'")


# these two take the SQL of their batch queries, which holds its views already
ORACLE_SQL["st3_stream_plate_votes"] = ORACLE_SQL["w8_plate_decisions"]
ORACLE_SQL["st5_stream_track_segments"] = f"SELECT camera_id, track_id, segment, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS rows FROM ({ORACLE_SQL['w6_segment_tracks']}) GROUP BY ALL"
