"""Upserts, enrolment, retention and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import l2_normalize, normalize_plate
from ..helpers.tables import numbered


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and existing ones whose key it does not have."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def upsert_cameras(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Cameras after a sync: all but the id and creation time is updated, missing ones are inserted."""
    kept = existing.select("camera_id", F.col("created_at").alias("was"))
    rows = new.join(kept, "camera_id", "left").withColumn("created_at", F.coalesce("was", "created_at")).drop("was")
    return upsert(existing, rows, "camera_id")


def replace_tracks(tracks: DataFrame, embeddings: DataFrame, new: DataFrame, cameras: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tracks, embeddings) with the cameras' tracks and their embeddings replaced by new tracks."""
    gone = tracks.where(F.col("camera_id").isin(cameras))
    kept = tracks.where(~F.col("camera_id").isin(cameras))
    return kept.unionByName(new), embeddings.join(gone.select("track_id"), "track_id", "left_anti")


def replace_partitions(rows: DataFrame, path: str, by: str, values: list) -> None:
    """Writes rows anew for `values` of the partition column `by` of the Parquet table at path; other partitions' files stay as they are.

    Partitions that rows have are overwritten when the job commits; those of `values` that they have not are removed
    after it. Rows of other values are an error. A new table is made if there is none.
    """
    spark = rows.sparkSession
    if not rows.where(~F.coalesce(F.col(by).isin(values), F.lit(False))).isEmpty():
        raise ValueError(f"rows of other partitions than {values}")
    there = {r[by] for r in rows.select(by).distinct().collect()}  # at most the values given
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for value in values:
        if value not in there:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, names.getPartitionPathString(by, str(value))), True)


def overwrite_cameras(tracks: DataFrame, embeddings: DataFrame, folder: str, cameras: list[str]) -> None:
    """The cameras' tracks and embeddings in the tables folder/tracks and folder/embeddings, both partitioned by camera_id, written anew.

    The unit of change is the camera: embeddings carry their track's camera, so what depends on the tracks is replaced
    with them and no other camera's files are read or written. Tracks come last: a run that stopped in between leaves
    no track whose embedding is not there, and is done again with the same result.
    """
    replace_partitions(embeddings, f"{folder.rstrip('/')}/embeddings", "camera_id", cameras)
    replace_partitions(tracks, f"{folder.rstrip('/')}/tracks", "camera_id", cameras)


def delete_unit(people: DataFrame, embeddings: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """(people, embeddings) without a unit's people."""
    gone = people.where(F.col("unit") == unit)
    return people.where(F.coalesce(F.col("unit") != unit, F.lit(True))), embeddings.join(gone.select("person_id"), "person_id", "left_anti")


def next_ids(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """new rows with ids after the table's largest, by order; the order is a range partitioning, not one task."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]
    return numbered(new, order, "place_").withColumn(key, F.col("place_") + F.lit(top)).drop("place_")


def audit_rows(rows: DataFrame, actor: str, action: str, target: Column, ts: Column) -> DataFrame:
    return rows.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), target.cast("string").alias("target"), ts.alias("ts"))


def retention(tracks: DataFrame, identities: DataFrame, embeddings: DataFrame, events: DataFrame, now: float, days: float = 7.0) -> dict[str, DataFrame]:
    """What the retention of unidentified people leaves: tracks, embeddings, events, files to delete, and a one-row report.

    Tracks that ended before the cutoff, of people still unknown or pending, lose embeddings and thumbnail;
    their rows stay. Events of such identities lose their thumbnail too.
    """
    cutoff = now - days * 86400
    roles = identities.select("gid", "role_state")
    role = F.coalesce("role_state", "role", F.lit("pending"))
    old = tracks.join(roles, "gid", "left").where((F.col("end_ts") < cutoff) & role.isin("unknown", "pending"))
    due = old.select("track_id", "thumb")
    marked = tracks.join(due.select("track_id", F.lit(True).alias("due")), "track_id", "left")
    event_role = F.coalesce("role_state", F.lit("pending"))
    late = events.join(roles, "gid", "left").where((F.col("ts") < cutoff) & event_role.isin("unknown", "pending") & F.col("thumb"))
    new_events = events.join(late.select("event_id", F.lit(True).alias("due")), "event_id", "left").withColumn("thumb", F.col("thumb") & F.col("due").isNull()).drop("due")
    files = due.where("thumb is not null").select(F.col("thumb").alias("file")).unionByName(late.select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("file")))
    lost = embeddings.join(due, "track_id", "left_semi")
    report = due.agg(F.count("*").alias("tracks")).join(lost.agg(F.count("*").alias("embeddings")), F.lit(True)).join(late.agg(F.count("*").alias("events")), F.lit(True)).join(files.agg(F.count("*").alias("files")), F.lit(True))
    return {
        "tracks": marked.withColumn("thumb", F.when(F.col("due").isNull(), F.col("thumb"))).drop("due"),
        "embeddings": embeddings.join(due, "track_id", "left_anti"),
        "events": new_events,
        "files": files,
        "report": report,
        "audit": audit_rows(report, "system", "retention", F.col("tracks"), F.lit(now)),
    }


def enroll_batch(requests: DataFrame, shots: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted people, their embeddings, refusals with a reason).

    requests: request_id, name, role, consent; shots: request_id, kind, emb. Consent, the role resident or
    staff, and three shots of a face or a body are needed; faces are dropped if there are fewer than three.
    """
    n = shots.groupBy("request_id").agg(F.count(F.when(F.col("kind") == "face", 1)).alias("faces"), F.count(F.when(F.col("kind") == "body", 1)).alias("bodies"))
    rows = requests.join(n, "request_id", "left").fillna(0, ["faces", "bodies"])
    reason = (
        F.when(~F.coalesce("consent", F.lit(False)), "no consent")
        .when(~F.coalesce(F.col("role").isin("resident", "staff"), F.lit(False)), "role")
        .when((F.col("faces") < least) & (F.col("bodies") < least), "too few shots")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null")
    use = good.select("request_id", F.col("faces") >= least)
    vectors = shots.join(use.toDF("request_id", "with_faces"), "request_id").where("kind = 'body' or with_faces")
    vectors = vectors.select("request_id", "kind", l2_normalize(F.col("emb")).alias("emb"))
    return good.drop("reason", "faces", "bodies"), vectors, rows.where("reason is not null").select("request_id", "reason")


def delete_people(people: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return people.join(gone.select("person_id"), "person_id", "left_anti"), embeddings.join(gone.select("person_id"), "person_id", "left_anti")


def people_summary(people: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Face and body samples of each person, 0 where there are none."""
    counts = embeddings.groupBy("person_id").pivot("kind", ["face", "body"]).count()
    return people.join(counts, "person_id", "left").fillna(0, ["face", "body"])


def register_vehicles(vehicles: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vehicles with the accepted ones, refusals): plates are normalised; invalid and known ones, and later rows of one plate in the batch, are refused.

    vehicles: plate, owner; batch: row, plate, owner.
    """
    rows = batch.withColumn("p", normalize_plate(F.col("plate"))).withColumn("fixed", F.col("p.text"))
    turn = F.row_number().over(Window.partitionBy("fixed").orderBy("row"))
    known = vehicles.select(F.col("plate").alias("fixed"), F.lit(True).alias("known"))
    rows = rows.withColumn("turn", turn).join(known, "fixed", "left")
    reason = F.when(F.col("p.kind") == "invalid", "invalid").when(F.col("known") | (F.col("turn") > 1), "duplicate")
    rows = rows.withColumn("reason", reason)
    new = rows.where("reason is null").select(F.col("fixed").alias("plate"), "owner")
    return vehicles.select("plate", "owner").unionByName(new), rows.where("reason is not null").select("row", "plate", "reason")


def remove_vehicles(vehicles: DataFrame, plates: DataFrame) -> DataFrame:
    gone = plates.select(normalize_plate(F.col("plate"))["text"].alias("plate")).distinct()
    return vehicles.join(gone, "plate", "left_anti")


def acknowledge(events: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with acks set, audit rows of first acknowledgements). acks: event_id, actor, ts."""
    first = acks.groupBy("event_id").agg(F.min(F.struct("ts", "actor")).alias("a"))
    due = events.where(~F.col("acknowledged")).join(first, "event_id")
    audit = due.select("a.actor", F.lit("acknowledge").alias("action"), F.col("event_id").cast("string").alias("target"), "a.ts")
    marked = events.join(first.select("event_id", F.lit(True).alias("asked")), "event_id", "left")
    return marked.withColumn("acknowledged", F.col("acknowledged") | F.col("asked").isNotNull()).drop("asked"), audit
