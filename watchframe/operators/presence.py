"""Presences in zones, alert rules and cooldowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import in_window, local_seconds
from ..helpers.folds import keep_in_order

#: Roles that a rule applies to unless it names its own.
DEFAULT_ROLES = {
    "unknown_in_zone": ["unknown"],
    "loitering": ["unknown"],
    "after_hours": ["resident", "unknown"],
    "tailgating": ["unknown"],
}


def person_key(gid: Column, camera: Column, track: Column) -> Column:
    """g<gid>, or <camera>:t<track> for a track without identity."""
    return F.when(gid.isNotNull(), F.concat(F.lit("g"), gid.cast("string"))).otherwise(F.concat(camera, F.lit(":t"), track.cast("string")))


def mark_presences(obs: DataFrame, gap_s: float = 10.0) -> DataFrame:
    """obs (person, zone, ts, ...) with its presence's number, entry and dwell so far.

    A new presence begins after a gap longer than gap_s. Rows of one time share one presence.
    """
    own = Window.partitionBy("person", "zone").orderBy("ts")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("ts") - F.lag("ts").over(own) > gap_s) | F.lag("ts").over(own).isNull()
    rows = obs.withColumn("presence", F.sum(F.when(new, 1).otherwise(0)).over(upto))
    entered = F.min("ts").over(Window.partitionBy("person", "zone", "presence"))
    return rows.withColumn("entered", entered).withColumn("dwell", F.col("ts") - F.col("entered"))


def presences(obs: DataFrame, gap_s: float = 10.0) -> DataFrame:
    """One row for each presence: person, zone, presence, entered, last, observations."""
    rows = mark_presences(obs, gap_s)
    return rows.groupBy("person", "zone", "presence").agg(F.min("ts").alias("entered"), F.max("ts").alias("last"), F.count("*").alias("observations"))


def tailgating_entries(marked: DataFrame, window_s: float, roles: tuple[str, ...] = ("resident", "staff")) -> DataFrame:
    """Entering observations that follow another person's authorised entry to the zone within window_s.

    marked: mark_presences' rows with role. Both entries are cut into buckets of window_s, so a row meets
    its own and the previous bucket only.
    """
    entry = marked.where("ts = entered").select("person", "zone", "presence", "ts", "role").distinct()
    host = entry.where(F.col("role").isin(*roles)).select("zone", F.col("person").alias("host"), F.col("ts").alias("host_ts"), F.floor(F.col("ts") / window_s).alias("bucket"))
    probe = entry.withColumn("bucket", F.explode(F.array(F.floor(F.col("ts") / window_s), F.floor(F.col("ts") / window_s) - 1)))
    near = (F.col("person") != F.col("host")) & (F.col("ts") - F.col("host_ts")).between(0, window_s)
    hits = probe.join(host, ["zone", "bucket"]).where(near)
    return hits.select("person", "zone", "presence", "ts", "role").distinct()


def first_triggers(marked: DataFrame, rules: list[dict], gap_s: float = 10.0) -> DataFrame:
    """The first observation of each presence that a rule fires on: rule, person, zone, presence, ts, role, dwell.

    rules: dicts of id, type, severity, zones (empty: restricted zones), roles (or the type's own), and
    dwell_s, start/end seconds of day or window_s. marked needs role and restricted. A rule fires once in
    a presence; on equal times the role first by name is told.
    """
    found = None
    for rule in rules:
        rows = marked.where(F.col("zone").isin(rule["zones"]) if rule.get("zones") else F.col("restricted"))
        if rule["type"] == "tailgating":
            keys = ["person", "zone", "presence", "ts", "role"]
            rows = rows.join(tailgating_entries(marked, rule["window_s"]), keys, "left_semi").where("ts = entered")
        rows = rows.where(F.col("role").isin(rule.get("roles") or DEFAULT_ROLES[rule["type"]]))
        if rule["type"] == "loitering":
            rows = rows.where(F.col("dwell") >= rule["dwell_s"])
        elif rule["type"] == "after_hours":
            rows = rows.where(in_window(local_seconds(F.col("ts")), rule["start"], rule["end"]))
        hit = rows.groupBy("person", "zone", "presence").agg(F.min(F.struct("ts", "role", "dwell")).alias("at"))
        hit = hit.select(F.lit(rule["id"]).alias("rule"), F.lit(rule.get("severity", "medium")).alias("severity"), "person", "zone", "presence", "at.ts", "at.role", F.bround("at.dwell", 1).alias("dwell"))
        found = hit if found is None else found.unionByName(hit)
    return found


def cooldown(events: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Events that come at least `seconds` after the last kept one of their key (time column ts).

    Only keys and times pass through the fold, in streamed batches.
    """
    kept = keep_in_order(events.select(*keys, "ts").distinct(), keys, ["ts"], "ts", lambda last, t: last is None or t - last >= seconds)
    one = Window.partitionBy(*keys, "ts").orderBy(*[c for c in events.columns if c not in [*keys, "ts"]])
    # of several events of one time, the first is the accepted one
    return events.join(kept, [*keys, "ts"], "left_semi").withColumn("turn", F.row_number().over(one)).where("turn = 1").drop("turn")


def alerts(obs: DataFrame, rules: list[dict], gap_s: float = 10.0, cooldown_s: float = 300.0) -> DataFrame:
    """One alert per incident: presences, first triggers, then the cooldown of each (rule, person)."""
    return cooldown(first_triggers(mark_presences(obs, gap_s), rules), ["rule", "person"], cooldown_s)


def rule_zones(rules: DataFrame, zones: DataFrame) -> DataFrame:
    """(rule, camera_id, zone) that each rule watches: its own zones, or all restricted ones if it names none."""
    named = rules.where(F.size("zones") > 0).select("rule", F.explode("zones").alias("zone")).join(zones.select("camera_id", "zone"), "zone")
    rest = rules.where(F.size("zones") == 0).select("rule").join(zones.where("restricted").select("camera_id", "zone"), F.lit(True))
    return named.select("rule", "camera_id", "zone").unionByName(rest.select("rule", "camera_id", "zone"))


def incident_tally(marked: DataFrame, alerts_: DataFrame, seconds: float) -> DataFrame:
    """Per rule: presences with an alert, alerts, presences alerted twice, alerts within the cooldown of the one before."""
    spans = marked.groupBy("person", "zone", "presence").agg(F.min("ts").alias("entered"), F.max("ts").alias("last"))
    inside = alerts_.select("rule", "person", "zone", "ts").join(spans, ["person", "zone"]).where(F.col("ts").between(F.col("entered"), F.col("last")))
    each = inside.groupBy("rule", "person", "zone", "presence").agg(F.count("*").alias("n"))
    per = each.groupBy("rule").agg(F.count("*").alias("incidents"), F.sum("n").alias("alerts"), F.count(F.when(F.col("n") > 1, 1)).alias("alerted_twice"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("rule", "person").orderBy("ts"))
    early = alerts_.withColumn("gap", gap).groupBy("rule").agg(F.count(F.when(F.col("gap") < seconds, 1)).alias("cooldown_violations"))
    return per.join(early, "rule")
