"""Identities: gallery matches, roles over time, global ids across cameras."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType



def load_gallery(people: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embeddings of people who consented."""
    return embeddings.join(people.where("consent").select("person_id"), "person_id", "left_semi")


def gallery_best_match(samples: DataFrame, gallery: DataFrame) -> DataFrame:
    """samples with the most similar gallery person of their kind: person_id and sim (nulls without gallery rows).

    samples: kind, emb and a key `sample_id`; gallery: kind, person_id, emb. Equal similarities (to twelve
    digits): the least person. A gallery of at most BROADCAST_FLOATS numbers goes to every worker, and the
    samples, which do not move, are multiplied with it in Arrow batches. A larger one is cut into parts of
    that size, and each part meets the samples in blocks of GRID_ROWS rows, one cell of the grid at a time.
    """
    samples = samples.drop("person_id", "sim")
    n, dims = gallery.agg(F.count("*"), F.coalesce(F.max(F.size("emb")), F.lit(0))).first()
    if n * dims <= BROADCAST_FLOATS:
        return _match_here(samples, gallery)
    parts, blocks = -(-n * dims // BROADCAST_FLOATS), max(1, -(-samples.count() // GRID_ROWS))
    left = samples.select("sample_id", "kind", "emb").withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = gallery.select("person_id", "kind", "emb").withColumn("part", F.pmod(F.xxhash64("person_id", "emb"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def cell(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or known.empty:
            return pd.DataFrame({"sample_id": [], "k": [], "sim": []})
        person, sim = _nearest(np.stack(mine.emb.to_numpy()), *_table(known.person_id, known.emb))
        return pd.DataFrame({"sample_id": mine.sample_id, "k": -person, "sim": sim})

    keys = ["kind", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, f"sample_id {dict(samples.dtypes)['sample_id']}, k long, sim double")
    best = found.groupBy("sample_id").agg(F.max(F.struct("sim", "k")).alias("b"))
    return samples.join(best, "sample_id", "left").withColumns({"person_id": -F.col("b.k"), "sim": F.col("b.sim")}).drop("b")


#: Most numbers of a gallery that is sent to every worker (64 MB), and samples in a cell of the grid.
BROADCAST_FLOATS = 8_000_000
GRID_ROWS = 20_000


def _table(people, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """People in ascending order with their vectors and lengths."""
    people = np.asarray(people, np.int64)
    order = np.argsort(people, kind="stable")
    known = np.stack([np.asarray(v, float) for v in vectors])[order]
    return people[order], known, np.sqrt((known * known).sum(1))


def _nearest(vectors: np.ndarray, people: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most similar person of each vector and the cosine; blocks keep the products small."""
    person, sim = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    step = max(1, 2_000_000 // len(people))
    for i in range(0, len(vectors), step):
        own = np.asarray(vectors[i : i + step], float)
        table = (own @ known.T) / np.maximum(np.sqrt((own * own).sum(1))[:, None] * lengths[None, :], 1e-12)
        best = np.round(table, 12).argmax(1)
        person[i : i + step], sim[i : i + step] = people[best], table[np.arange(len(own)), best]
    return person, sim


def _match_here(samples: DataFrame, gallery: DataFrame) -> DataFrame:
    rows = gallery.select("kind", "person_id", F.col("emb").cast("array<double>").alias("emb")).collect()  # at most BROADCAST_FLOATS numbers
    kinds = {k: _table(*zip(*[(r["person_id"], r["emb"]) for r in rows if r["kind"] == k], strict=True)) for k in {r["kind"] for r in rows}}
    shared = samples.sparkSession.sparkContext.broadcast(kinds)
    at_kind, at_emb = samples.columns.index("kind"), samples.columns.index("emb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            person, sim = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            none = np.ones(batch.num_rows, bool)
            kind, there = np.array(batch.column(at_kind).to_pylist(), object), batch.column(at_emb).is_valid().to_numpy(zero_copy_only=False)
            for k, table in shared.value.items():
                own = np.flatnonzero((kind == k) & there)
                if len(own):
                    vectors = np.stack([np.asarray(v, float) for v in batch.column(at_emb).take(pa.array(own)).to_pylist()])
                    person[own], sim[own] = _nearest(vectors, *table)
                    none[own] = False
            extra = [pa.array(person, mask=none), pa.array(sim, mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "person_id", "sim"])

    schema = StructType([*samples.schema.fields, StructField("person_id", LongType()), StructField("sim", DoubleType())])
    return samples.mapInArrow(run, schema)


ROLE_DEFAULTS = {
    "t_face": 0.45, "t_body": 0.75, "face_weight": 1.0, "body_weight": 0.5, "min_quality": 0.35,
    "accept": 1.0, "switch_ratio": 2.0, "unknown_after": 8, "recent": 20,
}


class RoleState:
    """Evidence and role of one identity; rows go through `add` in time order."""

    def __init__(self, roles: dict[int, str], **limits):
        self.p = ROLE_DEFAULTS | limits
        self.roles, self.role, self.person, self.n, self.evidence = roles, "pending", None, 0, {}

    def score(self, kind: str, person, sim, quality: float) -> None:
        if person is None or sim is None or sim < self.p[f"t_{kind}"]:
            return
        self.evidence[person] = self.evidence.get(person, 0.0) + self.p[f"{kind}_weight"] * quality

    def decide(self) -> None:
        best = max(self.evidence, key=self.evidence.get, default=None)
        if best is not None and self.evidence[best] >= self.p["accept"] and best in self.roles:
            now = self.evidence.get(self.person, 0.0)
            settled = self.person is not None and self.role in ("resident", "staff")
            if not settled or (best != self.person and self.evidence[best] >= self.p["switch_ratio"] * now):
                self.person, self.role = best, self.roles[best]
        elif self.role == "pending" and self.n >= self.p["unknown_after"]:
            self.role = "unknown"

    def add(self, kind: str, person, sim, quality: float) -> str:
        if quality >= self.p["min_quality"]:
            self.n += 1
            self.score(kind, person, sim, quality)
            self.decide()
        return self.role


_ROLES = "gid long, ts double, kind string, role string, role_person long, observations long"


def _none(x):
    return None if x is None or pd.isna(x) else x


def identity_roles(matched: DataFrame, people: DataFrame, **limits) -> DataFrame:
    """Role of each identity after each of its samples: gid, ts, kind, role, role_person, observations.

    matched: gid, ts, kind, quality, person_id, sim; people: person_id, role. Samples of one time: face
    before body. The fold keeps order, so an identity's samples run in one task, in streamed batches. Each
    row brings its own person's role along; the fold needs no other.
    """
    roles = people.select("person_id", F.col("role").alias("person_role"))
    rows = matched.join(roles, "person_id", "left").select("gid", "ts", (F.col("kind") == "body").alias("later"), "kind", "quality", "person_id", "sim", "person_role")
    rows = rows.repartition("gid").sortWithinPartitions("gid", "ts", "later", "quality", "person_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, state = None, None
        for b in batches:
            out = []
            for g, ts, kind, q, person, sim, known in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                if state is None or g != gid:
                    gid, state = g, RoleState({}, **limits)
                if known is not None:
                    state.roles[person] = known
                role = state.add(kind, person, sim, q)
                out.append((g, ts, kind, role, state.person, state.n))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.float64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in _ROLES.split(", ")])

    return rows.mapInArrow(run, _ROLES)


def role_transitions(roles: DataFrame) -> DataFrame:
    """Rows of identity_roles where the role changed, with the role before."""
    own = Window.partitionBy("gid").orderBy("ts", "observations", F.desc("kind"))
    before = F.coalesce(F.lag("role").over(own), F.lit("pending"))
    return roles.withColumn("before", before).where(F.col("role") != F.col("before"))


def rescore(matched: DataFrame, states: DataFrame, people: DataFrame, **limits) -> DataFrame:
    """Roles after a change of the gallery: gid, role, role_person.

    matched: the samples matched against the new gallery; their last 20 of each gid count. states: gid,
    role, role_person, observations before. A person who is gone sets the role back to pending.
    """
    p = ROLE_DEFAULTS | limits
    recent = Window.partitionBy("gid").orderBy(F.desc("ts"), "kind")
    rows = matched.where(F.col("quality") >= p["min_quality"]).withColumn("place", F.row_number().over(recent)).where(F.col("place") <= p["recent"])
    weight = F.when(F.col("kind") == "face", p["face_weight"]).otherwise(p["body_weight"])
    limit = F.when(F.col("kind") == "face", p["t_face"]).otherwise(p["t_body"])
    scores = rows.where(F.col("sim") >= limit).groupBy("gid", "person_id").agg(F.sum(weight * F.col("quality")).alias("score"))
    scores = scores.join(people.select("person_id", F.col("role").alias("new_role")), "person_id")
    best = scores.groupBy("gid").agg(F.max(F.struct("score", (-F.col("person_id")).alias("k"), "new_role")).alias("b"))
    own = scores.select("gid", F.col("person_id").alias("role_person"), F.col("score").alias("own_score"))
    s = states.join(people.select(F.col("person_id").alias("role_person"), F.lit(True).alias("there")), "role_person", "left")
    gone = F.col("role_person").isNotNull() & F.col("there").isNull()
    s = s.withColumns({"role": F.when(gone, "pending").otherwise(F.col("role")), "role_person": F.when(~gone, F.col("role_person"))}).drop("there")
    s = s.join(best, "gid", "left").join(own, ["gid", "role_person"], "left")
    person = -F.col("b.k")
    settled = F.col("role_person").isNotNull() & F.col("role").isin("resident", "staff")
    accept = F.coalesce(F.col("b.score") >= p["accept"], F.lit(False))
    switch = accept & (~settled | ((person != F.col("role_person")) & (F.col("b.score") >= p["switch_ratio"] * F.coalesce("own_score", F.lit(0.0)))))
    lost = ~accept & (F.col("role") == "pending") & (F.col("observations") >= p["unknown_after"])
    return s.select(
        "gid",
        F.when(switch, F.col("b.new_role")).when(lost, "unknown").otherwise(F.col("role")).alias("role"),
        F.when(switch, person).otherwise(F.col("role_person")).alias("role_person"),
    )


GLOBAL_DEFAULTS = {
    "threshold": 0.55, "appearance": 1.0, "position": 0.6, "same_place_m": 1.5, "max_speed": 3.0,
    "forget_s": 600.0, "live_gap": 1.0, "gallery": 20,
}


def assign_epoch(rows: pd.DataFrame, **limits) -> pd.DataFrame:
    """Sightings of one site and epoch to identities numbered from 1, in the order of their assign times.

    rows: camera_id, track_id, first_ts, last_ts, end_ts, assign_ts, emb (samples so far), end_emb (all
    samples), positions (array of ts, gx, gy).
    """
    p = GLOBAL_DEFAULTS | limits
    rows = rows.sort_values(["assign_ts", "camera_id", "track_id"]).to_dict("records")
    people: list[dict] = []
    owner: dict[tuple, int] = {}

    def position(s, ts):
        near = [(abs(t - ts), x, y) for t, x, y in s["spots"] if abs(t - ts) <= p["live_gap"] and t <= ts]
        return min(near, key=lambda n: n[0])[1:] if near else None

    def score(s, one, ts):
        bonus, mine = 0.0, position(s, ts)
        for o in one["open"]:
            if ts - min(o["last_ts"], max((t for t in (o["last_ts"],) if t <= ts), default=ts)) > p["live_gap"] or o["end_ts"] < ts:
                continue
            if o["camera_id"] == s["camera_id"]:
                return None
            theirs = position(o, ts)
            if mine and theirs:
                d = np.hypot(mine[0] - theirs[0], mine[1] - theirs[1])
                if d > p["same_place_m"]:
                    return None
                bonus = max(bonus, p["position"] * np.exp(-((d / p["same_place_m"]) ** 2)))
        if not bonus and one["spot"] and s["spots"]:
            (t0, x0, y0), (t1, x1, y1) = one["spot"], s["spots"][0]
            if abs(t1 - t0) > p["live_gap"] and np.hypot(x0 - x1, y0 - y1) / abs(t1 - t0) > p["max_speed"]:
                return None
        return p["appearance"] * np.sort(np.stack(one["gallery"]) @ s["emb"])[-3:].mean() + bonus

    for s in rows:
        s["emb"], s["end_emb"] = np.asarray(s["emb"], float), np.asarray(s["end_emb"], float)
        s["spots"] = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (s["positions"] if s["positions"] is not None else [])]
        ts, best = s["assign_ts"], None
        for i, one in enumerate(people):
            for o in [o for o in one["open"] if o["end_ts"] < ts]:
                one["open"].remove(o)
                one["gallery"] = [*one["gallery"], o["end_emb"]][-p["gallery"] :]
            seen = [min(o["last_ts"], ts) for o in one["open"]]
            one["last_seen"] = max([one["last_seen"], *seen])
            spots = [x for o in [*one["open"], *one["past"]] for x in o["spots"] if x[0] <= ts]
            one["spot"] = max(spots, default=None)
            if ts - one["last_seen"] > p["forget_s"] and not one["open"]:
                continue
            got = score(s, one, ts)
            if got is not None and got >= p["threshold"] and (best is None or got > best[0]):
                best = (got, i)
        if best is None:
            people.append({"gallery": [s["emb"]], "open": [], "past": [], "last_seen": ts, "spot": None})
            best = (0.0, len(people) - 1)
        else:
            one = people[best[1]]
            one["gallery"] = [*one["gallery"], s["emb"]][-p["gallery"] :]
        one = people[best[1]]
        one["open"].append(s)
        one["past"] = [*one["past"], s][-3:]
        one["last_seen"] = max(one["last_seen"], s["last_ts"] if s["last_ts"] <= ts else ts)
        owner[s["camera_id"], s["track_id"]] = best[1] + 1
    return pd.DataFrame([(c, t, i) for (c, t), i in owner.items()], columns=["camera_id", "track_id", "number"])


def assign_global_ids(sightings: DataFrame, site: str = "site", **limits) -> DataFrame:
    """Global id of each sighting that reached its third sample: site, camera_id, track_id, gid.

    Sightings are matched online and greedily, in time order, which only means something within a site.
    A quiet gap longer than forget_s with no open sighting starts a new epoch: no identity can be matched
    across it, so epochs run apart. Ids are renumbered by each epoch's offset.
    """
    p = GLOBAL_DEFAULTS | limits
    rows = sightings.where("assign_ts is not null")
    own = Window.partitionBy(site).orderBy("assign_ts", "camera_id", "track_id")
    busy = F.max("end_ts").over(own.rowsBetween(Window.unboundedPreceding, -1))
    quiet = busy.isNull() | (F.col("first_ts") - busy > p["forget_s"])
    rows = rows.withColumn("epoch", F.sum(F.when(quiet, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    names = ["camera_id", "track_id", "first_ts", "last_ts", "end_ts", "assign_ts", "emb", "end_emb", "positions"]
    kind = {c: dict(sightings.dtypes)[c] for c in (site, "camera_id", "track_id")}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = assign_epoch(pdf[names], **limits)
        out.insert(0, site, key[0])
        out.insert(1, "epoch", key[1])
        return out

    schema = f"{site} {kind[site]}, epoch long, camera_id {kind['camera_id']}, track_id {kind['track_id']}, number long"
    each = rows.select(site, "epoch", *names).groupBy(site, "epoch").applyInPandas(run, schema)
    top = each.groupBy(site, "epoch").agg(F.max("number").alias("top"))
    before = top.withColumn("before", F.coalesce(F.sum("top").over(Window.partitionBy(site).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return each.join(before.select(site, "epoch", "before"), [site, "epoch"]).select(site, "camera_id", "track_id", (F.col("before") + F.col("number")).alias("gid"))


def merge_identities(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Identities after updates (gid, ts, role_state, person_id): first insert's first_seen, latest last_seen, last non-null role and person."""
    order = F.struct("ts", "role_state", "person_id")
    new = updates.groupBy("gid").agg(
        F.min("ts").alias("u_first"),
        F.max("ts").alias("u_last"),
        F.max_by("role_state", F.when(F.col("role_state").isNotNull(), order)).alias("u_role"),
        F.max_by("person_id", F.when(F.col("person_id").isNotNull(), order)).alias("u_person"),
    )
    return existing.join(new, "gid", "full").select(
        "gid",
        F.coalesce("u_role", "role_state", F.lit("pending")).alias("role_state"),
        F.coalesce("u_person", "person_id").alias("person_id"),
        F.coalesce("first_seen", "u_first").alias("first_seen"),
        F.greatest("last_seen", "u_last").alias("last_seen"),
    )


def identity_stats(identities: DataFrame, gallery: DataFrame | None = None, decisions: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """What the system holds: section, name, n.

    Rows (roles, role, identities in it); and where the tables are given (identities, gallery_people,
    people with an embedding), (plates, decided, decided tracks) and (plates, registry, plates in it).
    """
    one = lambda section, name: (F.lit(section).alias("section"), F.lit(name).alias("name"))
    out = identities.groupBy(F.lit("roles").alias("section"), F.col("role_state").alias("name")).agg(F.count("*").alias("n"))
    out = out.unionByName(identities.agg(F.count("*").alias("n")).select(*one("identities", "global_ids"), "n"))
    if gallery is not None:
        out = out.unionByName(gallery.agg(F.countDistinct("person_id").alias("n")).select(*one("identities", "gallery_people"), "n"))
    if decisions is not None:
        out = out.unionByName(decisions.agg(F.countDistinct("camera_id", "track_id").alias("n")).select(*one("plates", "decided"), "n"))
    if registry is not None:
        out = out.unionByName(registry.agg(F.countDistinct("plate").alias("n")).select(*one("plates", "registry"), "n"))
    return out
