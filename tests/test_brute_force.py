"""Registered queries without SQL against plain sequential models over the same inputs."""

from collections import defaultdict

import numpy as np
import pytest

from watchframe.operators import boxes, identity, search
from watchframe.plans import queries
from watchframe.plans.views import view

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return view(spark, SF, name).collect()


def overlap(a, b):
    w = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
    h = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h)


def best_pairs(weights):
    """Pairs of the heaviest one-to-one matching, by longest augmenting paths (Bellman-Ford). weights: {(left, right): w}."""
    of, by = {}, {}
    while True:
        gain, came = {a: 0.0 for a, _ in weights if a not in of}, {}
        for _ in range(len(weights) + 1):
            changed = False
            for (a, b), w in weights.items():
                if a in gain and of.get(a) != b:
                    if gain[a] + w > gain.get(("r", b), -1e18) + 1e-12:
                        gain["r", b], came[b], changed = gain[a] + w, a, True
                        back = by.get(b)
                        if back is not None and gain["r", b] - weights[back, b] > gain.get(back, -1e18) + 1e-12:
                            gain[back] = gain["r", b] - weights[back, b]
            if not changed:
                break
        free = [(g, k[1]) for k, g in gain.items() if isinstance(k, tuple) and k[0] == "r" and k[1] not in by]
        if not free or max(g for g, _ in free) <= 1e-12:
            return set(of.items())
        b = max(free, key=lambda f: f[0])[1]
        while True:
            a = came[b]
            before = of.get(a)
            of[a], by[b] = b, a
            if before is None:
                break
            b = before


@pytest.fixture(scope="module")
def frames(spark):
    gt, pred = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "v_gt"):
        gt[r["camera_id"], r["frame"]].append(r)
    for r in rows_of(spark, "v_pred"):
        pred[r["camera_id"], r["frame"]].append(r)
    return gt, pred


def test_match_frame(spark, frames):
    gt, pred = frames
    want = set()
    for key, ours in gt.items():
        weights = {}
        for g in ours:
            for p in pred.get(key, ()):
                if (w := overlap(g, p)) > 1e-12:
                    weights[g["id"], p["id"]] = max(w, weights.get((g["id"], p["id"]), 0))
        want |= {(*key, a, b) for a, b in best_pairs(weights) if weights[a, b] >= 0.5}
    got = {(r["camera_id"], r["frame"], r["gt_id"], r["pred_id"]) for r in queries.QUERIES["j5_match_frame"](spark, SF).collect()}
    assert got == want and len(want) > 1000


def idtp(gt, pred, own_gt, own_pred):
    counts = defaultdict(int)
    for key, ours in gt.items():
        for g in ours:
            for p in pred.get(key, ()):
                if overlap(g, p) >= 0.5:
                    counts[own_gt(g), own_pred(p)] += 1
    weights = dict(counts)
    left, todo, total = defaultdict(set), dict(weights), 0
    for a, b in weights:
        left["g", a].add(("p", b))
        left["p", b].add(("g", a))
    while todo:  # component by component
        seen, stack = set(), [("g", next(iter(todo))[0])]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += left[x]
        part = {k: w for k, w in todo.items() if ("g", k[0]) in seen}
        total += sum(part[k] for k in best_pairs(part))
        todo = {k: w for k, w in todo.items() if k not in part}
    return total


def test_id_metrics(spark, frames):
    gt, pred = frames
    r = queries.QUERIES["a12_id_metrics"](spark, SF).collect()[0]
    n_gt, n_pred = sum(map(len, gt.values())), sum(map(len, pred.values()))
    tp = idtp(gt, pred, lambda g: g["id"], lambda p: p["id"])
    assert (r["idtp"], r["fp"], r["fn"]) == (tp, n_pred - tp, n_gt - tp) and tp > 1000
    assert r["idf1"] == pytest.approx(2 * tp / (n_gt + n_pred))


def test_mtmc_report(spark, frames):
    gt, pred = frames
    got = {r["mode"]: r["idtp"] for r in queries.QUERIES["a13_mtmc_report"](spark, SF).collect()}
    gid = lambda p: p["id"] if p["frame"] % 3 > 0 else None
    own = lambda r, k: int(r["camera_id"][4:]) * 1000 + r[k]
    last = {}
    for p in sorted((p for ps in pred.values() for p in ps), key=lambda p: p["frame"]):
        if gid(p) is not None:
            last[p["camera_id"], p["track_id"]] = gid(p)
    modes = {
        "single": (lambda g: own(g, "id"), lambda p: own(p, "track_id")),
        "online": (lambda g: g["id"], lambda p: ("t", own(p, "track_id")) if gid(p) is None else gid(p)),
        "tracklet": (lambda g: g["id"], lambda p: last.get((p["camera_id"], p["track_id"]), ("t", own(p, "track_id")))),
    }
    assert got == {m: idtp(gt, pred, *f) for m, f in modes.items()}


def test_pick_shots(spark):
    people = defaultdict(list)
    for r in rows_of(spark, "v_gt"):
        if r["label"] == "person":
            people[r["id"]].append((-(r["y2"] - r["y1"]), r["camera_id"], r["frame"]))
    want = []
    for i, shots in people.items():
        kept = []
        for h, c, f in sorted(shots):
            if len(kept) < 8 and all(c != d or abs(f - g) >= 15 for _, d, g in kept):
                kept.append((h, c, f))
        want += [(i, n, c, f, -h) for n, (h, c, f) in enumerate(kept)]
    got = queries.QUERIES["t8_pick_shots"](spark, SF).select("id", "place", "camera_id", "frame", "height").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.fixture(scope="module")
def matched(spark):
    """Samples with their nearest gallery person, one by one."""
    samples, gallery = rows_of(spark, "v_samples"), rows_of(spark, "v_gallery")
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))

    def run(known):
        out = []
        for s in samples:
            sims = [(-round(float(unit(s["emb"]) @ unit(g["emb"])), 12), g["person_id"]) for g in known if g["kind"] == s["kind"]]
            sim, person = min(sims, default=(None, None))
            out.append((s["gid"], s["ts"], s["kind"], s["quality"], person, None if sim is None else -sim))
        return out

    return run(gallery), run([g for g in gallery if g["person_id"] != 3])


def roles_model(matched, roles):
    """gid -> rows (ts, kind, role, person, observations), by the rules one after the other."""
    out = defaultdict(list)
    for gid in {m[0] for m in matched}:
        role, person, n, score = "pending", None, 0, {}
        for _, ts, kind, quality, who, sim in sorted((m for m in matched if m[0] == gid), key=lambda m: (m[1], m[2] == "body", m[3], m[4] if m[4] is not None else -1)):
            if quality >= 0.35:
                n += 1
                if who is not None and sim >= 0.28:
                    score[who] = score.get(who, 0.0) + quality * (1.0 if kind == "face" else 0.5)
                top = max(score, key=score.get) if score else None
                if top is not None and score[top] >= 1.0 and top in roles:
                    if person is None or role not in ("resident", "staff") or (top != person and score[top] >= 2.0 * score.get(person, 0.0)):
                        role, person = roles[top], top
                elif role == "pending" and n >= 8:
                    role = "unknown"
            out[gid].append((ts, kind, role, person, n))
    return out


def test_roles_and_transitions(spark, matched):
    roles = {r["person_id"]: r["role"] for r in rows_of(spark, "v_people")}
    model = roles_model(matched[0], roles)
    got = sorted(tuple(r) for r in queries.QUERIES["w9_identity_roles"](spark, SF).collect())
    assert got == sorted((g, *r) for g, rs in model.items() for r in rs) and len({r[3] for r in got}) > 2
    moves = []
    for g, rs in model.items():
        before = "pending"
        for r in rs:
            if r[2] != before:
                moves.append((g, *r, before))
            before = r[2]
    names = ["gid", "ts", "kind", "role", "role_person", "observations", "before"]
    assert sorted(tuple(r) for r in queries.QUERIES["w13_role_transitions"](spark, SF).select(*names).collect()) == sorted(moves)


def test_rescore(spark, matched):
    roles = {r["person_id"]: r["role"] for r in rows_of(spark, "v_people")}
    model, left = roles_model(matched[0], roles), {p: r for p, r in roles.items() if p != 3}
    want = {}
    for gid, rs in model.items():
        _, _, role, person, n = max(rs, key=lambda r: (r[0], r[4]))
        if person is not None and person not in left:
            role, person = "pending", None
        own = sorted((m for m in matched[1] if m[0] == gid and m[3] >= 0.35), key=lambda m: (-m[1], m[2]))[:20]
        score = defaultdict(float)
        for _, _, kind, quality, who, sim in own:
            if who is not None and sim >= 0.28 and who in left:
                score[who] += quality * (1.0 if kind == "face" else 0.5)
        top = min(score, key=lambda p: (-score[p], p), default=None)
        if top is not None and score[top] >= 1.0:
            if person is None or role not in ("resident", "staff") or (top != person and score[top] >= 2.0 * score.get(person, 0.0)):
                role, person = left[top], top
        elif role == "pending" and n >= 8:
            role = "unknown"
        want[gid] = (role, person)
    got = {r["gid"]: (r["role"], r["role_person"]) for r in queries.QUERIES["w10_rescore"](spark, SF).collect()}
    assert got == want


def test_large_galleries_meet_in_a_grid(spark, monkeypatch, matched):
    monkeypatch.setattr(identity, "BROADCAST_FLOATS", 500)
    monkeypatch.setattr(identity, "GRID_ROWS", 20)
    samples = view(spark, SF, "v_samples")
    got = {r["sample_id"]: (r["person_id"], r["sim"]) for r in identity.gallery_best_match(samples, view(spark, SF, "v_gallery")).collect()}
    for (_, ts, _, _, person, sim) in matched[0]:
        assert got[int(ts)][0] == person and got[int(ts)][1] == pytest.approx(sim)
    lone = identity.gallery_best_match(samples, view(spark, SF, "v_gallery").where("false"))
    assert lone.where("person_id IS NOT NULL").count() == 0 and lone.count() == samples.count()


def test_zones_of_many_points(spark):
    points = [(0.5 + 0.4 * np.cos(t), 0.5 + 0.4 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 3000, endpoint=False)]
    zones = spark.createDataFrame([("c", "round", False, [(float(x), float(y)) for x, y in points])], "camera_id string, zone string, restricted boolean, polygon array<struct<x:double,y:double>>")
    feet = [(0.5, 0.15), (0.15, 0.5), (0.5, 0.85), (0.85, 0.5), (0.5, 0.5), (0.05, 0.05), (0.95, 0.5)]
    det = spark.createDataFrame([("c", i, x * 100 - 1, 0.0, x * 100 + 1, y * 100) for i, (x, y) in enumerate(feet)], "camera_id string, track_id int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["track_id"] for r in boxes.zone_membership(det, zones, 100, 100).collect()) == [0, 1, 2, 3, 4]


def test_batch_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    pick = lambda xs: xs[rng.integers(len(xs))]
    tracks = [(i, pick(["c1", "c2"]), pick(["unknown", "staff", None]), pick(["red", "blue", None]), float(t := rng.integers(0, 8 * 86400)), float(t + rng.integers(0, 3 * 86400 if i % 9 == 0 else 100))) for i in range(400)]
    asked = [(i, pick(["c1", "c2", None]), pick(["unknown", None]), pick(["red", "blue", None]), pick([None, float(rng.integers(0, 9 * 86400))]), pick([None, float(rng.integers(0, 9 * 86400))])) for i in range(150)]
    t = spark.createDataFrame(tracks, "track_id int, camera_id string, role string, upper_color string, start_ts double, end_ts double")
    q = spark.createDataFrame(asked, "query_id int, camera_id string, role string, upper_color string, since double, until double")
    want = []
    for i, c, r, u, since, until in asked:
        hits = sorted((-s, k) for k, tc, tr, tu, s, e in tracks if c in (None, tc) and r in (None, tr) and u in (None, tu) and (since is None or e >= since) and (until is None or s <= until))
        want += [(i, k, n + 1) for n, (_, k) in enumerate(hits[:3])]
    assert sorted(map(tuple, search.batch_search(q, t, 3).collect())) == sorted(want)
