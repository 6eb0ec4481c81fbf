"""Camera tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

The driver's data holds no video rows, so keys and residues of its tables stand in for them. Written
once with a few macros, so that both engines see identical inputs: SEQ(n) makes the rows 0..n-1, DIV is
whole-number division, and names in braces are tables or views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MACROS = {
    "spark": {"SEQ": "explode(sequence(0, CAST(({0}) - 1 AS INT)))", "DIV": "(({0}) div ({1}))", "EPOCH": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {0}) AS DOUBLE)", "LIST": "array({0})", "PICK": "element_at(array({1}), CAST({0} AS INT) + 1)", "ELT": "element_at({0}, {1})"},
    "duckdb": {"SEQ": "unnest(range(0, ({0})))", "DIV": "(({0}) // ({1}))", "EPOCH": "CAST(floor(epoch({0})) AS DOUBLE)", "LIST": "[{0}]", "PICK": "([{1}])[({0}) + 1]", "ELT": "({0})[{1}]"},
}

_PLATE = (
    "concat(PICK({k} % 6 | 'TN', 'KA', 'MH', 'DL', 'KL', 'AP'), lpad(CAST({k} % 90 + 10 AS VARCHAR(8)), 2, '0'), "
    "PICK({k} % 5 | 'A', 'B', 'S', 'Z', 'G'), PICK(DIV({k} | 7) % 4 | 'B', 'D', 'J', 'T'), lpad(CAST(({k} * 7919) % 10000 AS VARCHAR(8)), 4, '0'))"
)


def plate_of(key: str) -> str:
    return _PLATE.replace("{k}", f"({key})")


VIEWS = {
    "v_det": """
        SELECT concat('cam_', CAST(k % 8 AS VARCHAR(8))) AS camera_id, k AS track_id, DIV(k | 2) + i AS frame,
               (k * 53) % 1100 + 0.5e0 * i AS x1, CAST((k * 29) % 380 AS DOUBLE) AS y1,
               (k * 53) % 1100 + 0.5e0 * i + 0.4e0 * (60 + (k * 7) % 240 + i % 5) AS x2, CAST((k * 29) % 380 + 60 + (k * 7) % 240 + i % 5 AS DOUBLE) AS y2,
               0.5e0 + (c % 50) / 100e0 AS conf, CASE WHEN k % 5 = 0 THEN 'car' ELSE 'person' END AS label
        FROM (SELECT o_orderkey AS k, o_custkey AS c, SEQ(5 + (o_orderkey * 13) % 45) AS i FROM {orders}) AS t
        WHERE i % 11 <> 7
    """,
    "v_edges": """
        SELECT concat('cam_', CAST(n AS VARCHAR(8))) AS camera_id, zone, restricted, ax, ay, bx, by_, e
        FROM (SELECT DISTINCT o_orderkey % 8 AS n FROM {orders}) AS c, (VALUES
            ('gate', TRUE, 1, 0e0, 0e0, 0.5e0, 0e0), ('gate', TRUE, 2, 0.5e0, 0e0, 0.5e0, 1e0), ('gate', TRUE, 3, 0.5e0, 1e0, 0e0, 1e0), ('gate', TRUE, 4, 0e0, 1e0, 0e0, 0e0),
            ('yard', FALSE, 1, 0.5e0, 0.2e0, 0.95e0, 0.3e0), ('yard', FALSE, 2, 0.95e0, 0.3e0, 0.7e0, 0.6e0), ('yard', FALSE, 3, 0.7e0, 0.6e0, 0.9e0, 0.95e0),
            ('yard', FALSE, 4, 0.9e0, 0.95e0, 0.55e0, 0.9e0), ('yard', FALSE, 5, 0.55e0, 0.9e0, 0.5e0, 0.2e0)
        ) AS z(zone, restricted, e, ax, ay, bx, by_)
    """,
    "v_obs": """
        SELECT concat('g', CAST(user_id AS VARCHAR(20))) AS person, CASE WHEN value > 34.5 THEN 'a' ELSE 'b' END AS zone, EPOCH(ts) AS ts,
               CASE WHEN event_type = 'signup' THEN 'pending' ELSE PICK(user_id % 4 | 'resident', 'staff', 'unknown', 'unknown') END AS role,
               value > 34.5 AS restricted, event_id
        FROM {events}
    """,
    "v_alerts": """
        SELECT event_id, event_type AS rule, PICK(user_id % 3 | 'low', 'medium', 'high') AS severity, EPOCH(ts) AS ts, user_id AS gid, props AS payload,
               value > 50 AS acknowledged, value < 20 AS thumb
        FROM {events}
    """,
    "v_reads": """
        SELECT concat('cam_', CAST(l_orderkey % 8 AS VARCHAR(8))) AS camera_id, l_orderkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 3 AS frame,
               CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN translate(p, '0158', 'OISB') WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN concat(p, 'XY')
                    WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN concat(substring(p, 1, 2), '-', lower(substring(p, 3, 20))) ELSE p END AS text,
               p AS label, round(0.4e0 + 5 * l_discount, 4) AS conf, round(0.3e0 + l_tax * 5, 4) AS min_char_conf
        FROM (SELECT *, PLATE(l_orderkey) AS p FROM {lineitem}) AS t
    """,
    "v_vehicles": """
        SELECT CASE WHEN c_custkey % 3 = 0 THEN concat(substring(p, 1, 9), PICK((c_custkey + 1) % 10 | '0', '1', '2', '3', '4', '5', '6', '7', '8', '9')) ELSE p END AS plate, c_name AS owner, c_custkey AS vehicle_id
        FROM (SELECT *, PLATE(c_custkey) AS p FROM {customer}) AS t
    """,
    "v_samples": """
        SELECT vec_id AS sample_id, vec_id % 40 AS gid, CAST(vec_id AS DOUBLE) AS ts, CASE WHEN vec_id % 3 = 0 THEN 'face' ELSE 'body' END AS kind,
               0.3e0 + (vec_id % 7) / 10e0 AS quality, concat('cam_', CAST(vec_id % 4 AS VARCHAR(8))) AS camera_id, vec_id % 40 AS track_id, vec_id AS frame, embedding AS emb
        FROM {embeddings} WHERE vec_id % 10 <> 0
    """,
    "v_gallery": """
        SELECT CAST(label AS BIGINT) AS person_id, CASE WHEN vec_id % 20 = 0 THEN 'face' ELSE 'body' END AS kind, embedding AS emb, vec_id
        FROM {embeddings} WHERE vec_id % 10 = 0
    """,
    "v_people": """
        SELECT DISTINCT CAST(label AS BIGINT) AS person_id, CASE WHEN label % 2 = 0 THEN 'resident' ELSE 'staff' END AS role, label % 5 <> 0 AS consent, concat('unit', CAST(label % 3 AS VARCHAR(8))) AS unit
        FROM {embeddings}
    """,
    "v_tracks": """
        SELECT o_orderkey AS track_id, concat('cam_', CAST(o_orderkey % 8 AS VARCHAR(8))) AS camera_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS gid,
               PICK(o_orderkey % 5 | 'red', 'blue', 'black', 'white', 'green') AS upper_color, PICK(o_custkey % 4 | 'blue', 'black', 'gray', 'brown') AS lower_color,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 150e0 + o_custkey % 45 END AS height_cm, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 2e0 + o_orderkey % 4 END AS height_error,
               PICK(o_custkey % 3 | 'unknown', 'pending', 'resident') AS role, EPOCH(o_orderdate) + o_orderkey % 86400 AS start_ts, EPOCH(o_orderdate) + o_orderkey % 86400 + 20 + o_custkey % 100 AS end_ts,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('t', CAST(o_orderkey AS VARCHAR(20))) END AS thumb, o_totalprice AS quality
        FROM {orders}
    """,
    "v_identities": """
        SELECT c_custkey AS gid, PICK(c_custkey % 4 | 'resident', 'staff', 'unknown', 'pending') AS role_state, CASE WHEN c_custkey % 4 < 2 THEN c_custkey END AS person_id,
               CAST(c_custkey AS DOUBLE) AS first_seen, CAST(c_custkey * 2 AS DOUBLE) AS last_seen
        FROM {customer}
    """,
    "v_gt": "SELECT camera_id, frame, DIV(track_id | 3) AS id, x1, y1, x2, y2, label FROM {v_det}",
    "v_pred": """
        SELECT camera_id, frame, track_id, CASE WHEN track_id % 3 = 0 AND frame - DIV(track_id | 2) >= 15 THEN -track_id ELSE track_id END AS id, x1 + off AS x1, y1, x2 + off AS x2, y2
        FROM (SELECT *, CASE WHEN track_id % 8 = 5 THEN 0.4e0 * (x2 - x1) ELSE track_id % 7 END AS off FROM {v_det}) AS t WHERE (frame + track_id) % 17 <> 0
    """,
    "v_plate_reads": """
        SELECT l_orderkey * 10 + l_linenumber AS read_id, concat('cam_', CAST(l_orderkey % 8 AS VARCHAR(8))) AS camera_id, PLATE(l_orderkey) AS plate, EPOCH(l_shipdate) AS ts,
               PICK(l_orderkey % 3 | 'registered', 'likely_registered', 'unregistered') AS status
        FROM {lineitem}
    """,
    "v_crops": """
        SELECT concat('cam_', CAST(l_orderkey % 8 AS VARCHAR(8))) AS camera_id, l_orderkey AS track_id, l_linenumber AS frame, l_discount * 10 AS quality, l_tax * 10 AS share,
               PICK(l_partkey % 5 | 'red', 'blue', 'unknown', 'white', 'green') AS color, CAST(l_partkey % 180 AS DOUBLE) AS h, CAST(l_suppkey * 37 % 256 AS DOUBLE) AS s, CAST(l_partkey * 91 % 256 AS DOUBLE) AS v
        FROM {lineitem}
    """,
}


def _macro(sql: str, dialect: str) -> str:
    """Replaces NAME(a | b) calls, innermost first."""
    sql = re.sub(r"PLATE\((\w+)\)", lambda m: plate_of(m[1]), sql)
    names = "|".join(_MACROS[dialect])
    while m := list(re.finditer(rf"\b({names})\(", sql)):
        at = m[-1]  # the last one has no other inside it
        depth, end = 1, at.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        args = [a.strip() for a in sql[at.end() : end - 1].split(" | ")]
        sql = sql[: at.start()] + _MACROS[dialect][at[1]].format(*args) + sql[end:]
    return sql


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Neighbouring keys that stay in one task: their boxes share frames.
KEY_RUN = 256


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or one of the driver's tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = re.findall(r"\{(\w+)\}", sql)
    found = {u: view(spark, sf_dir, u) for u in used}
    if "SEQ(" in sql:  # a row becomes many, and a million rows can be one row group of one file, which one task reads
        found = {u: _dealt(df) for u, df in found.items()}
    return spark.sql(_macro(sql, "spark"), **found)


def _dealt(df: DataFrame) -> DataFrame:
    """df in as many tasks as shuffles have, in runs of neighbouring keys (the first column)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), F.floor(F.col(df.columns[0]) / KEY_RUN))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    found: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in found:
                need(VIEWS[name])
                found.append(name)

    need(sql)
    parts = [f"{n} AS ({_macro(re.sub(r'\{(\w+)\}', r'\1', VIEWS[n]), 'duckdb')})" for n in found]
    body = _macro(sql, "duckdb").strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    return f"WITH {', '.join(parts)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(parts)} {body}"
