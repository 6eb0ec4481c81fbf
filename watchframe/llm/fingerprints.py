"""One-permutation MinHash fingerprints of documents.

Each shingle hash is computed once and falls into one of BINS bins by its high bits; a bin keeps its
least value. Empty bins copy the value of a bin that a universal hash of (bin, attempt) chooses, drawn
again until it is a filled one (optimal densification, Shrivastava 2017): the same draws for every
document, so two documents agree on a densified bin exactly when they agree on its source. Of each
value BITS low-order bits are kept. Two unrelated bins agree with probability 2**-BITS, which the
likeness takes off: (agreeing - C) / (1 - C), at least 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .textops import mix, shingle_sets

BINS = 256
BITS = 8
_EMPTY = np.iinfo(np.uint64).max


def _draws(bins: int, attempts: int = 64) -> np.ndarray:
    """Bins that each empty bin tries, in order."""
    place = np.arange(bins, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    turn = np.arange(1, attempts + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    return (mix(place + turn) % np.uint64(bins)).astype(np.int64)


def _dense(values: np.ndarray, draws: np.ndarray) -> np.ndarray:
    filled = values != _EMPTY
    out, todo = values.copy(), np.flatnonzero(~filled)
    for row in draws:
        if not len(todo):
            return out
        source = row[todo]
        good = filled[source]
        out[todo[good]] = values[source[good]]
        todo = todo[~good]
    # a bin that met only empty ones (few shingles): the nearest filled bin upwards, the same for all
    have = np.flatnonzero(filled)
    out[todo] = values[have[np.searchsorted(have, todo) % len(have)]]
    return out


def signatures(texts: list[bytes], width: int = 5, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprint of each text; b"" for a text without words. Needs bits of 1, 2, 4 or 8."""
    draws, out = _draws(bins), []
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    low = np.uint64((1 << int(shift)) - 1)
    for s in shingle_sets(texts, width):
        if not len(s):
            out.append(b"")
            continue
        # s ascends, so a bin's first value is its least
        where = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        values = np.full(bins, _EMPTY, np.uint64)
        values[where[first]] = s[first] & low
        # the least of a bin is small in its high bits; mixing makes every low bit even
        code = (mix(_dense(values, draws)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
        per = 8 // bits
        packed = np.zeros(bins // per, np.uint8)
        for i in range(per):
            packed |= code[i::per] << np.uint8(i * bits)
        out.append(packed.tobytes())
    return out


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    per = 8 // bits
    same = sum(int(np.count_nonzero(((x ^ y) >> np.uint8(i * bits)) & np.uint8((1 << bits) - 1) == 0)) for i in range(per))
    chance = 2.0**-bits
    return max(0.0, (same / (len(x) * per) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 5, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """docs with one more column, `fingerprint` (base64; empty for texts without words, null or empty).

    Replaces a column of that name. Fewer words than `width` make one shingle.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "fingerprint"]

    @F.pandas_udf("string")
    def sign(texts):
        raw = [(t or "").encode() for t in texts]
        return texts.__class__([base64.b64encode(x).decode() for x in signatures(raw, width, bins, bits)], dtype=object)

    return docs.select(*kept, sign(F.col(text_col).cast("string")).alias("fingerprint"))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(bins: int, bits: int, width: int):
    """Rows (run, doc_id, text, ahead), sorted by run and id: each with the row after it in its run.

    The last row of a run (ahead = true) belongs to the next run; it is only looked at.
    """
    names = [x.split()[0] for x in _EDITED.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        """held: rows and the one after them; a row without a next of its own run gets no output."""
        import hashlib

        texts = [r[2] or "" for r in held]
        own = signatures([t.encode() for t in texts], width, bins, bits)
        at = [i for i in range(len(held) - 1) if not held[i][3] and held[i + 1][0] == held[i][0]]
        edited = []
        for i in at:
            k = len(texts[i]) // 4
            edited.append((texts[i][: len(texts[i]) - k] + texts[i + 1][:k]).encode())
        new = signatures(edited, width, bins, bits)
        text64 = lambda x: base64.b64encode(x).decode()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][1] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([text64(own[i]) for i in at], pa.string()),
                pa.array([text64(x) for x in new], pa.string()),
                pa.array([likeness(own[i], x, bits) for i, x in zip(at, new, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1], bits) for i in at], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows(batches):
            held.append(r)
            size += len(r[2] or "")
            if size >= 1 << 20 or len(held) >= 2000:
                yield solve(held)
                held, size = held[-1:], len(held[-1][2] or "")
        if len(held) > 1:
            yield solve(held)

    return run


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bins: int = BINS, bits: int = BITS, run_rows: int = 4096) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they find it to both.

    The edited text has its last floor(n / 4) code points replaced by the first as many (or all) of the
    next text by ascending id; the last row's next is the first. Ids may repeat: rows of one id are in
    order of their texts. Null ids come first. Null texts are empty; texts without words have an empty
    fingerprint, alike 1 to another empty one and 0 to the rest. A lone row is its own next. Other
    columns, whatever their names, are not read; an empty table gives an empty result. Very long texts are
    read whole, in pieces.

    The id range is cut at ids that the table holds into runs of about `run_rows` rows; the first row of
    each cut id is copied to the run before, so each text crosses the network about once and each row meets
    its next one without any global order in one task. Rows that share one id are in one run. There are at most
    10,000 runs, whose edges stand in the plan: above 41 million rows runs are longer, which costs no memory, as a
    task reads its runs in order and holds one batch.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = src.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))
    n = ids.count()
    if not n:
        return src.sparkSession.createDataFrame([], _EDITED)
    runs = max(1, min(10_000, -(-n // run_rows)))
    cuts = ids.agg(F.percentile_approx("k", [i / runs for i in range(runs + 1)], 100 * runs), F.min("k"), F.max("k")).first()
    low = cuts[1]
    edges = sorted({low, *cuts[0]} - ({cuts[2]} if cuts[2] != low else set()))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    own = src.withColumn("k", key).withColumn("run", _place(F.col("k"), edges))
    is_cut = F.col("k").isin(edges) if len(edges) < 50 else _element(F.col("k"), edges) == F.col("k")
    # the first row of a cut id also ends the run before; that of the first cut ends the last run
    before = F.when(F.col("k") == F.lit(low), F.lit(len(edges))).otherwise(F.col("run") - 1)
    heads = own.where(is_cut).groupBy("k", "run").agg(F.min(F.struct("text")).alias("first"), F.max("doc_id").alias("doc_id"))
    heads = heads.select(before.alias("run"), "doc_id", "k", F.col("first.text").alias("text"), F.lit(True).alias("ahead"))
    rows = own.select("run", "doc_id", "k", "text", F.lit(False).alias("ahead")).unionByName(heads)
    parts = max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs // 2))
    dealt = rows.repartition(parts, "run").sortWithinPartitions("run", "ahead", "k", "text").select("run", "doc_id", "text", "ahead")
    return dealt.mapInArrow(_compare(bins, bits, width), _EDITED)


def _steps(edges: list[int]) -> int:
    return max(1, int(len(edges) ** 0.5))


def _place(k, edges: list[int]):
    """1-based number of the last edge at or below k, in two looks of about sqrt(len(edges)) each."""
    step = _steps(edges)
    blocks = [edges[i : i + step] for i in range(0, len(edges), step)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    which = F.size(F.filter(heads, lambda e: e <= k))
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), which)
    return ((which - 1) * step + F.size(F.filter(inner, lambda e: e <= k))).cast("int")


def _element(k, edges: list[int]):
    return F.element_at(F.array(*[F.lit(x) for x in edges]), _place(k, edges))
