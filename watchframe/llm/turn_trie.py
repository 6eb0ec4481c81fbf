"""The prefix tree of conversations, from whole sequences collapsed first.

Conversations of a block of ids begin alike: each takes its first turns from the block's first conversation.
A turn is told by the SHA-256 of its role and text (its first 16 bytes) and its length, so texts are read
once and never move. A rebuilt conversation passes as a sorted stream, in which each prefix has the digest
of the prefix before it and of its last turn: a node's key.

- Conversations with the same last key are one weighted sequence with its list of ends. Only one of them
  goes on, with its prefixes as rows.
- Sequences whose key is a proper prefix of another are dropped by an anti-join; the others are the leaves.
- Nodes are the weighted prefixes of all sequences, summed by key. Each node belongs to one leaf below it, so
  what a subtree saves is a running total from that leaf upwards, summed by key: no node meets all of its
  descendants. Sums combine before the shuffle, so the root and a first turn that a third share are not hot.

Lists of ends are hashed in order of the ids. They are range-sorted by key and id, so a sequence that a third of
all conversations have is joined to pieces of text in many tasks, and only the pieces (PIECE_IDS ids each) meet
in one, to be hashed one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import HOT_ROWS, HOT_SHARE, join_split
from .storage import materialise

#: Conversations whose ids differ in the last two digits are one block.
BLOCK = 100
#: A conversation takes fewer than this many turns from its block's first.
MOST_SHARED = 6
PIECE_IDS = 10_000
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _shared(conv):
    """How many turns a conversation takes from its block's first."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, digest and chars of each turn."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return rows.where("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.left(whole, F.lit(32))).alias("digest"), F.length("text").cast("long").alias("chars"))


def prefixes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth (from 0), key, parent_key, chars, is_end.

    A conversation is rebuilt from the first h turns of its block's first conversation (all if it has fewer,
    none if there is no such conversation) and its own turns after its first h, h = crc32 of its id, modulo 6.
    Turns are ordered by number, nulls first, then by the digest of role and text; repeated rows are turns of
    their own. Null roles and texts are empty; rows with a null conv_id belong to no conversation and are left out.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    of_block = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    first = turns.where(F.col("conv_id") % BLOCK == 0).withColumn("place", F.row_number().over(of_block)).where(F.col("place") < MOST_SHARED)
    # fewer than MOST_SHARED turns come together for a block
    first = first.groupBy(F.col("conv_id").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("given"))
    ids = turns.select("conv_id").distinct().withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", _shared(F.col("conv_id")))
    # a block has at most BLOCK ids
    heads = ids.join(first, "block", "left").select("conv_id", "h", F.slice("given", F.lit(1), F.col("h")).alias("given"), F.lit(0).alias("is_turn"))
    both = heads.unionByName(turns.withColumn("is_turn", F.lit(1)), allowMissingColumns=True)
    order = ["conv_id", "is_turn", F.col("turn").asc_nulls_first(), "digest"]
    dealt = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "h", "given", "digest", "chars")
    names = ["conv_id", "depth", "key", "parent_key", "chars", "is_end"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed, h, out = None, 0, 0, []

        def step(digest, chars):
            nonlocal last
            out.append((*last, False))
            conv, depth, key = last[:3]
            last = conv, depth + 1, hashlib.blake2b(key + digest, digest_size=16).digest(), key, chars

        for batch in batches:
            for conv, shared, given, digest, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shared is not None:
                    if last is not None:
                        out.append((*last, True))
                    last, passed, h = (conv, 0, ROOT, None, 0), 0, shared
                    for turn in given or ():
                        step(turn["digest"], turn["chars"])
                else:
                    passed += 1
                    if passed > h:
                        step(digest, chars)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out.clear()
        if last is not None:
            out.append((*last, True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(run, "conv_id long, depth long, key binary, parent_key binary, chars long, is_end boolean")


def ends(rows: DataFrame) -> DataFrame:
    """For each key of rows (conv_id, key) the SHA-256 of its ids in decimal, ascending, joined by commas: key, ends_sha256."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.select("key", "conv_id")).repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["key", "first", "ids"])

        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or len(held) == PIECE_IDS):
                    yield told()
                    held = []
                key = k
                held.append(conv)
        if held:
            yield told()

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def told():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["key", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and k == key:
                    digest.update(f",{ids}".encode())
                    continue
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield told()
                out = []
        if digest is not None:
            out.append((key, digest.hexdigest()))
            yield told()

    pieces = dealt.mapInArrow(join_ids, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(hash_pieces, "key binary, ends_sha256 string")


def sequences(steps: DataFrame) -> DataFrame:
    """The distinct rebuilt conversations of steps (see prefixes): key, conv_id (the smallest), weight, is_leaf."""
    seqs = steps.where("is_end").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))
    inner = steps.where("NOT is_end").select("key").distinct().withColumn("inner", F.lit(True))
    # an anti-join whose outcome is kept
    return seqs.join(inner, "key", "left").select("key", "conv_id", "weight", F.col("inner").isNull().alias("is_leaf"))


def prefix_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the tree of rebuilt conversations (see prefixes).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's (n_convs - 1) times the code points of its last text),
    ends_sha256 (of the ids that end here). Conversations without turns are members of the root. Nodes are told
    apart by 128-bit digests. A table without conversations has no nodes.
    """
    steps = materialise(prefixes(conversations, conv_col, turn_col, role_col, text_col))
    seqs = materialise(sequences(steps))
    # one conversation of each sequence goes on
    paths = materialise(
        steps.drop("is_end").join(seqs.select("conv_id", "weight", "is_leaf"), "conv_id"),
    )
    nodes = paths.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("chars").alias("chars"), F.count_if("is_leaf").alias("n_leaves"), F.min(F.when(F.col("is_leaf"), F.col("conv_id"))).alias("owner"))
    nodes = materialise(nodes)
    children = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    # what each node saves stands at one leaf below it; (owner, depth) is one row on either side
    own = nodes.select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"))
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    saved = paths.where("is_leaf").select("conv_id", "depth", "key").join(own, ["conv_id", "depth"], "left").withColumn("below", F.sum(F.coalesce("saves", F.lit(0))).over(below))
    saved = saved.groupBy("key").agg(F.sum("below").alias("saved_tokens"))
    found = nodes.join(saved, "key").join(children, "key", "left").join(ends(steps.where("is_end")), "key", "left")
    found = materialise(found.select("conv_id", "depth", "parent_key", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    # parents of many children (the root above all) are joined apart; how many each has is known
    least = max(HOT_ROWS, found.count() // (HOT_SHARE * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = materialise(children.where(F.col("n_children") > least).select(F.col("key").alias("parent_key")))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return join_split(found, parents, ["parent_key"], "left", hot).select(*names)
