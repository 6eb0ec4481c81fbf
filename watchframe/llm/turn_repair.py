"""Repairing the structure of conversations by the cheapest edits, planned on one suffix-shared automaton.

A conversation's signature has one symbol a turn: its role's initial and its fault. What an edit can still
cost depends only on the turns that follow and on the state of the grammar `(s?(ua)+)?`, so signatures are
minimised from the end: an automaton node is a distinct suffix of any signature, held once for all
conversations that end alike. Node by node, cost-to-go and best first edit are worked out for the four
grammar states; the best audit is read off by following the best edits from a signature's own node.

Signatures are range-sorted by their reversed symbols, so that signatures with a common suffix are
neighbours: a task keeps the nodes of the current signature on a stack, shares those of the common suffix
with the next, and makes the others. A node is made once; only the suffixes at the borders between two ranges
(one path a task) are made in both. A signature that a third of all conversations have is split over
several ranges. Steps between nodes repeat as well (relative costs are small numbers) and are remembered.

Texts move once: faults are told from digests and flags of the turns (68 bytes a turn and its ids), plans
then meet the texts. A conversation's turns pass in order and nothing of them is held but the signature (a byte
a turn); its digest is that of one text, so one task must read its turns one after the other, however many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, small_batches

#: White space of the words `[^\x20\x09-\x0D]+`.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FAULTS = ("blank", "duplicate", "truncated")
STATS = ("gaps", *FAULTS, "illegal")
LEGAL = {"su", "ua", "au"}

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT_COST = 1
#: Grammar states: nothing yet, after s, after u, after a. What comes next of user and assistant, and to where.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Where a kept turn of this initial leads.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Cost after the last turn: a conversation may end before its first turn and after an assistant.
AT_END = (0, 4, 2, 0)


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with planted faults, chosen by crc32 of `conv_id:turn` modulo 20: conv_id, turn, role, text, present.

    0: the turn is dropped, 1: its text is emptied, 2: it loses `.`, `!` and `?`, 3: it comes twice, 4: its
    role becomes user. Nulls of role and text are one space, as nulls are in the key. A dropped turn stays as
    a row that is not present, so that its conversation is still known.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col), F.col(turn_col).alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(True), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select(F.col(conv_col), "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), twice.alias("copy_")).drop("copy_")


def _turn_digest():
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _order(conv_col: str, *first) -> list:
    """Turns of a conversation in order: by turn, nulls first, then by the digest of role and text."""
    return [F.col(conv_col).asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "digest_"]


def signatures(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Each conversation's statistics and reversed signature: conv_col, gaps, blank, duplicate, truncated, illegal, reversed.

    turns: conv_col, turn, role, text and present (absent rows only name their conversation). A turn's first
    fault counts: blank (nothing but white space), duplicate (role and text came before), truncated (last
    other character not `.`, `!` or `?`). Symbols are `x` for turns that must go, else `s`, `u`, `a` or `o` for
    the role's initial or any other, in upper case if truncated. Turns with equal numbers are in the order of
    the SHA-256 of role and text. No turns: zeros and an empty signature.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = turns.select(
        F.col(conv_col), "turn", "present",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role_"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.when(F.col("present"), _turn_digest()).alias("digest_"),
    ).repartition(F.col(conv_col))
    # both sorts and the window run inside the one partitioning by conversation
    before = Window.partitionBy(conv_col, "digest_", "present").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(before) > 1).sortWithinPartitions(*_order(conv_col)).select(conv_col, "turn", "present", "role_", "blank", "cut", "again")
    kind = turns.schema[conv_col].dataType.simpleString()
    names = [conv_col, *STATS, "reversed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = None, []

        def told():
            conv, first, last, turns_, counts, illegal, symbols = own[:7]
            gaps = last - first + 1 - turns_ if turns_ else 0
            return conv, gaps, *counts, illegal, symbols[::-1].decode()

        for batch in batches:
            for conv, turn, present, role, blank, cut, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        out.append(told())
                    own = [conv, None, None, 0, [0, 0, 0], 0, bytearray(), ""]
                if not present:
                    continue
                if turn is not None and turn != own[2]:
                    own[1], own[2], own[3] = turn if own[1] is None else own[1], turn, own[3] + 1
                if own[7] and own[7] + role not in LEGAL:
                    own[5] += 1
                own[7] = role
                if blank or again or cut:
                    own[4][0 if blank else 1 if again else 2] += 1
                own[6] += b"x" if blank or again else role.upper().encode() if cut else role.encode()
            if len(out) >= 1_000:
                yield _batch(out, names, _types(batch))
                out = []
        if own is not None:
            yield _batch([*out, told()], names, _types(batch))

    def _types(batch):
        return [batch.schema.types[0], *[pa.int64()] * 5, pa.string()]

    return rows.mapInArrow(run, f"`{conv_col}` {kind}, " + ", ".join(f"{c} long" for c in STATS) + ", reversed string")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class Automaton:
    """Nodes of the suffixes of the current signature, each with cost-to-go and best first edit of every grammar state."""

    def __init__(self):
        self.symbols = ""
        self.nodes = [(AT_END, ("", INSERT, INSERT, ""))]
        self.made = 0
        self.steps: dict[tuple, tuple] = {}

    def _step(self, symbol: str, after: tuple) -> tuple:
        """Costs and first edits of the node that reads `symbol` and goes on to a node of costs `after`."""
        found = []
        for state in range(4):
            ways = [(COST[DELETE] + after[state], DELETE)]
            if symbol != "x":
                cut = CUT_COST * symbol.isupper()
                if (state, symbol.lower()) in KEPT:
                    ways.append((COST[KEEP] + cut + after[KEPT[state, symbol.lower()]], KEEP))
                ways.append((COST[REROLE] + cut + after[NEXT[state][1]], REROLE))
            found.append(min(ways))  # of equal costs the least letter
        costs = [cost for cost, _ in found]
        for _ in range(3):  # an insertion leads to another state of the same node
            costs = [min(costs[s], COST[INSERT] + costs[NEXT[s][1]]) for s in range(4)]
        edits = [min((c, e) for c, e in (found[s], (COST[INSERT] + costs[NEXT[s][1]], INSERT)) if c == costs[s])[1] for s in range(4)]
        return tuple(costs), tuple(edits)

    def read(self, reversed_: str) -> None:
        """Moves to a signature; nodes of the suffix that it shares with the last one stay."""
        old, common = self.symbols, 0
        most = min(len(old), len(reversed_))
        if old[:most] == reversed_[:most]:
            common = most
        else:
            low, high = 0, most  # the longest common beginning, by halving
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if old[:middle] == reversed_[:middle] else (low, middle)
            common = low
        del self.nodes[common + 1 :]
        for symbol in reversed_[common:]:
            costs = self.nodes[-1][0]
            least = min(costs)
            key = symbol, *(c - least for c in costs)
            step = self.steps.get(key)
            if step is None:
                step = self.steps[key] = self._step(symbol, key[1:])
            self.nodes.append((tuple(least + c for c in step[0]), step[1]))
            self.made += 1
        self.symbols = reversed_

    def best(self) -> tuple[int, str]:
        """Cost and audit of the signature that was read: the ASCII-least of the cheapest."""
        at, state, audit = len(self.nodes) - 1, 0, []
        while edit := self.nodes[at][1][state]:
            audit.append(edit)
            if edit == INSERT:
                state = NEXT[state][1]
                continue
            if edit != DELETE:
                state = NEXT[state][1] if edit == REROLE else KEPT[state, self.symbols[at - 1].lower()]
            at -= 1
        # at the end of a conversation nothing is left to edit
        return self.nodes[-1][0][0], "".join(audit)


def plans(signed: DataFrame) -> DataFrame:
    """signed (a column `reversed`, as from signatures()) with the cheapest edits: cost and audit in its place.

    Every other column is kept. The audit has an initial for each edit: Keep, Rerole, Delete, Insert; of
    equally cheap ones the ASCII-least. An edit's initial leads to one grammar state only, so the audit tells
    all roles.
    """
    rows = materialise(signed)
    others = [c for c in rows.columns if c != "reversed"]
    keys = ["reversed", *others[:1]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, last, best = Automaton(), None, None
        for batch in batches:
            found = []
            for reversed_ in batch.column("reversed").to_pylist():
                if reversed_ != last:
                    automaton.read(reversed_)
                    last, best = reversed_, automaton.best()
                found.append(best)
            kept = batch.drop_columns(["reversed"])
            columns = [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*others, "cost", "audit"])

    return dealt.mapInArrow(run, schema)


def _with_plans(turns: DataFrame, planned: DataFrame, conv_col: str) -> DataFrame:
    """Every conversation's plan, then its turns in order, in one partition."""
    rows = turns.where("present").select(F.col(conv_col), "turn", "role", "text", F.lit(1).alias("is_turn"))
    heads = planned.withColumn("is_turn", F.lit(0))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition(F.col(conv_col)).withColumn("digest_", _turn_digest()).sortWithinPartitions(*_order(conv_col, "is_turn")).drop("digest_", "turn")


def _edited(batches: Iterator[pa.RecordBatch], heads: list[str]) -> Iterator[tuple]:
    """(values of heads, None) for each conversation, then (edit, role, text) of each of its edits."""
    audit, at, state = "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            at += 1
            role, state = NEXT[state]
            yield INSERT, role, ""

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*heads, "audit", "is_turn", "role", "text")]
        for *values, planned, is_turn, role, text in zip(*columns, strict=True):
            if not is_turn:
                yield from inserted()
                yield values, None
                audit, at, state = planned, 0, 0
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == REROLE:
                role, state = NEXT[state]
            elif edit == KEEP:
                state = KEPT[state, role[0]]
            yield edit, role, text
    yield from inserted()


def repaired_turns(turns: DataFrame, planned: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired conversations: conv_col, place (from 0), edit, role, text; deleted turns are left out.

    turns as for signatures(), planned as from plans(). A conversation of which nothing is left has no rows.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema[conv_col].dataType
    names = [conv_col, "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
        conv, place, out, size = None, 0, [], 0
        for event in _edited(batches, [conv_col]):
            if event[1] is None:
                conv, place = event[0][0], 0
            elif event[0] != DELETE:
                out.append((conv, place, *event))
                place, size = place + 1, size + len(event[2])
                if size > 1 << 20 or len(out) >= 1_000:
                    yield _batch(out, names, types)
                    out, size = [], 0
        if out:
            yield _batch(out, names, types)

    heads = planned.select(conv_col, "audit")
    return _with_plans(turns, heads, conv_col).mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, place long, edit string, role string, text string")


def repair_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage, statistics, cheapest edits and digest of the repaired text of every conversation.

    Columns: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired
    turns, `role:text`, joined by newlines). Rows whose conv_col is null are one conversation. Of a conversation
    without turns after the damage: zeros, an empty audit and the digest of an empty text. Repeated rows and equal
    turn numbers are turns of their own; roles other than those of `s`, `u` and `a`, empty ones too, cannot
    be kept. Other columns are not read; an empty table gives an empty one.
    """
    small_batches(conversations.sparkSession)
    turns = damage(conversations, conv_col, turn_col, role_col, text_col)
    planned = plans(signatures(turns, conv_col))
    kind = turns.schema[conv_col].dataType
    heads = [conv_col, *STATS, "cost", "audit"]
    names = [*heads, "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
        values, digest, first, out = None, None, True, []
        for event in _edited(batches, heads):
            if event[1] is None:
                if digest is not None:
                    out.append((*values, digest.hexdigest()))
                values, digest, first = event[0], hashlib.sha256(), True
                if len(out) >= 1_000:
                    yield _batch(out, names, types)
                    out = []
            elif event[0] != DELETE:
                digest.update(f"{'' if first else chr(10)}{event[1]}:{event[2]}".encode())
                first = False
        if digest is not None:
            yield _batch([*out, (*values, digest.hexdigest())], names, types)

    longs = ", ".join(f"{c} long" for c in (*STATS, "cost"))
    return _with_plans(turns, planned, conv_col).mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, {longs}, audit string, repaired_sha256 string")
