"""Exact n-gram Jaccard self-join of documents with prefix trees.

The sets are the distinct five-word shingles of whole texts. Two sets link when their Jaccard
similarity is at least a threshold given as a fraction of whole numbers (75/100).

Plan
1. One pass over the texts makes, for each document, its set's size and 128-bit digest, and *postings*
   (shingle, set) of the set's prefix in hash order. Postings travel packed, by hash bucket. Shingles
   that several sets of one map batch hold are answered there and travel once for the batch, so a
   passage that a third of all documents share costs one entry for each batch.
2. A set that shares too few of its prefix with any other set can have no partner (prefix-filter
   lemma), and leaves. One document of each remaining distinct set is read again.
3. Exact document frequencies of the remaining sets' shingles give the global order. A set with less
   than 75 % shared shingles leaves. The rest are grouped by their rare prefix shingles into candidate
   groups, as components over star edges, not pairs.
4. Each group's sets go into one trie in the global order, rare shingles first, with a dictionary from each
   prefix shingle to the nodes that hold it. A set enters the trie only at nodes of its own prefix
   shingles; from there partial overlaps are shared along the paths, and a subtree is left when its
   remaining length cannot reach the needed overlap. A set is compared with a component found so far
   until its first match, since one link joins the whole component.
   Groups above a size go in blocks: a trie for each block, then tries among one set of each component,
   then pairs of blocks for sets that are still in different components. Of these, a set goes only to the
   blocks that hold a prefix shingle of it in another component. No pair is given up.

Shingles are compared by 64-bit hashes; two different shingles of one pair of sets share a hash with a
probability of about 2**-64. Sets are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .skew import hot_keys, join_split
from .storage import handing_back, materialise, partitions_for, small_batches
from .textops import shingle_sets

#: Postings held by a map task before they are packed and sent.
FLUSH = 500_000
#: Buckets of postings that a task meets one after the other.
BUCKETS = 4
#: Shingles of one trie task; larger groups are cut in blocks of this size.
BLOCK = 200_000

_POSTS = "bucket int, kind int, doc_id long, n long, sig long, sig2 long, tokens binary, sigs binary, runs binary"
_FACTS = "kind int, doc_id long, n long, sig long, sig2 long"


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-num * n // den)


def spare(n: int) -> int:
    """Common prefix shingles that are asked for: longer prefixes tell more."""
    return max(1, n // 4)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def _pack(t: np.ndarray) -> bytes:
    """The low 48 bits of each hash: with the bucket, enough to tell which ones may be shared."""
    return t.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _unpack(data: bytes, bucket: int) -> np.ndarray:
    low = np.frombuffer(data, "<u2").reshape(-1, 3)
    full = np.empty((len(low), 4), "<u2")
    full[:, :3], full[:, 3] = low, bucket & 0xFFFF
    return full.view("<u8").ravel()


def _runs(sigs: np.ndarray) -> tuple[bytes, bytes]:
    """Each set once, and how many shingles in a row are its own."""
    cut = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
    return sigs[cut].tobytes(), np.diff(np.append(cut, len(sigs))).astype("<u4").tobytes()


def _postings(buckets: int, num: int, den: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            t, s = np.concatenate(tokens), np.concatenate(sigs)
            tokens.clear(), sigs.clear()
            held = 0
            order = np.lexsort((s, t))
            t, s = t[order], s[order]
            keep = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))
            t, s = t[keep], s[keep]
            head = np.append(True, t[1:] != t[:-1])
            group = np.cumsum(head) - 1
            several = np.bincount(group) > 1
            shared = several[group]
            who, times = np.unique(s[shared], return_counts=True)
            yield _facts_batch(2, who, times)
            for kind, part_t, part_s in ((1, t[~shared], s[~shared]), (3, t[head][several], None)):
                b = ((part_t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                if part_s is not None:  # set by set in each bucket, so that a set is named once
                    order = np.lexsort((part_s, b))
                    part_t, part_s, b = part_t[order], part_s[order], b[order]
                cut = np.flatnonzero(np.diff(b, prepend=-1))
                if not len(cut):
                    continue
                ends = np.append(cut[1:], len(b))
                spans = list(zip(cut.tolist(), ends.tolist(), strict=True))
                named = [(None, None) if part_s is None else _runs(part_s[i:j]) for i, j in spans]
                yield _post_batch(kind, b[cut], [_pack(part_t[i:j]) for i, j in spans], [x for x, _ in named], [y for _, y in named])

        for batch in batches:
            ids, sizes, first, second = [], [], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(_utf8(batch.column(1)), width), strict=True):
                n = len(s)
                a, b = _digest(s)
                ids.append(doc_id), sizes.append(n), first.append(a), second.append(b)
                if n:
                    prefix = s[: n - needed(n, num, den) + spare(n)]
                    tokens.append(prefix), sigs.append(np.full(len(prefix), a, np.int64))
                    held += len(prefix)
                    if held >= FLUSH:
                        yield from flush()
            size = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(size) % buckets, pa.int32()),
                    pa.array(np.zeros(size), pa.int32()),
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.nulls(size, pa.binary()),
                    pa.nulls(size, pa.binary()),
                    pa.nulls(size, pa.binary()),
                ],
                _POST_NAMES,
            )
        if held:
            yield from flush()

    def _facts_batch(kind, who, times):
        size = len(who)
        return pa.RecordBatch.from_arrays(
            [
                pa.array((who.view(np.uint64) % np.uint64(buckets)).astype(np.int32), pa.int32()),
                pa.array(np.full(size, kind), pa.int32()),
                pa.nulls(size, pa.int64()),
                pa.array(times.astype(np.int64)),
                pa.array(who, pa.int64()),
                pa.nulls(size, pa.int64()),
                pa.nulls(size, pa.binary()),
                pa.nulls(size, pa.binary()),
                pa.nulls(size, pa.binary()),
            ],
            _POST_NAMES,
        )

    def _post_batch(kind, bucket, tokens, sigs, runs):
        size = len(bucket)
        none = pa.nulls(size, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(np.full(size, kind), pa.int32()), none, none, none, none, pa.array(tokens, pa.binary()), pa.array(sigs, pa.binary()), pa.array(runs, pa.binary())],
            _POST_NAMES,
        )

    return run


_POST_NAMES = [x.split()[0] for x in _POSTS.split(", ")]
_FACT_NAMES = [x.split()[0] for x in _FACTS.split(", ")]


def _shared_of(tokens: list[np.ndarray], sigs: list[np.ndarray], common: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of one bucket with how many of their postings in it are shared."""
    t, s = np.concatenate(tokens), np.concatenate(sigs)
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    keep = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))
    t, s = t[keep], s[keep]
    group = np.cumsum(np.append(True, t[1:] != t[:-1])) - 1
    shared = (np.bincount(group) > 1)[group]
    if common:
        shared |= np.isin(t, np.unique(np.concatenate(common)))
    return np.unique(s[shared], return_counts=True)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and known counts pass; postings become (set, how many of its postings are shared).

    Rows come sorted by bucket, and one bucket is held at a time.
    """
    bucket, tokens, sigs, common = None, [], [], []

    def settle() -> Iterator[pa.RecordBatch]:
        if tokens:
            who, times = _shared_of(tokens, sigs, common)
            for i in range(0, len(who), 10_000):
                j = min(i + 10_000, len(who))
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, 2), pa.int32()), none, pa.array(times[i:j].astype(np.int64)), pa.array(who[i:j]), none], _FACT_NAMES)
        tokens.clear(), sigs.clear(), common.clear()

    for batch in batches:
        buckets, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        plain = np.flatnonzero((kind == 0) | (kind == 2))
        if len(plain):
            part = batch.take(pa.array(plain))
            yield pa.RecordBatch.from_arrays(part.columns[1:6], _FACT_NAMES)
        for i in np.flatnonzero((kind == 1) | (kind == 3)).tolist():
            if buckets[i] != bucket:
                yield from settle()
                bucket = buckets[i]
            t = _unpack(batch.column(6)[i].as_py(), int(bucket))
            if kind[i] == 3:
                common.append(t)
                continue
            tokens.append(t)
            sigs.append(np.repeat(np.frombuffer(batch.column(7)[i].as_py(), np.int64), np.frombuffer(batch.column(8)[i].as_py(), "<u4")))
    yield from settle()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(_utf8(batch.column(0)), width)]
            sigs = np.array([_digest(s) for s in found], np.int64).reshape(-1, 2)
            ends = np.cumsum([0] + [len(s) for s in found])
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["sig", "sig2", "n", "tokens"],
            )

    return run


class _Node:
    """Ranks [low, high) of a path, which many sets may share; longest, least and most are of the sets below."""

    __slots__ = ("path", "low", "high", "above", "kids", "ends", "longest", "least", "most", "live")

    def __init__(self, path, low: int, high: int, above):
        self.path, self.low, self.high, self.above = path, low, high, above
        self.kids, self.ends = {}, []
        self.longest, self.least, self.most, self.live = 0, 1 << 62, 0, False


class Trie:
    """All sets of a group by ascending ranks. `live` sets are those that later ones are compared with."""

    def __init__(self, ranks: list[np.ndarray], sizes: list[int], prefixes: list[int]):
        self.ranks, self.sizes, self.prefixes = ranks, sizes, prefixes
        self.root = _Node(np.empty(0, np.int64), 0, 0, None)
        self.home: list[_Node] = [self.root] * len(ranks)
        #: rank -> component -> {node: place of the rank in its path}, for live sets' prefixes
        self.holders: dict[int, dict[int, dict[_Node, int]]] = {}
        self.alive = np.zeros(len(ranks), bool)
        for i, r in enumerate(ranks):
            self._add(i, r)

    def _add(self, i: int, r: np.ndarray) -> None:
        node, n = self.root, self.sizes[i]
        while True:
            node.longest, node.least, node.most = max(node.longest, len(r)), min(node.least, n), max(node.most, n)
            at = node.high
            if at == len(r):
                break
            kid = node.kids.get(int(r[at]))
            if kid is None:
                kid = node.kids[int(r[at])] = _Node(r, at, len(r), node)
                continue
            end = min(kid.high, len(r))
            differ = np.flatnonzero(kid.path[at:end] != r[at:end])
            same = at + int(differ[0]) if len(differ) else end
            if same < kid.high:  # nodes are only split before any of them is live
                top = node.kids[int(r[at])] = _Node(kid.path, at, same, node)
                top.longest, top.least, top.most = kid.longest, kid.least, kid.most
                top.kids[int(kid.path[same])] = kid
                kid.low, kid.above = same, top
                kid = top
            node = kid
        node.ends.append(i)
        self.home[i] = node

    def enliven(self, i: int, component: int) -> None:
        """Later sets meet set i, under the prefix ranks that it holds."""
        self.alive[i] = True
        node, prefix = self.home[i], self.prefixes[i]
        while node is not None:
            node.live = True
            for at in range(node.low, min(node.high, prefix)):
                self.holders.setdefault(int(node.path[at]), {}).setdefault(component, {})[node] = at
            node = node.above

    def match(self, i: int, node: _Node, at: int, has: np.ndarray, num: int, den: int, wanted) -> int | None:
        """A live set below node that links with set i and is wanted, if their first shared rank is at `at`."""
        if has[node.path[:at]].any():  # they share an earlier one, and meet there
            return None
        mine, n = self.ranks[i], self.sizes[i]
        low, high = -(-num * n // den), n * den // num
        todo = [(node, at, 0)]
        while todo:
            node, at, got = todo.pop()
            if not node.live or node.least > high or node.most < low:
                continue
            got += int(np.count_nonzero(has[node.path[at : node.high]]))
            left = len(mine) - int(np.searchsorted(mine, node.path[node.high - 1], "right"))
            # |A & B| * (num + den) >= num * (|A| + |B|), for the smallest size below
            if (got + min(left, node.longest - node.high)) * (num + den) < num * (n + max(node.least, low)):
                continue
            for k in node.ends:
                if self.alive[k] and got * (num + den) >= num * (n + self.sizes[k]) and wanted(k):
                    return k
            todo.extend((kid, kid.low, got) for kid in node.kids.values())
        return None


def trie_links(sids, labels, sizes, tokens: list[np.ndarray], num: int, den: int, sides=None, counts: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join the components among some sets; sets with one label are in one already.

    counts: how often each token occurs anywhere, which gives the global order (without it: in these
    sets). With sides, only sets of different sides are compared.
    """
    if not len(sids):
        return []
    flat, first, inverse = np.unique(np.concatenate(tokens), return_index=True, return_inverse=True)
    often = np.bincount(inverse) if counts is None else np.concatenate(counts)[first]
    rank = np.empty(len(flat), np.int64)
    rank[np.lexsort((flat, often))] = np.arange(len(flat))  # rare shingles first
    ranks = [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(t) for t in tokens])[:-1])]
    sizes = [int(n) for n in sizes]
    # shingles that no other set anywhere holds are not among the tokens; they stand before all others
    trie = Trie(ranks, sizes, [max(0, len(r) + 1 - needed(n, num, den)) for r, n in zip(ranks, sizes, strict=True)])
    home: dict[int, int] = {}

    def find(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    labels = [int(x) for x in labels]
    for x in labels:
        home[x] = x
    has, links = np.zeros(len(flat), bool), []
    for i in np.lexsort((sids, sizes)).tolist():
        r, label = ranks[i], labels[i]
        has[r] = True
        wanted = lambda k: find(labels[k]) != find(label) and (sides is None or sides[k] != sides[i])  # noqa: B023, E731
        entered: set[_Node] = set()  # nothing below them links, as seen from an earlier shared rank
        for x in r[: trie.prefixes[i]].tolist():
            holders = trie.holders.get(x)
            if not holders:
                continue
            for component in list(holders):
                now = find(component)
                if now != component:  # it has become part of another one
                    holders.setdefault(now, {}).update(holders.pop(component))
            for component in list(holders):
                if find(component) == find(label):
                    continue
                for node, at in holders[component].items():
                    if node in entered:
                        continue
                    k = trie.match(i, node, at, has, num, den, wanted)
                    if k is None:
                        entered.add(node)
                    else:
                        links.append((int(sids[i]), int(sids[k])))
                        home[find(label)] = find(labels[k])
                        break
        has[r] = False
        trie.enliven(i, find(label))
    return links


def joined_labels(labels, links: list[tuple[int, int]], sids) -> list[tuple[int, int]]:
    """(label, least label that links join it with) of the labels that are not the least themselves."""
    of = {int(s): int(x) for s, x in zip(sids, labels, strict=True)}
    home = {x: x for x in of.values()}

    def find(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    for a, b in links:
        x, y = find(of[a]), find(of[b])
        home[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in home if find(x) != x]


def _join_groups(num: int, den: int, two_sided: bool):
    """Rows (key, side, label, sid, n, tokens, counts), sorted by key, to the labels that each key's sets join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                sides, labels, sids, sizes, tokens, counts = zip(*rows, strict=True)
                links = trie_links(np.array(sids), np.array(labels), np.array(sizes), list(tokens), num, den, np.array(sides) if two_sided else None, list(counts))
                if links:
                    a, b = zip(*joined_labels(labels, links, sids), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "least"])
            rows.clear()

        for batch in batches:
            keys, sides, labels, sids, sizes = (batch.column(i).to_pylist() for i in range(5))
            tokens, at = batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy()
            counts = batch.column(6).flatten().to_numpy()
            at = at - at[0]
            for i, k in enumerate(keys):
                if k != key:
                    yield from solve()
                    key = k
                part = slice(at[i], at[i + 1])
                rows.append((sides[i], labels[i], sids[i], sizes[i], tokens[part].copy(), counts[part].copy()))
        yield from solve()

    return run


def _solve(groups: DataFrame, key, num: int, den: int, two_sided: bool = False) -> DataFrame:
    """groups: side, label, sid, n, tokens, counts, which meet by key. Written: node, least."""
    rows = groups.select(key.alias("key"), "side", "label", "sid", "n", "tokens", "counts").repartition("key").sortWithinPartitions("key")
    return materialise(rows.mapInArrow(handing_back(_join_groups(num, den, two_sided)), "node long, least long"))


def _relabelled(names: DataFrame, found: DataFrame) -> DataFrame:
    """names (with label) after each label became the least one that it was joined with."""
    return materialise(names.join(found, names["label"] == found["node"], "left").withColumn("label", F.coalesce("least", "label")).drop("node", "least"))


def _group_labels(sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(sid, label): the least set of each set's component, for those that are not it themselves.

    sets: comp (candidate group), sid, n, ahead, tokens, counts.
    """
    sizes = sets.groupBy("comp").agg(F.sum(F.size("tokens")).alias("load"), F.count("*").alias("members"))
    blocks = F.ceil(F.col("load") / F.lit(block)).cast("int")
    sets = sets.join(sizes.where("members > 1").select("comp", blocks.alias("blocks")), "comp")
    sets = sets.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("sid"), "blocks")).otherwise(F.lit(0)))
    sets = materialise(sets.withColumns({"label": F.col("sid"), "side": F.lit(0)}))
    # all components within blocks; a group of one block is done
    found = _solve(sets, F.xxhash64("comp", "block"), num, den)
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return found.select(F.col("node").alias("sid"), F.col("least").alias("label"))
    names = _relabelled(large.select("comp", "sid", "block", "label"), found)
    # one set of each component, again in blocks, until they fit one or join no more
    heads = materialise(large.join(names.where("sid = label").select("sid"), "sid", "left_semi"))
    while True:
        load = heads.groupBy("comp").agg(F.sum(F.size("tokens")).alias("load"), F.count("*").alias("members")).where("members > 1")
        heads = materialise(heads.drop("blocks", "block").join(load.select("comp", F.ceil(F.col("load") / block).cast("int").alias("blocks")), "comp"))
        mixed = F.pmod(F.xxhash64("sid", F.lit(1)), "blocks")
        more = _solve(heads, F.xxhash64("comp", mixed), num, den)
        if more.isEmpty():
            break
        names = _relabelled(names, more)
        heads = materialise(heads.where("blocks > 1").join(more, F.col("sid") == F.col("node"), "left_anti"))
        if heads.isEmpty():
            break
    # what is left in several components of one group: pairs of blocks
    open_ = names.groupBy("comp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("comp")
    rest = materialise(large.drop("label").join(names.join(open_, "comp", "left_semi").select("sid", "label"), "sid"))
    if not rest.isEmpty():
        posts = rest.select("comp", "sid", "block", "label", F.explode(F.slice("tokens", F.lit(1), F.col("ahead"))).alias("token"))
        # prefix shingles of several components, and the blocks (never more than the group has) that hold them
        held = posts.groupBy("comp", "token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.collect_set("block").alias("others"), F.count("*").alias("held")).where("x <> y AND size(others) > 1")
        held = materialise(held.select("comp", "token", "others", "held"))
        meets = join_split(posts, held.drop("held"), ["comp", "token"], "inner", hot_keys(posts, ["comp", "token"], held)).select("sid", "block", F.explode("others").alias("other")).where("block <> other").select("sid", "other").distinct()
        spread = rest.drop("side").join(meets, "sid").withColumn("side", (F.col("block") > F.col("other")).cast("int"))
        last = _solve(spread, F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other")), num, den, two_sided=True)
        if not last.isEmpty():
            joined = connected_components(last.select(F.col("node").alias("a"), F.col("least").alias("b")))
            names = _relabelled(names, joined.select("node", F.col("label").alias("least")))
    small = found.join(large.select("sid"), found["node"] == large["sid"], "left_anti")
    return small.select(F.col("node").alias("sid"), F.col("least").alias("label")).unionByName(names.where("sid <> label").select("sid", "label"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, width: int = 5, block: int = BLOCK) -> DataFrame:
    """Components of the exact Jaccard join: one row for each row of docs.

    Columns: id_col, n_shingles, component_id. Null and empty texts, and texts without words, have no
    shingle and link with nothing, not even with each other. Rows with equal sets link. Repeated rows
    and repeated ids each keep their row; component_id is the least id of the linked rows (null where
    all of them are null). Texts are read whole, however long they are. Other columns, whatever their
    names, are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = partitions_for(src, "text", 64)
    posts = src.mapInArrow(handing_back(_postings(BUCKETS * parts, num, den, width)), _POSTS)
    facts = materialise(posts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(handing_back(_count_shared), _FACTS))
    members = facts.where("kind = 0").select("doc_id", "n", "sig", "sig2")
    shared = facts.where("kind = 2").groupBy("sig").agg(F.sum("n").alias("shared"))
    low = F.ceil(F.lit(num) * F.col("n") / den)
    enough = F.greatest(F.lit(1), F.floor(low / 4))  # spare() of the smallest possible partner
    heads = members.where("n > 0").groupBy("sig", "sig2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    heads = heads.join(shared, "sig").where(F.col("shared") >= enough).select("sig", "sig2", "doc_id")
    # a set's number, once written, stands for its 128 bits
    heads = materialise(heads.withColumn("sid", F.monotonically_increasing_id()))
    # ids may repeat, and be null, so a set is known by its digest, and one reading of each is kept
    wanted = heads.select(F.col("doc_id").alias("head_id")).distinct()
    # always by shuffle: the list of ids grows with the table
    again = src.join(wanted.hint("merge"), src["doc_id"].eqNullSafe(wanted["head_id"]), "left_semi").select("text")
    sets = again.mapInArrow(handing_back(_sets(width)), "sig long, sig2 long, n long, tokens array<long>").dropDuplicates(["sig", "sig2"])
    sets = materialise(sets.join(heads.select("sig", "sig2", "sid").hint("merge"), ["sig", "sig2"]).select("sid", "n", "tokens"))
    # exact document frequencies among what is left; a shingle of one set only counts in n
    posts = sets.select("sid", "n", F.explode("tokens").alias("token"))
    df = materialise(posts.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1"))
    # a passage in a third of all texts makes its shingles hot: they do not move
    hot = hot_keys(posts, ["token"], df.withColumnRenamed("df", "held"))
    ordered = join_split(posts, df, ["token"], "inner", hot).groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    ordered = ordered.where(F.size("common") >= F.ceil(F.lit(num) * F.col("n") / den))
    # the rare shingles of the set that come before its common ones take up places of the prefix
    ahead = F.col("n") - F.ceil(F.lit(num) * F.col("n") / den) + 1 - (F.col("n") - F.size("common"))
    ordered = materialise(ordered.select("sid", "n", F.col("common.token").alias("tokens"), F.col("common.df").alias("counts"), ahead.cast("int").alias("ahead")))
    prefix = ordered.select("sid", F.explode(F.slice("tokens", F.lit(1), F.col("ahead"))).alias("token"))
    star = prefix.groupBy("token").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z").select("token", "a")
    edges = join_split(prefix, star, ["token"], "inner", hot).select("a", F.col("sid").alias("b")).where("a <> b")
    comps = connected_components(edges).select(F.col("node").alias("sid"), F.col("label").alias("comp"))
    labels = _group_labels(ordered.join(comps, "sid"), num, den, block)
    firsts = members.where("n > 0").groupBy("sig", "sig2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("held"))
    # the least set of a component has no row of its own among the labels
    linked = labels.unionByName(labels.select(F.col("label").alias("sid"), "label").distinct())
    linked = heads.select("sig", "sig2", "sid").join(linked, "sid").select("sig", "sig2", "label")
    firsts = materialise(firsts.join(linked, ["sig", "sig2"], "left"))
    joined = firsts.where("label IS NOT NULL")
    least = materialise(joined.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("held")))
    found = join_split(joined.drop("held"), least.drop("held"), ["label"], "inner", hot_keys(joined, ["label"], least)).select("sig", "sig2", "component_id")
    found = found.unionByName(firsts.where("label IS NULL").select("sig", "sig2", F.col("first_id").alias("component_id")))
    full = members.where("n > 0")
    out = join_split(full, found, ["sig", "sig2"], "inner", hot_keys(full, ["sig", "sig2"], firsts)).select("doc_id", "n", "component_id")
    out = out.unionByName(members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of rows that link, directly or over others: that of the smallest id.

    Null ids come last; of rows that repeat the smallest id one stays. Rows without shingles stay. All
    columns, whatever their names, are returned; an empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*columns).alias("row")))
    found = jaccard_components(keyed.select("key", F.col("row")[text_col].alias("text")), "key", "text").where("n_shingles > 0")
    found = found.join(keyed.select("key", F.col("row")[id_col].alias("id")), "key").select(F.col("component_id").alias("group"), F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("rank"))
    found = materialise(found)
    groups = found.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("held"))
    groups = materialise(groups.where("held > 1"))
    gone = join_split(found, groups.drop("held"), ["group"], "inner", hot_keys(found, ["group"], groups)).where("rank.key <> first.key").select(F.col("rank.key").alias("gone"))
    return keyed.join(gone, keyed["key"] == gone["gone"], "left_anti").select("row.*")
