"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue. A use of a document has a virtual finish time: the
words that its source has served up to its end, divided by the source's target. A queue starts over when
it is exhausted, so a source whose target is above its size uses documents again. All uses of all sources
are range-sorted by their finish times, and the order is cut where the total budget of words is used up:
a use stays if at least half of its words fit. Since the targets add up to the budget, the cut falls near
virtual time 1, and each source is served within about one document of its target. Documents are used
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals
from .skew import join_split
from .storage import materialise

#: Most times that a source's words may be used.
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD))


def source_targets(sizes: DataFrame, repeats: int = MAX_REPEATS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: source, source_size. Adds weight, before (words of the sources ahead) and target.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... Shares of the total follow the
    weights; a target stops at `repeats` times its source's size and its excess is shared again.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = running_totals(sizes.withColumn("one", F.lit(1)), order, "one", "place")
    ranked = running_totals(ranked, order, "source_size", "upto").withColumn("before", F.col("upto") - F.col("source_size"))
    # places of the list go round: 1, 2, 3, 1, ...
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight).select("source", "source_size", "before", "weight"))
    level, full = 0.0, -1
    while True:
        # a source above its limit stays above: the common level only rises
        above = F.lit(level) * F.col("weight") > F.col("source_size") * repeats
        got = ranked.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(above, F.col("source_size") * repeats)), F.lit(0)).alias("used"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if not got["open"] or got["full"] == full:
            break
        full, level = got["full"], (got["total"] - got["used"]) / got["open"]
    target = F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * repeats).cast("double"))
    return ranked.withColumn("target", target)


def served_uses(rows: DataFrame, seed: str = "mix", repeats: int = MAX_REPEATS) -> DataFrame:
    """rows: key, id, source, size. What the queues serve: one row for each key.

    Columns: key, id, size, source_size, target, uses (times that the row is taken), first_finish.
    Both orders are range-sorted running totals, so a source with a third of all rows, or any run of equal
    finish times, spreads over as many tasks as its rows need. Only rows that are equal in source, id and size (null ids of
    one size) cannot be cut by the order and stand in one task, as small rows without their texts.
    """
    src = materialise(rows.withColumn("turn", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))))))
    targets = materialise(source_targets(src.groupBy("source").agg(F.sum("size").alias("source_size")), repeats))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    queue = materialise(running_totals(src, [F.col("source").asc_nulls_last(), "turn", "id", "size"], "size", "upto"))
    queue = join_split(queue, targets, ["source"])
    each = queue.withColumn("use", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = F.when(F.col("target") > 0, (F.col("upto") - F.col("before") + F.col("use") * F.col("source_size")) / F.col("target"))
    order = [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), "use", "turn", "id", "size"]
    served = running_totals(each.withColumn("finish", finish).drop("before", "upto", "weight"), order, "size", "served")
    inside = 2 * F.col("served") - F.col("size") <= F.lit(2 * budget)
    return served.groupBy("key", "id", "size", "source_size", "target").agg(F.count_if(inside).alias("uses"), F.min("finish").alias("first_finish"))


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", repeats: int = MAX_REPEATS) -> DataFrame:
    """What the mix takes of each row: id_col, size, source_size, target, taken, first_finish.

    size: words of the text (null: 0), however long it is. taken: words used, repeats counted: 0 to
    `repeats` times the size, whole uses only. first_finish: virtual finish time of the first use (null
    where the target is 0). The shuffle is the order of md5(seed:id), so reruns agree; repeated and null
    ids stand in the order of their sizes, and rows that repeat id and size are served one after the
    other. A null source is a source. Other columns, whatever their names, are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).cast("long").alias("size"))
    found = served_uses(rows, seed, repeats)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("uses") * F.col("size")).alias("taken"), "first_finish")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: docs' rows as often as they are used.

    Rows are dealt to partitions by a hash of their keys, so each is a fair part of the mix, and stand in the
    order of virtual finish times there; whole texts move once. Every use is the whole row with all its columns, whatever their names. Rows without words (null, empty
    or white space) are not part of a mix. Null and repeated ids and repeated rows are rows of their own:
    each row has a key from its first reading to the output. An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*columns).alias("row")))
    field = lambda c: F.col("row")[c]
    rows = keyed.select("key", field(id_col).alias("id"), field(source_col).alias("source"), word_count(field(text_col)).cast("long").alias("size"))
    mix = served_uses(rows, seed, repeats).where("uses > 0 AND size > 0").select("key", "uses", "first_finish", (F.col("source_size") / F.col("target")).alias("round"))
    found = keyed.join(mix, "key").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses").cast("int") - 1)))
    found = found.withColumn("finish", F.col("first_finish") + F.col("use") * F.col("round"))
    return found.sortWithinPartitions("finish", "key").select("row.*")
