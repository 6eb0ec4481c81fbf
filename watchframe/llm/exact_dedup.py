"""Exact dedup over content-defined chunk recipes, in DataFrame expressions only.

A text is cut where its own content says so: after white space that a pattern of the letters before it
selects, never before MIN_CHUNK and at MAX_CHUNK characters at the latest. An insertion moves only the
cuts near it. A document becomes its *recipe*, the ordered list of its chunks' identifiers, and two
texts are equal when their recipes are.

Whole texts never move. Chunk hashes make a recipe digest on the reading side; only documents whose
digest and length occur more than once go on. Of those, the chunks are grouped by hash and their texts
compared: a hash with one text identifies it; where texts differ, the identifier also holds the text's
number. The ordered lists of these verified identifiers then decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .skew import hot_keys, join_split
from .storage import materialise

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHUNK = 256
MAX_CHUNK = 4096
#: Letters before a white space that end a chunk: about one word in fifteen.
CUT_AFTER = "[dkpx]"


def lower_ascii(text):
    """A-Z lower-cased, nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def chunks(text, least: int = MIN_CHUNK, most: int = MAX_CHUNK):
    """Array of the content-defined chunks whose concatenation is the text."""
    cut = rf"(?s).{{{least - 2},{most - 2}}}?{CUT_AFTER}\s|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _recipes(texts: DataFrame, least: int, most: int) -> DataFrame:
    """texts: id, text_sha256, digest, bytes, text. The verified recipe of each (id, text_sha256)."""
    found = texts.select("id", "text_sha256", "digest", "bytes", F.posexplode(chunks(F.col("text"), least, most)).alias("pos", "chunk"))
    found = found.withColumn("h", F.xxhash64("chunk"))
    several = found.select("h", "chunk").distinct()
    clash = several.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    clash = materialise(clash)
    if clash.isEmpty():  # each hash stands for one text
        found = found.withColumn("variant", F.lit(0))
    else:
        order = Window.partitionBy("h").orderBy("chunk")
        names = several.join(clash, "h").withColumn("variant", F.row_number().over(order)).select("h", "chunk", "variant")
        found = found.join(names, ["h", "chunk"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
    # a document's text can be empty: posexplode drops it, so it has the empty recipe
    lists = found.groupBy("id", "text_sha256", "digest", "bytes").agg(F.sort_array(F.collect_set(F.struct("pos", "h", "variant"))).alias("recipe"))
    empty = texts.where("bytes = 0").select("id", "text_sha256", "digest", "bytes").distinct()
    none = F.array().cast("array<struct<pos:int,h:bigint,variant:int>>")
    return lists.unionByName(empty.withColumn("recipe", none))


def _equal_texts(docs: DataFrame, id_col: str, text_col: str, least: int, most: int) -> DataFrame:
    """One row for each different (id, text): id, text_sha256, times that it occurs, keep_id, group_size."""
    lowered = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    src = docs.select(F.col(id_col).alias("id"), lowered.alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    digest = F.xxhash64(F.transform(chunks(F.col("text"), least, most), lambda c: F.xxhash64(c)))
    facts = src.select("id", "text_sha256", F.octet_length("text").alias("bytes"), digest.alias("digest"))
    facts = materialise(facts.groupBy("id", "text_sha256", "bytes", "digest").agg(F.count("*").alias("times")))
    again = materialise(facts.groupBy("digest", "bytes").agg(F.count("*").alias("held")).where("held > 1"))
    facts = materialise(join_split(facts, again, ["digest", "bytes"], "left", hot_keys(facts, ["digest", "bytes"], again)))
    maybe, alone = facts.where("held IS NOT NULL"), facts.where("held IS NULL")
    asked = maybe.select(F.col("id").alias("maybe_id"), F.col("text_sha256").alias("maybe_sha"), "digest", "bytes")
    # always by shuffle: the list of ids grows with the table
    texts = src.join(asked.hint("merge"), src["id"].eqNullSafe(asked["maybe_id"]) & (src["text_sha256"] == asked["maybe_sha"]))
    texts = materialise(texts.select("id", "text_sha256", "digest", "bytes", "text"))
    recipes = _recipes(texts, least, most).withColumnsRenamed({"id": "rid", "text_sha256": "rsha"}).select("rid", "rsha", "recipe")
    rows = maybe.join(recipes, maybe["id"].eqNullSafe(recipes["rid"]) & (maybe["text_sha256"] == recipes["rsha"]))
    # the recipe decides; a digest of the text names the group of one recipe in the join that follows
    groups = rows.groupBy("digest", "bytes", "recipe").agg(F.max("id").alias("keep_id"), F.sum("times").alias("group_size"), F.min("text_sha256").alias("text_sha256"), F.count("*").alias("held"))
    groups = materialise(groups.drop("recipe"))
    keys = ["digest", "bytes", "text_sha256"]
    equal = join_split(maybe.drop("held"), groups, keys, "inner", hot_keys(maybe, keys, groups)).select("id", "text_sha256", "times", "keep_id", "group_size")
    alone = alone.select("id", "text_sha256", "times", F.col("id").alias("keep_id"), F.col("times").alias("group_size"))
    return equal.unionByName(alone)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """The group of equal texts of each row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty, and empty texts are
    equal. Of each group the row with the largest id stays (null ids only where all are null). Where
    rows repeat both id and text, one of them is kept. Texts are read whole, however long they are. Other
    columns, whatever their names, are not read; an empty table gives an empty result.

    A digest that a large part of all rows share is joined by broadcast (see skew.join_split); groups are
    aggregated with map-side combination.
    """
    each = _equal_texts(docs, id_col, text_col, least, most)
    each = each.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return each.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _orders(kind: DataType) -> bool:
    """Whether values of a type can be ordered; maps and variants inside it cannot."""
    if isinstance(kind, ArrayType):
        return _orders(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orders(f.dataType) for f in kind.fields)
    return kind.typeName() not in ("map", "variant")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, whatever their names and types.

    Of rows that repeat both id and text the first stays, in the order of the other columns: those that have an
    order, then the JSON of the others (maps, and what holds them). Such rows are combined before the shuffle, and
    those of a pair that a large part of all rows repeat (null ids of one text) do not move at all.
    """
    kept = _equal_texts(docs, id_col, text_col, MIN_CHUNK, MAX_CHUNK).where(F.col("id").eqNullSafe(F.col("keep_id")))
    kept = materialise(kept.select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), "times"))
    lowered = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(lowered, 256).alias("sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = lambda r, k: r["id"].eqNullSafe(k["kept_id"]) & (r["sha"] == k["kept_sha"])
    several = kept.where("times > 1")
    if several.isEmpty():
        return rows.join(kept, same(rows, kept), "left_semi").select("row.*")
    others = [f for f in docs.schema.fields if f.name != id_col]
    ordered = [F.col("row")[f.name].alias(f"o{i}") for i, f in enumerate(others) if _orders(f.dataType)]
    told = [F.to_json(F.struct(*[F.col("row")[f.name].alias(f.name) for f in others if not _orders(f.dataType)])).alias("rest")] if any(not _orders(f.dataType) for f in others) else []
    first = F.min_by("row", F.struct(*ordered, *told) if ordered or told else F.lit(1))
    hot = hot_keys(kept, ["kept_id", "kept_sha"], several.withColumnRenamed("times", "held"))
    cold = rows.join(F.broadcast(hot), same(rows, hot), "left_anti")
    cold = cold.join(kept, same(cold, kept))
    out = cold.where("times = 1").select("row").unionByName(cold.where("times > 1").groupBy("id", "sha").agg(first.alias("row")).select("row"))
    return out.unionByName(rows.join(F.broadcast(hot), same(rows, hot), "left_semi").groupBy("id", "sha").agg(first.alias("row")).select("row")).select("row.*")
