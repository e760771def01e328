"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

#: Expected copies are counted in units of 2^-32, so that prefix sums are exact in any order of addition.
UNIT = 1 << 32
MOST_COPIES = 3


def word_count(text: str) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _part(salt: str, value: F.Column) -> F.Column:
    return F.md5(F.concat(F.lit(salt), F.coalesce(value.cast("string"), F.lit("-"))))


def _offset(seed: str, source: F.Column) -> F.Column:
    """A draw from 0 to 2^32 - 1, the same for a source in every run."""
    return F.conv(F.substring(_part(f"{seed}/offset/", source), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, units) of each source, from (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the total size. A target stops at
    ``most`` times its source's size and the excess is shared again by weight: sources are capped in the
    order of cap / weight, and the last level w * (rest / weights left) at which none is above its cap holds.
    The table of sources has one row for each source, so its windows may run in one task.
    """
    table = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = table.withColumn("place", place)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most
    table = table.withColumn("cap", cap).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    table = table.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    table = table.withColumn("caps_before", F.sum("cap").over(order) - F.col("cap")).withColumn("weight_before", F.sum("weight").over(order) - F.col("weight"))
    level = (F.col("total") - F.col("caps_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    table = table.withColumn("level", level)
    # the level only rises while sources at their caps are set aside; the first that fits holds for all after it
    table = table.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole))
    free = F.struct("ratio", "place") >= F.struct(F.col("final.ratio"), F.col("final.place"))
    target = F.when(free, F.col("weight") * F.col("final.level")).otherwise(F.col("cap").cast("double"))
    table = table.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = F.least(F.floor(copies * UNIT), F.lit(most * UNIT)).cast("long")
    return table.select("source", "source_size", "target", units.alias("units"))


def boundaries(rank: F.Column, units: F.Column, offset: F.Column) -> F.Column:
    """Whole numbers in ``(rank * units + offset) / 2^32``, by parts, so that no product leaves a long.

    rank is below 2^61 and units below 2^34.
    """
    whole, part = F.shiftright(units, 32), units.bitwiseAND(F.lit(UNIT - 1))
    high, low = F.shiftright(rank, 30), rank.bitwiseAND(F.lit((1 << 30) - 1))
    upper = high * part
    rest = low * part + F.shiftleft(upper.bitwiseAND(F.lit(3)), 30) + offset
    return rank * whole + F.shiftright(upper, 2) + F.shiftright(rest, 32)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """(id, version, source, size, source_size, target, copies) of every row; version is a hash of the text.

    Within each source, documents are put in the order of size and then of a hash of the id, the expected
    copies of all before are added up, one offset drawn from ``seed`` is added, and a document is taken
    once for each whole number that its own share crosses. As neighbours have equal sizes, the words
    taken stay within about one document of the target. Rows are sorted over all partitions, so
    the largest source is spread over many tasks; only a count for each source and partition
    is added up further. Reruns agree, as order, offset and fixed-point sums don't depend on partitions.

    Null texts have size 0, a null source is one more source, null ids come last, and repeated rows are
    taken one by one. A source without words is never taken. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("version"))
    ordered = rows.orderBy(F.col("source").asc_nulls_last(), "size", _part(f"{seed}/order/", F.col("id")), F.col("id").asc_nulls_last(), "version")
    at = F.monotonically_increasing_id()
    ordered = materialize(ordered.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "mix-ordered")
    targets = materialize(source_targets(ordered.select("source", "size"), weights, most), "mix-targets")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(
        parts["source"], "part", "begin", "earlier", "source_size", "target", "units", _offset(seed, parts["source"]).alias("offset")
    )
    same = ordered["source"].eqNullSafe(parts["source"]) & (ordered["part"] == parts["part"])
    # one row for each source and partition that holds some of it
    joined = ordered.join(parts, same).select(ordered["*"], "begin", "earlier", "source_size", "target", "units", "offset")
    rank = F.col("earlier") + F.col("at") - F.col("begin")
    crossed = lambda r: boundaries(r, F.col("units"), F.col("offset"))
    return joined.withColumn("copies", crossed(rank + 1) - crossed(rank)).select("id", "version", "source", "size", "source_size", "target", "copies")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns, with copy_number (from 1) added.

    Texts are exchanged once. Rows alike in id, source and text are taken as one stack.
    """
    counted = mix(docs, id_col, text_col, source_col, **how).groupBy("id", "version", "source")
    counted = counted.agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("rows")).where("mix_copies > 0")
    taken = materialize(counted, "mix-taken")
    kept = [c for c in docs.columns if c != "copy_number"]
    base = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"), F.xxhash64(F.col(text_col)).alias("own_version"))
    same = base["own_id"].eqNullSafe(taken["id"]) & (base["own_version"] == taken["version"]) & base["own_source"].eqNullSafe(taken["source"])
    found = base.join(taken.where("rows = 1"), same)
    if not taken.where("rows > 1").isEmpty():
        stacks = base.join(taken.where("rows > 1"), same)
        found = found.union(stacks.dropDuplicates(["own_id", "own_source", "own_version"]))
    return found.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy_number"))
