"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The copies are laid end to end, one random
offset is added to the sums, and a document is emitted once for each whole number that its stretch crosses.

The order inside a source spreads long documents: half of the documents, by a digest of doc_id, ascend by size, and
the other half descends. What rounding up takes too much on the way up is about what it takes too little on the way
down, so that a source misses its target by much less than its longest document on average, whatever the
offset; at worst by about that document, when it is alone of its length.

Documents of one half and size are ordered by a digest prefix of doc_id, and by doc_id. Positions come from three
small prefix sums (sizes in a source, digest prefixes in a size, rows in a prefix), so no task ever sorts a
whole source: a source or a group of equal sizes with a third of all rows is spread over the prefixes. Only the
list of sources is ranked in one task, a row each.

Defined cases: null text or no word has size 0 and is never taken; null sources form one source, put
last; an empty table gives an empty result; a source of size 0 has target 0; rows with the same
doc_id, size and source are interchangeable; names of further columns can't clash, as they are carried as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, null_key

#: Offsets are multiples of this, so that adding them to an exact product stays exact enough.
OFFSET_STEPS = 65536
#: Places of the descending half lie behind those of the ascending one.
BEHIND = 1 << 62


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_size: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(mix_key, source_size, target) from (mix_key, mix_source, mix_size, n).

    Water filling in closed form: with sources in order of cap over weight, the first one whose cap
    isn't reached fixes the common level; a source gets the level times its weight, or its cap. Levels
    fall from that source on, so it has the greatest of those that stay below their cap.
    """
    sources = per_size.groupBy("mix_key", "mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    level = weighted.select(
        "*",
        ((total - before) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))).alias("level"),
        (F.col("source_size") * cap / F.col("weight")).alias("full_at"),
    )
    common = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    return level.select(
        "mix_key",
        "source_size",
        F.least(common * F.col("weight"), (F.col("source_size") * cap).cast("double")).alias("target"),
    )


def crossed(start: Column, end: Column, offset: Column) -> Column:
    """Whole numbers crossed from place ``start`` to ``end``, at the copies a document of the source."""
    each = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    return F.floor(end.cast("double") * each + offset) - F.floor(start.cast("double") * each + offset)


def offset_of(key: Column, seed: int) -> Column:
    """The random offset of a source, from 0 to 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / OFFSET_STEPS


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, mix_size, mix_source_size, mix_target, mix_copies): the rows of ``docs`` as they were, and 0 to ``cap`` copies."""
    key, digest = ["mix_key", "mix_place", "mix_slot"], F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("mix_id"),
        F.col(source_col).alias("mix_source"),
        null_key(F.col(source_col)).alias("mix_key"),
        word_count(F.col(text_col)).alias("mix_size"),
        F.substring(digest, 1, 3).alias("mix_slot"),
        F.substring(digest, 4, 1).isin(*"13579bdf").alias("mix_down"),
    )
    rows = rows.withColumn("mix_place", F.when(F.col("mix_down"), F.lit(BEHIND) - F.col("mix_size")).otherwise(F.col("mix_size"))).drop("mix_down")
    slots = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("mix_source").alias("mix_source"), F.first("mix_size").alias("mix_size"))
    per_place = slots.groupBy("mix_key", "mix_place").agg(F.sum("n").alias("n"), F.first("mix_source").alias("mix_source"), F.first("mix_size").alias("mix_size"))
    by_place = Window.partitionBy("mix_key").orderBy("mix_place")
    placed = per_place.select("mix_key", "mix_place", (F.sum("n").over(by_place) - F.col("n")).alias("place_start"))
    placed = placed.join(targets(per_place, weights, cap), "mix_key").withColumn("offset", offset_of(F.col("mix_key"), seed))
    by_slot = Window.partitionBy("mix_key", "mix_place").orderBy("mix_slot")
    starts = slots.select(*key, (F.sum("n").over(by_slot) - F.col("n")).alias("slot_start")).join(placed, ["mix_key", "mix_place"])
    numbered = rows.withColumn("mix_row", F.row_number().over(Window.partitionBy(*key).orderBy("mix_id"))).join(starts, key)
    end = F.col("place_start") + F.col("slot_start") + F.col("mix_row")
    copies = F.least(F.coalesce(crossed(end - 1, end, F.col("offset")), F.lit(0)), F.lit(cap))
    return numbered.select(
        "row",
        "mix_size",
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.when(F.col("mix_size") > 0, copies).otherwise(0).cast("int").alias("mix_copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is drawn."""
    drawn = mix(docs, **options).where("mix_copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")
