"""Mixing sources to target weights by entropy balancing.

Each document gets a rate ``exp(tilt of its source)``, the rates closest in
relative entropy (over words) to one that give every source its target. The dual
is convex and Newton's method solves it: each round sums the tilted words over cells,
the documents of one source and size. Each constraint is on one source, so the dual
falls apart by source and the tilts come to ``ln(target / words)``. Rates become whole
copies: copies are first dealt to cells by running sums, then exchanged between sizes
while that brings a source nearer to its target, then dealt within a cell by a hash of
the document. Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import SPACE_CLASS, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
ROUNDS = 60
TOLERANCE = 1e-12
# Documents of a cell are dealt out in sub-cells of about this many.
CELL_ROWS = 256
# Rounds of exchanges between the sizes of a source.
EXCHANGES = 4


def word_count(text: Column) -> Column:
    """Runs of non-space characters; 0 for null. Every run shrinks to nothing but its
    first character's place, so no list of words is built."""
    spaced = F.concat(F.lit(" "), text)
    return F.coalesce(
        F.length(spaced) - F.length(F.regexp_replace(spaced, rf"[{SPACE_CLASS}](?=[^{SPACE_CLASS}])", "")), F.lit(0)
    ).cast("long")


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target). Sources in code-point order, null last, weigh
    ``weights``, repeating, and share ``share`` of all words; no target exceeds
    ``most`` times the source, and the excess goes to the others by weight.

    The end of that sharing is the level at which ``min(most * size, level * weight)``
    adds up; sources reach their limit in the order of limit per weight. One row
    per source is all that these windows see.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = reduce(
        lambda column, i: column.when(F.col("place") % len(weights) == i, weights[i]),
        range(1, len(weights)),
        F.when(F.col("place") % len(weights) == 0, weights[0]),
    )
    fill = Window.orderBy("height", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    return (
        sources.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("limit", F.col("source_size") * float(most))
        .withColumn("height", F.col("limit") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(whole) * share)
        .withColumn("limits", F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.coalesce("limits", F.lit(0.0))) / F.col("open"))
        # a source is at its limit if what those before it leave would lift it above
        .withColumn("at_limit", F.col("level") >= F.col("height"))
        .withColumn("spent", F.sum(F.when(F.col("at_limit"), F.col("limit")).otherwise(0.0)).over(whole))
        .withColumn("sharing", F.sum(F.when(F.col("at_limit"), 0.0).otherwise(F.col("weight"))).over(whole))
        .select(
            "source",
            "source_size",
            F.when(F.col("at_limit"), F.col("limit"))
            .otherwise((F.col("all_words") - F.col("spent")) / F.col("sharing") * F.col("weight"))
            .alias("target"),
        )
    )


def tilts(cells: DataFrame, wanted: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, source_size, target, tilt): Newton rounds on the dual
    ``sum(words * exp(tilt)) - target * tilt``, whose slope is tilted words less
    target and whose curvature is the tilted words. A source without words, or with
    target 0, has rate 0 (tilt null). Every round sums the tilted words over the cells;
    only the largest error reaches the driver. Rounds that do not get there raise."""
    state = wanted.withColumn("tilt", F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.lit(0.0)))
    state = stored(state.select("source", "source_size", "target", "tilt"), "mixing-tilts")
    for _ in range(rounds + 1):
        tilted = (
            cells.alias("c")
            .join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("of"))
            .agg(F.sum(F.col("docs") * F.col("size") * F.exp("tilt")).alias("tilted"))
        )
        state = state.join(tilted, state["source"].eqNullSafe(tilted["of"]), "left").drop("of")
        # the step is the Newton step, held to 1 so that far sources do not overshoot
        gap = (F.col("target") - F.col("tilted")) / F.col("tilted")
        state = stored(
            state.select(
                "source", "source_size", "target", "tilt", (F.abs(gap) * F.col("tilted") / F.col("target")).alias("error"),
                F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap)).alias("step"),
            ),
            "mixing-tilts",
        )
        worst = state.where("tilt is not null").agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            return state.drop("error", "step")
        state = state.select("source", "source_size", "target", (F.col("tilt") + F.col("step")).alias("tilt"))
    raise ArithmeticError(f"tilts are off by {worst:.1e} of their targets after {rounds} rounds")


def _running(value: Column, *order) -> Column:
    """Running sum over the cells of a source; cells are sizes, not documents."""
    over = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(over)


def dealt(cells: DataFrame, tilted: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Cells (source, size, salt, docs) with ``copies`` for all and ``extra`` documents that
    get one more. Rounding goes down the sizes, carrying the fraction; what a source
    still lacks or has too much is then evened out over its smallest documents."""
    rate = F.least(F.lit(float(most)), F.coalesce(F.exp("tilt"), F.lit(0.0)))
    base = F.floor(F.col("rate") + F.lit(1e-9))
    order = (F.desc("size"), "salt")
    rounded = (
        cells.join(tilted, cells["source"].eqNullSafe(tilted["source"]))
        .drop(tilted["source"])
        .withColumn("rate", rate)
        .withColumn("copies", base)
        .withColumn("share", F.greatest(F.lit(0.0), F.col("rate") - F.col("copies")) * F.col("docs"))
        .withColumn("sum", _running(F.col("share"), *order))
        .withColumn("extra", F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("share") + 0.5))
        .withColumn("extra", F.greatest(F.lit(0), F.least("docs", "extra")))
        .withColumn(
            "lack",
            F.col("target")
            - F.sum((F.col("copies") * F.col("docs") + F.col("extra")) * F.col("size")).over(
                Window.partitionBy("source")
            ),
        )
    )
    # documents that can still change, from the smallest on, until the lack is used up
    more = F.col("lack") > 0
    free = F.when(more, F.when(F.col("copies") < most, F.col("docs") - F.col("extra")).otherwise(0)).otherwise(
        F.col("extra")
    )
    return (
        rounded.withColumn("free", F.when(F.col("size") > 0, free).otherwise(0))
        .withColumn("reach", _running(F.col("free") * F.col("size"), "size", "salt"))
        .withColumn("left", F.abs("lack") - F.col("reach") + F.col("free") * F.col("size"))
        .withColumn(
            "change",
            F.when(
                F.col("size") > 0, F.greatest(F.lit(0), F.least("free", F.floor(F.col("left") / F.col("size"))))
            ).otherwise(0),
        )
        .withColumn("extra", F.col("extra") + F.when(more, F.col("change")).otherwise(-F.col("change")))
        .select(
            "source", "size", "salt", "docs", "source_size", "target", "rate",
            (F.col("copies") * F.col("docs") + F.col("extra")).cast("long").alias("taken"),
        )
    )


def exchanged(plan: DataFrame, most: int, rounds: int = EXCHANGES) -> DataFrame:
    """``plan`` (cells with ``taken``, the copies of all their documents) after exchanges.

    Each round finds, per source, the size that gets a copy more and the size that gets one
    less (either may be none) whose difference comes closest to what the source lacks:
    both lists of sizes are put in one order, where the nearest partner of a size
    stands beside it. An exchange that brings no gain is not made. Sizes of a source
    are few beside its documents."""
    nothing = F.lit(0).cast("long")
    for _ in range(rounds):
        of = Window.partitionBy("source")
        lacking = plan.withColumn("lack", F.col("target") - F.sum(F.col("taken") * F.col("size")).over(of))
        sizes = lacking.where("size > 0").groupBy("source", "size").agg(
            F.first("lack").alias("lack"),
            F.max(F.col("taken") < most * F.col("docs")).alias("more"),
            F.max(F.col("taken") > 0).alias("less"),
        )
        none = lacking.groupBy("source").agg(F.first("lack").alias("lack")).select("source", nothing.alias("size"), "lack")
        more = sizes.where("more").select("source", "size", "lack").unionByName(none)
        less = sizes.where("less").select("source", "size", "lack").unionByName(none)
        line = more.select("source", "lack", (F.col("size") - F.col("lack")).alias("at"), F.col("size").alias("up"), nothing.cast("long").alias("down"), F.lit(True).alias("asks")).unionByName(
            less.select("source", "lack", F.col("size").cast("double").alias("at"), F.lit(None).cast("long").alias("up"), F.col("size").alias("down"), F.lit(False).alias("asks"))
        )
        order = Window.partitionBy("source").orderBy("at", "asks", "down")
        back = Window.partitionBy("source").orderBy(F.desc("at"), "asks", "down")
        partner = F.when(~F.col("asks"), F.col("down"))
        beside = line.withColumns({
            "below": F.last(partner, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "above": F.last(partner, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }).where("asks")
        tried = beside.select("source", "lack", "up", F.explode(F.array("below", "above")).alias("down")).where("down is not null")
        left = F.abs(F.col("lack") - F.col("up") + F.col("down"))
        best = tried.groupBy("source").agg(F.min(F.struct(left.alias("left"), "up", "down", F.abs("lack").alias("lack"))).alias("b"))
        best = best.where("b.left < b.lack").select(F.col("source").alias("of"), "b.up", "b.down")
        # one cell of each chosen size changes: the first that can
        first = Window.partitionBy("source", "size").orderBy("salt")
        able = lambda name, can: F.sum(F.when(can, 1).otherwise(0)).over(first.rowsBetween(Window.unboundedPreceding, 0)).alias(name)
        can_more, can_less = F.col("taken") < most * F.col("docs"), F.col("taken") > 0
        numbered = plan.select("*", able("nth_more", can_more), able("nth_less", can_less))
        change = (
            F.when(can_more & (F.col("nth_more") == 1) & (F.col("size") == F.col("up")) & (F.col("size") > 0), 1).otherwise(0)
            - F.when(can_less & (F.col("nth_less") == 1) & (F.col("size") == F.col("down")) & (F.col("size") > 0), 1).otherwise(0)
        )
        changed = numbered.join(best, numbered["source"].eqNullSafe(best["of"]), "left").withColumn("taken", F.col("taken") + F.coalesce(change, F.lit(0)))
        plan = stored(changed.select(*plan.columns), "mixing-plan")
    return plan


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (row, source, size) with source_size, target, rate and copies, one row each.

    ``row`` tells rows apart and decides, by its hash, who in a cell gets a copy more.
    Null sources form one source, the last; documents without words are copied like
    their source and count 0; an empty table gives no rows. Reruns give the same.
    """
    sizes = stored(sizes.select("row", "source", "size"), "mixing-sizes")
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    salted = sizes.join(
        counts.select(
            F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("n") / CELL_ROWS).alias("salts")
        ),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).select("row", "source", "size", F.pmod(F.xxhash64("row"), "salts").alias("salt"))
    salted = stored(salted, "mixing-salted")
    cells = stored(salted.groupBy("source", "size", "salt").agg(F.count("*").alias("docs")), "mixing-cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    plan = stored(dealt(cells, tilts(cells, targets(totals, weights, share, most)), most), "mixing-plan")
    other = exchanged(plan, most).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("k"), "source_size", "target", "rate",
        F.floor(F.col("taken") / F.col("docs")).alias("copies"), (F.col("taken") % F.col("docs")).alias("extra"),
    )
    place = Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("row", F.lit(1)), "row")
    return (
        salted.withColumn("place", F.row_number().over(place))
        .join(
            other,
            F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("k")),
        )
        .select(
            "row",
            "source",
            "size",
            "source_size",
            "target",
            "rate",
            (F.col("copies") + (F.col("place") <= F.col("extra")).cast("long")).alias("copies"),
        )
    )


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) per row of ``docs``. Equal rows may
    share copies either way; columns other than doc_id, text and source are not read."""
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("row"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    return mix(sizes).select(
        F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: rows with no copy go, others repeat. Rows that share a
    doc_id take their numbers of copies in the order of their columns."""
    columns = docs.columns
    sizes = docs.select(
        F.col("doc_id").alias("row"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    taken = mix(sizes).where("copies > 0").groupBy("row").agg(F.sort_array(F.collect_list("copies")).alias("__copies"))
    place = Window.partitionBy("doc_id").orderBy(*columns)
    repeated = (
        docs.join(taken.withColumnRenamed("row", "__row"), F.col("doc_id").eqNullSafe(F.col("__row")))
        .withColumn("__place", F.row_number().over(place))
        .withColumn("__times", F.get("__copies", F.col("__place") - 1))
        .where("__times > 0")
    )
    return repeated.withColumn("__i", F.explode(F.sequence(F.lit(1), "__times"))).select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
