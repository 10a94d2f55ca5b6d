"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share the budget by weight; a target stops at `max_epochs` times its source's size and the excess goes to
the others by weight until none is above. A target is the source's size times a rate; whole copies up to the rate are
certain, and the remaining share of the words is drawn: each document gets an inclusion probability (longer documents a
higher one), the odds of a uniform number are divided by the odds of that probability, and documents are taken in this
order until the target is reached. The number of words is thus fixed, up to the one document at the edge, which counts if
that comes nearer to the target.

The edge of each source is found without sorting documents: three counting passes over at most 4,096 buckets per source
narrow the order down to one of 2^36 places, and a document's copies follow from its own row and its source's edge. So
neither a source nor the documents meet in one task. The number of a document comes from a hash of its id and text, so
reruns agree.

Null text: size 0. Null sources are a source of their own, ordered last. Documents of size 0 are taken with the certain
copies only. Repeated rows (same id and text) share their number and are taken or left together; rows without an id
differ by their text. Other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .names import fresh

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
BITS = 12
LEVELS = 3
SEED = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """One row per source: source, source_size, n_docs, target. `sizes` has source and size.

    Let a source of size W and weight w be full at c = max_epochs W / w. In the order of c the first sources are full;
    the others share what is left by weight. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    full = F.lit(float(max_epochs)) * F.col("source_size")
    by_room = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    levels = (
        weighed.withColumn("full", full)
        .withColumn("left", F.lit(float(budget)) * total - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("level", F.greatest(F.col("left"), F.lit(0.0)) / F.sum("weight").over(rest))
        # The level holds from the first source that it does not fill.
        .withColumn("open", F.col("level") <= F.col("full") / F.col("weight"))
    )
    final = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), "source", "level"))).over(
        Window.partitionBy()
    )
    target = F.least(F.col("full"), F.coalesce(final["level"] * F.col("weight"), F.col("full")))
    return levels.select("source", "source_size", "n_docs", target.alias("target"))


def _share() -> Column:
    """The share of the words of a source that is drawn, beyond certain copies."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rate - F.floor(rate)


def _place(size: Column, number: Column) -> Column:
    """Place in the order of sampling as an integer below 2^36; small places are taken first.

    Inclusion rises with the size, to at most twice the share. Odds of the uniform number over odds of inclusion, brought
    to the unit interval.
    """
    uniform = (F.shiftrightunsigned(number, 11) + F.lit(0.5)) / F.lit(float(2**53))
    mean = F.col("source_size") / F.col("n_docs")
    inclusion = F.least(F.col("share") * 2 * size / (size + mean), F.lit(1 - 1e-9))
    ratio = uniform / (1 - uniform) * (1 - inclusion) / inclusion
    top = F.lit(float(2 ** (BITS * LEVELS) - 1))
    return F.when(inclusion > 0, F.floor(ratio / (1 + ratio) * top)).otherwise(top).cast("bigint")


def _edges(placed: DataFrame) -> DataFrame:
    """Per source with something to draw: the place of the edge and whether documents at that place are taken.

    `placed` has source, size, place and need, the words to draw.
    """
    rows = placed.filter(F.col("need") > 0).withColumn("before", F.lit(0).cast("bigint"))
    found = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if found is not None:
            inside = found.select(F.col("source").alias("s"), F.col("prefix"), F.col("before").alias("b"))
            rows = (
                placed.join(inside, F.col("source").eqNullSafe(F.col("s")))
                .filter(F.shiftright("place", shift + BITS) == F.col("prefix"))
                .select(*placed.columns, F.col("b").alias("before"))
            )
        tally = rows.groupBy("source", F.shiftright("place", shift).alias("prefix")).agg(
            F.sum("size").alias("words"), F.min("need").alias("need"), F.min("before").alias("base")
        )
        upto = Window.partitionBy("source").orderBy("prefix")
        passed = tally.withColumn("after", F.col("base") + F.sum("words").over(upto)).filter("after >= need")
        first = F.row_number().over(upto)
        found = stored(
            passed.withColumn("first", first)
            .filter("first = 1")
            .select("source", "prefix", (F.col("after") - F.col("words")).alias("before"), "after", "need"),
            "edges",
        )
    nearer = (F.col("after") - F.col("need")) < (F.col("need") - F.col("before"))
    return found.select("source", F.col("prefix").alias("edge"), nearer.alias("edge_taken"))


def _number(key: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), key, F.coalesce(F.xxhash64(text), F.lit(0)))


def plan_mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
) -> tuple[DataFrame, DataFrame]:
    """The sized documents (id, source, size, number) and the plan, one row per source; both are written tables."""
    sized = stored(
        docs.select(
            F.col(key).alias("id"),
            F.col(source).alias("source"),
            n_words(F.col(text)).alias("size"),
            _number(F.col(key), F.col(text)).alias("number"),
        ),
        "sized",
    )
    return sized, mix_of(sized, weights, budget, max_epochs)


def mix_of(sized: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    targets = stored(source_targets(sized, weights, budget, max_epochs).withColumn("share", _share()), "targets")
    renamed = targets.withColumnRenamed("source", "s")
    joined = sized.join(renamed, F.col("source").eqNullSafe(F.col("s")))
    placed = stored(
        joined.select(
            "source",
            "size",
            _place(F.col("size"), F.col("number")).alias("place"),
            (F.col("share") * F.col("source_size")).alias("need"),
        ).filter((F.col("need") > 0) & (F.col("size") > 0)),
        "placed",
    )
    edges = _edges(placed).withColumnRenamed("source", "s")
    plan = targets.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return stored(plan, "mix")


def copies(size: Column, number: Column) -> Column:
    """Copies that the mix takes of a row joined to its source's line of the plan."""
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    place = _place(size, number)
    drawn = (F.col("edge").isNotNull() & (size > 0)) & (
        (place < F.col("edge")) | ((place == F.col("edge")) & F.col("edge_taken"))
    )
    return (certain + F.when(drawn, 1).otherwise(0)).cast("bigint")


def mixed_sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: id, size, source_size, target of its source, and the words taken, repeats counted."""
    sized, plan = plan_mix(docs, key, source, text)
    joined = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(
        F.col("id").alias(key),
        "size",
        "source_size",
        "target",
        (copies(F.col("size"), F.col("number")) * F.col("size")).alias("taken"),
        "source",
    )


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` with every row as often as the mix takes it."""
    size, number, line, name = fresh(docs, "mix_size", "mix_number", "mix_plan", "mix_source")
    # Written, so that the words of a text are counted once, however often the expressions below name their number.
    marked = stored(docs.withColumns({size: n_words(F.col(text)), number: _number(F.col(key), F.col(text))}), "marked")
    sized = marked.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(number).alias("number"))
    plan = mix_of(sized, WEIGHTS, BUDGET, MAX_EPOCHS)
    kept = plan.select(F.struct(*plan.columns).alias(line)).withColumn(name, F.col(line)["source"])
    joined = marked.join(kept, F.col(source).eqNullSafe(F.col(name)))
    # The expressions of the plan name its columns, which may clash with those of the caller: rows travel as structs.
    row = joined.select(
        F.struct(*docs.columns).alias("row"),
        F.col(size).alias("size"),
        F.col(number).alias("number"),
        F.col(line).alias("plan"),
    ).select("row", "size", "number", "plan.*")
    taken = row.withColumn("n_copies", copies(F.col("size"), F.col("number"))).filter("n_copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row.*")
