"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix is its weight, bounded by ``most`` times its own size; what is above is
dealt out again by weight.  Over the training time 0..1 a source is drawn at a rate given by its
schedule, a piecewise linear density.  The integral of the schedule is the source's cumulative demand;
its inverse turns the cumulative words of the source's documents into training positions, and the
mix is the documents, range-sorted by position.

Documents of a source stand in keyed random order.  If the target is above the source's size, the
order is run through again.  A document is cut where the source's target is reached, so that every
source takes its target to the word.  Everything is a keyed hash: reruns agree.

Null text: size 0, nothing taken.  Null source: a source of its own, last in order.  Repeated rows
are documents of their own.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.store import checked, keep, typed
from facsimile.llm.words import count_words
from facsimile.operators.ordered import running

# A source's documents are summed up in this many buckets of the keyed order, so that a source with a
# third of all rows is spread over many tasks.
BUCKET_BITS = 12
#: Schedules dealt to the sources in turn: the density of draws at the start and at the end.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def documents_with_size(docs: DataFrame) -> DataFrame:
    rows = typed(docs, doc_id="long", source="string", text="binary")
    return rows.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("print"),
                       count_words("text").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, target, rate0 and rate1 (its schedule).

    Water filling: with the sources in the order of most * size / weight, those before a point are
    full and the rest share what is left by weight; the first point at which the next source stays
    below its bound is the answer.  The sums are running sums in buckets over the table of sources."""
    per_source = keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                      .withColumns({"no_name": F.col("source").isNull().cast("int"), "name": F.coalesce("source", F.lit(""))}), "mix-sources")
    turn = (F.col("turn") - 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1)
    pick = F.pmod(turn, F.lit(len(SCHEDULES))) + 1
    rates = [F.element_at(F.array(*[F.lit(s[k]) for s in SCHEDULES]), pick) for k in (0, 1)]
    bound = F.col("source_size") * F.lit(float(most))
    weighted = keep(running(per_source, ["no_name", "name"], row_number="turn")
                    .select("*", weight.alias("weight"), rates[0].alias("rate0"), rates[1].alias("rate1"))
                    .withColumns({"bound": bound, "full_at": bound / F.col("weight")}), "mix-weights")
    size, weight_sum = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size) * F.lit(float(share)) - (F.col("bounds") - F.col("bound"))) \
        / (F.lit(weight_sum) - (F.col("weights") - F.col("weight")))
    levels = running(weighted, ["full_at", "no_name", "name"], sums={"bounds": "bound", "weights": "weight"}, row_number="place") \
        .withColumn("level", level)
    settled = levels.where(F.col("level") * F.col("weight") < F.col("bound")).agg(F.min(F.struct("place", "level"))["level"]).first()[0]
    target = F.col("bound") if settled is None else F.least(F.col("bound"), F.lit(settled) * F.col("weight"))
    return weighted.select("source", "source_size", target.cast("double").alias("target"), "rate0", "rate1")


def running_words(sizes: DataFrame) -> DataFrame:
    """Adds ``ahead``: the words of the documents that stand before a row in its source's keyed
    order.  Buckets of the order are summed first; a document then adds what precedes its bucket."""
    keyed = sizes.withColumn("key", F.xxhash64(F.lit("mix"), "print", "doc_id")) \
        .withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKET_BITS).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bucket_ahead = (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("bucket_ahead")
    ahead = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), bucket_ahead)
    order = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("key", 0), "doc_id", "size")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return keyed.withColumn("inside", inside) \
        .join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))) \
        .withColumn("ahead", F.col("bucket_ahead") + F.col("inside")).drop("s", "b", "bucket_ahead", "inside")


def training_time(words: Column, target: Column, rate0: Column, rate1: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``words``: the inverse of the integral
    of its schedule, which runs linearly from ``rate0`` to ``rate1``."""
    part = words / target
    bend = (rate1 - rate0) / 2
    mean = (rate0 + rate1) / 2
    root = F.sqrt(F.greatest(rate0 * rate0 + 4 * bend * mean * part, F.lit(0.0)))
    return F.when(bend == 0, part).otherwise((root - rate0) / (2 * bend))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, source, print (hash of the row),
    size (words), source_size, target, taken (words taken, repeats counted) and times, the training
    times of its uses in order, with the words used at each: array<struct<time, words>>.  Range-sorted
    by the first use; documents that are not used come last."""
    sizes = keep(documents_with_size(docs), "mix-sizes")
    goals = targets(sizes, weights, share, most).select(
        F.col("source").alias("goal_source"), "source_size", "target", "rate0", "rate1")
    placed = running_words(sizes).join(checked(goals), F.col("source").eqNullSafe(F.col("goal_source")))
    goal = F.floor("target")
    uses = []
    for turn in range(int(-(-most // 1))):
        at = F.col("ahead") + F.col("source_size") * turn
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).cast("long")
        time = training_time(at.cast("double"), F.col("target"), F.col("rate0"), F.col("rate1"))
        uses.append(F.when(words > 0, F.struct(time.alias("time"), words.alias("words"))))
    taken = F.aggregate("times", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    mixed = placed.withColumn("times", F.array_compact(F.array(*uses))).withColumn("taken", taken) \
        .select("doc_id", "source", "print", "size", "source_size", "target", "taken", "times")
    first = F.when(F.col("taken") > 0, F.get("times", F.lit(0))["time"]).asc_nulls_last()
    return mixed.sort(first, "print", "doc_id")


def mixed(docs: DataFrame, **mixing) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix uses them, in training order.
    A use that is cut counts as whole if at least half of the document is due, else it is left out."""
    plan = mix(docs, **mixing).where("taken > 0").select(
        F.col("doc_id").alias("use_id"), "print", F.filter("times", lambda u: 2 * u["words"] >= F.col("size")).alias("times"))
    # rows that repeat a document have one print: each takes the uses of the first of them
    order = Window.partitionBy("use_id", "print").orderBy(F.col("times")[0]["time"])
    uses = keep(plan.where(F.size("times") > 0).withColumn("turn", F.row_number().over(order)), "uses")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string").cast("binary")).alias("row_print"))
    met = rows.join(checked(uses.where("turn = 1").drop("turn")), F.col("use_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("row_print")))
    return met.select("row", F.explode("times").alias("use")).sort("use.time", F.xxhash64("row")).select("row.*")
