"""Draws over tables: weighted domains of any size, calendars, fan-out, foreign keys, holdouts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.operators import ordered, scale

# Calendar weights. Monday first; then month end (day >= 25) and last quarter.
WEEKDAY_WEIGHTS = (1.1, 1.15, 1.2, 1.15, 1.3, 0.6, 0.5)
MONTH_END_BOOST = 1.3
LAST_QUARTER_BOOST = 1.15
WEIGHT_UNIT = 100_000


@dataclass(frozen=True)
class Spans:
    """A weighted domain laid out on a line: each row owns [lo, hi) of [0, total)."""

    table: DataFrame
    total: int
    size: int

    def hot(self, value: str) -> list:
        """Values that own at least a thousandth of the line."""
        big = self.table.filter((F.col("hi") - F.col("lo")) * 1000 >= self.total)
        return [r[0] for r in big.select(value).limit(1000).collect()]


def spans(domain: DataFrame, weight: str, order: Sequence[str]) -> Spans:
    size, total = domain.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    run = ordered.running(domain, order, sums={"hi": weight}, rows=size)
    return Spans(run.withColumn("lo", F.col("hi") - F.col(weight)), int(total), size)


def draw_from_spans(rows: DataFrame, u: Column, line: Spans, keep: Sequence[str]) -> DataFrame:
    """Inverse-CDF draw as an equi-join on a coarse cell of the line.

    A heavy value covers many cells, so its rows spread over many join keys; a cell overlaps only
    a few values.  The table is broadcast only when it is proven small.
    """
    size, total, table = max(1, line.size), line.total, line.table
    shift = max(0, total.bit_length() - max(1, (size * 2).bit_length()))
    cells = F.sequence(F.shiftright(F.col("lo"), shift), F.shiftright(F.col("hi") - 1, shift))
    dim = table.filter(F.col("hi") > F.col("lo")).select(
        F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), *keep, F.explode(cells).alias("__cell"))
    limit = scale.setting(rows.sparkSession, "boundedRows", scale.BOUNDED_ROWS)
    if size <= limit // 4:  # at most 4 cells per row on average
        dim = F.broadcast(dim)
    spot = F.floor(u * F.lit(float(total))).cast("bigint")
    left = rows.withColumn("__spot", spot).withColumn("__cell", F.shiftright(F.col("__spot"), shift))
    hit = (F.col("__spot") >= F.col("__lo")) & (F.col("__spot") < F.col("__hi"))
    return left.join(dim, "__cell").filter(hit).drop("__spot", "__cell", "__lo", "__hi")


def zipf_domain(items: DataFrame, rank: str, s: float) -> DataFrame:
    """Integer weights proportional to 1/rank^s."""
    w = F.greatest(F.rint(F.lit(float(2**32)) / F.pow(F.col(rank).cast("double"), F.lit(float(s)))), F.lit(1.0))
    return items.withColumn("weight", w.cast("bigint"))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def day_weight(day: Column, weekday: Sequence[float] = WEEKDAY_WEIGHTS, seasonality: str | None = "retail") -> Column:
    """Integer weight of a calendar day."""
    base = F.element_at(keyed.literal_array([round(w * WEIGHT_UNIT) for w in weekday]), F.weekday(day) + 1)
    w = base.cast("double")
    if seasonality in ("retail", "financial"):
        w = w * F.when(F.dayofmonth(day) >= 25, F.lit(MONTH_END_BOOST)).otherwise(F.lit(1.0))
    if seasonality == "retail":
        w = w * F.when(F.month(day) >= 10, F.lit(LAST_QUARTER_BOOST)).otherwise(F.lit(1.0))
    return F.rint(w).cast("bigint")


def weighted_dates(rows: DataFrame, u: Column, start: str, end: str, out: str = "day",
                   weekday: Sequence[float] = WEEKDAY_WEIGHTS, seasonality: str | None = "retail") -> DataFrame:
    cal = calendar(rows.sparkSession, start, max(start, end)).withColumnRenamed("day", out)
    cal = cal.withColumn("weight", day_weight(F.col(out), weekday, seasonality))
    return draw_from_spans(rows, u, spans(cal, "weight", [out]), [out])


def fan_out(parent: DataFrame, count: Column, seq: str = "seq") -> DataFrame:
    """Repeat each row ``count`` times; a zero count gives no rows."""
    return (parent.withColumn("__n", count).filter(F.col("__n") > 0)
            .withColumn(seq, F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n"))


def fk_sample(child: DataFrame, u: Column, parent: DataFrame, pk: str, out: str) -> DataFrame:
    """Uniform draw of a parent key per child row."""
    n = parent.count()
    if n == 0:
        return child.withColumn(out, F.lit(None))
    ids = ordered.dense_ids(parent.select(F.col(pk).alias(out)), [out], name="__pid", rows=n)
    left = child.withColumn("__pid", keyed.uniform_int(u, 1, n + 1))
    return scale.lookup(left, ids, "__pid", "inner", size=n).drop("__pid")


def split_holdout(df: DataFrame, u: Column, key: str | None = None, frac: float = 0.2,
                  min_rows: int = 20, exact: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(train, holdout); below ``min_rows`` there is no holdout.

    ``exact`` holds out floor(frac * rows) rows with the smallest (u, key); otherwise each row is
    held out when u < frac, which needs no pass over the data beyond the row count.
    """
    n = df.count()
    if n < min_rows:
        return df, None
    tagged = df.withColumn("__u", u)
    if exact:
        (c,) = ordered.rank_cutoffs(tagged, "__u", key, [int(n * frac)], n)
        held = ordered.within("__u", key, c, default=False)
    else:
        held = F.col("__u") < frac
    return tagged.filter(~held).drop("__u"), tagged.filter(held).drop("__u")


# Our own word lists for vocabularies.
FIRST_WORDS = ["Amber", "Bright", "Cedar", "Delta", "Ember", "Frost", "Golden", "Harbor", "Ivory", "Jade",
               "Kite", "Lunar", "Maple", "North", "Ocean", "Prime", "Quartz", "River", "Silver", "Timber"]
SECOND_WORDS = ["Anchor", "Basket", "Compass", "Drift", "Engine", "Field", "Garden", "House", "Island", "Journey",
                "Kettle", "Lantern", "Mirror", "Needle", "Orchard", "Pocket", "Quilt", "Ribbon", "Saddle", "Tower"]


def vocab_bank(spark: SparkSession, semantic: str, size: int = 200, seed: int = 0,
               first: Sequence[str] = FIRST_WORDS, second: Sequence[str] = SECOND_WORDS) -> DataFrame:
    """``size`` distinct values of a semantic, in a seeded order: (word_no, word)."""
    import math
    a, b = list(dict.fromkeys(first)), list(dict.fromkeys(second))
    rounds = max(1, math.ceil(size / (len(a) * len(b))))
    base = spark.range(len(a) * len(b) * rounds)
    pair, rnd = F.col("id") % (len(a) * len(b)), F.floor(F.col("id") / (len(a) * len(b)))
    w1 = F.element_at(keyed.literal_array(a), (F.floor(pair / len(b)) + 1).cast("int"))
    w2 = F.element_at(keyed.literal_array(b), (pair % len(b) + 1).cast("int"))
    tail = F.when(rnd == 0, F.lit("")).otherwise(F.concat(F.lit(" "), (rnd + 1).cast("string")))
    two = F.concat(w1, F.lit(" "), w2, tail)
    forms = {
        "company": F.concat(two, F.lit(" Co.")),
        "address": F.concat((F.col("id") % 900 + 1).cast("string"), F.lit(" "), two, F.lit(" Street")),
        "email": F.concat(F.lit("user"), F.lpad((F.col("id") + 1).cast("string"), 5, "0"), F.lit("@example.com")),
        "phone": F.concat(F.lit("+00-000-"), F.lpad((F.col("id") + 1).cast("string"), 7, "0")),
        "city": F.concat(w1, F.lower(w2), tail),
    }
    words = base.select(forms.get(semantic, two).alias("word"))
    words = words.withColumn("__u", keyed.uniform(seed, "vocab", semantic, key="word"))
    picked = ordered.sample_exact(words, size, F.col("__u"), "word")
    picked = picked.withColumn("__u", keyed.uniform(seed, "vocab", semantic, key="word"))
    return ordered.running(picked, ["__u", "word"], row_number="word_no").select("word_no", "word")


def parse_day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
