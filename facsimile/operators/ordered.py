"""Ordered computations that never sort a whole table, or a whole hot group, in one task.

``running`` is the one primitive: rows are range-split on (group, order) by bounds drawn from
a keyed sample; each bucket is scanned by its own window; what precedes a bucket is added from
a table with one row per bucket.  The split is a pure function of the row, so a recomputed task
gets the same rows, and a group that holds a third of the table is simply cut into many buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions import keyed
from facsimile.operators import scale

MAX_BUCKETS = 16_384
SAMPLE_PER_BUCKET = 32
SAMPLE_CAP = 400_000


def _bounds(df: DataFrame, cols: list[str], n: int, buckets: int) -> list[tuple]:
    """Sorted split points from a keyed (repeatable) sample of the distinct order keys."""
    want = min(buckets * SAMPLE_PER_BUCKET, SAMPLE_CAP)
    keys = df.select(*cols)
    if n > want:
        mod = 1 << 40
        share = max(1, int(mod * want / n))
        keys = keys.filter(F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit("bounds")),
                                  F.lit(mod)) < F.lit(share))
    rows = [tuple(r) for r in keys.distinct().orderBy(*cols).collect()]
    if not rows:
        return []
    picks = [rows[int(i * len(rows) / buckets)] for i in range(1, buckets)]
    return sorted_unique(picks)


def sorted_unique(picks: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for p in picks:
        if not out or out[-1] != p:
            out.append(p)
    return out


def _key_text(bound: tuple, cols: list[str], types: dict[str, str]) -> str:
    """A bound as SQL text: a struct constant of the key's own types."""
    parts = []
    for v, c in zip(bound, cols, strict=True):
        text = v.isoformat(sep=" ") if hasattr(v, "hour") else str(v)
        text = text.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"cast('{text}' as {types[c]}) as `{c}`")
    return f"struct({', '.join(parts)})"


def _bucket(df: DataFrame, cols: list[str], bounds: list[tuple]) -> Column:
    """Number of bounds <= the row's key: a coarse search, then a search inside one stretch."""
    types = dict(df.dtypes)
    key = F.struct(*[F.col(c) for c in cols])
    text = [_key_text(b, cols, types) for b in bounds]

    def below(arr: Column) -> Column:
        return F.size(F.filter(arr, lambda b: b <= key))

    if len(bounds) <= 48:
        return below(F.expr(f"array({', '.join(text)})"))
    step = math.ceil(math.sqrt(len(bounds)))
    stretches = [f"array({', '.join(text[i:i + step])})" for i in range(0, len(text), step)]
    coarse = below(F.expr(f"array({', '.join(text[::step])})"))
    fine = F.element_at(F.expr(f"array({', '.join(stretches)})"), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * F.lit(step) + below(fine))


def sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest group)."""
    groups = df.groupBy(*by).agg(F.count("*").alias("n"))
    return tuple(groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str] | None = None,
            maxes: dict[str, str] | None = None, by: Sequence[str] = (),
            row_number: str | None = None, rows: int | None = None,
            prior_maxes: dict[str, str] | None = None, largest: int | None = None) -> DataFrame:
    """Add running sums, running maxima and/or a row number over ``order`` within ``by``.

    ``(by, order)`` must identify a row and its columns must not be null.  ``sums`` and
    ``maxes`` map a new column to the source column; ``prior_maxes`` leave out the row itself
    (null on the first row of a group).  Groups that each fit into a bucket (``largest`` rows at most,
    counted if not known) are scanned whole: rows move once and are read once.
    """
    by, order = list(by), list(order)
    sums, maxes, prior = dict(sums or {}), dict(maxes or {}), dict(prior_maxes or {})
    if row_number:
        df = df.withColumn("__one", F.lit(1).cast("bigint"))
        sums[row_number] = "__one"
    per_bucket = scale.setting(df.sparkSession, "rowsPerBucket", scale.ROWS_PER_BUCKET)
    if by and (rows is None or largest is None and rows > per_bucket):
        rows, largest = sizes(df, by)
    n = df.count() if rows is None else rows
    buckets = min(max(1, math.ceil(n / per_bucket)), MAX_BUCKETS)
    whole = by and (buckets == 1 or largest <= per_bucket)
    bounds = _bounds(df, by + order, n, buckets) if buckets > 1 and not whole else []

    def window(parts: list, last: int = Window.currentRow) -> Window:
        return Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)

    if not bounds:
        # at most one bucket's worth of rows, in all or in each group
        w = window(by if by else [F.lit(0)])
        out = df
        for name, src in sums.items():
            out = out.withColumn(name, F.sum(src).over(w))
        for name, src in maxes.items():
            out = out.withColumn(name, F.max(src).over(w))
        for name, src in prior.items():
            out = out.withColumn(name, F.max(src).over(window(by if by else [F.lit(0)], -1)))
        return out.drop("__one")

    tagged = df.withColumn("__bucket", _bucket(df, by + order, bounds))
    carry = _carry(tagged, by, bounds, sums, {**maxes, **prior})
    w = window(["__bucket", *by])
    joined = tagged.join(F.broadcast(carry), "__bucket", "left")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = joined
    for name, src in sums.items():
        local = F.sum(src).over(w)
        out = out.withColumn(name, local + F.coalesce(F.when(same, F.col(f"__c_{name}")), F.lit(0)))
    for name, src in maxes.items():
        out = out.withColumn(name, F.greatest(F.max(src).over(w), F.when(same, F.col(f"__c_{name}"))))
    for name, src in prior.items():
        local = F.max(src).over(window(["__bucket", *by], -1))
        out = out.withColumn(name, F.greatest(local, F.when(same, F.col(f"__c_{name}"))))
    drop = ["__bucket", "__one", *[f"__by_{c}" for c in by],
            *[f"__c_{n}" for n in (*sums, *maxes, *prior)]]
    return out.drop(*drop)


def _carry(tagged: DataFrame, by: list[str], bounds: list[tuple], sums: dict, maxes: dict) -> DataFrame:
    """One row per bucket: the totals of that bucket's leading group over earlier buckets.

    Only a group that owns a bound can span buckets, so the aggregate is restricted to those
    groups and returns at most two rows per bucket.
    """
    spark = tagged.sparkSession
    aggs = [F.sum(s).alias(n) for n, s in sums.items()] + [F.max(s).alias(n) for n, s in maxes.items()]
    k = len(by)
    if by:
        owners = sorted_unique([b[:k] for b in bounds])
        schema = tagged.select(*by).schema
        own = spark.createDataFrame(owners, schema)
        part = tagged.join(F.broadcast(own), by, "left_semi").groupBy("__bucket", *by).agg(*aggs)
    else:
        part = tagged.groupBy("__bucket").agg(*aggs)
    names = [*sums, *maxes]
    per: dict[tuple, list] = {}
    for r in part.collect():
        d = r.asDict()
        per.setdefault(tuple(d[c] for c in by), []).append((d["__bucket"], d))
    for found in per.values():
        found.sort(key=lambda x: x[0])
    rows = []
    # buckets come in order, so each owner's totals are carried on from one bucket to the next
    state: dict[tuple, tuple[int, dict]] = {}
    for b in range(1, len(bounds) + 1):
        owner = bounds[b - 1][:k]
        found = per.get(owner, [])
        at, vals = state.get(owner, (0, dict.fromkeys(names)))
        while at < len(found) and found[at][0] < b:
            for nme, v in ((n, found[at][1][n]) for n in names):
                if v is not None:
                    old = vals[nme]
                    vals[nme] = v if old is None else old + v if nme in sums else max(old, v)
            at += 1
        state[owner] = (at, vals)
        if at:
            rows.append((b, *owner, *[vals[nme] for nme in names]))
    fields = ["__bucket int"]
    types = dict(part.dtypes)
    fields += [f"`__by_{c}` {types[c]}" for c in by]
    fields += [f"`__c_{n}` {types[n]}" for n in names]
    return spark.createDataFrame(rows, ", ".join(fields))


def dense_ids(df: DataFrame, order: Sequence[str], start: int = 1, name: str = "row_id",
              rows: int | None = None) -> DataFrame:
    """Gap-free ids in the order of a unique key."""
    out = running(df, order, row_number=name, rows=rows)
    return out.withColumn(name, (F.col(name) + F.lit(start - 1)).cast("bigint"))


def format_id(idx: Column | str, prefix: str, width: int) -> Column:
    c = (F.col(idx) if isinstance(idx, str) else idx).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0")))


# --- exact-size draws ------------------------------------------------------------------


#: How many standard deviations an even draw's rank may be off before its cutoff is looked for in histograms,
#: and the rows of all such ranges that the driver takes (they grow with the root of the table).
DEVIATIONS, IN_RANGES = 4, 100_000


def rank_cutoffs(df: DataFrame, u: str, key: str, ranks: Sequence[int], rows: int | None = None) -> list[tuple | None]:
    """For each rank r, the (u, key) of the r-th smallest row (None when r = 0 or r > rows)."""
    found = rank_cutoffs_of(df, {u: ranks}, key, rows)[u]
    return [found.get(r) if r > 0 else None for r in ranks]


def merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets that touch, as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cutoffs_of_even_draws(df: DataFrame, ranks: Mapping[str, Sequence[int]], key: str, rows: int) -> dict[str, dict[int, tuple]]:
    """Cutoffs found in one pass, as ``rows`` even draws in [0, 1) have them: the r-th one lies about r / rows.

    Rows in such ranges are listed, all others counted between them, so ranks are exact; a rank that does
    not lie in its range, as when draws are not even, is left out.
    """
    ranges = {}
    for u, rs in ranks.items():
        off = {r: DEVIATIONS * math.sqrt(r + 1) + 1 for r in rs if 0 < r <= rows}
        ranges[u] = merged([((r - d) / rows, (r + d) / rows) for r, d in off.items()])
    if sum((hi - lo) * rows for rs in ranges.values() for lo, hi in rs) > IN_RANGES:
        return {u: {} for u in ranks}
    cells = []
    for i, (u, found) in enumerate(ranges.items()):
        c, place, inside = F.col(u), None, F.lit(False)
        for j, (lo, hi) in enumerate(found):  # places 0, 2, 4 lie between the ranges 1, 3, 5
            for b, edge in ((2 * j, lo), (2 * j + 1, hi)):
                place = F.when(c < edge, F.lit(b)) if place is None else place.when(c < edge, F.lit(b))
            inside = inside | (c >= lo) & (c < hi)
        if place is not None:
            cells.append(F.when((c >= 0) & (c < 1), F.struct(
                F.lit(i).alias("i"), place.otherwise(F.lit(2 * len(found))).alias("b"),
                F.when(inside, c).alias("u"), F.when(inside, F.col(key)).alias("k"))))
    if not cells:
        return {u: {} for u in ranks}
    met = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.b", "c.u", "c.k").agg(F.count("*").alias("n"))
    listed = met.limit(2 * IN_RANGES + 1).collect()
    if len(listed) > 2 * IN_RANGES:
        return {u: {} for u in ranks}
    out: dict[str, dict[int, tuple]] = {}
    for i, u in enumerate(ranges):
        wanted, run = sorted({r for r in ranks[u] if r > 0}), 0
        out[u] = {}
        for r in sorted((r for r in listed if r["i"] == i), key=lambda r: (r["b"], r["u"] or 0.0, r["k"] is not None, r["k"])):
            if r["b"] % 2:
                out[u].update({w: (r["u"], r["k"]) for w in wanted if run < w <= run + r["n"]})
            run += r["n"]
    return out


def rank_cutoffs_of(df: DataFrame, ranks: Mapping[str, Sequence[int]], key: str,
                    rows: int | None = None) -> dict[str, dict[int, tuple | None]]:
    """``rank_cutoffs`` for several columns of draws at once.  If ``df`` is known to have so many ``rows``,
    cutoffs are first looked for where even draws have them.

    Works on histograms of the columns in [0, 1) that are refined around each rank until the interval
    is small enough to sort on the driver: no table-wide sort, no wide rows moved.  A level of refining
    is one pass for all columns together, and so is the last look at the small intervals.  Where many
    rows have one u (a repeated key), the interval can't shrink; those rows are numbered by key instead.
    """
    bins, small = 2048, 4096
    found: dict[str, dict[int, tuple | None]] = {u: {} for u in ranks}
    if rows:
        found = dict(_cutoffs_of_even_draws(df, ranks, key, rows))
    active = [(u, 0.0, 1.0, 0, sorted({r for r in rs if r > 0 and r not in found[u]})) for u, rs in ranks.items()]
    if rows:  # beyond the last row there is nothing to look for
        active = [(u, lo, hi, base, [r for r in rs if r <= rows]) for u, lo, hi, base, rs in active]
    active = [a for a in active if a[4]]
    near: list[tuple] = []

    def bin_of(u: str, lo: float, width: float) -> Column:
        return F.least(F.floor((F.col(u) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")

    def inside(u: str, lo: float, hi: float) -> Column:
        return (F.col(u) >= lo) & (F.col(u) < hi)

    while active:
        cells = [F.when(inside(u, lo, hi), F.struct(F.lit(i).alias("i"), bin_of(u, lo, (hi - lo) / bins).alias("b")))
                 for i, (u, lo, hi, _, _) in enumerate(active)]
        hist: dict[int, dict[int, int]] = {}
        counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.b").agg(F.count("*").alias("n"))
        for r in counts.collect():  # at most 2048 rows an interval
            hist.setdefault(r["i"], {})[r["b"]] = r["n"]
        deeper = []
        for i, (u, lo, hi, base, wanted) in enumerate(active):
            width, run = (hi - lo) / bins, base
            for b in sorted(hist.get(i, {})):
                n = hist[i][b]
                hits = [r for r in wanted if run < r <= run + n]
                if hits and n <= small:
                    near.append((u, lo, hi, b, run, hits))
                elif hits and width > 1e-15:
                    deeper.append((u, lo + b * width, lo + (b + 1) * width, run, hits))
                elif hits:
                    rows = df.select(u, key).filter(inside(u, lo, hi) & (bin_of(u, lo, width) == b))
                    placed = running(rows, [u, key], row_number="__place").filter(F.col("__place").isin([r - run for r in hits]))
                    found[u].update({r["__place"] + run: (r[u], r[key]) for r in placed.collect()})
                run += n
        active = deeper
    if near:
        picks = [F.when(inside(u, lo, hi) & (bin_of(u, lo, (hi - lo) / bins) == b),
                        F.struct(F.lit(p).alias("p"), F.col(u).alias("u"), F.col(key).alias("k")))
                 for p, (u, lo, hi, b, _, _) in enumerate(near)]
        rows: dict[int, list] = {}
        for r in df.select(F.explode(F.array_compact(F.array(*picks))).alias("c")).select("c.*").collect():
            rows.setdefault(r["p"], []).append((r["u"], r["k"]))
        for p, (u, _, _, _, run, hits) in enumerate(near):
            ordered = sorted(rows[p])
            found[u].update({r: ordered[r - run - 1] for r in hits})
    return found


def within(u: Column | str, key: Column | str, cutoff: tuple | None, default: bool) -> Column:
    """(u, key) <= cutoff."""
    if cutoff is None:
        return F.lit(default)
    u, key = (F.col(c) if isinstance(c, str) else c for c in (u, key))
    cu, ck = cutoff
    return (u < F.lit(cu)) | ((u == F.lit(cu)) & (key <= F.lit(ck)))


def rank_band(df: DataFrame, u: Column, key: str, edges: Sequence[int], rows: int | None = None) -> Column:
    """Index (1-based) of the rank band a row of ``df`` falls in, 0 beyond the last edge.

    ``edges`` are cumulative sizes: [3, 5] puts ranks 1-3 in band 1 and 4-5 in band 2.  Ranks follow
    (u, key); the result is an expression, so nothing is joined or sorted.
    """
    return rank_bands(df, {"u": (u, edges)}, key, rows)["u"]


def rank_bands(df: DataFrame, draws: Mapping[str, tuple[Column, Sequence[int]]], key: str, rows: int | None = None) -> dict[str, Column]:
    """``rank_band`` for several draws, looked for in the same passes over ``df`` (of so many ``rows``, if known)."""
    if not draws:
        return {}
    names = {n: f"__u{i}" for i, n in enumerate(draws)}
    looked = df.select(*[draws[n][0].alias(c) for n, c in names.items()], F.col(key).alias("__k"))
    found = rank_cutoffs_of(looked, {names[n]: edges for n, (_, edges) in draws.items()}, "__k", rows)
    out = {}
    for n, (u, edges) in draws.items():
        band = None
        for i, edge in enumerate(edges, start=1):
            hit = within(u, key, found[names[n]].get(edge) if edge > 0 else None, default=edge > 0)
            band = F.when(hit, F.lit(i)) if band is None else band.when(hit, F.lit(i))
        out[n] = band.otherwise(F.lit(0)) if band is not None else F.lit(0)
    return out


def sample_exact(df: DataFrame, n: int, u: Column, key: str) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the n smallest (u, key)."""
    if n <= 0:
        return df.limit(0)
    tagged = df.withColumn("__u", u)
    (cutoff,) = rank_cutoffs(tagged, "__u", key, [n])
    return tagged.filter(within("__u", key, cutoff, default=True)).drop("__u")


# --- value-level ranks --------------------------------------------------------------------


def hot_values(counts: DataFrame, col: str, n_col: str, rows: int) -> list[tuple]:
    """Values that hold at least a thousandth of all rows (so at most a thousand values), and their shares."""
    floor = max(rows / 1000.0, 1.0)
    return [(r[0], r[1] / rows) for r in counts.filter(F.col(n_col) >= F.lit(floor)).select(col, n_col).limit(1000).collect()]


def with_ranks(df: DataFrame, col: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """Attach the average rank of ``col`` to every row; null stays null.

    ``base`` is where the values come from when ``df`` already carries other joins, so that
    ranking one column does not repeat the joins of the columns before it.
    """
    dim, distinct, _, hot = rank_table(df if base is None else base, col, out)
    return scale.lookup(df, dim, col, "left", hot, distinct)


def rank_table(df: DataFrame, col: str, out: str) -> tuple[DataFrame, int, int, Callable[[], list]]:
    """(value -> average rank, distinct values, non-null rows, function listing the hot values)."""
    counts = df.select(col).filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("cnt"))
    distinct, rows = counts.agg(F.count("*"), F.coalesce(F.sum("cnt"), F.lit(0))).first()
    run = running(counts, [col], sums={"cum": "cnt"}, rows=distinct)
    dim = run.select(col, (F.col("cum") - (F.col("cnt") - F.lit(1)) / F.lit(2.0)).alias(out))
    return dim, distinct, rows, lambda: hot_values(counts, col, "cnt", rows)


def ranks_of_all(df: DataFrame, domains: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Average ranks of many expressions at once: one row per row of ``df`` that has any value, with a
    column per name (null where the expression is), and how many values each one has.

    All values stand in one tall table, are counted and ranked by one grouped running sum, meet their
    rows in one join and come back by one regrouping on the row's place: no job or join per expression."""
    names = list(domains)
    rows = scale.cut(df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(domains.values())])
                     .withColumn("place", F.monotonically_increasing_id()))
    entries = F.array_compact(F.array(*[F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(i).alias("d"), (F.col(f"v{i}") + 0.0).alias("v")))
                                        for i, _ in enumerate(names)]))
    tall = rows.select("place", F.explode(entries).alias("e")).select("place", "e.*")
    key = F.concat_ws(":", "d", "v")
    counts = scale.cut(tall.groupBy("d", "v").agg(F.count("*").alias("n")))
    totals = {names[r["d"]]: r["t"] for r in counts.groupBy("d").agg(F.sum("n").alias("t")).collect()}
    every = max(sum(totals.values()), 1)
    run = running(counts, ["v"], sums={"upto": "n"}, by=["d"])
    table = run.select(key.alias("k"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))
    met = scale.lookup(tall.withColumn("k", key), table, "k", "left",
                       lambda: hot_values(counts.select(key.alias("k"), "n"), "k", "n", every))
    back = met.groupBy("place").agg(*[F.max(F.when(F.col("d") == i, F.col("rank"))).alias(name) for i, name in enumerate(names)])
    return back.drop("place"), {name: totals.get(name, 0) for name in names}


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], exact_rows: int = 5_000_000,
                    weight: str | None = None) -> list[float | None]:
    """Linear-interpolated quantiles; ``weight`` counts a row that many times.

    Small inputs use the built-in exact ``percentile``; beyond ``exact_rows`` distinct values are
    counted and ranked (``running``) and only the needed order statistics reach the driver, so no
    aggregation buffer has to hold the whole column.
    """
    limit = scale.setting(df.sparkSession, "exactPercentileRows", exact_rows)
    w = F.col(weight) if weight else F.lit(1)
    vals = df.select(F.col(col).cast("double").alias("v"), w.cast("bigint").alias("w")).filter("v is not null")
    rows, n = vals.agg(F.count("*"), F.sum("w")).first()
    if not n:
        return [None] * len(qs)
    if rows <= limit:
        return list(vals.agg(F.percentile("v", keyed.literal_array([float(q) for q in qs]), F.col("w"))).first()[0])
    need: set[int] = set()
    for q in qs:
        h = q * (n - 1)
        need |= {math.floor(h), math.ceil(h)}
    ranks = running(vals.groupBy("v").agg(F.sum("w").alias("cnt")), ["v"], sums={"cum": "cnt"})
    arr = keyed.literal_array(sorted(need)).cast("array<bigint>")
    hit = F.filter(arr, lambda p: (p >= F.col("cum") - F.col("cnt")) & (p < F.col("cum")))
    stat = {r["p"]: r["v"] for r in ranks.select("v", F.explode(hit).alias("p")).collect()}
    out = []
    for q in qs:
        h = q * (n - 1)
        a, b = stat[math.floor(h)], stat[math.ceil(h)]
        out.append(a + (b - a) * (h - math.floor(h)))
    return out
