"""Near duplicates by a signature-coordinate inverted join.

Every text's set of word shingles gets a MinHash signature.  Documents with equal sets are one class
from the start.  The classes are posted under each (coordinate, value) of their signatures; a value
that only one class has is dropped, and so is a class that has too few shared values to reach the
match threshold with anyone.  With the rest ordered from rare to common, two classes that agree in at
least ``matches`` coordinates share one of their rarest (coordinates - matches + 1), so that only these
prefixes are joined and the common values are skipped.  Pairs that agree in enough coordinates are
confirmed on their full sets.

Of the pairs that meet, the collisions over all coordinates are counted, and those with at least
``matches`` are retained.  A second signature of 512 single-byte coordinates tells more sharply which
of them are worth comparing in full.

Pairs inside a connected group need no further look.  A posting is therefore first joined as a star
(each member with one member of another component, the number of rows staying that of the posting);
a document tries its best candidate, components are formed, and this is repeated.  Then the members of
different components under one value are compared, large postings in blocks.  The full sets come along,
so that a pair that agrees is confirmed where it meets, and a block gives only links that tie two of its
components together, a spanning forest at most.  So no link between components is lost, one pass is
enough, and rows grow with the members, not with their pairs, whether these are links or near misses.

The two thresholds follow from ``percent``: the largest whose exact binomial tails stay within 8 and 3
in a million.  At 75 percent these are 53 of 96 and 339 of 512 with tails of 7.6e-6 and 2.7e-6, so that
a pair just at the limit is missed about ten times in a million.

Texts without words, and rows without an id, have no links.  Rows that repeat a document belong to its
class.  If one id has several texts, the one with the least set hash stands for it in comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.graph import components
from facsimile.llm.hot import lookup
from facsimile.llm.store import checked, keep, typed

COORDINATES, FINE_COORDINATES = 96, 512
# Tails at most: how often a pair just at the limit stays below the thresholds of the two signatures.
MISSED, FINE_MISSED = 8e-6, 3e-6
# Turns in which documents try star partners, before all that is left is compared.
STAR_TURNS = 2
# A posting is compared in blocks of this many members, or bytes of their sets; a task takes about so many rows or bytes of blocks.
BLOCK_MEMBERS = 1024
BLOCK_BYTES = 8 << 20
TASK_MEMBERS = 8192
TASK_BYTES = 32 << 20

_draw = np.random.default_rng(20240611)
_MULTIPLY = _draw.integers(1, 1 << 63, COORDINATES + FINE_COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, COORDINATES + FINE_COORDINATES, dtype=np.uint64)
_MIX = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def least_matches(n: int, p: float, missed: float) -> int:
    """The largest m such that a binomial (n, p) falls below m with a chance of at most ``missed``."""
    m, tail = 0, 0.0
    while m <= n and (tail := tail + math.comb(n, m) * p ** m * (1 - p) ** (n - m)) <= missed:
        m += 1
    return min(m, n)


def thresholds(percent: int) -> tuple[int, int]:
    """The matches of both signatures that a pair alike to ``percent`` needs; single bytes also agree by chance."""
    like = percent / 100
    matches = least_matches(COORDINATES, like, MISSED)
    if not 0 < percent <= 100 or matches < 1:
        raise ValueError(f"{COORDINATES} coordinates cannot find pairs alike to {percent} percent")
    return matches, least_matches(FINE_COORDINATES, like + (1 - like) / 256, FINE_MISSED)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased; a text with fewer
    words than ``width`` has one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k:len(words) - size + 1 + k] * _MIX[k % 64] + np.uint64(k))
    return np.unique(total)


def lowest(hashes: np.ndarray, functions: slice) -> np.ndarray:
    """The smallest value of each of some hash functions."""
    multiply, add = _MULTIPLY[functions], _ADD[functions]
    low = np.full(len(multiply), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(low, (hashes[k:k + 512, None] * multiply + add).min(axis=0), out=low)
    return low


def signature(hashes: np.ndarray) -> np.ndarray:
    return (lowest(hashes, slice(COORDINATES)) >> np.uint64(32)).astype(np.uint32)


def fine_signature(hashes: np.ndarray) -> np.ndarray:
    return (mixed(lowest(hashes, slice(COORDINATES, None))) >> np.uint64(56)).astype(np.uint8)


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (hash of the set) and signature of every row."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows.text:
                sets = shingle_hashes(text, width)
                name = xxhash.xxh128_intdigest(sets.tobytes())
                out.append((len(sets), (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63),
                            signature(sets).tobytes() if len(sets) else b""))
            made = pd.DataFrame(out, columns=["n_shingles", "h1", "h2", "signature"])
            yield made.assign(doc_id=rows.doc_id.astype("Int64").to_numpy())

    rows = typed(docs, doc_id="long", text="binary").withColumn("text", F.coalesce("text", F.lit(b"")))
    return keep(rows.mapInPandas(describe, "n_shingles long, h1 long, h2 long, signature binary, doc_id long"), "signatures")


def shared_postings(classes: DataFrame, matches: int) -> DataFrame:
    """The rare prefix of every class: (key, node, n), n being the number of classes under the key."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for rows in batches:
            for k in range(0, len(rows), 1024):
                some = rows.iloc[k:k + 1024]
                values = np.frombuffer(b"".join(some.signature), dtype=np.uint32).reshape(len(some), COORDINATES)
                yield pd.DataFrame({"key": (values.astype(np.int64) + place).ravel(),
                                    "node": np.repeat(some.node.to_numpy(), COORDINATES)})

    posted = classes.select("node", "signature").mapInPandas(post, "key long, node long")
    common = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(common, "key")
    own = Window.partitionBy("node")
    rare = F.row_number().over(own.orderBy("n", "key"))
    return shared.withColumns({"place": rare, "s": F.count("*").over(own)}) \
        .where((F.col("s") >= matches) & (F.col("place") <= F.col("s") - matches + 1)).select("key", "node", "n")


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal coordinates of signatures, row by row."""
    return (left == right).sum(axis=-1)


def agreeing(pairs: DataFrame, sets: DataFrame, matches: int, fine_matches: int) -> DataFrame:
    """``pairs(a, b)`` with at least ``matches`` collisions, and enough equal coordinates of the fine
    signatures, with their number."""

    def agree(left: pd.Series, right: pd.Series, coarse_left: pd.Series, coarse_right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype="int32")
        a, b, c, d = (np.frombuffer(b"".join(x), dtype=t).reshape(len(x), -1) for x, t in (
            (left, np.uint8), (right, np.uint8), (coarse_left, np.uint32), (coarse_right, np.uint32)))
        return pd.Series(np.where(collisions(c, d) >= matches, collisions(a, b), 0).astype("int32"))

    sides = [sets.select(F.col("node").alias(c), F.col("fine").alias(f"s{c}"), F.col("signature").alias(f"t{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").withColumn("agree", F.pandas_udf(agree, "int")("sa", "sb", "ta", "tb")) \
        .where(F.col("agree") >= fine_matches).select("a", "b", "agree")


def star_pairs(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Each member of a posting with the posting's first or last member of another component."""
    at = postings.select("key", "node").join(labels, "node")
    ends = at.groupBy("key").agg(F.min(F.struct("component", "node")).alias("lo"), F.max(F.struct("component", "node")).alias("hi")) \
        .where("lo.component <> hi.component")
    met = at.join(ends, "key")
    other = F.when(F.col("lo.component") != F.col("component"), F.col("lo.node")).otherwise(F.col("hi.node"))
    return met.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def forests(a: np.ndarray, b: np.ndarray, agree: np.ndarray, group: dict[int, int], most: int) -> tuple[list[int], bool]:
    """Which of the pairs, from the best on, join two trees of components in one of ``most`` forests, each
    pair being put into the first that it fits; and whether pairs are left that fit in none."""
    roots: list[dict[int, int]] = [{} for _ in range(most)]

    def root(own: dict[int, int], c: int) -> int:
        while (up := own.get(c, c)) != c:
            own[c] = own.get(up, up)
            c = up
        return c

    chosen, left = [], False
    for k in np.lexsort((b, a, -agree)).tolist():
        x, y = group[a[k]], group[b[k]]
        for own in roots:
            p, q = root(own, x), root(own, y)
            if p != q:
                own[max(p, q)] = min(p, q)
                chosen.append(k)
                break
        else:
            left = True
    return chosen, left


def remaining_links(postings: DataFrame, labels: DataFrame, sets: DataFrame, matches: int, fine_matches: int, percent: int) -> DataFrame:
    """Links ``a, b`` of different components that share a posting, collide in ``matches`` coordinates,
    agree in ``fine_matches`` of the fine ones and reach the similarity on their full sets: of a block
    those that make up a spanning forest of its components."""
    at = postings.join(labels, "node").join(sets.select("node", "size"), "node")
    open_keys = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(8 * F.col("size")).alias("bytes")) \
        .where("lo <> hi").select("key", "bytes")
    at = keep(at.join(open_keys, "key"), "open-postings")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "i", "j"])
        values = np.frombuffer(b"".join(rows.fine), dtype=np.uint8).reshape(len(rows), -1)
        coarse = np.frombuffer(b"".join(rows.signature), dtype=np.uint32).reshape(len(rows), -1)
        nodes, labelled, side, size = rows.node.to_numpy(), rows.component.to_numpy(), rows.own.to_numpy(), rows["size"].to_numpy()
        cell, full = rows[["key", "i", "j"]].to_numpy(), rows["set"].to_numpy()
        ends = [*(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        found: set[tuple[int, int]] = set()
        start = 0
        for end in ends:
            _, i, j = cell[start]
            first = np.flatnonzero(side[start:end] == i) + start
            second = np.flatnonzero(side[start:end] == j) + start
            group = labelled[start:end].copy()  # grows together as links are found
            numbers: list[np.ndarray] | None = None
            for x in first:
                others = second[(group[second - start] != group[x - start]) & ((i != j) | (nodes[second] > nodes[x]))]
                others = others[100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])]
                others = others[collisions(coarse[others], coarse[x]) >= matches]
                agree = collisions(values[others], values[x])
                others, agree = others[agree >= fine_matches], agree[agree >= fine_matches]
                if not len(others):
                    continue
                if numbers is None:  # the block's shingles by number
                    shingles, number = np.unique(np.frombuffer(b"".join(full[start:end]), dtype=np.uint64), return_inverse=True)
                    numbers = np.split(number, np.cumsum(size[start:end])[:-1])
                    mine = np.zeros(len(shingles), dtype=bool)
                mine[numbers[x - start]] = True
                same = np.array([np.count_nonzero(mine[numbers[y - start]]) for y in others])
                mine[numbers[x - start]] = False
                linked = 100 * same >= percent * (size[others] + size[x] - same)
                others, agree = others[linked], agree[linked]
                if len(others):
                    a, b = np.minimum(nodes[others], nodes[x]), np.maximum(nodes[others], nodes[x])
                    near = np.append(others, x) - start
                    chosen, _ = forests(a, b, agree, dict(zip(nodes[start:end][near].tolist(), group[near].tolist())), 1)
                    found.update(zip(a[chosen].tolist(), b[chosen].tolist()))
                    group[np.isin(group, group[near])] = group[x - start]
            start = end
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    dealt = at.withColumn("own", own).select("key", "node", "component", "own", "size", F.explode(cells).alias("cell")) \
        .select("key", "node", "component", "own", "size", "cell.*")
    members, total = dealt.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("size")), F.lit(0))).first()
    tasks = max(64, -(-members // TASK_MEMBERS), -(-total // TASK_BYTES))
    return dealt.join(sets.select("node", "set", "fine", "signature"), "node") \
        .withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)).cast("int")).repartition(tasks, "task") \
        .groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def best_each(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs that are among the ``most`` best of one of their ends."""
    ends = [pairs.select("a", "b", "agree", F.col(c).alias("node"), F.col(d).alias("other")) for c, d in ("ab", "ba")]
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("agree"), "other"))
    return ends[0].unionByName(ends[1]).withColumn("place", place).where(F.col("place") <= most).select("a", "b").distinct()


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, component)`` after the components that ``links(a, b)`` tie together are one.  Only
    the components' own graph is searched, and a component of very many nodes is looked up apart."""
    ends = [labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    sizes = labels.groupBy("component").agg(F.count("*").alias("members"))
    merged = keep(components(keep(between, "component-links")).toDF("component", "first").join(sizes, "component"), "merged")
    return lookup(labels, merged, "component", "members").select("node", F.coalesce("first", "component").alias("component"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose full sets reach the similarity."""

    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            same = len(a) + len(b) - len(np.union1d(a, b))
            out.append(100 * same >= percent * (len(a) + len(b) - same))
        return pd.Series(out, dtype="bool")

    sides = [sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"), F.col("size").alias(f"n{c}")) for c in "ab"]
    possible: Column = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(sides[0], "a").join(sides[1], "b").where(possible) \
        .where(F.pandas_udf(linked, "boolean")("sa", "sb")).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle sets of the documents ``wanted(node, h1, h2)``, kept, with both signatures: node, size, set, fine, signature."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 256):
                some = rows.iloc[k:k + 256]
                sets = [shingle_hashes(text, width) for text in some.text]
                names = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
                mine = [(n >> 64) - (1 << 63) == h1 and (n & ((1 << 64) - 1)) - (1 << 63) == h2
                        for n, h1, h2 in zip(names, some.h1, some.h2)]
                made = pd.DataFrame({"node": some.node, "size": [len(s) for s in sets], "set": [s.tobytes() for s in sets],
                                     "fine": [fine_signature(s).tobytes() for s in sets], "signature": [signature(s).tobytes() for s in sets]})
                yield made[mine]

    texts = typed(docs, doc_id="long", text="binary").toDF("node", "text").where("text is not null")
    return keep(texts.join(checked(wanted), "node").mapInPandas(describe, "node long, size long, set binary, fine binary, signature binary").dropDuplicates(["node"]), "full-sets")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, matches: int | None = None,
                    fine_matches: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (the smallest id
    reachable over links, its own included) and kept (true for that document)."""
    derived = thresholds(percent)
    matches, fine_matches = derived[0] if matches is None else matches, derived[1] if fine_matches is None else fine_matches
    rows = described(docs, width)
    spark = rows.sparkSession
    # rows without words or id have no name and meet nothing; texts with very many copies are looked up apart
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = rows.withColumn("name", F.when(known, F.struct("h1", "h2")))
    real = rows.where("name is not null")
    named = keep(real.groupBy("name").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "names")
    members = keep(lookup(rows.select("doc_id", "n_shingles", "h1", "h2", "name"), named, "name", "copies")
                   .select("doc_id", "n_shingles", "h1", "h2", "node"), "classes")
    heads = members.where("doc_id = node").groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("h")).select("node", "h.*")
    classes = keep(real.withColumnRenamed("doc_id", "node").join(heads, ["node", "h1", "h2"]).dropDuplicates(["node"])
                   .select("node", "h1", "h2", "signature"), "class-signatures")
    postings = keep(shared_postings(classes, matches), "postings")
    nodes = keep(postings.select("node").distinct(), "posted")
    labels = nodes.select("node", F.col("node").alias("component"))
    if not nodes.isEmpty():
        sets = full_sets(docs, classes.join(nodes, "node").select("node", "h1", "h2"), width)
        tried = spark.createDataFrame([], "a long, b long")

        def connect(links: DataFrame) -> None:
            """Forms components anew with the links."""
            nonlocal labels
            new = keep(links, "confirmed")
            if not new.isEmpty():
                labels = keep(joined_components(labels, new), "labels")

        for _ in range(STAR_TURNS):
            pairs = best_each(agreeing(star_pairs(postings, labels), sets, matches, fine_matches), 1)
            chosen = keep(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "chosen")
            if chosen.isEmpty():
                break
            tried = tried.unionByName(chosen)
            connect(confirmed(chosen, sets, percent))
        connect(remaining_links(postings, labels, sets, matches, fine_matches, percent))
    found = labels.select("node", "component")
    return members.join(found, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, **near) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when one document of each group does.
    Rows without an id stay; of rows that repeat an id that stays, the one with the least hash does."""
    found = keep(near_duplicates(docs, **near).select("doc_id", "kept"), "kept")
    gone = checked(found.where("not kept").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    twice = checked(keep(repeated, "repeated"))
    turn = F.row_number().over(Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row")))
    one = left.join(twice, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row")).withColumn("turn", turn) \
        .where("turn = 1").select("row.*")
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
