"""A prefix trie of conversations by Spark SQL ROLLUP.

A conversation becomes a row of turn-id columns by position, and one ``GROUP BY ROLLUP`` over these
columns counts all prefixes at once; ``grouping_id`` tells a prefix's length.  Conversations longer
than the columns go on in further blocks of columns, grouped by the node that the block before ended
in.  Only prefixes that several conversations share go on: once a conversation is alone, the rest of
its turns are nodes of their own.  A second ROLLUP over the nodes adds up whole subtrees, from the
deepest block to the first.

A turn's id is 128 bits of the SHA-256 of its role and text, a node's key a chain of these, so no
text is shuffled.  Null roles and texts count as empty.  Turns are ordered by turn, null first, ties
by the digest of role and text; repeated rows are turns of their own.  Rows without conv_id belong to
no conversation and make no node.  A long conversation is numbered and joined in segments, and the
identifiers that end in one node are hashed as a stream of sorted pieces, so neither is ever gathered.
An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.hot import lookup
from facsimile.llm.store import keep
from facsimile.operators.ordered import running

#: Turn columns of the first block and of those that follow.
FIRST, FURTHER = 8, 32
#: Turns of a conversation that share one join key.
SEGMENT = 4096
#: Conversations borrow at most so many turns less one from the first of their hundred.
HEADS = 6
#: Identifiers in one piece of a node's list.
PIECE = 256

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(text: Column) -> Column:
    """The first 128 bits of a SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def segment(position: Column) -> Column:
    return F.floor((position - 1) / SEGMENT).cast("long")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations, kept: conv_id, depth, turn(digest, chars); and one row of
    depth 0 per conversation, which holds its n_turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.encode(F.concat(F.length(role), F.lit(":"), role, text), "UTF-8"), 256)
    rows = keep(conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().cast("int").alias("numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"), sha.alias("sha"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("place")), "turns")
    rows = rows.select("conv_id", "numbered", "at", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("tie"), "place",
                       F.struct(F.substring(F.unhex("sha"), 1, 16).alias("digest"), "chars").alias("turn"))
    placed = keep(running(rows, ["numbered", "at", "tie", "place"], by=["conv_id"], row_number="pos")
                  .select("conv_id", "pos", "turn"), "turn-positions")

    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = placed.groupBy("conv_id").agg(
        F.count("*").alias("own"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "turn")))).alias("start"))
    firsts = sizes.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("first"), F.col("start").alias("lent"))
    plan = sizes.select("conv_id", "own", borrowed.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("first")) \
        .join(firsts, "first", "left") \
        .withColumn("head", F.expr("slice(coalesce(lent, array()), 1, cast(h as int))")) \
        .withColumn("n_turns", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = keep(plan.select("conv_id", "own", "h", "head", F.col("n_turns").cast("long").alias("n_turns")), "conversations")

    shift = plan.select("conv_id", "h", F.size("head").alias("ahead"),
                        F.explode(F.sequence(F.lit(0).cast("long"), segment(F.col("own")))).alias("segment"))
    own = placed.withColumn("segment", segment(F.col("pos"))).join(shift, ["conv_id", "segment"]).filter("pos > h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("ahead")).alias("depth"), "turn", F.lit(None).cast("long").alias("n_turns"))
    heads = plan.select("conv_id", F.posexplode("head").alias("k", "lent")) \
        .select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), F.col("lent.turn").alias("turn"), F.lit(None).cast("long").alias("n_turns"))
    marks = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(dict(placed.dtypes)["turn"]).alias("turn"), "n_turns")
    return keep(own.unionByName(heads).unionByName(marks), "rebuilt-turns")


def columns(width: int) -> list[str]:
    return [f"t{k}" for k in range(1, width + 1)]


def key_of(prior: Column, turns: Column) -> Column:
    """The key of the node that the turns lead to from ``prior``."""
    return F.aggregate(F.filter(turns, lambda t: t.isNotNull()), prior, lambda key, t: digest(F.concat(key, t["digest"])))


def block_rows(turns: DataFrame, going: DataFrame | None, start: int, width: int) -> DataFrame:
    """The turns at depths after ``start`` as columns, one row per conversation that goes on."""
    inside = turns.filter((F.col("depth") > start) & (F.col("depth") <= start + width))
    if going is None:
        inside = inside.unionByName(turns.filter("depth = 0")).withColumn("prior", digest(F.lit("").cast("binary")))
    else:
        inside = inside.drop("n_turns").join(going, "conv_id")
    rows = inside.groupBy("conv_id").agg(
        F.first("prior").alias("prior"), F.max("n_turns").alias("n_turns"),
        *[F.max(F.when(F.col("depth") == start + k, F.col("turn"))).alias(f"t{k}") for k in range(1, width + 1)])
    return keep(rows.withColumn("at", key_of(F.col("prior"), F.array(*columns(width)))), "turn-columns")


def rolled_up(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """``aggregates`` of every prefix of the turn columns below each prior node; ``level`` is the
    prefix's length.  Prefixes that end before the level are no prefixes of that length."""
    names = columns(width)
    listed = ", ".join(names)
    found = rows.sparkSession.sql(
        f"select prior, {listed}, {width} - bit_count(grouping_id()) as level, {aggregates} "
        f"from {{rows}} group by prior, rollup({listed})", rows=rows)
    last = F.coalesce(*[F.when(F.col("level") == k, F.col(c)) for k, c in enumerate(names, 1)])
    return found.withColumn("last", last).filter((F.col("level") == 0) | F.col("last").isNotNull())


def block_nodes(rows: DataFrame, start: int, width: int) -> DataFrame:
    """The nodes of one block, kept, with the turn columns that lead to them."""
    turns, level = F.array(*columns(width)), F.col("level")
    nodes = rolled_up(rows, width, "count(*) as n_convs, min(conv_id) as conv_id, max(n_turns) as longest")
    if start:
        nodes = nodes.filter("level > 0")
    return keep(nodes.select(
        "prior", *columns(width), level, "n_convs", "conv_id", "longest", (level + start).cast("long").alias("depth"),
        key_of(F.col("prior"), turns).alias("key"),
        F.when(level > 0, key_of(F.col("prior"), F.slice(turns, 1, F.greatest(level - 1, F.lit(0))))).alias("parent"),
        F.coalesce((F.col("n_convs") - 1) * F.col("last.chars"), F.lit(0)).alias("saved"),
        ((level == width) & (F.col("n_convs") == 1) & (F.col("longest") > level + start)).alias("alone")), "trie-nodes")


def with_subtrees(nodes: DataFrame, width: int, deeper: DataFrame | None) -> DataFrame:
    """``nodes`` and the sums over their subtrees; the rows of level 0 sum up all below a prior node."""
    leaf = (F.col("longest") == F.col("depth")) | F.col("alone")
    nodes = nodes.withColumn("leaves", leaf.cast("long"))
    if deeper is not None:
        nodes = nodes.join(deeper, "key", "left").withColumn("leaves", F.col("leaves") + F.coalesce("deep_leaves", F.lit(0))) \
            .withColumn("saved", F.col("saved") + F.coalesce("deep_saved", F.lit(0)))
    # of all nodes with a prefix, the one that is the prefix has the least level
    return rolled_up(nodes, width, "sum(leaves) as n_leaves, sum(saved) as saved_tokens, min_by("
                     "struct(key, parent, depth, conv_id, n_convs, alone, level as own_level), level) as node")


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of ``ends(key, conv_id)``: identifiers are sorted over many tasks and written
    down in pieces; a node's pieces then pass one after the other through its hash."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made: list[tuple[bytes, int, str]] = []
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and end - at < PIECE and keys[end] == keys[at]:
                    end += 1
                made.append((keys[at], ids[at], ",".join(map(str, ids[at:end]))))
                at = end
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.int64(), pa.string()))],
                                                 ["key", "first", "listed"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, listed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(listed.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())],
                                             ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    listed = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id") \
        .mapInArrow(pieces, "key binary, first long, listed string")
    return listed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def lone_tails(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """The nodes after the block in which a conversation was left ``alone(conv_id, depth, longest)``."""
    first = segment(F.col("depth") + 1)
    spans = alone.select("conv_id", F.col("depth").alias("from_depth"), "longest",
                         F.explode(F.sequence(first, segment(F.col("longest")))).alias("segment"))
    own = turns.filter("depth > 0").select("conv_id", "depth", segment(F.col("depth")).alias("segment"))
    ended = F.col("depth") == F.col("longest")
    listed = F.when(ended, F.col("conv_id").cast("string")).otherwise("")
    return own.join(spans, ["conv_id", "segment"]).filter("depth > from_depth").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~ended).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, first: int = FIRST, further: int = FURTHER) -> DataFrame:
    """One row per node of the trie of the rebuilt ``conversations(conv_id, turn, role, text)``."""
    turns = rebuilt(conversations)
    blocks: list[tuple[DataFrame, int]] = []
    ends: DataFrame | None = None
    going: DataFrame | None = None
    start, width = 0, first
    while True:
        rows = block_rows(turns, going, start, width)
        nodes = block_nodes(rows, start, width)
        blocks.append((nodes, width))
        over = F.col("n_turns") > start + width
        ended = rows.filter(~over).select(F.col("at").alias("key"), "conv_id")
        ends = ended if ends is None else ends.unionByName(ended)
        shared = nodes.filter((F.col("level") == width) & (F.col("n_convs") > 1) & (F.col("longest") > F.col("depth"))) \
            .select(F.col("key").alias("prior"), "n_convs")
        going = keep(lookup(rows.filter(over).select("conv_id", "n_turns", F.col("at").alias("prior")), shared, "prior", "n_convs", "inner")
                     .drop("n_convs"), "longer")
        if going.isEmpty():
            break
        start, width = start + width, further

    summed: list[DataFrame] = []
    deeper: DataFrame | None = None
    for k, (nodes, width) in reversed(list(enumerate(blocks))):
        whole = with_subtrees(nodes, width, deeper)
        whole = keep(whole.select("prior", "level", "n_leaves", "saved_tokens", "node.*"), "trie-sums")
        # further blocks hold no row for the prior node itself: their level 0 is what it adds up
        summed.append(whole.filter("level = own_level"))
        deeper = whole.filter("level = 0").select(F.col("prior").alias("key"), F.col("n_leaves").alias("deep_leaves"),
                                                  F.col("saved_tokens").alias("deep_saved"))
    nodes = summed[0]
    for more in summed[1:]:
        nodes = nodes.unionByName(more)

    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("below"))
    nodes = keep(nodes.join(children, "key", "left").join(ends_digests(ends), "key", "left").select(
        "key", "parent", "depth", "conv_id", "n_convs", "n_leaves", "saved_tokens",
        (F.coalesce("below", F.lit(0)) + F.col("alone").cast("long")).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "trie")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                    F.col("n_children").alias("weight"))
    alone = blocks[0][0].filter("alone").select("conv_id", "depth", "longest")
    for more, _ in blocks[1:]:
        alone = alone.unionByName(more.filter("alone").select("conv_id", "depth", "longest"))
    return lookup(nodes, parents, "parent", "weight").select(*NODE).unionByName(lone_tails(turns, alone).select(*NODE))


# conversations as lists of turns, prefixes as slices of these; the checksum bit by bit
ORACLE = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
placed as (
  select conv_id, {'role': role, 'text': text} as said, row_number() over (partition by conv_id order by turn nulls first,
    ('0x' || substr(sha256(length(role) || ':' || role || text), 1, 15))::bigint) as pos from t),
convs as (
  select conv_id, count(*) as own, xor(list_reduce(
      list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint),
      lambda c, b: list_reduce(range(8), lambda r, k: case when r % 2 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, xor(c, b)),
      4294967295), 4294967295) % 6 as h
  from placed group by conv_id),
turns as (
  select c.conv_id, 0 as part, p.pos, p.said from convs c join placed p on p.conv_id = c.conv_id - c.conv_id % 100 and p.pos <= c.h
  union all select c.conv_id, 1, p.pos, p.said from convs c join placed p on p.conv_id = c.conv_id and p.pos > c.h),
whole as (
  select c.conv_id, coalesce(list(said order by part, pos) filter (said is not null), []) as path
  from convs c left join turns using (conv_id) group by c.conv_id),
members as (select conv_id, unnest(range(0, len(path) + 1)) as depth, path as full_path from whole),
nodes as (
  select depth, full_path[1:depth] as path, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(full_path) = depth), '') as ends
  from members group by all),
placed_nodes as (select n.*, n.path[1:depth - 1] as up from nodes n),
children as (select up as path, depth - 1 as depth, count(*) as n_children from placed_nodes where depth > 0 group by all),
full_nodes as (
  select n.*, coalesce(c.n_children, 0) as n_children, case when n.depth = 0 then 0 else (n.n_convs - 1) * length(n.path[n.depth].text) end as saved
  from placed_nodes n left join children c on c.path = n.path and c.depth = n.depth),
spread as (select unnest(range(0, depth + 1)) as level, path, n_children, saved from full_nodes),
sums as (select level, path[1:level] as path, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from spread group by all)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join sums s on s.level = n.depth and s.path = n.path left join nodes p on p.depth = n.depth - 1 and p.path = n.up"""
