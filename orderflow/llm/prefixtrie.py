"""A prefix trie of conversations by fixed-length block hashing.

Conversations are cut into blocks of ``BLOCK`` turns. A block's digest covers its turns;
the digest of a prefix of whole blocks is a sum over position-salted block digests, so it
is a running sum and needs no conversation in one value. Conversations are grouped by
(prefix digest, next block's digest) first: copies and shared beginnings fall into one
edge with a count. Only where a prefix has more than one next block are the turn
boundaries inside refined, on one representative of each edge.

Sums over subtrees need no walk: a node belongs to its smallest member, so a node's sum
is that of its members' own nodes below it, added up by block and then by turn.

Equal digests count as equal turns (SHA-256 of a turn; 120 bits of it for prefixes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.functions.scan import segmented_scan_multi
from orderflow.llm.common import WORD, cut

#: Turns of a block; rows of one segment of a running sum; ids of one packed chunk.
BLOCK, SEGMENT, CHUNK = 4, 4096, 65536
#: A node: block, digest of the blocks before it, turns into the block, their digest.
NODE = ["k", "p", "j", "q"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn_sha, words) in order of (turn, role, text), nulls first.

    A null role or text is the empty one. Numbers come from segments of turn values, so a
    conversation of any length spreads over many tasks.
    """
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("turn_sha"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    segment = F.struct("a", F.floor(F.col("turn") / SEGMENT).alias("s"))
    out = segmented_scan_multi(rows, ["conv_id"], segment, ["a", "turn", "role", "text"], [("pos", F.lit(1).cast("long"), "sum")])
    return out.select("conv_id", "pos", "turn_sha", "words")


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The rebuilt conversations, (conv_id, pos, turn_sha, words); one row with pos null for each that has no turn.

    Conversation c begins with the first h turns of conversation c - c % ``group`` (all if
    fewer, none if absent) and goes on with its own after its first h; h = crc32(decimal
    c) % ``heads``. A null conv_id is one conversation, left as it is.
    """
    rows = cut(numbered(conversations))
    head = F.struct("pos", "turn_sha", "words")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < heads, head))).alias("first"))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, F.lit(0)).cast("int")
    own = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heir = own.join(convs.select(F.col("conv_id").alias("base"), "first"), "base", "left")
    heir = cut(heir.select("conv_id", "n", "h", F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("h")).alias("taken")))
    borrowed = heir.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    # the own turns move by what the base is short of h
    moved = heir.where("size(taken) < h").select(F.col("conv_id").alias("c"), (F.col("h") - F.size("taken")).alias("by"))
    kept = rows.where(F.col("pos") > F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, F.lit(0)))
    kept = kept.join(moved, F.col("conv_id") == F.col("c"), "left") \
        .select("conv_id", (F.col("pos") - F.coalesce("by", F.lit(0))).alias("pos"), "turn_sha", "words")
    empty = heir.where("size(taken) = 0 and n <= h").select("conv_id", F.lit(None).cast("long").alias("pos"),
                                                           F.lit(None).cast("binary").alias("turn_sha"), F.lit(0).cast("long").alias("words"))
    return cut(borrowed.unionByName(kept).unionByName(empty))


def _running(df: DataFrame, order: Column, ties: list[str], specs: list, inclusive: bool) -> DataFrame:
    """Running sums per conversation; null conversations are one group."""
    d = df.withColumn("o", order)
    return segmented_scan_multi(d, ["conv_id"], F.floor(F.col("o") / SEGMENT), ["o", *ties], specs, inclusive).drop("o")


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p, q, after, turns): block k, digest p of the blocks before it, q of its own, after = p with it."""
    k = F.floor((F.col("pos") - 1) / BLOCK)
    whole = turns.where("pos is not null").groupBy("conv_id", k.alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_sha", "words"))).alias("turns"))
    whole = whole.withColumn("q", _digest(F.col("turns.turn_sha")))
    salted = F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), "q"), 256)
    number = lambda at: F.conv(F.substring(salted, at, 15), 16, 10).cast("decimal(20,0)")
    whole = cut(whole.withColumns({"a": number(1), "b": number(16)}))
    sums = _running(whole, F.col("k"), [], [("sa", F.col("a"), "sum"), ("sb", F.col("b"), "sum")], True)
    said = lambda a, b: F.concat_ws("|", a.cast("string"), b.cast("string"))
    return sums.select("conv_id", "k", said(F.col("sa") - F.col("a"), F.col("sb") - F.col("b")).alias("p"), "q",
                       said(F.col("sa"), F.col("sb")).alias("after"), "turns")


def _digest(shas: Column) -> Column:
    return F.sha2(F.aggregate(shas, F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y)), 256)


def ends(conversations: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the decimal conv_ids of each key, ascending, comma-joined.

    Ids are packed in chunks of a range of values, so at most ``CHUNK`` meet in one value.
    A hash is sequential by nature: where a key has several chunks one task streams over
    them and holds one.
    """
    ids = conversations.where("conv_id is not null")
    packed = ids.groupBy(*key, F.floor(F.col("conv_id") / CHUNK).alias("c")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")) \
        .select(*key, "c", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    packed = cut(packed)
    chunks = packed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("ids").alias("ids"))
    one = chunks.where("n = 1").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    several = chunks.where("n > 1").select(*key)
    if several.isEmpty():
        return one
    packed = packed.join(several, key, "left_semi").select(F.to_json(F.struct(*key)).alias("text"), "c", "ids").repartition("text").sortWithinPartitions("text", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["text", "ends_sha256"])

        for batch in batches:
            for text, ids_ in zip(batch.column("text").to_pylist(), batch.column("ids").to_pylist()):
                if text == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        yield done()
                    now, digest = text, hashlib.sha256()
                digest.update(ids_.encode())
        if now is not None:
            yield done()

    hashed = packed.select("text", "ids").mapInArrow(run, "text string, ends_sha256 string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids.select(*key).schema)
    return one.unionByName(hashed.select(F.from_json("text", schema).alias("key"), "ends_sha256").select("key.*", "ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has a row (conv_id, pos, turn_sha, words) for each turn, pos from 1 without
    gaps, and one with pos null for a conversation without turns; other columns are
    ignored. A node is a distinct sequence of first turns; the root (depth 0) has none. A
    null conv_id is one conversation that never is the smallest member unless it is alone,
    and its id is left out of ``ends_sha256``. Repeated conversations share all their
    nodes. Texts are read as digests, so their length does not matter. An empty table
    gives no node.
    """
    block = cut(blocks(turns))
    edges = cut(block.groupBy("k", "p", "q").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.first("after").alias("after"),
                                                F.first("turns").alias("turns")))
    siblings = edges.groupBy("k", "p").agg((F.count(F.lit(1)) > 1).alias("diverge"))
    # where siblings diverge a boundary is known by the turns before it, else by the block
    shas = F.col("turns.turn_sha")
    path = F.transform("turns", lambda t, i: F.when(F.col("diverge") & (i + 1 < F.size("turns")), _digest(F.slice(shas, F.lit(1), i + 1))).otherwise(F.col("q")))
    edges = cut(edges.join(siblings, ["k", "p"]).select("k", "p", F.col("q").alias("e"), "n", "m", "after", path.alias("path"), F.col("turns.words").alias("words")))

    steps = edges.select("k", "p", "e", "n", "m", "after", "path", F.posexplode("words").alias("i", "words"))
    steps = steps.select("k", "p", (F.col("i") + 1).alias("j"), F.col("path")[F.col("i")].alias("q"), "n", "m", "words",
                         F.when(F.col("i") > 0, F.get("path", F.col("i") - 1)).alias("up"), F.when(F.col("i") + 1 == BLOCK, F.col("after")).alias("after"),
                         F.struct(F.col("m").isNull(), "m", "e").alias("rank"), F.struct("e", "path").alias("by"))
    node = steps.groupBy(*NODE).agg(F.sum("n").alias("n_convs"), F.min("m").alias("conv_id"), F.first("words").alias("words"), F.first("up").alias("up"),
                                    F.first("after").alias("after"), F.min_by("by", "rank").alias("owner"))
    inside = lambda j, q: F.concat_ws("/", "k", "p", j, q)
    node = node.select(F.struct(*NODE, "n_convs", "conv_id", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "owner").alias("self"),
                       F.when(F.col("j") == 1, F.concat_ws("/", "k", "p")).otherwise(inside(F.col("j") - 1, F.col("up"))).alias("parent"),
                       F.when(F.col("j") == BLOCK, F.concat_ws("/", F.col("k") + 1, "after")).otherwise(inside(F.col("j"), F.col("q"))).alias("me"))
    node = cut(node)
    # a node and its children meet under its name
    named = node.select(F.col("me").alias("name"), "self", "parent", F.lit(0).alias("child")).unionByName(
        node.select(F.col("parent").alias("name"), F.lit(1).alias("child")), allowMissingColumns=True)
    named = cut(named.groupBy("name").agg(F.first("self", True).alias("self"), F.first("parent", True).alias("parent"), F.sum("child").alias("n_children")))
    node = named.where("self is not null").select("self.*", "name", "parent", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"))

    # a node's sums belong to its smallest member: they count for the nodes above it in its block ...
    owned = node.where("saved > 0 or leaf > 0")
    upward = owned.select("k", "p", F.posexplode(F.slice("owner.path", F.lit(1), F.col("j"))).alias("i", "q"), "saved", "leaf")
    # ... and for the nodes of that member's earlier blocks
    later = owned.groupBy("conv_id", "k").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).withColumn("late", F.lit(1))
    every = block.select("conv_id", "k", "p", F.col("q").alias("e"), F.lit(0).alias("late")).unionByName(later, allowMissingColumns=True)
    below = _running(cut(every), -F.col("k"), ["late"], [("s", F.col("saved"), "sum"), ("l", F.col("leaf"), "sum")], False)
    below = below.where("late = 0").groupBy("k", "p", "e").agg(F.sum("s").alias("saved"), F.sum("l").alias("leaf")).where("saved > 0 or leaf > 0")
    below = below.join(edges.select("k", "p", "e", "path"), ["k", "p", "e"]).select("k", "p", F.posexplode("path").alias("i", "q"), "saved", "leaf")

    last = block.groupBy("conv_id").agg(F.max_by(F.struct("k", "p", F.size("turns").alias("j"), "q"), "k").alias("b")).select("conv_id", "b.*")
    parts = upward.unionByName(below).select("k", "p", (F.col("i") + 1).alias("j"), "q", "saved", "leaf").unionByName(
        ends(last, NODE), allowMissingColumns=True).unionByName(
        node.select(*NODE, F.struct("conv_id", "n_convs", "n_children", "parent").alias("self")), allowMissingColumns=True)
    whole = parts.groupBy(*NODE).agg(F.first("self", True).alias("self"), F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"),
                                     F.max("ends_sha256").alias("ends_sha256"))
    whole = whole.select("k", "j", "self.*", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "n_leaves", "ends_sha256")

    none, at = F.sha2(F.lit(""), 256), "0/0|0"
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    sums = named.agg(F.coalesce(F.sum("self.saved"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum(F.when(F.col("name") == at, F.col("n_children"))), F.lit(0)).alias("n_children"),
                     F.coalesce(F.count_if(F.col("self").isNotNull() & (F.col("n_children") == 0)), F.lit(0)).alias("leaves"))
    turnless = ends(convs.where("n is null").select("conv_id", F.lit(1).alias("root")), ["root"]).agg(F.max("ends_sha256").alias("x"))
    root = top.unionByName(sums, True).unionByName(turnless, True).agg(  # one row each
        *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_children", "leaves", "saved_tokens", "x")]).where("n_convs > 0")
    root = root.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(top.schema["conv_id"].dataType).alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("x", none).alias("ends_sha256"))
    names = node.select(F.col("name").alias("parent"), F.col("conv_id").alias("above")).unionByName(
        top.select(F.lit(at).alias("parent"), F.col("conv_id").alias("above")))
    made = whole.join(names, "parent", "left").select(
        "conv_id", (F.col("k") * BLOCK + F.col("j")).cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return made.unionByName(root)
