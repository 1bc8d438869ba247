"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns. A sequence is known by its depth and two exclusive sums of hashes of its
turns and their places (128 bits), which are summed in runs of CHUNK turns and shifted by the runs before, so that a
long conversation is the work of many tasks. A node is named by its smallest member and its depth.

Sums over subtrees need no walk from leaf to root. Nodes are weighed by the conversations that own a node and pass
through them, so that the weight below a node is one grouped sum of the turns that follow, not a rollup. In a component
the nodes with more than half of its weight below them are a path down from its top; the last one is the centroid. The
component is split there: its children's components, and the one above. What the centroid and the components below it
hold is totalled and added to every node on the path. A split at least halves the weight, so the number of rounds is at
most the logarithm of the number of turns, however deep or broad the trie is. Components of at most GROUP turns are
brought together and split to the end in one task, by the same steps.

Defined cases: null role and text read as empty; turns of equal number stand in order of the MD5 of role and text; rows
without a conv_id belong to no conversation and are left out; repeated rows are turns of their own; a conversation may
be rebuilt without turns and is then a member of the root only; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import arrow_schema, partitions, stored, whole_groups
from sluiceway.llm.numbering import numbered
from sluiceway.skew import stored_side

# Turns of a conversation summed by one window, and ids joined to one piece of text, which also bounds its size.
CHUNK = 4096
ID_PIECE_BITS = 12
# Components of this weight at most are split to the end in one task.
GROUP = 20_000
# A rebuilt conversation takes fewer than HEADS turns from the first conversation of its block of BLOCK ids.
HEADS = 6
BLOCK = 100

NODE = ["p", "x1", "x2"]
TOP = ["top_o", "top_p"]


# --- turns ---------------------------------------------------------------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, n, digest, chars): every turn's place in its conversation from 0, without its text."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.unhex(digest).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return numbered(stored(narrow, "turns"), "c", [F.col("turn").asc_nulls_first(), F.col("digest")], "placed-turns").drop("turn")


def taken_heads(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, p, digest, chars, total): the turns of the rebuilt conversations from 1; and (c, total) of all of them."""
    sizes = turns.groupBy("c").agg(F.max("n").alias("n")).withColumn("h", taken_heads(F.col("c"))).withColumn("b", F.col("c") - F.col("c") % BLOCK)
    first = sizes.select(F.col("c").alias("b"), F.col("n").alias("there"))
    convs = sizes.join(first, "b", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    heads = turns.where((F.col("c") % BLOCK == 0) & (F.col("pos") < HEADS - 1)).select(F.col("c").alias("b"), "pos", "digest", "chars")
    given = convs.join(heads, "b").where("pos < k").select("c", (F.col("pos") + 1).alias("p"), "digest", "chars", "total")
    later = turns.where(F.col("pos") >= taken_heads(F.col("c"))).select("c", "pos", "digest", "chars")
    own = later.join(convs, "c").select("c", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("p"), "digest", "chars", "total")
    return stored(given.unionByName(own), "rebuilt-turns"), convs.select("c", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` with the sums x1, x2 of the prefix that each turn ends, and px1, px2 of the one before it."""
    chunked = turns.withColumn("chunk", F.expr(f"p div {CHUNK}")).withColumn("l1", F.xxhash64("p", "digest")).withColumn("l2", F.xxhash64("digest", F.lit(1), "p"))
    within = Window.partitionBy("c", "chunk").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = chunked.groupBy("c", "chunk").agg(F.bit_xor("l1").alias("s1"), F.bit_xor("l2").alias("s2"))
    shifts = runs.select("c", "chunk", F.bit_xor("s1").over(before).alias("s1"), F.bit_xor("s2").over(before).alias("s2")).where("s1 is not null")
    local = chunked.withColumn("x1", F.bit_xor("l1").over(within)).withColumn("x2", F.bit_xor("l2").over(within))
    shifted = local.join(shifts, ["c", "chunk"], "left")
    for k in "12":
        shifted = shifted.withColumn(f"x{k}", F.col(f"x{k}").bitwiseXOR(F.coalesce(f"s{k}", F.lit(0)))).withColumn(f"px{k}", F.col(f"x{k}").bitwiseXOR(F.col(f"l{k}")))
    return shifted.select("c", "p", "chars", "total", "x1", "x2", "px1", "px2")


# --- nodes ---------------------------------------------------------------------------------------------------------------

def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node: its key, smallest member `o`, the parent's `po`, n_convs, n_children and the characters of its text."""
    zero = F.lit(0).cast("long")
    made = turns.groupBy(*NODE).agg(
        F.min("c").alias("o"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("px1").alias("px1"), F.max("px2").alias("px2"))
    root = convs.agg(F.min("c").alias("o"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(k) for k in NODE], "o", "n_convs", zero.alias("chars"), zero.alias("px1"), zero.alias("px2"))
    nodes = stored(made.unionByName(root), "nodes")
    upper = nodes.select((F.col("p") + 1).alias("p"), F.col("x1").alias("px1"), F.col("x2").alias("px2"), F.col("o").alias("po"))
    children = nodes.where("p > 0").groupBy((F.col("p") - 1).alias("p"), F.col("px1").alias("x1"), F.col("px2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = nodes.join(upper, ["p", "px1", "px2"], "left").join(children, NODE, "left")
    return stored(linked.select(*NODE, "o", "po", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "chars"), "linked-nodes")


def joined_ids(ends: DataFrame) -> DataFrame:
    """(p, x1, x2, sha): the digest of each node's ending conversations, joined by commas in ascending order.

    Ids are joined in pieces of neighbouring ids first; a node's pieces are hashed as they pass, none is kept."""
    pieces = ends.groupBy(*NODE, F.shiftright("c", ID_PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    written = pieces.select(F.xxhash64(*NODE).alias("key"), *NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    target = arrow_schema("p long,x1 long,x2 long,sha string")

    def run(batches):
        current, seen = None, hashlib.sha256()
        for batch in batches:
            done = []
            column = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in (*NODE, "ids")]
            for *node, ids in zip(*column):
                if node != current:
                    if current is not None:
                        done.append((*current, seen.hexdigest()))
                    current, seen = node, hashlib.sha256(ids.encode())
                else:
                    seen.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), target)], schema=target)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*current, seen.hexdigest()), target)], schema=target)

    dealt = written.repartition(partitions(ends.sparkSession), "key").sortWithinPartitions("key", *NODE, "piece")
    return dealt.mapInArrow(run, "p long,x1 long,x2 long,sha string")


# --- centroid decomposition ------------------------------------------------------------------------------------------------

def split_to_the_end(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums of one component whose nodes are sorted by depth; `parent` is -1 above its top, `weight` is the weight
    below each node."""
    weight = list(weight)
    sums = [[0] * len(v) for v in values]
    waiting = [list(range(len(parent)))] if parent else []
    while waiting:
        nodes = waiting.pop()
        whole = weight[nodes[0]]
        path = [v for v in nodes if 2 * weight[v] > whole]
        centroid = path[-1]
        upper, below, part_of = [], [centroid], {}
        for v in nodes:
            if v == centroid:
                continue
            if parent[v] == centroid:
                part_of[v] = [v]
                waiting.append(part_of[v])
            elif parent[v] in part_of:
                part_of[v] = part_of[parent[v]]
                part_of[v].append(v)
            else:
                upper.append(v)
                continue
            below.append(v)
        for total, value in zip(sums, values):
            held = sum(value[v] for v in below)
            for v in path:
                total[v] += held
        for v in path[:-1]:
            weight[v] -= weight[centroid]
        if upper:
            waiting.append(upper)
    return sums


def split_small(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(o, p, *names): subtree sums within components that are brought together whole."""
    schema = "o long,p long," + ",".join(f"{name} long" for name in names)
    target = arrow_schema(schema)

    def run(batches):
        for batch in whole_groups(batches, "key"):
            top_o, top_p, p, o, po, w, *values = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in (*TOP, "p", "o", "po", "w", *names))
            sums: list[list[int]] = [[] for _ in names]
            start = 0
            for end in range(1, len(p) + 1):
                if end < len(p) and top_o[end] == top_o[start] and top_p[end] == top_p[start]:
                    continue
                place = {(o[i], p[i]): i - start for i in range(start, end)}
                parent = [place.get((po[i], p[i] - 1), -1) for i in range(start, end)]
                for total, found in zip(sums, split_to_the_end(parent, w[start:end], [v[start:end] for v in values])):
                    total.extend(found)
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (o, p, *sums)], schema=target)

    keyed = nodes.select(F.xxhash64(*TOP).alias("key"), *TOP, "p", "o", "po", "w", *names)
    return keyed.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", *TOP, "p").mapInArrow(run, schema)


def split_once(state: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over all components: what it adds to nodes (o, p, *names), and the components that are left."""
    columns = state.columns
    owners = state.where("c = o")
    centroids = owners.where("2 * w > whole").groupBy(*TOP).agg(F.max_by(F.struct("o", "p", "w"), "p").alias("g"))
    sides = stored_side(centroids.select(*TOP, F.col("g.o").alias("go"), F.col("g.p").alias("gp"), F.col("g.w").alias("gw")), "centroids")
    marked = state.join(sides, TOP)
    heads = marked.where("p = gp + 1 and po = go").select("c", *TOP, F.col("o").alias("ho"), F.col("w").alias("hw"))
    below = marked.join(heads, ["c", *TOP], "left").withColumn("below", F.col("ho").isNotNull() & (F.col("p") > F.col("gp")))
    step = stored(below.withColumn("is_g", F.expr("o = go and p = gp")).withColumn("on_path", F.expr("2 * w > whole and p <= gp")), "split")
    own = step.where("c = o")
    totals = own.where("below or is_g").groupBy(*TOP).agg(*[F.sum(name).alias(name) for name in names])
    added = own.where("on_path").select(*TOP, "o", "p").join(stored_side(totals, "component-totals"), TOP).select("o", "p", *names)
    left = step.where("not is_g").select(
        *[c for c in columns if c not in (*TOP, "w", "whole")],
        F.when(F.col("below"), F.col("ho")).otherwise(F.col("top_o")).alias("top_o"),
        F.when(F.col("below"), F.col("gp") + 1).otherwise(F.col("top_p")).alias("top_p"),
        F.expr("case when on_path then w - gw else w end").alias("w"),
        F.when(F.col("below"), F.col("hw")).otherwise(F.col("whole") - F.col("gw")).alias("whole"))
    return added, left.select(*columns)


def subtree_sums(state: DataFrame, names: list[str], group: int = GROUP) -> DataFrame:
    """(o, p, *names) summed over the subtree of every node.

    `state` has a row for every conversation c that owns a node and every node (o, p) on its way, the parent's po, the
    top of its component (top_o, top_p), the weights w below the node and `whole` below the top, and the values."""
    added = []
    while True:
        added.append(split_small(state.where((F.col("whole") <= group) & (F.col("c") == F.col("o"))), names))
        large = state.where(F.col("whole") > group)
        if large.isEmpty():
            break
        more, state = split_once(large, names)
        added.append(more)
    every = added[0]
    for more in added[1:]:
        every = every.unionByName(more)
    return every.groupBy("o", "p").agg(*[F.sum(name).alias(name) for name in names])


# --- the trie ------------------------------------------------------------------------------------------------------------

def prefix_trie(turns: DataFrame, convs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per node of the trie of the conversations (c, total) with turns (c, p, digest, chars, total)."""
    known = stored(prefixes(turns), "prefixes")
    nodes = trie_nodes(known, convs)
    zero = F.lit(0).cast("long")
    ends = known.where("p = total").select(*NODE, "c").unionByName(convs.where("total = 0").select(*[zero.alias(k) for k in NODE], "c"))
    values = nodes.select("o", "p", "po", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), "x1", "x2")

    # Conversations that own a node pass through all nodes together; they own the node where they end.
    members = stored(known.select("c", "total", *NODE).join(values, NODE).drop("x1", "x2"), "members")
    owners = members.where("p = total and c = o").select("c", "total")
    root = values.where("p = 0").select("o", "n_leaves", "saved_tokens").first()
    if root is None:
        return _named(nodes.withColumn("sha", F.lit("")).withColumn("n_leaves", zero).withColumn("saved_tokens", zero))
    passing = members.join(owners.select("c"), "c", "left_semi")
    weights = passing.groupBy("o", "p").agg(F.sum(F.col("total") - F.col("p") + 1).alias("w"))
    # The root's smallest member owns the root; without turns it ends there and owns nothing else.
    at_root = owners.unionByName(convs.where((F.col("c") == root.o) & (F.col("total") == 0)))
    whole = F.lit(at_root.agg(F.sum(F.col("total") + 1)).first()[0]).cast("long")
    start = at_root.select(
        "c", zero.alias("p"), F.lit(root.o).alias("o"), F.lit(None).cast("long").alias("po"),
        F.lit(root.n_leaves).cast("long").alias("n_leaves"), F.lit(root.saved_tokens).cast("long").alias("saved_tokens"), whole.alias("w"))
    state = passing.join(weights, ["o", "p"]).select(*start.columns).unionByName(start)
    state = stored(state.select("*", F.lit(root.o).alias("top_o"), zero.alias("top_p"), whole.alias("whole")), "trie-state")
    sums = stored(subtree_sums(state, ["n_leaves", "saved_tokens"], group), "subtree-sums")
    return _named(nodes.join(sums, ["o", "p"]).join(joined_ids(ends), NODE, "left"))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("o").alias("conv_id"), F.col("p").alias("depth"), F.col("po").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(conversations)), group)
