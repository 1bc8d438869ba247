"""Near-copy classes by ProbMinHash over weighted word shingles, banding and verification.

A text's shingles are its runs of five words, weighted by how often they occur. Each shingle sends arrivals of a
Poisson process whose rate is its weight, each to one of COMPONENTS places at random; a place keeps the shingle that
arrives first. Places agree between two texts with the probability Jaccard similarity. Arrivals are made in rounds for
all shingles of a slice at once, and a shingle stops as soon as its last arrival is later than everything its text
still waits for.

Equal texts are one node from the start. Signatures are cut into BANDS bands; nodes that share a band share a bucket.
1. Every node is compared with the node of the smallest id in each of its buckets, and components of the links are formed.
2. Buckets whose other members are not all in one component yet are searched again: every member outside the bucket's
   largest component is held against all members of other components, in blocks of bounded size, by signatures of
   LONG places of which a byte each is kept; pairs that agree in `least` of them are compared as texts as well (a pair
   at similarity 0.8 agrees in less than LEAST_AGREEMENT of them with a probability below 1e-4; 0 compares all).
   Members of the largest component are only sent to blocks of others, never to each other.
So no pair of a bucket is left out, and pairs within a component are not needed. A pair at similarity 0.8 shares no
bucket with a probability of (1 - 0.8 ** ROWS) ** BANDS = 1.1e-7. Comparison is exact, on the shingles of both texts.

Defined cases: a null text reads as empty; texts without words are only ever copies of equal texts; texts of fewer than
five words have one shingle of all of them; texts are compared, not ids, so rows that share an id but not a text may be
of different classes; a class is named by its smallest id, or by a negative number from its texts if no row has one;
of a class the row with the smallest id (null last) and text digest stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import GOLDEN, Columns, WordHashes, arrow_schema, grouped, map_slices, mix, order_by, partitions, stored, texts
from sluiceway.llm.components import components
from sluiceway.llm.fingerprints import runs

SHINGLE = 5
SIMILAR = 0.8
BANDS = 30
ROWS = 4
COMPONENTS = BANDS * ROWS
LONG = 1024
LEAST_AGREEMENT = 0.75
BLOCK = 2000


# --- signatures --------------------------------------------------------------------------------------------------------

def weighted(items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items of each owner with their counts."""
    key = mix(items ^ mix(owner.astype(np.uint64)))
    order = order_by(key)
    edge = np.ones(len(key), bool)
    edge[1:] = key[order][1:] != key[order][:-1]
    first = np.flatnonzero(edge)
    return items[order[first]], owner[order[first]], np.diff(np.append(first, len(key)))


def prob_minhash(items: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """For each of n owners the item that arrives first in each of m places; 0 for owners without items."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    horizon = np.full(n, np.inf)
    items, owner, weights = items.copy(), owner.copy(), weights.astype(float)
    clock = np.zeros(len(items))
    turn = 0
    while len(items):
        turn += 1
        drawn = mix(items + np.uint64(turn * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weights
        place = owner * m + (mix(drawn) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(clock < first[place])
        np.minimum.at(first, place[better], clock[better])
        won = better[clock[better] == first[place[better]]]
        winner[place[won]] = items[won]
        if turn < 4 or turn % 4 == 0:
            waiting = np.unique(owner)
            horizon[waiting] = first.reshape(n, m)[waiting].max(1)
            on = clock < horizon[owner]
            items, owner, weights, clock = items[on], owner[on], weights[on], clock[on]
    return winner.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(GOLDEN), (n, BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(GOLDEN) + parts[:, :, i])
    return key.view(np.int64)


def signed(listed: list[str], words: WordHashes, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of texts and how many shingles each has, repeats included."""
    items = [runs(words.of(t.split()), SHINGLE) for t in listed]
    sizes = np.array([len(x) for x in items], dtype=np.int64)
    return prob_minhash(*weighted(np.concatenate(items), np.repeat(np.arange(len(items)), sizes)), n=len(items), m=m), sizes


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands): digest of the text and the keys of its bands."""

    def start():
        words = WordHashes()

        def work(rows: Columns) -> Columns:
            signature, sizes = signed(rows["text"], words, COMPONENTS)
            return {
                "doc_id": rows["doc_id"], "digest": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in rows["text"]],
                "bands": [row if size else [] for row, size in zip(band_keys(signature), sizes)],
            }

        return work

    return map_slices(docs, start, "doc_id long,digest binary,bands array<long>")


def long_signatures(involved: DataFrame) -> DataFrame:
    """(node, sig): one byte of each of LONG places."""

    def start():
        words = WordHashes()

        def work(rows: Columns) -> Columns:
            signature, _ = signed(rows["text"], words, LONG)
            return {"node": rows["node"], "sig": [row.tobytes() for row in (signature >> np.uint64(56)).astype(np.uint8)]}

        return work

    return map_slices(involved.select("node", "text"), start, "node long,sig binary")


# --- verification ------------------------------------------------------------------------------------------------------

def shingles(text: str) -> Counter:
    words = text.split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(zip(*(words[i:] for i in range(SHINGLE))))


def probability_jaccard(x: Counter, y: Counter) -> float:
    """Sum over shared d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    shared = x.keys() & y.keys()
    if not shared:
        return 0.0
    if max(x.values()) == 1 == max(y.values()):
        return len(shared) / (len(x) + len(y) - len(shared))
    only_x = sum(x.values()) - sum(x[d] for d in shared)
    only_y = sum(y.values()) - sum(y[d] for d in shared)
    both = Counter((x[d], y[d]) for d in shared)
    total = 0.0
    for (a, b), n in both.items():
        total += n / (only_x / a + only_y / b + sum(k * max(p / a, q / b) for (p, q), k in both.items()))
    return total


def verified(pairs: DataFrame, involved: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, as links."""
    left = involved.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = involved.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    together = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def start():
        held: dict[str, Counter] = {}

        def counted(text: str) -> Counter:
            if text not in held:
                if len(held) >= 8:
                    held.clear()
                held[text] = shingles(text)
            return held[text]

        def work(rows: Columns) -> Columns:
            close = [probability_jaccard(shingles(x), counted(y)) >= SIMILAR for x, y in zip(rows["text_a"], rows["text_b"])]
            return {"a": [a for a, c in zip(rows["a"], close) if c], "b": [b for b, c in zip(rows["b"], close) if c]}

        return work

    return map_slices(together, start, "a long,b long", "text_a")


# --- the second search ---------------------------------------------------------------------------------------------------

def cross_pairs(members: dict[str, np.ndarray], least: int) -> tuple[list[int], list[int]]:
    """Pairs of different components whose signatures agree in at least `least` places, one of each outside the largest.

    A pair that shares several buckets belongs to the one of its first common band. In a part made of two blocks a pair
    has one member of each; members of the largest component lie in blocks of their own. So every pair comes up once."""
    node, sig, bands, block, root, outside = (members[k] for k in ("node", "sig", "bands", "block", "root", "outside"))
    apart = members["crossed"]
    a: list[int] = []
    b: list[int] = []
    for i in np.flatnonzero(outside):
        may = (root != root[i]) & (~outside | (node > node[i]))
        others = np.flatnonzero(may & ((block != block[i]) | ~outside) if apart else may)
        hits = others[(sig[others] == sig[i]).sum(1) >= least]
        common = bands[hits] == bands[i]
        first = bands[i][common.argmax(1)] == members["key"]
        for j in hits[first | ~common.any(1)]:
            a.append(int(max(node[i], node[j])))
            b.append(int(min(node[i], node[j])))
    return a, b


def second_pairs(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, involved: DataFrame, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """Candidate pairs among the members of a bucket other than its smallest, where they are not one component."""
    rows = buckets.where("node <> pivot").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_keys = parts.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("inner"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = open_keys.select("key", "largest", F.ceil((F.col("n") - F.col("inner")) / BLOCK).cast("int").alias("outer_blocks"), F.ceil(F.col("inner") / BLOCK).cast("int").alias("inner_blocks"))
    members = stored(rows.join(blocks, "key").withColumn("outside", F.col("root") != F.col("largest")).drop("largest"), "open-buckets")
    wanted = members.select("node").distinct()
    known = nodes.join(wanted, "node", "left_semi").select("node", "bands")
    long = stored(long_signatures(involved.join(wanted, "node", "left_semi")).join(known, "node"), "long-signatures")

    def numbers(blocks: str) -> Column:
        return F.sequence(F.lit(0), F.col(blocks) - 1)

    block = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("outer_blocks")).otherwise(F.col("inner_blocks"))).cast("int")
    placed = members.join(long, "node").withColumn("block", block)
    # Outsiders meet each other in pairs of blocks (kind 0), and the largest component's members in others (kind 1).
    meet = F.transform(numbers("outer_blocks"), lambda o: F.struct(F.lit(0).alias("kind"), F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    cross = F.transform(numbers("inner_blocks"), lambda o: F.struct(F.lit(1).alias("kind"), F.col("block").alias("x"), o.alias("y")))
    from_inside = F.transform(numbers("outer_blocks"), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("x"), F.col("block").alias("y")))
    spread = placed.withColumn("part", F.explode(F.when(F.col("outside"), F.concat(meet, cross)).otherwise(from_inside)))
    keyed = spread.select(
        F.xxhash64("key", "part").alias("part"), "node", "root", "sig", "bands", "key", "block", "outside",
        ((F.col("part.kind") == 1) | (F.col("part.x") != F.col("part.y"))).alias("crossed"))
    target = arrow_schema("a long,b long")
    least = int(np.ceil(least_agreement * LONG))

    def run(batches):
        for group in grouped(batches, "part"):
            column = {name: group.column(i) for i, name in enumerate(group.schema.names)}
            node, once = np.unique(column["node"].to_numpy(zero_copy_only=False), return_index=True)
            members = {name: column[name].to_numpy(zero_copy_only=False)[once] for name in ("root", "block", "outside")} | {
                "node": node, "sig": np.frombuffer(b"".join(column["sig"].to_pylist()), np.uint8).reshape(-1, LONG)[once],
                "bands": column["bands"].flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)[once],
                "key": column["key"][0].as_py(), "crossed": column["crossed"][0].as_py(),
            }
            a, b = cross_pairs(members, least)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=target)

    dealt = keyed.repartition(partitions(buckets.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "a long,b long").distinct()


# --- classes -------------------------------------------------------------------------------------------------------------

def near_copy_nodes(docs: DataFrame, least_agreement: float = LEAST_AGREEMENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, id, root, class_id, stays) of every different text: its smallest id, the
    node that its class is known by, the class's smallest id, and whether this text is the one that stays."""
    read = texts(docs)
    rows = stored(signatures(read), "signatures")
    # Numbers given while writing: different for different texts, whatever their ids are.
    nodes = stored(
        rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", "id", F.explode("bands").alias("key"))
    # The smallest id is likely an original, which copies are more like than each other.
    first = F.min_by("node", F.struct(F.col("id").isNull().alias("unnamed"), "id", "node"))
    shared = spread.groupBy("key").agg(first.alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot")
    buckets = stored(spread.select("node", "key").join(shared, "key"), "buckets")

    # One row of each text is read again: that of its smallest id, so a text's copies are not gathered.
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "digest", F.coalesce("id", F.lit(0)).alias("known"), F.col("id").isNull().alias("unnamed"))
    named = read.select(F.unhex(F.md5("text")).alias("digest"), F.coalesce("doc_id", F.lit(0)).alias("known"), F.col("doc_id").isNull().alias("unnamed"), "text")
    involved = stored(named.join(wanted, ["digest", "known", "unnamed"]).groupBy("node").agg(F.min("text").alias("text")), "involved")

    first = stored(verified(buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), involved), "star-links")
    roots = components(first)
    second = stored(verified(stored(second_pairs(buckets, roots, nodes, involved, least_agreement), "second-pairs"), involved), "second-links")
    if not second.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
    linked = stored(nodes.select("digest", "id", "node").join(roots, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root")), "linked-texts")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")
    heads = linked.groupBy("root").agg(F.min(order).alias("head"))
    unnamed = -1 - F.shiftrightunsigned(F.xxhash64("head.digest"), 1)
    classed = linked.join(heads, "root").select("digest", "id", "root", F.coalesce("head.id", unnamed).alias("class_id"), (F.col("digest") == F.col("head.digest")).alias("stays"))
    return rows.select("doc_id", "digest"), stored(classed, "classes")


def near_copy_classes(docs: DataFrame, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), and whether it is the one that stays."""
    rows, classed = near_copy_nodes(docs, least_agreement)
    joined = rows.join(classed, "digest")
    return joined.select("doc_id", "class_id", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("id"))).alias("stays"))


def keep_one_of_each(docs: DataFrame, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """The documents that stay, one of each class, with all their columns."""
    _, classed = near_copy_nodes(docs, least_agreement)
    kept = classed.where("stays").select(F.col("digest").alias("__digest"), F.coalesce("id", F.lit(0)).alias("__known"), F.col("id").isNull().alias("__unnamed"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("__digest"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__known"), F.col("doc_id").isNull().alias("__unnamed"))
    keys = ["__digest", "__known", "__unnamed"]
    return keyed.join(kept, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")
