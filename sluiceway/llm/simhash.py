"""SimHash near-copies by covering locality-sensitive hashing: every pair within RADIUS differing bits is found.

A text's fingerprint has a bit for each of 64 bits that over half its word shingles' hashes have set. The places of a
fingerprint are dealt over the non-zero vectors of RADIUS + 1 bits; every such vector v is a mask that keeps the places
whose vector has an odd product with v. Fewer vectors than dimensions leave one v that is orthogonal to all of them, so
any RADIUS differing places are all left out by some mask: a pair within the radius agrees under at least one mask.

Equal fingerprints are one node from the start. Nodes that agree under a mask share a bucket. A bucket's nodes are
compared with each other, and a spanning forest of those within the radius is kept instead of all pairs, which leaves
the same components. A bucket of more than BUCKET nodes is dealt again: its nodes can only differ in the places its mask
leaves out, and these are covered by masks in the same way. Such a smaller bucket has at most 2 ** 16 different
fingerprints whatever the input is, so no group grows without bound and no pair is left out. Links become components
without gathering them (see `components`).

Defined cases: a null text reads as empty; a text without words has fingerprint zero and is linked like any other; one
of fewer words than a shingle is one shingle; repeated rows are one node; a null id takes no part in naming a component,
which is null only if none of its documents has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import Columns, arrow_schema, map_slices, partitions, stored, texts, whole_groups
from sluiceway.llm.components import components
from sluiceway.skew import stored_side

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
BUCKET = 4096
# Hashes counted at once, so that a long text takes bounded memory.
COUNTED = 1 << 16
# Pairs compared at once within a bucket.
COMPARED = 1 << 20


# --- fingerprints --------------------------------------------------------------------------------------------------------

def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of `size` words, lower-cased and joined by one space."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    return np.array([xxh64_intdigest(line[lo:hi], SEED) for lo, hi in zip(starts, ends[size - 1:].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), COUNTED):
        octets = hashes[lo:lo + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed number of 64 bits."""

    def start():
        def work(rows: Columns) -> Columns:
            found = np.array([fingerprint(shingle_hashes(t, size)) for t in rows["text"]], np.uint64)
            return {"doc_id": rows["doc_id"], "fp": found.view(np.int64)}

        return work

    return map_slices(texts(docs), start, "doc_id long,fp long")


# --- masks ---------------------------------------------------------------------------------------------------------------

def masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """Masks of which at least one leaves out any `radius` of the places."""
    vectors = 1 << (radius + 1)
    dealt = {place: 1 + i % (vectors - 1) for i, place in enumerate(places)}
    return [sum(1 << place for place, own in dealt.items() if (own & v).bit_count() & 1) for v in range(1, vectors)]


def second_masks(radius: int = RADIUS) -> list[list[int]]:
    """For every mask those over the places that it leaves out."""
    return [masks([place for place in range(BITS) if not mask >> place & 1], radius) for mask in masks(list(range(BITS)), radius)]


def number(value: int) -> Column:
    """An unsigned 64-bit constant as Spark's signed one."""
    return F.lit(value - (1 << BITS) if value >> (BITS - 1) else value).cast("long")


def bucket_rows(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, fp): each node under every mask; the key names the mask and the masked fingerprint."""
    listed = F.array(*[F.struct(F.lit(v).alias("mask"), F.col("fp").bitwiseAND(number(m)).alias("part")) for v, m in enumerate(masks(list(range(BITS)), radius))])
    return nodes.select("fp", F.explode(listed).alias("b")).select(F.col("b.mask").alias("mask"), F.col("b.part").alias("part"), "fp")


def dealt_again(hot: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Members of large buckets under every mask over the places their bucket leaves open."""
    second = second_masks(radius)
    inner = [F.array(*[F.struct(F.lit(w).alias("inner"), F.col("fp").bitwiseAND(number(m)).alias("within")) for w, m in enumerate(listed)]) for listed in second]
    chosen = F.element_at(F.array(*inner), F.col("mask") + 1)
    return hot.select("mask", "part", "fp", F.explode(chosen).alias("i")).select("mask", "part", F.col("i.inner").alias("inner"), F.col("i.within").alias("within"), "fp")


# --- links ---------------------------------------------------------------------------------------------------------------

def spanning(members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b) that span the components of the different fingerprints `members` within the radius.

    Rows are compared in blocks; a pair becomes a link only if it joins two trees."""
    n = len(members)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    step = max(1, COMPARED // n)
    for lo in range(0, n, step):
        block = members[lo:lo + step]
        near = np.bitwise_count(block[:, None] ^ members[None, lo:]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            if j > i:
                x, y = find(lo + i), find(lo + j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(lo + i)
                    b.append(lo + j)
    return np.array(a, np.int64), np.array(b, np.int64)


def bucket_links(rows: DataFrame, names: list[str], radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) of every bucket; rows of one key lie in one task, where buckets follow each other."""
    target = arrow_schema("a long,b long")

    def run(batches):
        for batch in whole_groups(batches, "key"):
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            fp = columns[-1]
            new = np.ones(len(fp), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[1:-1]])
            starts = np.append(np.flatnonzero(new), len(fp))
            left, right = [], []
            for at in np.flatnonzero(np.diff(starts) > 1).tolist():
                members = fp[starts[at]:starts[at + 1]]
                a, b = spanning(members.view(np.uint64), radius)
                left.append(members[a])
                right.append(members[b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=target)

    keyed = rows.select(F.xxhash64(*names).alias("key"), *names, "fp")
    return keyed.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", *names).mapInArrow(run, "a long,b long")


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links that span the components of the nodes (fp) within the radius."""
    rows = bucket_rows(nodes, radius)
    hot = stored_side(rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > bucket).select("mask", "part"), "hot-buckets")
    ordinary = bucket_links(rows.join(hot, ["mask", "part"], "left_anti").select("mask", "part", "fp"), ["mask", "part"], radius)
    large = dealt_again(rows.join(hot, ["mask", "part"]).select("mask", "part", "fp"), radius)
    return ordinary.unionByName(bucket_links(large, ["mask", "part", "inner", "within"], radius)).distinct()


def near_copies(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row; a component is named by its smallest id."""
    rows = stored(fingerprints(docs, size), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(stored(near_links(nodes.select("fp"), radius, bucket), "fingerprint-links"))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = stored_side(linked.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(classed, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
