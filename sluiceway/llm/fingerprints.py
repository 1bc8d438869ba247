"""Document fingerprints by Order MinHash.

A text's items are its runs of K words, numbered by occurrence: the second run of the same words is another item than
the first. For each of SKETCHES hash functions the PICKED items with the smallest hashes are kept in text order, and
that tuple is hashed. Two texts agree in a sketch if they share the smallest items and have them in the same order, so
the share of equal sketches falls with edit distance, moved passages included.

A document is compared with its edited text, whose last quarter is replaced by the beginning of the next document, and
with the next document itself. Documents are dealt by ranges of the id, and the first document of each range is sent
to the range before it as well; nothing else crosses, so one shuffle of the texts is enough.

Defined cases: a null text reads as empty; texts without words share one fingerprint (likeness 1); fewer than K words
make one item; fewer than PICKED items are hashed as they are; rows with equal ids stand in text order and the next of
one may be another; a null id stands first; the last document's next is the first one; a single row is its own next; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import GOLDEN, MASK, WordHashes, arrow_schema, mix, order_by, partitions, range_bucket, slices, texts

K = 2
PICKED = 2
SKETCHES = 64
NONE = np.uint64(MASK)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    return numbers[:n], numbers[n:] | np.uint64(1)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; one of all words if there are fewer."""
    if not len(hashes):
        return hashes
    width = min(k, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = mix(out * np.uint64(GOLDEN) + hashes[i:i + n])
    return out


def numbered(items: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Items made distinct by their occurrence within their document."""
    key = mix(items ^ mix(owner.astype(np.uint64)))
    order = order_by(key)
    at = np.arange(len(key))
    edge = np.ones(len(key), bool)
    edge[1:] = key[order][1:] != key[order][:-1]
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(edge, at, 0))).astype(np.uint64)
    return mix(items + np.uint64(GOLDEN) * occurrence)


class Segments:
    """Items of several segments one after another, each followed by a blank so that none is empty."""

    def __init__(self, parts: list[np.ndarray], offset: int):
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(parts) else np.zeros(0, np.int64)
        self.items = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint64))]) if parts else np.zeros(0, np.uint64)
        self.blank = self.starts + sizes - 1
        self.places = np.arange(offset, offset + len(self.items), dtype=np.uint64)

    def smallest(self, a: np.uint64, b: np.uint64, low: np.uint64, picked: int, offset: int) -> np.ndarray:
        """For each segment the `picked` smallest hashes, with the item's place in the low bits."""
        key = (((self.items ^ a) * b) & ~low) | self.places
        key[self.blank] = NONE
        out = []
        for turn in range(picked):
            best = np.minimum.reduceat(key, self.starts)
            out.append(best)
            if turn + 1 < picked:
                real = best[best != NONE]
                key[(real & low).astype(np.int64) - offset] = NONE
        return np.stack(out, 1)


def sketch(candidates: np.ndarray, items: np.ndarray, low: np.uint64, picked: int) -> np.ndarray:
    chosen = np.sort(candidates, 1)[:, :picked]
    places = np.sort(np.where(chosen == NONE, NONE, chosen & low), 1)
    out = np.zeros(len(places), np.uint64)
    for i in range(picked):
        column = places[:, i]
        there = column != NONE
        item = np.where(there, items[np.where(there, column, np.uint64(0)).astype(np.int64)] if len(items) else np.uint64(0), np.uint64(0))
        out = mix(out * np.uint64(GOLDEN) + item)
    return (out >> np.uint64(48)).astype(">u2")


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut] if cut else text


def fingerprint_pairs(originals: list[str], edits: list[str], words: WordHashes, k: int = K, picked: int = PICKED, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (a row per text) of the originals and of their edited texts. Items before the edit are hashed once."""
    heads, tails, news = [], [], []
    first, second = [], []
    for text, other in zip(originals, edits):
        own = text.split()
        a = words.of(own)
        same = other == text
        b = a if same else words.of(other.split())
        first.append(runs(a, k))
        second.append(first[-1] if same else runs(b, k))
    shared = [len(x) if x is y else common_prefix(x, y) for x, y in zip(first, second)]

    def numbered_all(listed: list[np.ndarray]) -> list[np.ndarray]:
        sizes = [len(x) for x in listed]
        flat = np.concatenate(listed) if listed else np.zeros(0, np.uint64)
        done = numbered(flat, np.repeat(np.arange(len(listed)), sizes))
        return np.split(done, np.cumsum(sizes)[:-1]) if listed else []

    for x, y, n in zip(numbered_all(first), numbered_all(second), shared):
        heads.append(x[:n])
        tails.append(x[n:])
        news.append(y[n:])
    head, tail = Segments(heads, 0), None
    tail = Segments(tails, len(head.items))
    new = Segments(news, len(head.items) + len(tail.items))
    items = np.concatenate([head.items, tail.items, new.items])
    low = np.uint64((1 << max(1, int(len(items)).bit_length())) - 1)
    own, other = [], []
    for a, b in zip(*seeds(sketches)):
        h = head.smallest(a, b, low, picked, 0)
        t = tail.smallest(a, b, low, picked, len(head.items))
        n = new.smallest(a, b, low, picked, len(head.items) + len(tail.items))
        own.append(sketch(np.concatenate([h, t], 1), items, low, picked))
        other.append(sketch(np.concatenate([h, n], 1), items, low, picked))
    return np.stack(own, 1), np.stack(other, 1)


def common_prefix(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, guest) dealt and sorted so that the row after a document is its next. The guest that ends
    each bucket is the first row of the next one. The driver gets one id per bucket."""
    spark = docs.sparkSession
    n = partitions(spark)
    bounds = sorted({int(b) for b in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    dealt = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds).cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.col("digest"))
    firsts = dealt.select("doc_id", "bucket", F.md5("text").alias("digest")).groupBy("bucket").agg(F.min(order).alias("first")).orderBy("bucket").collect()
    buckets = [r.bucket for r in firsts]
    sent = {(r.first.doc_id, r.first.digest): buckets[i - 1] for i, r in enumerate(firsts)}
    # One entry per bucket at most.
    guests = spark.createDataFrame([(k[0], k[1], b) for k, b in sent.items()], "first_id long, first_digest string, sent_to int")
    keyed = dealt.withColumn("digest", F.md5("text"))
    extra = keyed.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))).dropDuplicates(["doc_id", "digest"])
    columns = ["doc_id", "text", "digest"]
    whole = keyed.select(*columns, "bucket", F.lit(0).alias("guest")).unionByName(extra.select(*columns, F.col("sent_to").alias("bucket"), F.lit(1).alias("guest")))
    return whole.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "digest").select("doc_id", "text", "bucket", "guest")


def order_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, picked: int = PICKED, sketches: int = SKETCHES) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike they and the next document's are."""
    schema = "doc_id long,n_chars long,edited_sha256 string,fingerprint string,edited_fingerprint string,near_edited double,near_next double"
    target = arrow_schema(schema)

    def work(ids: list, listed: list[str], words: WordHashes) -> pa.RecordBatch:
        """The last text is only there as the next of the one before."""
        changed = [edited(t, after) for t, after in zip(listed, listed[1:])]
        own, other = fingerprint_pairs(listed, [*changed, listed[-1]], words, k, picked, sketches)
        near_edited, near_next = (own[:-1] == other[:-1]).mean(1), (own[:-1] == own[1:]).mean(1)
        out = {
            "doc_id": ids, "n_chars": [len(t) for t in listed[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [row.tobytes().hex() for row in own[:-1]], "edited_fingerprint": [row.tobytes().hex() for row in other[:-1]],
            "near_edited": near_edited, "near_next": near_next,
        }
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    def run(batches):
        words = WordHashes()
        ids: list = []
        held: list[str] = []
        for part in slices(batches, "text", 1 << 20):
            listed, guest = part.column(1).to_pylist(), part.column(3).to_pylist()
            numbers = part.column(0).to_pylist()
            start = 0
            for i, g in enumerate(guest):
                if g:
                    ids += numbers[start:i]
                    held += listed[start:i + 1]
                    if ids:
                        yield work(ids, held, words)
                    ids, held, start = [], [], i + 1
            ids += numbers[start:]
            held += listed[start:]
            if len(held) > 1:
                yield work(ids[:-1], held, words)
                ids, held = ids[-1:], held[-1:]

    return with_next(texts(docs, id_col, text_col)).mapInArrow(run, schema)
