"""Removal of byte spans that repeat anywhere earlier, by interval expansion on Burrows-Wheeler transforms.

Every string of MIN_BYTES bytes is judged: it goes if an equal one starts earlier (smaller id, or same document and
earlier start). Strings are brought together through anchors: the run of ANCHOR bytes with the smallest hash within the
string (the last of equal ones), which depends on the string alone, so equal strings have equal anchors.

1. Count anchors; only those found twice or more matter.
2. Each occurrence of such an anchor is cut out with all strings it is the anchor of (a context, under 2 * MIN_BYTES
   bytes). Equal contexts are one, kept with its earliest occurrence; all later occurrences go whole.
3. The different contexts of an anchor come to one task. Strings that are alone with an anchor twice as long have no
   equal; a block of the others is put in suffix order. Starting from the
   intervals of suffixes that share STEP bytes, all intervals are extended backwards together, STEP bytes at a time,
   through the transform; this derives common prefixes by increasing value and stops at MIN_BYTES. The strings of one
   remaining interval are equal, and all but the earliest go.

An anchor whose contexts exceed CONTEXT_BYTES is extended to longer anchors, to the right for the strings that reach
further right and to the left for the others, until no group is too large: at MIN_BYTES its contexts are all equal.

Defined cases: a null text reads as empty; texts under MIN_BYTES lose nothing; a null id stands before all others; rows
that share an id are ordered by a hash of their text, and equal rows are one document with equal results; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import GOLDEN, Columns, arrow_schema, map_slices, mix, partitions, stored, texts, whole_groups
from sluiceway.llm.repetition import refine

MIN_BYTES = 100
ANCHOR = 32
STEP = 5
CONTEXT_BYTES = 1 << 20
# What a processor's cache holds: strings whose anchors are found together, and bytes of contexts judged together.
BLOCK = 1 << 17
JUDGED_BYTES = 1 << 16
FIRST_ID = -(1 << 63)

TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (k a power of two) from each position, by doubling."""
    current, width = TABLE[x], 1
    while width < k:
        factor = np.uint64(pow(GOLDEN, width, 1 << 64))
        current = current[:-width] * factor + current[width:]
        width *= 2
    return mix(current)


def window_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of MIN_BYTES bytes the position of its anchor; and the hash at every position."""
    hashes = gram_hashes(x, ANCHOR)
    width = MIN_BYTES - ANCHOR + 1
    # As many bits of a hash count in every block, so that equal strings have equal anchors in all of them.
    low = np.uint64((1 << 24) - 1)
    current = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    n, span = len(hashes) - width + 1, 1
    while 2 * span <= width:
        current = np.minimum(current[:-span], current[span:])
        span *= 2
    if span < width:
        current = np.minimum(current[:n], current[width - span:width - span + n])
    return (low - (current & low)).astype(np.int64), hashes


def occurrences(listed: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, first string, last string, anchor start) of each run of strings with one anchor;
    positions count from the start of the document. Anchors are found BLOCK strings at a time in the
    texts laid side by side; strings that reach over the end of a document are dropped."""
    sizes = np.array([len(b) for b in listed], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    strings = int(sizes.sum()) - MIN_BYTES + 1
    none = np.zeros(0, np.int64)
    if strings <= 0:
        return none, none, none, none, none
    x = np.frombuffer(b"".join(listed), np.uint8)
    # A run ends with the last string of a document, wherever its anchor lies.
    marks = np.unique(np.concatenate([starts, np.maximum(starts, ends - MIN_BYTES + 1)]))
    runs, anchors, keys, before = [], [], [], -1
    for lo in range(0, strings, BLOCK):
        hi = min(strings, lo + BLOCK)
        at, hashes = window_anchors(x[lo:hi + MIN_BYTES - 1])
        fresh = np.append(at[0] + lo != before, at[1:] != at[:-1])
        fresh[marks[np.searchsorted(marks, lo):np.searchsorted(marks, hi)] - lo] = True
        run = np.flatnonzero(fresh)
        runs.append(run + lo)
        anchors.append(at[run] + lo)
        keys.append(hashes[at[run]])
        before = at[-1] + lo
    first, anchor, key = np.concatenate(runs), np.concatenate(anchors), np.concatenate(keys)
    last = np.append(first[1:], strings) - 1
    d = np.searchsorted(starts, first, side="right") - 1
    whole = first + MIN_BYTES <= ends[d]
    d, first, last, anchor = d[whole], first[whole], last[whole], anchor[whole]
    return d, key[whole].view(np.int64), first - starts[d], last - starts[d], anchor - starts[d]


# --- equal strings within a block of contexts -----------------------------------------------------------------------

def packed_order(key: np.ndarray, bits: int) -> np.ndarray:
    """Indices that sort keys below 2**bits stably: one sort of keys with their indices where both fit 64 bits."""
    index_bits = np.uint64(len(key).bit_length())
    if bits + int(index_bits) > 64:
        return np.argsort(key, kind="stable")
    packed = np.sort((key << index_bits) | np.arange(len(key), dtype=np.uint64))
    return (packed & ((np.uint64(1) << index_bits) - np.uint64(1))).astype(np.int64)


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by at least their first MIN_BYTES bytes, and each suffix's rank by its first STEP bytes."""
    n = len(x)
    present = np.zeros(256, bool)
    present[x] = True
    code = np.cumsum(present).astype(np.uint64)
    bits = np.uint64(max(1, int(present.sum()).bit_length()))
    symbols = np.concatenate([code[x], np.zeros(STEP, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(STEP):
        key = (key << bits) | symbols[i:i + n]
    order = packed_order(key, int(bits) * STEP)
    edge = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    start = rank
    alone = edge.copy()
    alone[:-1] &= edge[1:]
    active, h = order[~alone], STEP
    while len(active) and h < MIN_BYTES:
        onward = active + h
        second = np.where(onward < n, rank[np.minimum(onward, n - 1)] + 1, 0)
        rank, active = refine(rank, active, second)
        h *= 2
    return packed_order(rank.astype(np.uint64), n.bit_length()), start


def equal_intervals(x: np.ndarray) -> np.ndarray:
    """For each position the number of the interval of suffixes that share MIN_BYTES bytes with the one there.

    A boundary stands between neighbours in suffix order with a common prefix below the level reached. Extending an
    interval backwards by STEP bytes keeps two neighbours together if they start with the same STEP bytes and no
    boundary lies between the places the transform sends their rests to."""
    n = len(x)
    suffix, start = suffix_order(x)
    place = np.empty(n, np.int64)
    place[suffix] = np.arange(n)
    rest = place[np.minimum(suffix + STEP, n - 1)]
    boundary = np.append(True, start[suffix][1:] != start[suffix][:-1])
    # The last STEP suffixes have no rest; they are shorter than any string asked about.
    boundary[place[max(0, n - STEP):]] = True
    joint = np.flatnonzero(~boundary)
    here, before = rest[joint], rest[joint - 1]
    for _ in range(STEP, MIN_BYTES, STEP):
        passed = np.cumsum(boundary, dtype=np.int32)
        apart = passed[here] != passed[before]
        if not apart.any():
            break
        boundary[joint[apart]] = True
        joint, here, before = joint[~apart], here[~apart], before[~apart]
    return np.cumsum(boundary)[place]


def shared_strings(contexts: list[bytes], at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the strings [from, to) whose longer anchor another context has as well.

    Anchors grow as in `extended`: to the right for strings that reach further right, to the left for the others. Equal
    strings have equal longer anchors, so a string that is alone with its own has no equal."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    base, strings = np.cumsum(sizes) - sizes, sizes - MIN_BYTES + 1
    x = np.frombuffer(b"".join(contexts), np.uint8)
    more = (MIN_BYTES - width + 1) // 2
    split = np.clip(at + width + more - MIN_BYTES, 0, strings)
    # The hash of a range is a difference of sums, brought to one power.
    power = np.cumprod(np.full(len(x) + 1, GOLDEN, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(TABLE[x] * power[:-1]))
    rows = [np.flatnonzero(split < strings), np.flatnonzero(split > 0)]
    starts = np.concatenate([(base + at)[rows[0]], (base + at - more)[rows[1]]])
    row, side = np.concatenate(rows), np.repeat(np.array([0, 1], np.uint64), [len(r) for r in rows])
    hashes = mix((sums[starts + (width + more)[row]] - sums[starts]) * power[len(x) - starts]) + side
    _, kind, n = np.unique(hashes, return_inverse=True, return_counts=True)
    kept = np.zeros((2, len(contexts)), bool)
    kept[side.astype(np.int64), row] = n[kind] > 1
    return np.where(kept[1], 0, split), np.where(kept[0], strings, split)


def later_strings(contexts: list[bytes], order: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each string that an earlier one equals; `order` ranks contexts by place in the corpus."""
    lo, hi = shared_strings(contexts, at, width)
    asked = np.flatnonzero(lo < hi)
    if not len(asked):
        return asked, asked
    pieces = [contexts[c][s:e - 1 + MIN_BYTES] for c, s, e in zip(asked.tolist(), lo[asked].tolist(), hi[asked].tolist())]
    number = equal_intervals(np.frombuffer(b"".join(pieces), np.uint8))
    counts = (hi - lo)[asked]
    sizes = counts - 1 + MIN_BYTES
    piece = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    interval = number[(np.cumsum(sizes) - sizes)[piece] + inside]
    context, offset = asked[piece], lo[asked][piece] + inside
    when = order[context] * (2 * MIN_BYTES) + offset
    earliest = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, interval, when)
    later = when != earliest[interval]
    return context[later], offset[later]


def spans_of(context: np.ndarray, offset: np.ndarray, n: int) -> list[list[int]]:
    """For each of n contexts the byte ranges [start, end) that its later strings cover, flattened."""
    out: list[list[int]] = [[] for _ in range(n)]
    if len(context):
        edge = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)))
        last = np.append(edge[1:], len(context)) - 1
        for c, s, e in zip(context[edge].tolist(), offset[edge].tolist(), offset[last].tolist()):
            out[c] += [s, e + MIN_BYTES]
    return out


# --- Spark -----------------------------------------------------------------------------------------------------------

def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text, row_id): ids without null, and a hash of the text where ids repeat."""
    read = texts(docs).withColumn("row_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(FIRST_ID)))
    unique = read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return read.withColumn("tie", F.lit(0).cast("long") if unique else F.xxhash64("text"))


def encoded(listed: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in listed]


def repeated_anchors(read: DataFrame) -> DataFrame:
    def start():
        def work(rows: Columns) -> Columns:
            found, counts = np.unique(occurrences(encoded(rows["text"]))[1], return_counts=True)
            return {"g": found, "n": counts}

        return work

    return map_slices(read.select("text"), start, "g long,n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")


def all_occurrences(read: DataFrame) -> DataFrame:
    """(g, doc_id, tie, code): first string, strings less one, and anchor offset in one number."""

    def start():
        def work(rows: Columns) -> Columns:
            d, g, a, b, at = occurrences(encoded(rows["text"]))
            ids, ties = np.array(rows["doc_id"], dtype=np.int64), np.array(rows["tie"], dtype=np.int64)
            return {"g": g, "doc_id": ids[d], "tie": ties[d], "code": (a << 16) | ((b - a) << 8) | (at - a)}

        return work

    return map_slices(read.select("doc_id", "tie", "text"), start, "g long,doc_id long,tie long,code long")


def flat(listed: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and which list each is from."""
    counts = [len(x) if x else 0 for x in listed]
    numbers = np.fromiter(chain.from_iterable(x for x in listed if x), np.int64, sum(counts))
    return numbers, np.repeat(np.arange(len(listed)), counts)


def cut_contexts(read: DataFrame, found: DataFrame) -> DataFrame:
    """(g, context, at, doc_id, tie, a): the strings around each repeated anchor."""
    joined = read.select("doc_id", "tie", "text").join(found, ["doc_id", "tie"]).select("doc_id", "tie", "text", "places.g", "places.code")

    def start():
        def work(rows: Columns) -> Columns:
            (g, d), (code, _) = flat(rows["g"]), flat(rows["code"])
            first = code >> 16
            last = first + ((code >> 8) & 255) + MIN_BYTES
            ids, ties, data = np.array(rows["doc_id"], dtype=np.int64), np.array(rows["tie"], dtype=np.int64), encoded(rows["text"])
            cut = [data[i][s:e] for i, s, e in zip(d.tolist(), first.tolist(), last.tolist())]
            return {"g": g, "context": cut, "at": (code & 255).astype(np.int32), "doc_id": ids[d], "tie": ties[d], "a": first}

        return work

    return map_slices(joined, start, "g long,context binary,at int,doc_id long,tie long,a long")


def earliest(contexts: DataFrame) -> DataFrame:
    """Different contexts with their earliest place; `origin` is the context of the text it was cut from."""
    return contexts.groupBy("g", "context").agg(F.min(F.struct("doc_id", "tie", "a", "origin")).alias("p"), F.min("at").alias("at"), F.min("width").alias("width")).select(
        "g", "context", "p.doc_id", "p.tie", "p.a", "p.origin", "at", "width")


def extended(contexts: DataFrame) -> DataFrame:
    """Contexts of anchors longer by half of what is missing to MIN_BYTES, to the right or to the left."""
    schema = "g long,context binary,at int,width int,doc_id long,tie long,a long,origin long"

    def start():
        def work(rows: Columns) -> Columns:
            out: Columns = {name: [] for name in ("g", "context", "at", "width", "doc_id", "tie", "a", "origin")}
            for c, at, width, doc_id, tie, a, origin in zip(*(rows[k] for k in ("context", "at", "width", "doc_id", "tie", "a", "origin"))):
                more = (MIN_BYTES - width + 1) // 2
                strings = len(c) - MIN_BYTES + 1
                # From this offset on a string reaches `more` bytes past the anchor; before it, it starts as much ahead.
                split = min(strings, max(0, at + width + more - MIN_BYTES))
                for lo, hi, start_at in ((split, strings, at), (0, split, at - more)):
                    if lo < hi:
                        anchor = c[start_at:start_at + width + more]
                        out["g"].append(int.from_bytes(hashlib.blake2b(anchor, digest_size=8).digest(), "little", signed=True))
                        out["context"].append(c[lo:hi - 1 + MIN_BYTES])
                        out["at"].append(start_at - lo)
                        out["width"].append(width + more)
                        for name, value in (("doc_id", doc_id), ("tie", tie), ("a", a + lo), ("origin", origin)):
                            out[name].append(value)
            return out

        return work

    return map_slices(contexts, start, schema, "context")


def sharing(keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys equal a neighbour."""
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    return same[1:] | same[:-1]


def judged(contexts: DataFrame) -> DataFrame:
    """(doc_id, tie, origin, spans): for each context the byte ranges that go, from the start of its document.

    Equal strings have their anchor at the same offset, and all strings of a context have one anchor place, so no two
    of them are equal. A context that is the only one of its anchor therefore needs no comparison."""
    target = arrow_schema("doc_id long,tie long,origin long,spans array<long>")

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        cut, doc_id, tie, a, origin, at, width = (table.column(k) for k in ("context", "doc_id", "tie", "a", "origin", "at", "width"))
        cut = cut.to_pylist()
        starts = a.to_numpy()
        by_place = np.lexsort((starts, tie.to_numpy(), doc_id.to_numpy()))
        order = np.empty(len(cut), np.int64)
        order[by_place] = np.arange(len(cut))
        spans = spans_of(*later_strings(cut, order, at.to_numpy().astype(np.int64), width.to_numpy().astype(np.int64)), len(cut))
        spans = [[v + s for v in listed] for listed, s in zip(spans, starts.tolist())]
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (doc_id, tie, origin)] + [pa.array(spans, target.field("spans").type)], schema=target)

    def settled(part: pa.RecordBatch) -> pa.RecordBatch:
        """Contexts without another one of their anchor: nothing goes."""
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "tie", "origin")), pa.array([[]] * part.num_rows, target.field("spans").type)], schema=target)

    def run(batches):
        held, size = [], 0
        for part in whole_groups(batches, "g"):
            shared = sharing(part.column("g").to_numpy(zero_copy_only=False))
            yield settled(part.filter(pa.array(~shared)))
            part, lo = part.filter(pa.array(shared)), 0
            keys = part.column("g").to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(pc.binary_length(part.column("context")).to_numpy(zero_copy_only=False), dtype=np.int64))
            for hi in (np.flatnonzero(np.append(keys[1:] != keys[:-1], True)[:len(keys)]) + 1).tolist():
                if size + upto[hi] - upto[lo] >= JUDGED_BYTES:
                    yield block([*held, part.slice(lo, hi - lo)])
                    held, size, lo = [], 0, hi
            if lo < len(keys):
                held.append(part.slice(lo))
                size += int(upto[-1] - upto[lo])
        if held:
            yield block(held)

    dealt = contexts.select("g", "context", "doc_id", "tie", "a", "origin", "at", "width").repartition(partitions(contexts.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "doc_id long,tie long,origin long,spans array<long>")


def removals(read: DataFrame, context_bytes: int = CONTEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repeated anchors' occurrences by document, and what goes of the contexts that are the earliest of their kind."""
    anchors = stored(repeated_anchors(read), "anchors")
    found = stored(
        all_occurrences(read).join(anchors, "g", "left_semi").groupBy("doc_id", "tie").agg(F.collect_set(F.struct("g", "code")).alias("places")), "occurrences")
    cut = cut_contexts(read, found).select("*", F.lit(ANCHOR).alias("width"), F.col("a").alias("origin"))
    contexts, results = stored(earliest(cut), "contexts"), []
    while True:
        large = stored(contexts.groupBy("g").agg(F.sum(F.octet_length("context")).alias("bytes")).where(F.col("bytes") > context_bytes).select("g"), "large-anchors")
        if large.isEmpty():
            results.append(judged(contexts))
            break
        results.append(judged(contexts.join(large, "g", "left_anti")))
        longer = stored(extended(contexts.join(large, "g", "left_semi")), "extended")
        contexts = stored(earliest(longer), "contexts")
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"e.{k}")) for k in ("g", "context")]
        repeated = longer.alias("l").join(contexts.alias("e"), same[0] & same[1]).where(
            (F.col("l.doc_id") != F.col("e.doc_id")) | (F.col("l.tie") != F.col("e.tie")) | (F.col("l.a") != F.col("e.a")))
        results.append(repeated.select("l.doc_id", "l.tie", "l.origin", F.array(F.col("l.a"), F.col("l.a") + F.octet_length("l.context")).alias("spans")))
    judged_all = results[0]
    for more in results[1:]:
        judged_all = judged_all.unionByName(more)
    firsts = stored(judged_all.groupBy("doc_id", "tie").agg(F.collect_list("origin").alias("origins"), F.flatten(F.collect_list("spans")).alias("spans")), "firsts")
    return found, firsts


def removed_runs(sizes: np.ndarray, codes: list, origins: list, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each run of bytes that goes: all strings of contexts that are not the earliest, and the
    judged spans of those that are, united within a document. Places count over the documents laid side by side."""
    starts = np.cumsum(sizes) - sizes
    code, owner = flat(codes)
    first = (code >> 16) + starts[owner]
    origin, owner_of = flat(origins)
    later = ~np.isin(first, origin + starts[owner_of])
    bounds, of = flat(spans)
    bounds += starts[of]
    doc = np.concatenate([owner[later], of[::2]])
    begin = np.concatenate([first[later], bounds[::2]])
    end = np.concatenate([(first + ((code >> 8) & 255))[later] + MIN_BYTES, bounds[1::2]])
    order = np.argsort(begin)
    doc, begin, reach = doc[order], begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.append(True, (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))[:len(doc)])
    return doc[fresh], begin[fresh], reach[np.append(fresh[1:], len(doc))[:len(fresh)] - 1]


def without(listed: list[bytes], codes: list, origins: list, spans: list) -> Columns:
    """Per document: bytes, bytes and spans that go, digest of what is left."""
    sizes = np.array([len(b) for b in listed], dtype=np.int64)
    doc, begin, end = removed_runs(sizes, codes, origins, spans)
    removed = np.zeros(len(listed), np.int64)
    np.add.at(removed, doc, end - begin)
    at = (np.cumsum(sizes) - sizes)[doc]
    bounds = np.stack([begin - at, end - at], axis=1)
    first = np.searchsorted(doc, np.arange(len(listed) + 1))
    digests = []
    for data, lo, hi in zip(listed, first[:-1].tolist(), first[1:].tolist()):
        # From the end of one run to the start of the next.
        edges = [0, *bounds[lo:hi].ravel().tolist(), len(data)] if hi > lo else [0, len(data)]
        digests.append(hashlib.sha256(b"".join([data[s:e] for s, e in zip(edges[::2], edges[1::2])])).hexdigest())
    return {"n_bytes": sizes, "n_removed": removed, "n_spans": np.diff(first), "kept_sha256": digests}


def remove_repeats(docs: DataFrame, context_bytes: int = CONTEXT_BYTES) -> DataFrame:
    """One row per document: bytes, bytes and spans removed, digest of what is left."""
    read = keyed_texts(docs)
    found, firsts = removals(read, context_bytes)
    both = stored(found.select("doc_id", "tie", "places.code").join(firsts, ["doc_id", "tie"], "left"), "decisions")
    joined = read.join(both, ["doc_id", "tie"], "left").select("row_id", "text", "code", "origins", "spans")

    def start():
        def work(rows: Columns) -> Columns:
            return {"doc_id": rows["row_id"]} | without(encoded(rows["text"]), rows["code"], rows["origins"], rows["spans"])

        return work

    return map_slices(joined, start, "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string")
