"""Operators that look across documents, and the pipeline: against brute force, on awkward rows, and on empty tables."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from awkward_rows import AWKWARD, DATA, LONG, awkward, frame, given, listed, no_docs, plain, prose  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from sluiceway.llm import components, fingerprints, mixing, near_copies, repeated_spans, toxicity
from sluiceway.llm.common import range_bucket
from sluiceway.llm.queries import tokenizer_path


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def brute_classes(rows):
    """Components of all pairs of texts with probability Jaccard 0.8 or equal texts; the smallest id names a class."""
    shingles = [near_copies.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or near_copies.probability_jaccard(shingles[i], shingles[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {frozenset(g) for g in groups.values()}


def listed_classes(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    return Counter(tuple(sorted(g, key=lambda i: (i is None, i or 0))) for g in got.values())


def brute_list(rows):
    """As listed_classes, with classes of the same name joined."""
    by = {}
    for k, g in enumerate(brute_groups(rows)):
        ids = sorted(g, key=lambda i: (i is None, i or 0))
        by.setdefault(ids[0] if ids[0] is not None else f"unnamed {k}", []).extend(ids)
    return Counter(tuple(sorted(g, key=lambda i: (i is None, i or 0))) for g in by.values())


def brute_groups(rows):
    places = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    return [[rows[k][0] for k in sorted(places_of)] for places_of in places]


@pytest.mark.parametrize("least", [near_copies.LEAST_AGREEMENT, 0.0])
def test_near_copies(given, awkward, no_docs, least):
    docs = given("documents")
    got = {}
    for r in near_copies.near_copy_classes(docs, least).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == brute_classes(plain(docs)) and all(k == min(v) for k, v in got.items())
    assert near_copies.near_copy_classes(no_docs).count() == 0
    assert listed_classes(near_copies.near_copy_classes(awkward, least)) == brute_list([(i, t or "") for i, t in AWKWARD])


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    same = prose(21, 90)
    rows = [(5, prose(20, 60)), (5, same), (7, same + " tail"), (None, same + " other end"), (None, prose(22, 40)), (None, prose(22, 40)), (None, prose(23, 40)), (5, same), (9, prose(20, 60) + " x")]
    docs = frame(spark, rows)
    got = near_copies.near_copy_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id if r.class_id >= 0 else "none") for r in got) == Counter(
        {(5, 5): 3, (7, 5): 1, (None, 5): 1, (9, 5): 1, (None, "none"): 3}) and len({r.class_id for r in got if r.class_id < 0}) == 2
    assert Counter((r.doc_id, r.text) for r in near_copies.keep_one_of_each(docs).collect()) == Counter(
        [(5, prose(20, 60)), (5, same), (None, prose(22, 40)), (None, prose(23, 40))])


def test_copies_at_many_distances(spark):
    """Planted copies with more and more words changed: exactly those at 0.8 or more are linked to their original."""
    r, rows, want = random.Random(11), [], 0
    for k in range(120):
        words = prose(1000 + k, 120).split()
        own = list(words)
        for p in r.sample(range(120), k % 9):
            own[p] = f"new{p}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(own))]
    by = listed(near_copies.near_copy_classes(frame(spark, rows)))
    for k in range(120):
        close = near_copies.probability_jaccard(near_copies.shingles(rows[2 * k][1]), near_copies.shingles(rows[2 * k + 1][1])) >= 0.8
        want += close
        assert by[2 * k + 1].class_id == (2 * k if close else 2 * k + 1)
    assert 40 < want < 110


def test_one_of_each_stays(awkward, no_docs):
    kept = near_copies.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and near_copies.keep_one_of_each(no_docs).count() == 0
    left = Counter(r.doc_id for r in kept.collect())
    assert left[5] == 1 and left[6] == left[7] == left[8] == left[9] == 0 and left[-3] == 1 and left[11] == 1 and left[None] == 1


def test_links_between_copies_of_a_weak_pivot(spark, monkeypatch):
    """The smallest document of the buckets is like none of the others enough; they are found by the second search."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    words = prose(9, 400).split()
    rows = [(0, " ".join(words[:290] + prose(10, 110).split()))]
    for k in range(1, 9):
        own = list(words)
        own[10 * k] = f"changed{k}"
        rows.append((k, " ".join(own)))
    got = listed(near_copies.near_copy_classes(frame(spark, rows)))
    assert got[0].class_id == 0 and {got[k].class_id for k in range(1, 9)} == {1}


def test_probability_jaccard_by_its_definition():
    x, y = Counter(a=3, b=1, c=2), Counter(a=1, b=1, d=5)
    want = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x | y) for d in x.keys() & y.keys())
    assert abs(near_copies.probability_jaccard(x, y) - want) < 1e-12


def test_signatures_estimate_it():
    r = random.Random(4)
    items = [r.getrandbits(64) for _ in range(300)]
    a = {h: r.randint(1, 4) for h in items[:220]}
    b = {h: a.get(h, 2) + (k % 5 == 0) for k, h in enumerate(items[60:])}
    flat = np.array([*a, *b], dtype=np.uint64)
    owner = np.repeat([0, 1], [len(a), len(b)])
    sig = near_copies.prob_minhash(flat, owner, np.array([*a.values(), *b.values()]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - near_copies.probability_jaccard(Counter(a), Counter(b))) < 0.03


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 105), (105, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[105] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows):
    seen, out = set(), Counter()
    for i, t in rows:
        data = t.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            part = data[s:s + 100]
            if part in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(part)
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out[(i, len(data), sum(gone), spans, sha(bytes(x for x, g in zip(data, gone) if not g)))] += 1
    return out


def removed(docs, **kw):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans.remove_repeats(docs, **kw).collect())


def test_repeated_spans(given, no_docs):
    docs = given("documents")
    want = brute_removal(sorted(plain(docs)))
    assert removed(docs) == want
    # With almost no room every anchor is extended, some of them to whole strings.
    assert removed(docs, context_bytes=400) == want
    assert removed(no_docs) == Counter()


def test_repeated_spans_of_awkward_rows(spark):
    passage = prose(21, 60)
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 11 and i != 12] + [(30, "ab" * 400), (31, passage + " x " + passage), (32, passage[7:] + "é"), (33, "é" * 120), (34, None)]
    assert removed(frame(spark, rows)) == brute_removal(sorted((i, t or "") for i, t in rows))
    once = frame(spark, [(1, LONG), (None, passage), (2, passage), (2, passage), (3, LONG[:500])])
    got = listed(repeated_spans.remove_repeats(once.where("doc_id is null or doc_id <> 2")))
    assert got[None].n_removed == 0 and got[1].n_removed == 0 and got[3].n_removed == got[3].n_bytes
    twice = [r for r in repeated_spans.remove_repeats(once).collect() if r.doc_id == 2]
    assert [r.n_removed for r in twice] == [len(passage.encode())] * 2


def test_repeated_spans_find_anchors_in_blocks(monkeypatch):
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (0, 99, 300, 0, 100, 1500, 5, 0)]
    whole = repeated_spans.occurrences(texts)
    for d, a, b, at in zip(*(whole[k].tolist() for k in (0, 2, 3, 4))):
        hashes = repeated_spans.gram_hashes(np.frombuffer(texts[d], np.uint8), repeated_spans.ANCHOR) >> np.uint64(24)
        for s in range(a, b + 1):
            window = hashes[s:s + repeated_spans.MIN_BYTES - repeated_spans.ANCHOR + 1]
            assert at == s + int(np.flatnonzero(window == window.min())[-1])
    strings = [max(0, len(t) - repeated_spans.MIN_BYTES + 1) for t in texts]
    assert int((whole[3] - whole[2] + 1).sum()) == sum(strings)
    monkeypatch.setattr(repeated_spans, "BLOCK", 37)
    assert all(np.array_equal(x, y) for x, y in zip(whole, repeated_spans.occurrences(texts)))
    monkeypatch.undo()
    # A slice of texts is worked on in pieces that stay in a processor's cache, not in arrays of eight bytes a byte.
    large = [r.randbytes(1 << 21)]
    tracemalloc.start()
    repeated_spans.occurrences(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_repeated_spans_judge_strings_with_a_shared_longer_anchor(monkeypatch):
    r = random.Random(9)
    anchor, far = r.randbytes(32), r.randbytes(34)
    left, right = r.randbytes(68), far + r.randbytes(34)
    # Two contexts share the anchor alone, two of them 34 bytes to its right, and two share all.
    alone = [r.randbytes(68) + anchor + r.randbytes(68) for _ in range(2)]
    half = [r.randbytes(68) + anchor + far + r.randbytes(34)]
    contexts = [*alone, *half, left + anchor + right, left[20:] + anchor + right]
    at, width, asked = np.array([68, 68, 68, 68, 48]), np.full(5, 32), []
    judge = repeated_spans.equal_intervals
    monkeypatch.setattr(repeated_spans, "equal_intervals", lambda x: (asked.append(len(x)), judge(x))[1])
    context, offset = repeated_spans.later_strings(contexts, np.array([4, 3, 2, 1, 0]), at, width)
    # The last one comes first: the strings of the fourth from its offset 20 on are later than those.
    assert set(context.tolist()) == {3} and offset.tolist() == list(range(20, 69))
    assert asked[0] == 34 + 100 + sum(len(c) for c in contexts[3:])
    assert len(repeated_spans.later_strings(contexts[:2], np.array([0, 1]), at[:2], width[:2])[0]) == 0 and len(asked) == 1


def test_repeated_spans_cut_documents_side_by_side():
    texts = [b"", b"x" * 120, b"y" * 130, b"z" * 10, b""]
    # One later context of 110 bytes, one earliest context with two judged spans; spans end with their document.
    codes = [None, [(0 << 16) | (20 << 8)], [(0 << 16) | (5 << 8), (25 << 16) | (5 << 8)], None, []]
    got = repeated_spans.without(texts, codes, [None, None, [0], None, None], [None, None, [0, 10, 12, 20], None, []])
    assert [list(map(int, got[k])) for k in ("n_bytes", "n_removed", "n_spans")] == [[0, 120, 130, 10, 0], [0, 120, 123, 0, 0], [0, 1, 3, 0, 0]]
    assert got["kept_sha256"] == [sha(""), sha(""), sha("y" * 7), sha("z" * 10), sha("")]
    # Runs that touch are one, and the work follows the runs and not the bytes.
    large = [b"q" * (1 << 21)]
    tracemalloc.start()
    got = repeated_spans.without(large, [[0]], [[0]], [[100, 300, 200, 250, 300, 500, 600, 700]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int(got[k][0]) for k in ("n_removed", "n_spans")] == [500, 2] and peak < 8 << 20


def test_order_fingerprints(given, awkward, no_docs):
    docs = given("documents")
    rows = sorted(plain(docs))
    got = listed(fingerprints.order_fingerprints(docs))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(t[:len(t) - cut] + after[:cut] if cut else t)
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    near, far = np.mean([r.near_edited for r in got.values()]), np.mean([r.near_next for r in got.values()])
    assert near > 0.25 > 0.05 > far
    assert fingerprints.order_fingerprints(no_docs).count() == 0
    odd = fingerprints.order_fingerprints(awkward).collect()
    assert len(odd) == len(AWKWARD) and {r.fingerprint for r in odd if r.n_chars == 0} == {next(r.fingerprint for r in odd if r.doc_id == 3)}
    assert fingerprints.order_fingerprints(awkward.where("doc_id = 7")).first().near_next == 1.0


def test_order_minhash_by_its_definition():
    """One text's sketches, computed item by item."""
    text = prose(12, 50) + " " + prose(12, 9)
    words = fingerprints.WordHashes()
    own, _ = fingerprints.fingerprint_pairs([text], [text], words)
    items, seen = [], Counter()
    for h in fingerprints.runs(words.of(text.split()), fingerprints.K).tolist():
        items.append(int(fingerprints.mix(np.array([h], dtype=np.uint64) + np.uint64(fingerprints.GOLDEN * seen[h] & fingerprints.MASK))[0]))
        seen[h] += 1
    want = []
    for a, b in zip(*(x.tolist() for x in fingerprints.seeds(fingerprints.SKETCHES))):
        best = sorted(range(len(items)), key=lambda p: ((items[p] ^ a) * b & fingerprints.MASK))[:fingerprints.PICKED]
        out = np.zeros(1, np.uint64)
        for p in sorted(best):
            out = fingerprints.mix(out * np.uint64(fingerprints.GOLDEN) + np.uint64(items[p]))
        want.append(int(out[0] >> np.uint64(48)))
    assert own[0].tolist() == want


def test_range_buckets(spark):
    bounds = [-5, 0, 3, 9, 10, 400]
    got = {r.id: r.b for r in spark.range(-10, 500).select("id", range_bucket(F.col("id"), bounds).alias("b")).collect()}
    assert all(b == sum(x <= i for x in bounds) for i, b in got.items())


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left, heavy = total - sum(full.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * left > 3 * sizes[s] * heavy]
        if not over:
            return full | {s: weight[s] * left / heavy for s in rest}
        full |= {s: 3 * sizes[s] for s in over}


def repeated(spark, seed=1):
    """Repeated and null ids: (rows, source) of the same id and text, of the same id, and of no id."""
    r = random.Random(seed)
    rows = [(None, "w " * r.randint(0, 3), "nulls") for _ in range(1000)]
    rows += [(k % 2, "a b c"[: 1 + 2 * (k % 2)], "two") for k in range(1000)] + [(7, "x " * 9, "one")] * 900 + [(7, "y " * k, "one") for k in range(40)]
    rows += [(k, "z " * r.randint(1, 900), f"s{k % 9}") for k in range(2000, 2400)] + [(None, None, None)] * 3
    r.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", s, 1, "clash", 1, "clash") for i, t, s in rows], frame(spark, AWKWARD).schema)


def test_source_mix(spark, given, awkward, no_docs):
    for docs in (given("documents"), awkward, repeated(spark)):
        sized = mixing.sizes(docs)
        plan = mixing.plan_sized(sized)
        got = mixing.mix(sized, plan).collect()
        words = Counter()
        for r in got:
            words[r.source] += r.size
        targets, taken = brute_targets(dict(words)), Counter()
        largest = {s: max(r.size for r in got if r.source == s) for s in words}
        assert len(got) == docs.count()
        for r in got:
            assert r.source_size == words[r.source] and abs(r.target - targets[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert sum(targets.values()) == pytest.approx(sum(words.values()))
        assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in words)
        again = Counter((r.doc_id, r.size, r.copies) for r in mixing.mix(sized, mixing.plan_mix(docs.repartition(3))).collect())
        assert again == Counter((r.doc_id, r.size, r.copies) for r in got)
        mixed = mixing.mixed_documents(docs, plan)
        assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    empty = mixing.sizes(no_docs)
    assert mixing.mix(empty, mixing.plan_sized(empty)).count() == 0


def test_level_of_many_sources(spark):
    r = random.Random(4)
    for n in (1, 2, 40):
        words = {f"u{k:03d}": r.choice([0, 1, r.randint(1, 9), r.randint(1, 9000)]) for k in range(n)}
        words[None] = 5
        sized = spark.createDataFrame([(s, w) for s, w in words.items()], "source string, size long")
        assert {t.source: t.target for t in mixing.source_targets(sized).collect()} == pytest.approx({k: float(v) for k, v in brute_targets(words).items()})


def test_inclusion_adds_up_to_what_is_needed(spark):
    r = random.Random(5)
    for share in (0.01, 0.4, 0.97):
        found = [r.choice([r.randint(1, 20), r.randint(1, 4000)]) for _ in range(3000)]
        needed = share * sum(found)
        sized = spark.createDataFrame([("s", w) for w in found], "source string, size long")
        targets = spark.createDataFrame([("s", needed)], "source string, needed double")
        factor = mixing.inclusion_factors(sized, targets).first().factor
        assert sum(min(1.0, factor * w**0.5) * w for w in found) == pytest.approx(needed, rel=0.02)


def test_sample_of_repeated_ids_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "other") for k in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    sample, _ = toxicity.labelled_sample(docs, labels, 5)
    assert sample.count() <= 10 and sample.select("doc_id").distinct().count() == sample.count()


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~held), rows=1500)
    assert list(model.thresholds) == sorted(model.thresholds)
    test = labels.where(held).join(toxicity.severity(docs, model).withColumnRenamed("toxic", "rejected"), "doc_id")
    table = {(r.toxic, r.rejected): r["count"] for r in test.groupBy("toxic", "rejected").count().collect()}
    assert table[(1, True)] / (table[(1, True)] + table.get((1, False), 0)) > 0.85
    assert table.get((0, True), 0) / table[(0, False)] < 0.01


def test_toxicity_of_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, None), (None, 1), (99, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    got = toxicity.severity(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in got)
    untrained = toxicity.train(awkward, labels.limit(0))
    assert toxicity.keep_clean(awkward, untrained).count() == len(AWKWARD) and toxicity.keep_clean(awkward, untrained).columns == awkward.columns
    assert toxicity.severity(no_docs, untrained).count() == 0


def test_toxicity_learns_rare_cues(spark):
    """Cues of a few documents get a weight on a small label table, and so does each of many rare ones."""
    cues = ["zargo", "blimu", "quosk", "fenty"]
    texts = [(i, f"{prose(500 + i, 30)} {cues[i % 4]}", 1) for i in range(12)] + [(i, prose(500 + i, 30), 0) for i in range(12, 60)]
    unseen = [prose(600 + k, 30) for k in range(20)]
    new = [(100 + k, t) for k, t in enumerate(unseen)] + [(200 + k, f"{t} {cues[k % 4]}") for k, t in enumerate(unseen)]
    docs = spark.createDataFrame([t[:2] for t in texts] + new, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    assert set(cues) <= set(model.weights) and all(model.weights[c] > 0 for c in cues)
    got = listed(toxicity.severity(docs, model))
    assert all(got[i].toxic == bool(y) for i, _, y in texts)
    assert all(got[i + 100].severity > got[i].severity for i in range(100, 120))


def test_toxicity_reaches_the_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert "achlichä" in model.weights
    test = labels.join(toxicity.severity(docs, model).withColumnRenamed("toxic", "rejected"), "doc_id")
    wrong = {r.toxic: r["count"] for r in test.where(F.col("rejected") != (F.col("toxic") == 1)).groupBy("toxic").count().collect()}
    assert wrong.get(1, 0) <= 1 and wrong.get(0, 0) <= 1


def test_ordinal_fit_orders_grades():
    rows, cols = np.arange(90), np.repeat([0, 1, 2], 30)
    grades = np.repeat([0, 1, 3], 30)
    w, thresholds = toxicity.fit_ordinal(rows, cols, np.ones(90), grades, np.ones(90), 3)
    assert w[0] < w[1] < w[2] and list(thresholds) == sorted(thresholds)


def test_pipeline_stage_by_stage(spark):
    """Each stage on its own input: what goes, what stays, and that columns stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect())


def brute_redacted(text):
    """Mails, addresses, cards and phones replaced by plain patterns; of overlapping items the first, then the longest."""
    found = [(m.start(), -m.end(), "EMAIL") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), -m.end(), "IP") for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])) % 10 == 0:
            found.append((m.start(), -m.end(), "CARD"))
    found += [(m.start(), -m.end(), "PHONE") for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out, at = "", 0
    for start, end, kind in sorted(found):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, -end)
    return out + text[at:]


def brute_factor(found, needed):
    classes = {}
    for w in found:
        classes.setdefault(math.floor(math.log(w) / math.log(2) * mixing.CLASSES), []).append(w)
    above, most = 0, 1e-9
    for c in sorted(classes, reverse=True):
        factor = (needed - above) / sum(w * math.sqrt(w) for k, listed in classes.items() if k <= c for w in listed)
        if 0 < factor and factor * math.sqrt(max(classes[c])) < 1:
            return factor
        most, above = max(most, factor), above + sum(classes[c])
    return most


def brute_copies(rows):
    """Copies by id of (doc_id, source, text): whole copies, and one more by rank until the words are nearest the target."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in rows}
    words = Counter()
    for i, s, _ in rows:
        words[s] += size[i]
    copies = {}
    for s, target in brute_targets(dict(words)).items():
        whole = min(3, int(target // words[s])) if words[s] else 0
        needed, ranked = target - whole * words[s], []
        factor = brute_factor([size[i] for i, source, _ in rows if source == s and size[i]], needed)
        for i, text in ((i, t) for i, source, t in rows if source == s):
            copies[i] = whole
            if size[i]:
                digest = xxhash.xxh64_intdigest(text.encode(), seed=42)
                digest -= (digest >> 63) << 64
                u = (int(hashlib.md5(f"{mixing.SEED}|{i}|{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
                p = factor * math.sqrt(size[i])
                ranked.append((u - 1 if p >= 1 else u / (1 - u) * ((1 - p) / p), i))
        total = 0
        for _, i in sorted(ranked):
            if total + size[i] / 2 > needed:
                break
            copies[i] += 1
            total += size[i]
    return copies


def test_pipeline_against_brute_force(spark):
    """Whole rows of the run on the smallest tables, computed again in plain Python with the fitted toxicity weights."""
    import sentencepiece

    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.source, r.text or "") for r in docs.collect()]
    assert len({i for i, _, _ in rows}) == len(rows)

    def toxic(text):
        counts = Counter(f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in (w, *(w[:k] + "*" for k in (3, 4, 5) if len(w) > k)))
        score = sum(model.weights[f] * (1 + math.log(n)) for f, n in sorted(counts.items()) if f in model.weights)
        return 1 / (1 + math.exp(model.thresholds[0] - score)) >= 0.5

    clean = [r for r in rows if not toxic(r[2])]
    first = {min(c) for c in brute_classes([(i, t) for i, _, t in clean])}
    kept = [(i, s, brute_redacted(t)) for i, s, t in clean if i in first]
    assert len(rows) > len(clean) > len(kept) and kept != [r for r in clean if r[0] in first]
    copies = brute_copies(kept)
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = Counter()
    for i, _, text in kept:
        ids = pieces.encode(text)
        ends = np.cumsum([len(p.surface.encode()) for p in pieces.encode(text, return_type="proto").pieces])
        if copies[i]:
            want[(i, len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids)), sha(ends.astype("<i8").tobytes()))] += copies[i]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == want
