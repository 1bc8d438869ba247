"""The manifest, the trie and the covering search: against plain Python, on awkward rows, and on empty tables."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from awkward_rows import DATA, SCHEMA, awkward, frame, given, no_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from sluiceway.llm import manifest, prefix_trie, simhash
from sluiceway.llm.numbering import numbered
from sluiceway.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans(manifest.UPPER, manifest.LOWER)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, data):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    from check_queries import bag

    db = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    df, relation = QUERIES[name](spark, data), db.sql(ORACLE_SQL[name])
    assert df.columns == relation.columns
    assert bag(df.columns, df.collect()) == bag(relation.columns, relation.fetchall())


def test_numbering(spark):
    rows = [("a" if i % 3 else "b", i % 7 if i % 5 else None) for i in range(200)] + [("hot", 1)] * 300
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = {}
    for r in numbered(df, "g", [F.col("v").asc_nulls_first()], "test").collect():
        got.setdefault(r.g, []).append((r.pos, r.v, r.n))
    for g, found in got.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and {n for _, _, n in found} == {len(found)}
        assert [v for _, v, _ in found] == sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v or 0))


# --- manifest --------------------------------------------------------------------------------------------------------------

def brute_manifest(rows, fanout):
    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return digest(map(written, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        steps = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            steps.append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
            i //= fanout
        return steps

    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: tree([leaf(r, r.text) for r in by[s]]) for s in order}
    crown = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps, text = path(trees[s], i) + path(crown, k), r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = text.translate(LOWER)
            up = leaf(r, text)
            for left, right in steps:
                up = digest([left, up, right])
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], crown[-1][0], digest([a + b for a, b in steps]), up, up == crown[-1][0]))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def listed_proofs(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest(spark, awkward, given, fanout):
    many = spark.createDataFrame([(k * 7 % 301, f"Text {k}", "en", "hot" if k % 3 else f"s{k}", k) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    empty_source = frame(spark, [(1, "A"), (1, "A"), (2, "B"), (None, None)], lambda k: "")
    for docs in (awkward, many, empty_source, given("documents")):
        assert listed_proofs(manifest.tamper_check(docs, fanout=fanout)) == brute_manifest(docs.collect(), fanout)


def test_manifest_of_nothing_and_of_one(spark, no_docs):
    assert manifest.tamper_check(no_docs).count() == 0
    one = frame(spark, [(5, "Alone")])
    r = manifest.tamper_check(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest([]) and listed_proofs(manifest.tamper_check(one)) == brute_manifest(one.collect(), 16)


def test_manifest_sees_every_change(spark, awkward):
    root = manifest.manifest(awkward).first().root
    for column, value in (("text", F.concat("text", F.lit("."))), ("lang", F.lit("de")), ("source", F.lit("other")), ("n_chars", F.lit(3)), ("doc_id", F.col("doc_id") + 1)):
        assert manifest.manifest(awkward.withColumn(column, value)).first().root != root


# --- trie ------------------------------------------------------------------------------------------------------------------

def brute_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in by.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()))
    whole = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(t[1:] for t in by.get(first, [])[:h] + turns[h:])
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, turns in whole.items():
        for k in range(len(turns) + 1):
            members.setdefault(turns[:k], []).append(c)
    for way in members:
        if way:
            kids.setdefault(way[:-1], []).append(way)
    out = []
    for way in sorted(members, key=len, reverse=True):
        own, m = kids.get(way, []), members[way]
        leaves[way] = sum(leaves[k] for k in own) if own else 1
        saved[way] = sum(saved[k] for k in own) + ((len(m) - 1) * len(way[-1][1]) if way else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(way))
        out.append((min(m), len(way), min(members[way[:-1]]) if way else None, len(m), len(own), leaves[way], saved[way], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string"


def listed_nodes(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def random_turns(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([r.randrange(0, 320), r.randrange(-150, 0), 200, 5000 + r.randrange(40)])
        for turn in range(r.randint(1, longest)):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "ü日", "", None])))
    return rows


@pytest.mark.parametrize("group", [12])
def test_trie(spark, monkeypatch, group):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = random_turns(group, 120, 9) + [(700, k, "user", "same") for k in range(60)] + [(801 + k, t, "user", "a") for k in range(30) for t in range(8)] + [(None, 1, "user", "x")]
    assert listed_nodes(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS), group)) == brute_trie(rows)


def test_trie_of_the_given_table(spark, given):
    df = given("conversations")
    assert listed_nodes(prefix_trie.rebuilt_trie(df)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_edges(spark):
    def trie(rows, schema=TURNS):
        return listed_nodes(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, schema)))

    assert trie([]) == [] and trie([(None, 1, "user", "x")]) == []
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 3)
    # Nothing is left of a short conversation whose first conversation is absent: a root alone.
    for rows in ([(lone, 0, "user", "x")], [(lone, 0, None, None), (lone + 300, 0, "user", "x")], [(lone, 0, "user", "y")] * 9):
        assert trie(rows) == brute_trie(rows)
    clash = [(lone, t, "user", "long " * 50_000, 3, "x") for t in range(6)]
    assert trie(clash, TURNS + ", p long, c string") == brute_trie([r[:4] for r in clash])


def test_centroids_split_any_tree():
    r = random.Random(3)
    for n in (1, 2, 3, 50, 400):
        for reach in (1, 3, n):
            parent = [-1] + [r.randrange(max(0, i - reach), i) for i in range(1, n)]
            own = [r.randint(1, 5) for _ in range(n)]
            depth = [0] * n
            for i in range(1, n):
                depth[i] = depth[parent[i]] + 1
            order = sorted(range(n), key=lambda i: depth[i])
            place = {v: i for i, v in enumerate(order)}
            up = [place.get(parent[v], -1) for v in order]
            weight, want = [own[v] for v in order], [v for v in order]
            for i in range(n - 1, 0, -1):
                weight[up[i]] += weight[i]
                want[up[i]] += want[i]
            assert prefix_trie.split_to_the_end(up, weight, [list(order)]) == [want]


# --- covering search ---------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, found, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (found[i] ^ found[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, d in enumerate(ids):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return [names.get(find(i)) for i in range(len(ids))]


def listed_fingerprints(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_simhash(spark, awkward, given, bucket):
    words = prose(5, 120).split()
    edited = frame(spark, [(k, " ".join(words[:k] + ["new"] + words[k + 1:])) for k in range(0, 120, 2)] + [(500, None), (-7, " \n"), (None, prose(5, 119)), (None, "only one")])
    for docs in (awkward, edited, given("documents")):
        rows = docs.select("doc_id", "text").collect()
        found = [brute_fingerprint(r.text) for r in rows]
        want = [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, found, brute_components([r.doc_id for r in rows], found))]
        assert listed_fingerprints(simhash.near_copies(docs, bucket=bucket)) == sorted(want, key=lambda r: (r[0] is not None, r[0], r[1]))


def test_simhash_of_nothing(no_docs):
    assert simhash.near_copies(no_docs).count() == 0


def test_sixty_four_bit_hashes_are_spark_hashes(spark):
    text = "one two three four"
    got = spark.createDataFrame([("one two three",), ("two three four",)], "t string").select(F.xxhash64("t")).collect()
    assert [int(h) for h in simhash.shingle_hashes(text.upper()).view(np.int64)] == [r[0] for r in got]


def test_masks_cover_every_choice_of_places():
    r = random.Random(8)
    first, second = simhash.masks(list(range(64))), simhash.second_masks()
    for _ in range(5000):
        places = r.sample(range(64), 3)
        differing = sum(1 << p for p in places)
        hits = [v for v, m in enumerate(first) if not m & differing]
        assert hits
        # Whatever bucket they share is covered again, which joins them in some smaller one.
        assert all(any(not inner & differing for inner in second[v]) for v in hits)
    assert all(sum(not m >> p & 1 for p in range(64)) - w.bit_count() <= 16 for m, listed in zip(first, second) for w in listed)


@pytest.mark.parametrize("bucket", [10])
def test_dense_balls(spark, bucket):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(4)]
    found = sorted({c ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(40)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in found], "fp long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.near_links(df, bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {v: v for v in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert [find(v) for v in found] == brute_components(found, found)
