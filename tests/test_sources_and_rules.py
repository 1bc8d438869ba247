import csv
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sluiceway.catalog.text_queries import SCRIPT_LINES
from sluiceway.functions import textrules
from sluiceway.functions.textrules import Rule
from sluiceway.operators.compare import same_rows
from sluiceway.plans.metrics import Chart, ChartError, Dataset, DatasetColumn, check_chart
from sluiceway.sources.files import csv_tables, ends_inside, read_csv, read_seed, rows_per_file
from sluiceway.sources.shape import child_table, flatten, sheet_header, sheet_table
from sluiceway.sources.web import read_index, read_rest, stream_rest


# ---- files

def test_csv_files_land_as_text(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,amount\n007, 1.50 \n008,\n009\n")
    (tmp_path / "customers.csv").write_text("id\nc1\n")
    tables = csv_tables(spark, f"{tmp_path}/*.csv")
    assert sorted(tables) == ["customers", "orders"]
    assert tables["orders"].dtypes == [("order_id", "string"), ("amount", "string")]
    assert rows(tables["orders"]) == [("007", " 1.50 "), ("008", None), ("009", None)]
    assert rows(rows_per_file(spark, f"{tmp_path}/customers.csv"), "rows") == [(1,)]


def test_no_match_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_tables(spark, f"{tmp_path}/*.csv")


def test_seed_types(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("stock_id,n\n0012,1\n")
    assert rows(read_seed(spark, str(tmp_path / "seed.csv"), "stock_id string, n int")) == [("0012", 1)]
    with pytest.raises(Exception):
        read_seed(spark, str(tmp_path / "seed.csv"), "stock_id string, n date").collect()


@pytest.mark.parametrize("paginator", ["page_number", "offset"])
def test_numbered_pages_end(paginator):
    from sluiceway.sources.web import RestReader, _Slice

    def read(answer, **options):
        asked = []

        def get(url, headers, body):
            asked.append(url)
            assert len(asked) < 20
            return answer(len(asked))

        reader = RestReader({"base_url": "http://x", "endpoint": "items", "paginator": paginator, **options}, get)
        return [json.loads(r[0]) for r in reader.read(_Slice(0))]

    two = lambda n: {"data": [{"id": n}] if n < 4 else [], "links": []}
    with pytest.raises(ValueError, match=r"holds 2 lists \['data', 'links'\]"):
        read(two)
    assert read(two, records="data") == [{"id": 1}, {"id": 2}, {"id": 3}]
    with pytest.raises(ValueError, match="0 lists"):
        read(lambda n: {"id": 1})
    with pytest.raises(ValueError, match="'data' is no list"):
        read(lambda n: {"data": {"id": 1}}, records="data")
    assert read(lambda n: [{"id": 1}]) == [{"id": 1}]


# ---- web readers on captured pages

def pages(count, size):
    def get(url, headers, body):
        query = dict(re.findall(r"(\w+)=(\w+)", url))
        if "offset" in query:
            start = int(query["offset"])
        else:
            start = (int(query.get("page", 1)) - 1) * size
        items = [{"id": i, "name": f"n{i}", "auth": headers.get("Authorization")} for i in range(start, min(count, start + size))]
        return {"data": items, "next": f"http://x/items?page={start // size + 2}" if start + size < count else None}

    return get


@pytest.mark.parametrize("count", [0, 9, 10, 25])
@pytest.mark.parametrize("paginator,slices", [("page_number", "1"), ("page_number", "3"), ("offset", "2"), ("json_link", "1")])
def test_rest_pages(spark, count, paginator, slices):
    df = read_rest(spark, "id bigint, name string, auth string", pages(count, 5), base_url="http://x", endpoint="items",
                   paginator=paginator, slices=slices, page_size="5", token="t0k", records="data")
    assert rows(df, "id") == [(i,) for i in range(count)]
    assert count == 0 or df.first()["auth"] == "Bearer t0k"


def growing_server(folder, size):
    """Pages of as many records as the file says; every request is logged. Read by the driver and by tasks."""
    def get(url, headers, body):
        with open(f"{folder}/log", "a") as f:
            f.write(url + "\n")
        with open(f"{folder}/count") as f:
            total = int(f.read())
        asked = {k: int(v) for k, v in re.findall(r"(\w+)=(\d+)", url)}
        start = asked["offset"] if "offset" in asked else (asked["page"] - 1) * size if "page" in asked else asked.get("cursor", 0)
        found, end = [{"id": i} for i in range(start, min(total, start + size))], start + size
        return {"items": found, "next": f"http://h/x?page={end // size + 1}" if end < total else None, "next_cursor": end if end < total else None}

    return get


@pytest.mark.parametrize("paginator", ["page_number", "offset", "json_link", "cursor"])
def test_a_stream_asks_for_new_pages_only(spark, tmp_path, paginator):
    out, sizes = str(tmp_path / "out"), [0, 43, 43, 45, 50, 131]
    asked = []
    for total in sizes:
        (tmp_path / "count").write_text(str(total))
        (tmp_path / "log").write_text("")
        # A new stream each time, from the same checkpoint.
        rows_in = stream_rest(spark, "id bigint", growing_server(str(tmp_path), 10), base_url="http://h", endpoint="x", records="items", paginator=paginator, slices="3", page_size="10")
        rows_in.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        asked.append((tmp_path / "log").read_text().split())
        assert rows(spark.read.schema("id bigint").parquet(out)) == [(i,) for i in range(total)]

    def place(url):
        found = re.search(r"(page|offset|cursor)=(\d+)", url)
        return 0 if found is None else int(found[2]) - 1 if found[1] == "page" else int(found[2]) // 10

    # The last page may have grown and is asked for again; none before it is.
    for before, now in zip(sizes, asked[1:]):
        assert min(map(place, now)) >= max(0, (before - 1) // 10)
    assert len(asked[2]) <= 4


def test_the_end_of_numbered_pages_takes_few_requests():
    from sluiceway.sources.web import RestStream

    for total in [*range(0, 60), 99_991, 100_000]:
        for paginator in ("page_number", "offset"):
            asked = []

            def get(url, headers, body):
                asked.append(url)
                q = {k: int(v) for k, v in re.findall(r"(\w+)=(\d+)", url)}
                start, size = (q["offset"], min(q["limit"], 7)) if "offset" in q else ((q["page"] - 1) * 7, 7)
                return [{"id": i} for i in range(start, min(total, start + size))]

            stream = RestStream({"base_url": "http://h", "endpoint": "x", "paginator": paginator, "slices": "4"}, get)
            start, end = stream.initialOffset(), stream.latestOffset()
            assert len(asked) < 50
            got = [json.loads(r[0])["id"] for part in stream.partitions(start, end) for r in stream.read(part)]
            assert got == list(range(total))
            assert stream.latestOffset() == end


def test_a_stream_whose_pages_vanish_stops():
    from sluiceway.sources.web import RestStream

    served = [{"id": i} for i in range(25)]
    for paginator in ("page_number", "offset"):
        def get(url, headers, body):
            q = {k: int(v) for k, v in re.findall(r"(\w+)=(\d+)", url)}
            start = q["offset"] if "offset" in q else (q["page"] - 1) * 10
            return served[start : start + 10]

        stream = RestStream({"base_url": "http://h", "endpoint": "x", "paginator": paginator, "page_size": "10"}, get)
        start, end = stream.initialOffset(), stream.latestOffset()
        parts, kept = stream.partitions(start, end), served[:]
        del served[22:]
        with pytest.raises(ValueError, match="seen before|were seen"):
            [list(stream.read(p)) for p in parts]
        assert stream.latestOffset() == end
        served[:] = kept
    alike = RestStream({"base_url": "http://h", "endpoint": "x", "paginator": "page_number"}, lambda *a: [{"id": 1}])
    assert alike.latestOffset() == {"page": 1, "taken": 1}


def test_unknown_paginator(spark):
    with pytest.raises(Exception, match="paginator"):
        read_rest(spark, "id int", pages(1, 1), base_url="http://x", endpoint="e", paginator="guess").collect()


@pytest.mark.parametrize("slices", ["1", "3"])
def test_index_scan(spark, slices):
    def search(url, headers, body):
        if "scroll_id" in body:
            part, of, start = map(int, body["scroll_id"].split(","))
        else:
            piece = body.get("slice", {"id": 0, "max": 1})
            part, of, start = piece["id"], piece["max"], 0
        mine = [i for i in range(20) if i % of == part]
        hits = [{"_id": f"d{i}", "_source": {"n": i}} for i in mine[start : start + 4]]
        return {"hits": {"hits": hits}, "_scroll_id": f"{part},{of},{start + 4}"}

    df = read_index(spark, "n bigint, _id string", search, host="http://es", index="docs", slices=slices)
    assert rows(df) == [(i, f"d{i}") for i in range(20)]
    assert df.rdd.getNumPartitions() == int(slices)


# ---- shaping

def test_sheet(spark):
    df = spark.createDataFrame([(1, ["id", "name"]), (2, ["1", "a", "beyond"]), (3, ["2"]), (4, [])], "row_number int, cells array<string>")
    assert rows(sheet_table(df, sheet_header(df))) == [(None, None), ("1", "a"), ("2", None)]


def test_flatten_and_child_rows(spark):
    df = spark.sql("select 1 as id, named_struct('a', named_struct('b', 2, 'c', 'x'), 'l', array(1)) as s, array(named_struct('n', 5), named_struct('n', 6)) as items, array('p', 'q') as tags "
                   "union all select 2, null, array(), null")
    assert flatten(df).columns == ["id", "s__a__b", "s__a__c"]
    assert rows(flatten(df)) == [(1, 2, "x"), (2, None, None)]
    assert rows(child_table(df, "id", "items")) == [(1, 0, 5), (1, 1, 6)]
    assert rows(child_table(df, "id", "tags")) == [(1, 0, "p"), (1, 1, "q")]


# ---- text rules, against plain Python

RULES = [
    Rule("lock", ["could not get lock", "unable to acquire"]), Rule("tail", ["^done$"], code=1), Rule("disk", ["no space le[f]t"], steps=("copy",), needs=["Space"]), Rule("any", ["error"]),
]


def first_rule(text, step, code, width=240):
    for rule in RULES:
        if rule.steps and step and step not in rule.steps or rule.code is not None and code is not None and code != rule.code:
            continue
        for pattern in rule.patterns:
            hit = re.search(pattern, text or "", re.I | re.M)
            if hit:
                a, b = max(0, hit.start() - width // 2), min(len(text), hit.end() + width // 2)
                return rule.rule_id, ("..." if a else "") + text[a:b].strip() + ("..." if b < len(text) else "")
    return None, None


def test_classify(spark):
    long = "x" * 300
    cases = [
        ("E: Could not get LOCK /var", None, None), (f"{long} error {long}", "", 3), ("a\nDONE\nb", None, 1), ("a\nDONE\nb", None, 2), ("a\nDONE\nb", None, None),
        ("no space left, error", "copy", 1), ("no space left, error", "move", 1), ("no space left, error", None, 1), ("fine", "copy", 1), (None, None, None), ("", "", 0),
        (f"  \n error {'y' * 119} z", None, None), ("undone\n", None, 1), ("unable to acquire then could not get lock", None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, step string, code int")
    got = df.select("i", textrules.classify(F.col("text"), RULES, F.col("step"), F.col("code")).alias("h")).select("i", "h.*")
    assert {r["i"]: (r["rule_id"], r["excerpt"]) for r in got.collect()} == {i: first_rule(*c) for i, c in enumerate(cases)}


def test_mask(spark):
    df = spark.createDataFrame([("pass=hunter2 and hunter22, abc $1.x",), (None,)], "t string")
    masked = df.select(textrules.mask(F.col("t"), ["hunter2", "hunter22", "abc", "   a", "$1.x"]).alias("t"))
    assert rows(masked) == [(None,), ("pass=***REDACTED*** and ***REDACTED***, abc ***REDACTED***",)]


def script_rules(text):
    seen = []
    for line in (text or "").splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            hit = next((i for i, p, _ in textrules.SCRIPT_RULES if re.search(p, line, re.I)), None)
            if hit and hit not in seen:
                seen.append(hit)
    return seen


def test_script_hits(spark):
    scripts = [
        "apt-get update\n# rm -rf /\n  rm -rf /\nreboot", "mkfs.ext4 /dev/sda\nMKFS x; rm -rf /\r\nsudo shutdown now", "curl http://x | sudo bash\vwget y|sh", "", None,
        "echo reboot\nrm -rf /home/x\nchmod -R 777 /\n> /etc/passwd", ":(){ :|: & };:\ndd if=a of=/dev/sda\nuserdel -r root", "iptables -F\nhistory -c\nchown -R a /", "rm -r /etc ", "a\x85mkfs halt",
    ]
    df = spark.createDataFrame(list(enumerate(scripts)), "i int, t string")
    got = {r["i"]: r["h"] for r in df.select("i", textrules.script_hits(F.col("t")).alias("h")).collect()}
    assert got == {i: script_rules(s) for i, s in enumerate(scripts)}


def test_every_script_rule_has_a_hit_and_a_near_miss(spark):
    lines = [(i, hit, miss) for i, (hit, miss) in enumerate(SCRIPT_LINES)]
    seen = spark.createDataFrame(lines, "i int, hit string, miss string").select(
        "i", textrules.script_hits(F.col("hit")).alias("h"), textrules.script_hits(F.col("miss")).alias("m"))
    assert rows(seen) == [(i, [rule[0]], []) for i, rule in enumerate(textrules.SCRIPT_RULES)]


@pytest.mark.parametrize("pattern,words", [
    ("copyright|all rights reserved", ("all rights reserved|copyright",)), (r"licen[cs]ed? under", ("licen", "e", " under")),
    ("(a|)b+", ("b",)), ("(?:Ab|c.dd)?x", ("x",)), ("x{0,3}", ()), ("(?!no)yes", ("yes",)), (r"a\|b", ("a", "b")), ("[a-z&&[^b]]", ()), (r"a\vb", ()),
    (r"\Qa.b\E", ()), (r"[\w[ab]]c", ()), ("(", ()), ("", ()), ("(foo|b(ar|oz))!", ("ar|foo|oz", "!")), (r"(ab)\1", ("ab",)),
])
def test_necessary_words(pattern, words):
    assert textrules.necessary_words(pattern) == words


def test_necessary_words_hide_no_match():
    """Random patterns, and the fixed ones with the words listed for them, against random texts made of their pieces."""
    r = random.Random(5)

    def make(depth):
        if depth == 0:
            return r.choice(["a", "B", "ab", "c d", ".", "[ab]", r"\s", r"\b", "^", "-"])
        a, b = make(depth - 1), make(depth - 1)
        return r.choice([a + b, f"({a}|{b})", f"({a})?{b}", f"(?:{a})+{b}", f"({a}){{0,2}}", f"(?={a}){b}", f"(?!{a}){b}", f"({a}|{b}|)"])

    def passes(needs, text):
        return all(any(w in text.lower() for w in entry.lower().split("|")) for entry in needs)

    matched = 0
    for _ in range(1500):
        pattern = make(r.randint(1, 4))
        needs = textrules.necessary_words(pattern)
        for _ in range(10):
            text = "".join(r.choice("aAbBcd -\n") for _ in range(r.randint(0, 9)))
            if re.search(pattern, text, re.I | re.M):
                matched += 1
                assert passes(needs, text), (pattern, needs, text)
    assert matched > 1000
    hits = set()
    for _ in range(4000):
        line = "".join(r.choice([c.lower(), c.upper()]) + (" " if c == " " and r.random() < 0.3 else "") for c in r.choice(r.choice(SCRIPT_LINES)))
        text = r.choice(["", "x; ", " "]) + line + r.choice(["", " ", " && y"])
        for name, pattern, listed in textrules.SCRIPT_RULES:
            if re.search(pattern, text, re.I):
                hits.add(name)
                assert passes(listed, text) and passes(textrules.necessary_words(pattern), text), (name, text)
    assert len(hits) == len(textrules.SCRIPT_RULES)


# ---- metrics

SALES = Dataset([DatasetColumn("region"), DatasetColumn("id", groupby=False), DatasetColumn("amount", groupby=False, filterable=False)],
                {"rows": "COUNT(*)", "ids": "count( distinct id )", "total": "SUM(amount)", "top": "MAX(amount)"})


def test_charts(table):
    df = table({"region": "string", "id": "int", "amount": "int"}, ("a", 1, 5), ("a", 1, 7), ("b", 2, 1), (None, 3, None))
    by_region = Chart(["rows", "ids", "total"], ["region"])
    assert rows(SALES.query(df, by_region)) == [(None, 1, 1, None), ("a", 2, 1, 12), ("b", 1, 1, 1)]
    assert rows(SALES.query(df, Chart(["rows", "top"]), {"region": ["a", "b"], "id": [1]})) == [(2, 7)]
    assert rows(SALES.query(df, Chart(["rows"], ["region"], 1, [F.desc("rows")]))) == [("a", 2)]
    board = SALES.dashboard(df, {"x": by_region, "y": Chart(["rows"])}, {"region": ["b"]}, {"region": ["x"]})
    assert rows(board["x"]) == [("b", 1, 1, 1)] and rows(board["y"]) == [(4,)]
    independent = df.groupBy("region").agg(F.count("*").alias("rows"))
    expected = [{"region": None, "rows": 1}, {"region": "a", "rows": 2}, {"region": "b", "rows": 1}]
    assert check_chart(SALES.query(df, Chart(["rows"], ["region"])), independent, expected).ok
    assert not check_chart(SALES.query(df, Chart(["rows"], ["region"])), independent.limit(2), expected).ok
    assert not check_chart(SALES.query(df, Chart(["rows"], ["region"])), independent, expected[:2]).ok


@pytest.mark.parametrize("chart,filters", [(Chart(["rows"], ["id"]), None), (Chart(["nope"]), None), (Chart([]), None), (Chart(["rows"]), {"amount": [1]}), (Chart(["rows"], ["gone"]), None)])
def test_charts_ask_only_what_the_dataset_offers(table, chart, filters):
    with pytest.raises(ChartError):
        SALES.query(table({"region": "string", "id": "int", "amount": "int"}), chart, filters)


@pytest.mark.parametrize("expression", ["SUM(*)", "COUNT(DISTINCT *)", "SUM(DISTINCT amount)", "SUM(gone)", "amount", "COUNT(*) + 1"])
def test_metric_expressions_are_checked(expression):
    with pytest.raises(ChartError):
        Dataset(SALES.columns, {"m": expression})


def _server(total, cap, style):
    """A server that returns at most `cap` records a page, whatever is asked for."""
    from urllib.parse import parse_qs, urlparse

    from sluiceway.sources.web import Reply

    def transport(url, headers, body):
        asked = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items()}
        start = asked["offset"] if "offset" in asked else (asked["page"] - 1) * cap if "page" in asked else asked.get("cursor", asked.get("after", 0))
        found, end = [{"n": i} for i in range(start, min(total, start + cap))], start + cap
        more = end < total
        if style == "header_link":
            return Reply({"items": found}, {"Link": f'<http://h/x?after=0>; rel="first", <http://h/x?after={end}>; rel="next"'} if more else {})
        return {"items": found, "meta": {"next_cursor": end if more else None}, "next": f"http://h/x?after={end}" if more else None}

    return transport


@pytest.mark.parametrize("style", ["page_number", "offset", "json_link", "header_link", "cursor"])
def test_a_server_with_a_page_cap_is_read_whole(style):
    from sluiceway.sources.web import RestReader

    options = {"base_url": "http://h", "endpoint": "x", "records": "items", "paginator": style, "cursor": "meta.next_cursor", "slices": "3"}
    reader = RestReader(options, _server(120, 50, style))
    got = [json.loads(r[0])["n"] for part in reader.partitions() for r in reader.read(part)]
    assert sorted(got) == list(range(120))


def serial(path, columns):
    """What a serial reader makes of a file: rows under the columns, empty and missing fields as None."""
    with open(path, newline="") as f:
        found = [r for r in csv.reader(f) if r]
    header = found[0]
    return [tuple(dict(zip(header, r)).get(c) or None for c in columns) for r in found[1:]]


def random_field(r):
    return "".join(r.choices(["a", "bc", " ", ",", '"', "\n", "\r\n", "é", '""', ""], k=r.randint(0, 5)))


def written_field(r, value):
    if any(c in value for c in ',"\n\r') or r.random() < 0.3:
        return '"' + value.replace('"', '""') + '"' + r.choice(["", "", "tail"])
    return value + r.choice(["", "", '"'] if value else [""])


@pytest.mark.parametrize("block", [40, 300, 1 << 20])
def test_csv_splits_equal_a_serial_reader(spark, tmp_path, block):
    r = random.Random(block)
    for n in range(2):
        lines = []
        for _ in range(r.randint(30, 120)):
            lines.append(",".join(written_field(r, random_field(r)) for _ in range(r.randint(1, 3))) + r.choice(["\n", "\n", "\r\n", "\n\n"]))
        (tmp_path / f"{n}.csv").write_bytes(('"a","b, ""x""\ny",c\n' + "".join(lines).rstrip("\r\n") + r.choice(["", "\n"])).encode())
    (tmp_path / "one-long.csv").write_bytes(b'a,c\n1,"' + b"line of the field\n" * 40 + b'"\n2,3\n')
    names = ["a", 'b, "x"\ny', "c"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_csv(spark, str(tmp_path))
        assert got.columns == names
        assert Counter(map(tuple, got.collect())) == Counter(row for f in ("0.csv", "1.csv", "one-long.csv") for row in serial(tmp_path / f, names))
        if block == 40:
            assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_end_as_a_serial_reader_sees_them():
    r = random.Random(2)
    for _ in range(4000):
        line = "".join(r.choices(["a", ",", '"', '""', " "], k=r.randint(0, 8)))
        for inside in (False, True):
            # A mark on the next line is a field of its own exactly if the line ended outside of quotes.
            first = 'q"' if not inside else '"q'
            found = list(csv.reader([(first if inside else "") + line + "\n", "mark\n"]))
            assert ends_inside(line, inside) is (found[-1] != ["mark"])


def test_splits_whose_states_are_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    from sluiceway.sources import files

    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f'{k},"v\n{k}"\n' for k in range(300)))
    monkeypatch.setattr(files, "is_small", lambda df: False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert sorted(map(tuple, read_csv(spark, str(tmp_path / "x.csv")).collect())) == sorted((str(k), f"v\n{k}") for k in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_one_stem_are_one_table(spark, tmp_path):
    for folder, text in (("x", "id,v\n1,a\n"), ("y", "v,id\nb,2\nc,3\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "orders.csv").write_text(text)
    (tmp_path / "y/other.csv").write_text("n\n9\n")
    tables = csv_tables(spark, f"{tmp_path}/*/*.csv")
    assert sorted(tables) == ["orders", "other"] and rows(tables["orders"], "id", "v") == [("1", "a"), ("2", "b"), ("3", "c")]


def test_fields_beyond_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2,3,\n4\n")
    with pytest.raises(Exception, match="a record has 4 fields under 2 columns"):
        read_csv(spark, str(tmp_path / "x.csv")).collect()
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "x.csv"), land_rest=True).collect())) == [("1", "2", ["3", ""]), ("4", None, None)]
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match=r"column\(s\) \['a'\] twice"):
        read_csv(spark, str(tmp_path / "twice.csv"))
    (tmp_path / "bom.csv").write_bytes("\ufeffa,b\nx,é\n".encode())
    assert rows(read_csv(spark, str(tmp_path / "bom.csv"))) == [("x", "é")]


def test_csv_dialect(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text('a,b\n"say ""hi"", ok","two\nlines"\n1,2\n')
    (tmp_path / "in/2.csv").write_text("b,a\nB,A\n")
    got = {(r.a, r.b) for r in read_csv(spark, str(tmp_path / "in")).collect()}
    assert got == {('say "hi", ok', "two\nlines"), ("1", "2"), ("A", "B")}


class Shop:
    """A database of this process that answers as the reader would; `later` runs after the first statement."""

    def __init__(self, later=()):
        import duckdb

        self.db, self.later, self.asked = duckdb.connect(), list(later), []

    def ask(self, query):
        self.asked.append(query)
        found = self.db.execute(query).fetchall()
        while self.later:
            self.db.execute(self.later.pop())

        class Answer:
            first = staticmethod(lambda: found[0])
            collect = staticmethod(lambda: found)

        return Answer

    def read(self, table, predicates):
        return [self.db.execute(f"select rowid from {table} where {p}").fetchall() for p in predicates]


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,3)", "varchar", "date", "timestamp"])
def test_ranges_of_a_cut_hold_each_row_once(kind):
    import datetime as dt
    import decimal

    from sluiceway.sources.jdbc import Database, read_cut

    r = random.Random(kind)
    made = {
        "bigint": lambda: r.randint(-50, 50), "decimal(20,3)": lambda: decimal.Decimal(r.randint(-900, 900)) / 1000,
        "varchar": lambda: "".join(r.choices("aB'\"é z", k=r.randint(0, 2))), "date": lambda: dt.date(2024, 1, 1) + dt.timedelta(r.randint(0, 40)),
        "timestamp": lambda: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=r.randint(0, 10**8)),
    }[kind]
    for n in range(60):
        shop, count = Shop(), r.choice([0, 1, 3, 200])
        keys = [None if r.random() < 0.1 else made() for _ in range(count)]
        if r.random() < 0.3:
            keys = [keys[0] if r.random() < 0.7 else k for k in keys]
        shop.db.execute(f'create table t ("the ""key" {kind})')
        if keys:
            shop.db.executemany("insert into t values (?)", [(k,) for k in keys])
        ranges = r.choice([1, 2, 7, 300])
        parts = read_cut(Database("jdbc:duckdb:x"), {"t": 'the "key'}, ranges, shop.ask, shop.read)["t"]
        assert sorted(row for part in parts for row, in part) == list(range(count)) and len(parts) <= ranges
        if len(set(keys)) == count == 200 and ranges == 7:
            assert max(map(len, parts)) <= 200 // 7 + 30


def test_a_cut_holds_all_tables_at_one_moment():
    from sluiceway.sources.jdbc import Database, read_cut

    shop = Shop(["insert into lines values (5, 3), (null, 9)", "insert into orders values (3)"])
    shop.db.execute("create table orders (id bigint); insert into orders values (1), (2); create table lines (n bigint, id bigint)")
    shop.db.execute("insert into lines values (1, 1), (2, 1), (3, 2), (4, 2); create table none (id bigint)")
    found = read_cut(Database("jdbc:duckdb:x"), {"orders": "id", "lines": "n", "none": "id"}, 2, shop.ask, shop.read)
    # What came after the first statement is in no table, but for rows without a key.
    assert [sum(map(len, found[t])) for t in ("orders", "lines", "none")] == [2, 5, 0]
    assert len(shop.asked) == 3 and len(found["lines"]) == 2
    assert read_cut(Database("jdbc:duckdb:x"), {}, 2, shop.ask, shop.read) == {}
    with pytest.raises(ValueError, match="0 ranges"):
        read_cut(Database("jdbc:duckdb:x"), {"orders": "id"}, 0, shop.ask, shop.read)


def test_literals_of_a_cut():
    import datetime as dt

    from sluiceway.sources.jdbc import Database, bounds_query, range_predicates, written

    moment = dt.datetime(2024, 5, 1, 3, 4, 5, 6)
    assert written(moment, "sqlserver") == "cast('2024-05-01 03:04:05.000006' as datetime2)"
    assert written(moment, "postgresql") == "cast('2024-05-01 03:04:05.000006' as timestamp)"
    for odd in (1.5, True, b"x"):
        with pytest.raises(ValueError, match="a cut needs a key"):
            written(odd, "postgresql")
    assert bounds_query(Database("jdbc:postgresql://h/d"), {"a": "id", "b": "no"}) == 'select (select max("id") from public.a) as high_0, (select max("no") from public.b) as high_1'
    assert range_predicates("id", 9, [1, 4, 4, 8], "sqlserver") == ['("id" < 4 or "id" is null)', '"id" >= 4 and "id" < 8', '"id" >= 8 and "id" <= 9']


def test_the_reader_gets_a_range_per_connection(spark, monkeypatch):
    from pyspark.sql import DataFrameReader

    from sluiceway.sources.jdbc import Database

    given, options = {}, []
    monkeypatch.setattr(DataFrameReader, "options", lambda self, **o: options.append(o) or self)
    answers = [[(90, None)], [(2, 50), (1, 10)]]

    class Answer:
        def __init__(self, found):
            self.first, self.collect = (lambda: found[0]), (lambda: found)

    monkeypatch.setattr(DataFrameReader, "load", lambda self: Answer(answers.pop(0)))
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, predicates, properties: given.update({table: (predicates, properties)}) or table)
    database = Database("jdbc:postgresql://h/d", {"user": "u"})
    assert database.read_cut(spark, {"a": "id", "b": "id"}, ranges=2) == {"a": "public.a", "b": "public.b"}
    assert given["public.a"] == (['("id" < 50 or "id" is null)', '"id" >= 50 and "id" <= 90'], {"user": "u", "fetchsize": "50000", "preferTimestampNTZ": "true"})
    assert given["public.b"][0] == ['"id" is null']
    # A query and a table exclude each other.
    assert all("dbtable" not in o and o["query"].startswith("select") for o in options)
