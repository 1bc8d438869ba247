"""Store, loads, bronze, ledger, staged runs and the stream."""

import datetime as dt
import itertools
import json
import random
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from sluiceway import bronze
from sluiceway.bronze.batch import REGISTRY, registry
from sluiceway.gates import NotNull, Quarantine, ReferentialIntegrity, RowCountBounds, Unique
from sluiceway.gates.model import GateError
from sluiceway.ledger import reports
from sluiceway.ledger.store import Ledger
from sluiceway.operators.merge import merge_changes
from sluiceway.operators.widen import TypeConflict, common_schema, common_type
from sluiceway.plans.staged import Flow, Stage, build_models, run_flow
from sluiceway.plans.store import TableStore, landing_namespace
from sluiceway.plans.validate import Expected, validate
from sluiceway.records import append_records
from sluiceway.sources.jdbc import Database, Incremental, Partitioning, load_table
from sluiceway.streaming.ingest import file_stream, ingest


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


COLUMNS = {"id": "bigint", "at": "timestamp_ntz", "v": "string"}


def at(day):
    return f"2026-01-{day:02d}T00:00:00"


# ---- store and loads

def test_replace_keeps_old_versions_and_publishes_together(store, table):
    a, b = table({"x": "int"}, (1,)), table({"x": "int"}, (2,))
    store.replace("ns", {"a": a, "b": b}, "1")
    first = store.current("ns", "a")
    store.replace("ns", {"a": b, "b": a}, "2")
    assert rows(store.read("ns", "a")) == [(2,)] and rows(store.read("ns", "b")) == [(1,)]
    assert rows(store.read_version(first)) == [(1,)]
    with pytest.raises(LookupError):
        store.read("ns", "never")


def test_empty_tables_keep_their_columns(store, table):
    store.replace("ns", {"t": table(COLUMNS)}, "1")
    assert store.read("ns", "t").count() == 0 and store.read("ns", "t").columns == list(COLUMNS)


def test_incremental_load(store, table):
    rule = Incremental("at", ["id"])
    first = table(COLUMNS, (1, at(1), "a"), (2, at(2), "b"), (2, at(1), "older"), (3, at(2), "c"))
    assert load_table(store, "l", "t", first, "1", rule)["extracted"] == 3
    later = table(COLUMNS, (1, at(5), "a2"), (2, at(2), "b"), (3, at(2), "c"), (4, at(4), "d"), (9, at(1), "too late"))
    done = load_table(store, "l", "t", later, "2", rule)
    assert (done["mode"], done["extracted"]) == ("merge", 4)
    expected = [(1, "a2"), (2, "b"), (3, "c"), (4, "d")]
    assert rows(store.read("l", "t"), "id", "v") == expected
    assert load_table(store, "l", "t", later, "3", rule)["extracted"] == 1
    assert rows(store.read("l", "t"), "id", "v") == expected
    gone = later.where("id > 2")
    load_table(store, "l", "t", gone, "4", rule)
    assert rows(store.read("l", "t"), "id", "v") == expected
    load_table(store, "l", "t", gone, "5", rule, full_refresh=True)
    assert rows(store.read("l", "t"), "id") == [(3,), (4,), (9,)]


def test_few_changes_do_not_shuffle_the_base(store, spark):
    base = spark.range(1000).selectExpr("id", "timestamp_ntz'2026-01-01' as at", "'a' as v")
    rule = Incremental("at", "id")
    load_table(store, "l", "t", base, "1", rule)
    newer = spark.range(5).selectExpr("id", "timestamp_ntz'2026-01-02' as at", "'b' as v")
    merged = merge_changes(store.read("l", "t"), newer, ["id"], "at")
    assert "Union\n   :- BroadcastHashJoin" in merged._jdf.queryExecution().executedPlan().toString()
    load_table(store, "l", "t", newer, "2", rule)
    assert store.read("l", "t").where("v = 'b'").count() == 5 and store.read("l", "t").count() == store.current("l", "t").rows == 1000
    load_table(store, "l", "t", base.withColumn("at", F.col("at") + F.expr("interval 9 days")), "3", rule)
    assert store.read("l", "t").where("v = 'a'").count() == 1000


TYPES = {
    "tinyint": 7, "smallint": 300, "int": 70_000, "bigint": 5_000_000_000, "decimal(5,2)": "123.45", "decimal(30,4)": "12345678901234567890.1234", "float": 1.5, "double": 2.25,
    "date": "2026-01-02", "timestamp_ntz": "2026-01-02 03:04:05", "timestamp": "2026-01-02 03:04:05", "string": "text", "boolean": "true", "binary": "x",
}


def test_common_types_hold_every_value_of_both(spark):
    """Every pair of plain types: both values survive the way into the common type and back, or there is none."""
    kinds = {name: T.StructType.fromDDL(f"v {name}")["v"].dataType for name in TYPES}
    refused = set()
    for a, b in itertools.combinations(TYPES, 2):
        common = common_type(kinds[a], kinds[b])
        assert common == common_type(kinds[b], kinds[a])
        if common is None:
            refused.add((a, b))
            continue
        for name in (a, b):
            value = F.lit(TYPES[name]).cast(kinds[name])
            r = spark.range(1).select(value.alias("x"), value.cast(common).cast(kinds[name]).alias("y")).first()
            assert r.x == r.y is not None, (a, b, common)
    assert {("bigint", "float"), ("bigint", "double"), ("timestamp_ntz", "timestamp"), ("string", "binary"), ("int", "date"), ("double", "date")} <= refused
    assert not {("int", "bigint"), ("bigint", "decimal(5,2)"), ("date", "timestamp_ntz"), ("int", "double"), ("double", "string")} & refused


def test_common_types_inside_and_their_limits():
    def kind(ddl):
        return T.StructType.fromDDL(f"v {ddl}")["v"].dataType

    assert common_type(kind("struct<a:int,b:date>"), kind("struct<B:timestamp,c:string>")) == kind("struct<a:int,b:timestamp,c:string>")
    assert common_type(kind("array<int>"), kind("array<decimal(12,1)>")) == kind("array<decimal(12,1)>")
    assert common_type(kind("map<string,int>"), kind("map<string,bigint>")) == kind("map<string,bigint>")
    for a, b in (("decimal(38,0)", "decimal(38,1)"), ("decimal(30,20)", "bigint"), ("array<int>", "int"), ("struct<a:int>", "string"), ("struct<a:int>", "struct<a:date>"), ("map<int,int>", "map<string,int>")):
        assert common_type(kind(a), kind(b)) is None
    with pytest.raises(TypeConflict, match="a: int and date; b: bigint and double"):
        common_schema(T.StructType.fromDDL("a int, b bigint, c int"), T.StructType.fromDDL("a date, b double, c string"))


def test_merges_widen_columns_or_refuse_before_they_publish(store, table):
    store.publish([store.stage("n", "t", table({"id": "int", "at": "date", "v": "int"}, (1, dt.date(2026, 1, 1), 5), (2, dt.date(2026, 1, 1), 6)), "1", ["id"], "at")])
    for n, kind in enumerate(("bigint", "decimal(20,2)", "string")):
        value = {"bigint": 7 << 40, "decimal(20,2)": Decimal("8.25"), "string": "nine"}[kind]
        store.merge(store.current("n", "t"), table({"ID": "bigint", "at": "timestamp_ntz", "v": kind}, (1, at(2 + n), value)), str(n))
        held = store.read("n", "t")
        assert held.count() == 2 and held.columns == ["id", "at", "v"] and dict(held.dtypes)["v"] == ["bigint", "decimal(21,2)", "string"][n]
    assert rows(store.read("n", "t"), "id", "v") == [(1, "nine"), (2, "6.00")]
    before = store.current("n", "t")
    for columns, row in (({"id": "bigint", "at": "timestamp", "v": "string"}, (1, at(9) + "Z", "x")), ({"id": "bigint", "at": "string", "v": "string"}, (1, "2026-02-02", "x"))):
        with pytest.raises(TypeConflict, match="n.t: no common type for at: timestamp_ntz"):
            store.merge(before, table(columns, row), "9")
    assert store.current("n", "t") == before and store.read("n", "t").count() == 2
    # Narrower rows land under the wide type.
    store.merge(before, table({"id": "int", "at": "date", "v": "int"}, (3, dt.date(2026, 3, 1), 4)), "10")
    assert rows(store.read("n", "t"), "id", "v") == [(1, "nine"), (2, "6.00"), (3, "4")]


def test_rejected_rows_of_all_shapes_stay_readable(store, table):
    store.add_rejected("n", "t", table({"id": "int", "v": "date"}, (1, dt.date(2026, 1, 1))), "a")
    store.add_rejected("n", "t", table({"id": "bigint", "v": "string", "w": "int"}, (2, "x", 3)), "b")
    store.add_rejected("n", "t", table({"id": "int", "v": "date"}, (4, None)), "c")
    for _ in range(2):
        assert rows(store.read_rejected("n", "t"), "id", "v", "w") == [(1, "2026-01-01", None), (2, "x", 3), (4, None, None)]
        store.add_rejected("n", "t", table({"id": "bigint", "v": "string", "w": "int"}, (2, "x", 3)), "b")


def test_initial_value(store, table):
    df = table(COLUMNS, (1, at(1), "a"), (2, at(2), "b"))
    load_table(store, "l", "t", df, "1", Incremental("at", "id", at(2)))
    assert rows(store.read("l", "t"), "id") == [(2,)]


def test_late_rows_land_once_inside_the_window(store, table):
    rule = Incremental("at", ["id"], look_back=dt.timedelta(days=3), count_missed=True)

    def load(version, *data):
        done = load_table(store, "ns", "t", table(COLUMNS, *data), version, rule)
        return done["extracted"], done["late"], done["missed"]

    old = [(1, at(1), "a"), (2, at(10), "b")]
    assert load("1", *old) == (2, 0, 0)
    # Behind the cursor: 3 and 5 inside the window (5 on its edge), 4 outside; 6 is past it.
    late = [(3, at(8), "c"), (4, at(5), "d"), (5, at(7), "e"), (6, at(11), "f")]
    assert load("2", *old, *late) == (3, 2, 1)
    assert load("3", *old, *late) == (0, 0, 1)
    assert rows(store.read("ns", "t"), "id") == [(1,), (2,), (3,), (5,), (6,)]
    # One row changes without its cursor, one comes with a cursor value that has landed.
    assert load("4", (1, at(1), "a"), (2, at(10), "B"), *late, (7, at(11), "g")) == (2, 1, 1)
    assert rows(store.read("ns", "t"), "id", "v")[1] == (2, "B")
    assert load("5", (1, at(20), "z"), *late, (7, at(11), "g"))[::2] == (1, 1)


def test_windows_over_numbers_with_an_initial_value(store, table):
    rule = Incremental("n", ["id"], initial_value=100, look_back=10, count_missed=True)
    columns = {"id": "bigint", "n": "bigint"}
    assert load_table(store, "ns", "t", table(columns, (1, 50), (2, 105)), "1", rule)["extracted"] == 1
    done = load_table(store, "ns", "t", table(columns, (1, 50), (2, 105), (3, 99), (4, 100), (5, 130)), "2", rule)
    assert (done["extracted"], done["late"], done["missed"]) == (2, 1, 0)
    done = load_table(store, "ns", "t", table(columns, (6, 119), (7, 120), (8, 60)), "3", rule)
    assert (done["extracted"], done["late"], done["missed"]) == (1, 1, 1)
    with pytest.raises(ValueError, match="without a value"):
        load_table(store, "ns", "t", table(columns, (9, None)), "4", rule)
    assert store.read("ns", "t").count() == 4


def test_a_first_load_without_rows_and_wider_types_keep_the_window(store, table):
    rule = Incremental("n", ["id"], look_back=5)
    assert load_table(store, "ns", "t", table({"id": "int", "n": "int"}), "1", rule)["extracted"] == 0
    assert load_table(store, "ns", "t", table({"id": "int", "n": "int"}, (1, 10)), "2", rule)["extracted"] == 1
    assert load_table(store, "ns", "t", table({"id": "bigint", "n": "int"}, (1, 10), (2, 6)), "3", rule)["late"] == 1
    assert load_table(store, "ns", "t", table({"id": "string", "n": "int"}, ("x", 9)), "4", rule)["extracted"] == 1
    assert rows(store.read("ns", "t"), "id") == [("1",), ("2",), ("x",)]
    for wrong in (dict(look_back=-1), dict(look_back="1 day"), dict(count_missed=True)):
        with pytest.raises(ValueError):
            Incremental("n", ["id"], **wrong)


@pytest.mark.parametrize("args",[("", ["id"]), ("at", []), ("at", None), ("at", ["id"], True), ("at", ["id"], "soon")])
def test_wrong_incremental_settings(args):
    with pytest.raises(ValueError):
        Incremental(*args)


def test_jdbc_options():
    pg = Database("jdbc:postgresql://h/db", {"user": "u"})
    assert pg.reader_options("t")["dbtable"] == "public.t"
    assert Database("jdbc:sqlserver://h").reader_options("t")["dbtable"] == "dbo.t"
    assert Database("jdbc:sqlserver://h", schema="s").qualified("t") == "s.t"
    split = pg.reader_options("t", Partitioning("id", "1", "100", 8))
    assert split["numPartitions"] == "8" and split["partitionColumn"] == "id" and split["fetchsize"] == "50000"


def test_namespaces():
    assert landing_namespace("flow") == "flow_landing" and landing_namespace("flow", "own") == "own"


# ---- bronze

TYPED = {"id": "int", "name": "string", "ok": "boolean", "amount": "decimal(12,2)", "at": "timestamp_ntz", "seen": "timestamp", "day": "date", "part": "float"}
TYPED_ROWS = [
    (1, "Ả é", True, "12.30", at(1), "2026-01-01T07:00:00+07:00", "2026-01-01", 1.5), (2, None, None, None, None, None, None, None),
    (3, "", False, "-0.01", at(3), "2026-01-03T00:00:00Z", "2026-01-03", 0.25), (4, " x ", True, "9999999999.99", at(4), None, None, -1.0), (5, "y", True, "0.00", at(5), None, None, 0.0),
]


@pytest.fixture
def batch(spark, tmp_path, table):
    root = str(tmp_path / "bronze")
    tables = {"typed": table(TYPED, *TYPED_ROWS).coalesce(1), "none": table({"id": "bigint"}), "plain": table({"id": "bigint"}, (1,), (2,)).coalesce(1)}
    return root, tables, bronze.extract(spark, root, "f", tables, chunk_rows=2)


def test_bronze_round_trip(spark, batch, store):
    root, tables, batch_id = batch
    entries = {e["table"]: e for e in registry(spark, root).collect()}
    assert entries["typed"]["objects"] == 3 and entries["none"]["objects"] == 0 and entries["none"]["total_rows"] == 0
    stored = spark.read.parquet(entries["typed"]["path"])
    assert dict(stored.dtypes)["amount"] == "string" and dict(stored.dtypes)["id"] == "bigint"
    done = bronze.load(spark, root, "f", batch_id, store)
    assert done["outcome"] == "loaded" and done["tables"]["typed"]["rows"] == 5
    landed = store.read("f_landing", "typed")
    assert landed.schema.simpleString() == tables["typed"].schema.simpleString()
    assert rows(landed) == rows(tables["typed"])
    assert store.read("f_landing", "none").count() == 0
    assert store.current("f_landing", "plain").path == entries["plain"]["path"]
    assert bronze.load(spark, root, "f", batch_id, store)["outcome"] == "already_loaded"
    assert {e["status"] for e in registry(spark, root).collect()} == {"loaded"}


def test_unsupported_types_are_refused(spark, tmp_path):
    with pytest.raises(bronze.BronzeError, match="not supported"):
        bronze.extract(spark, str(tmp_path), "f", {"t": spark.sql("select array(1) as a")})
    with pytest.raises(bronze.BronzeError, match="1 to 20"):
        bronze.extract(spark, str(tmp_path), "f", {})


def data_files(entry):
    folder = entry["path"].removeprefix("file:")
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".parquet"))


def entry_of(spark, root, name):
    return registry(spark, root).where(F.col("table") == name).first()


def refused(spark, root, batch_id, store, text, flow="f"):
    with pytest.raises(bronze.BronzeError, match=text):
        bronze.load(spark, root, flow, batch_id, store)
    assert store.current("f_landing", "plain") is None


def test_a_changed_object_is_refused_before_anything_is_replaced(spark, batch, store):
    root, _, batch_id = batch
    path = data_files(entry_of(spark, root, "typed"))[0]
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))  # as on a store without checksums
    refused(spark, root, batch_id, store, "sha256 differs")


def test_a_cut_off_object_is_named(spark, batch, store):
    root, _, batch_id = batch
    path = data_files(entry_of(spark, root, "typed"))[0]
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-9])
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    refused(spark, root, batch_id, store, f"{os.path.basename(path)} size differs")


def test_all_missing_objects_are_counted(spark, tmp_path, store, table):
    root = str(tmp_path / "bronze")
    batch_id = bronze.extract(spark, root, "f", {"plain": table({"id": "bigint"}, *[(i,) for i in range(9)]).coalesce(1)}, chunk_rows=1)
    for path in data_files(entry_of(spark, root, "plain"))[1:]:
        os.remove(path)
    refused(spark, root, batch_id, store, r"(part-\S+ missing; ){4}part-\S+ missing and 3 more$")


def test_objects_are_sized_by_bytes(spark, tmp_path, monkeypatch, table):
    from sluiceway.bronze import batch as batches

    wide = table({"id": "bigint", "text": "string"}, *[(i, "x" * 1000) for i in range(40)]).coalesce(1)
    tables = {"wide": wide, "narrow": table({"id": "bigint"}, *[(i,) for i in range(40)]).coalesce(1), "none": table({"id": "bigint"})}
    columns = {t: batches.stored_columns(df.schema) for t, df in tables.items()}
    rows_each = batches.rows_per_object(tables, columns, 10_300)
    assert rows_each["wide"] in (9, 10) and 900 < rows_each["narrow"] < 1300
    assert batches.rows_per_object({"wide": wide}, columns, 1) == {"wide": 1}
    monkeypatch.setattr(batches, "rows_per_object", lambda *a: rows_each)
    bronze.extract(spark, str(tmp_path / "b"), "f", tables)
    assert {e["table"]: e["objects"] for e in registry(spark, str(tmp_path / "b")).collect()} == {"wide": -(-40 // rows_each["wide"]), "narrow": 1, "none": 0}


def test_a_batch_takes_few_jobs(spark, tmp_path, store, table):
    tables = {n: table({"id": "bigint"}, (1,), (2,)) for n in ("a", "b", "c")}
    counted = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bronze-jobs", "jobs of a batch")
    try:
        batch_id = bronze.extract(spark, str(tmp_path / "b"), "f", tables, chunk_rows=10)
        extracted = len(counted.getJobIdsForGroup("bronze-jobs"))
        bronze.load(spark, str(tmp_path / "b"), "f", batch_id, store)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    loaded = len(counted.getJobIdsForGroup("bronze-jobs")) - extracted
    assert extracted + loaded <= 26, (extracted, loaded)


def test_an_extra_object_is_refused(spark, batch, store):
    root, _, batch_id = batch
    path = data_files(entry_of(spark, root, "plain"))[0]
    open(path.replace("part-", "part-9"), "wb").write(open(path, "rb").read())
    refused(spark, root, batch_id, store, "not in the manifest")


def test_a_changed_manifest_is_refused(spark, batch, store):
    root, _, batch_id = batch
    folder = entry_of(spark, root, "plain")["path"] + "/_manifest"
    manifest = spark.createDataFrame(spark.read.parquet(folder).withColumn("rows", F.lit(7).cast("bigint")).collect(), "object string, sha256 string, size_bytes bigint, rows bigint")
    manifest.write.mode("overwrite").parquet(folder)
    refused(spark, root, batch_id, store, "manifest changed")


def test_wrong_batches_are_refused(spark, batch, store):
    root, _, batch_id = batch
    refused(spark, root, "nonsense", store, "not a batch id")
    refused(spark, root, "00000000-0000-0000-0000-000000000000", store, "not in the registry")
    refused(spark, root, batch_id, store, "belongs to", flow="other")
    one = entry_of(spark, root, "plain").asDict()
    append_records(spark, f"{root}/_registry", [{**one, "status": "extracting", "seq": one["seq"] + 10**15}], REGISTRY)
    refused(spark, root, batch_id, store, "not entirely 'extracted'")


def test_an_incomplete_batch_is_refused(spark, batch, store):
    root, _, batch_id = batch
    entries = [e.asDict() for e in registry(spark, root).collect()]
    append_records(spark, f"{root}/_registry", [{**e, "batch_tables": 4, "seq": e["seq"] + 10**15} for e in entries], REGISTRY)
    refused(spark, root, batch_id, store, "incomplete")


def test_older_batches_and_drift_are_refused(spark, batch, store, table):
    root, _, old = batch
    new = bronze.extract(spark, root, "f", {"plain": table({"id": "bigint"}, (7,))})
    bronze.load(spark, root, "f", new, store)
    with pytest.raises(bronze.BronzeError, match="newer batch"):
        bronze.load(spark, root, "f", old, store)
    drifted = bronze.extract(spark, root, "f", {"plain": table({"id": "bigint", "extra": "string"}, (7, "x"))})
    with pytest.raises(bronze.BronzeError, match="drift"):
        bronze.load(spark, root, "f", drifted, store)
    assert rows(store.read("f_landing", "plain")) == [(7,)]
    assert reports.batch_problems(registry(spark, root), 1, 3) == ["2 batch(es) are incomplete"]


# ---- staged runs and the ledger

def flow(source, threshold=50, curated_min=0):
    return Flow("demo", {"orders": lambda _s: source}, [
        Stage("raw", {"raw_orders": lambda m: m["orders"].select(F.col("id").cast("bigint").alias("id"), "v")},
              [NotNull("raw_orders", ["v"]), Unique("raw_orders", ["id"])], Quarantine(threshold)),
        Stage("curated", {"report": "select count(*) as n from {raw_orders}"}, [RowCountBounds("report", min=curated_min)], depends_on="raw"),
    ], landing_gates=[RowCountBounds("orders", min=1, max_delta_pct=60)])


SOURCE = {"id": "string", "v": "string"}


def test_staged_run(spark, store, table):
    ledger = Ledger(spark, f"{store.root}/_ledger")
    good = table(SOURCE, ("1", "a"), ("2", None), ("3", "c"), ("4", "d"))
    first = run_flow(spark, flow(good), store, ledger)
    assert first.status == "ok" and rows(store.read("demo", "report")) == [(3,)]
    assert rows(store.read("demo", "raw_orders"), "id") == [(1,), (3,), (4,)]
    again = run_flow(spark, flow(good), store, ledger)
    assert rows(store.read("demo", "report")) == [(3,)]
    assert rows(store.read_rejected("demo", "raw_orders"), "id", "run_id") == sorted([(2, first.run_id), (2, again.run_id)])

    bad = run_flow(spark, flow(table(SOURCE, ("1", "a"), ("1", "b"), ("3", None), ("4", None))), store, ledger)
    assert bad.status == "failed" and "unique" in bad.problem and "curated" not in bad.outcomes
    assert rows(store.read("demo", "report")) == [(3,)] and rows(store.read("demo", "raw_orders"), "id") == [(1,), (3,), (4,)]
    assert store.read_rejected("demo", "raw_orders").where(F.col("run_id") == bad.run_id).count() == 4

    shrunk = run_flow(spark, flow(table(SOURCE, ("1", "a"))), store, ledger)
    assert shrunk.status == "failed" and "off the previous" in shrunk.problem

    runs, stages, gates, events = (ledger.table(n) for n in ("runs", "stage_runs", "gate_runs", "events"))
    assert rows(runs, "id", "status") == [(first.run_id, "ok"), (again.run_id, "ok"), (bad.run_id, "failed"), (shrunk.run_id, "failed")]
    status = reports.status_table(runs, stages, gates, "data")
    assert rows(status, "run_id", "stage", "status", "gates") == [(shrunk.run_id, "landing", "failed", "row_count_bounds:failed")]
    timeline = reports.audit_timeline(bad.run_id, stages, gates, events)
    assert [r["source"] for r in timeline.orderBy("source").collect()].count("gate") == 3
    summary = {(r["run_id"], r["stage"]): json.loads(r["gates"]) for r in reports.gate_summary(stages, gates).collect()}
    assert [(g["type"], g["status"], g["rows_checked"], g["rows_rejected"]) for g in summary[bad.run_id, "raw"]] == [("not_null", "passed", 4, 2), ("unique", "failed", 2, 2)]
    assert reports.reconcile(summary_frame(spark, summary), summary_frame(spark, summary), ["k"], ["v"]).count() == 0


def summary_frame(spark, summary):
    return spark.createDataFrame([(str(k), json.dumps(v)) for k, v in summary.items()], "k string, v string")


def test_a_stage_that_raises_is_recorded(spark, store, table):
    broken = Flow("demo", {"t": lambda _s: table(SOURCE, ("x", "a"))}, [Stage("raw", {"r": lambda m: m["t"].select(F.col("id").cast("int"))})])
    run = run_flow(spark, broken, store)
    assert run.status == "failed" and "CAST_INVALID_INPUT" in run.problem
    assert rows(Ledger(spark, f"{store.root}/_ledger").table("stage_runs"), "stage", "status") == [("landing", "passed"), ("raw", "failed")]


def test_flow_definitions_are_checked(table):
    def make(*stages, gates=()):
        return Flow("f", {"t": lambda _s: None}, stages, gates)

    for wrong in (
        lambda: make(Stage("a", {}), Stage("a", {})), lambda: make(Stage("a", {}, depends_on="b"), Stage("b", {})),
        lambda: make(Stage("a", {"m": "select 1"}, [NotNull("n", ["x"])])), lambda: make(gates=[NotNull("m", ["x"])]),
    ):
        with pytest.raises(GateError):
            wrong()


def test_incremental_sources_in_a_flow(spark, store, table):
    def make(*data):
        return Flow("inc", {"t": lambda _s: table(COLUMNS, *data)}, [Stage("out", {"n": "select count(*) as n from {t}"})],
                    incremental={"t": Incremental("at", ["id"])})

    run_flow(spark, make((1, at(1), "a"), (2, at(2), "b")), store)
    run_flow(spark, make((2, at(3), "b2"), (3, at(3), "c")), store)
    assert rows(store.read("inc_landing", "t"), "id", "v") == [(1, "a"), (2, "b2"), (3, "c")]
    assert rows(store.read("inc", "n")) == [(3,)]
    run_flow(spark, make((3, at(3), "c")), store, full_refresh=True)
    assert rows(store.read("inc", "n")) == [(1,)]
    noted = Ledger(spark, f"{store.root}/_ledger").table("events").where("kind = 'extract.done'").orderBy("id").collect()
    assert [json.loads(e["data_json"]) for e in noted] == [{"t": 2}, {"t": 2}, {"t": 1}]
    with pytest.raises(GateError):
        Flow("f", {}, [], incremental={"t": Incremental("at", ["id"])})
    with pytest.raises(GateError):
        Flow("f", {}, [], limits={"total": 3})


def test_a_stage_over_its_limit_is_stopped(spark, store, table):
    slow = Flow("slow", {"t": lambda _s: table({"x": "int"}, (1,))}, [
        Stage("raw", {"r": lambda m: spark.range(10**13).selectExpr("sum(pmod(hash(id), 7)) as s")}),
    ], limits={"transform": 1.0, "gate": 0.5})
    run = run_flow(spark, slow, store)
    assert run.status == "failed" and "did not finish within 1.5 s" in run.problem
    assert spark.range(3).count() == 3


def test_validate(spark, tmp_path, table):
    good = table(SOURCE, ("1", "a"), ("2", None), ("3", "c"))
    expected = [Expected("report", [{"n": 2}], columns={"n": "bigint"}, row_count=1), Expected("raw_orders", [{"id": 1}, {"id": 3}])]

    def go(name, want=expected, fixture=good, **kw):
        return validate(spark, flow(good), {"orders": fixture}, want, TableStore(spark, str(tmp_path / name)), **kw)

    need = {"stage": "raw", "type": "unique", "table": "raw_orders", "columns": ["id"]}
    assert go("a", required_gates=[need]).ok
    assert "surplus" in go("b", [Expected("report", [{"n": 3}])]).problems[0]
    assert "unique" in go("c", fixture=table(SOURCE, ("1", "a"), ("1", "b"))).problems[0]
    assert go("d", required_gates=[{**need, "on_violation": "fail"}]).problems
    assert validate(spark, flow(good), {}, expected, TableStore(spark, str(tmp_path / "e"))).problems == ["the fixture lacks source table(s) ['orders']"]


def test_models_refer_to_each_other(table):
    built = build_models({"t": table({"x": "int"}, (1,), (2,))}, {"a": "select x + 1 as x from {t}", "b": lambda m: m["a"].where("x > 2")})
    assert rows(built["b"]) == [(3,)]


def test_prune(spark, table):
    old, new = "2026-01-01T00:00:00", "2026-03-01T00:00:00"
    tables = {
        "runs": table({"id": "bigint", "kind": "string", "target": "string", "status": "string", "finished_at": "timestamp_ntz"},
                      (1, "data", "a", "ok", old), (2, "data", "a", "running", None), (3, "data", "b", "failed", old), (4, "data", "a", "ok", new), (5, "verify", "a", "ok", old), (6, "data", "a", "running", old)),
        "stage_runs": table({"id": "bigint", "run_id": "bigint"}, (10, 1), (11, 1), (12, 2), (13, 3), (14, None)),
        "gate_runs": table({"id": "bigint", "stage_run_id": "bigint"}, (20, 10), (21, 11), (22, 12), (23, 13)),
        "events": table({"id": "bigint", "run_id": "bigint"}, (30, 1), (31, 3), (32, None), (33, 5)),
    }
    now = dt.datetime(2026, 3, 2)
    kept, counts = reports.prune(tables, now, 30)
    assert rows(counts) == [("events", 2), ("gate_runs", 3), ("runs", 2), ("stage_runs", 3)]
    assert {n: [r["id"] for r in df.orderBy("id").collect()] for n, df in kept.items()} == {"runs": [2, 4, 5, 6], "stage_runs": [12, 14], "gate_runs": [22], "events": [32, 33]}
    assert rows(reports.prune(tables, now, 30, "b")[1])[2] == ("runs", 1)
    assert all(r["deleted"] == 0 for r in reports.prune(tables, now, 3000)[1].collect())


def test_ledger_keeps_history_but_shows_the_last_state(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    run = ledger.start_run("data", "flow", {"by": "me"})
    assert rows(ledger.table("runs"), "status") == [("running",)]
    ledger.finish_run(run, "ok")
    assert rows(ledger.table("runs"), "id", "status") == [(run, "ok")] and ledger.records("runs").count() == 2
    assert ledger.last_counts("flow", "raw") == {}


def test_pruning_the_ledger_itself(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for target, end in (("a", "ok"), ("b", "failed"), ("a", None)):
        run = ledger.start_run("data", target)
        stage = ledger.start_stage(run, target, "raw")
        if end:
            ledger.finish_stage(stage, "passed", "fine", counts={"t": 4})
            ledger.finish_run(run, end)
    later = dt.datetime.now() + dt.timedelta(days=9)
    expected = {"runs": 2, "stage_runs": 2, "gate_runs": 0, "events": 2}
    assert ledger.prune(30, now=later) == dict.fromkeys(expected, 0)
    assert ledger.prune(3, dry_run=True, now=later) == expected and ledger.table("runs").count() == 3
    assert ledger.prune(3, "b", now=later) == {"runs": 1, "stage_runs": 1, "gate_runs": 0, "events": 1}
    assert ledger.last_counts("a", "raw") == {"t": 4} and ledger.last_counts("b", "raw") == {}
    assert ledger.prune(3, now=later)["runs"] == 1
    assert rows(Ledger(spark, str(tmp_path / "ledger")).table("runs"), "target", "status") == [("a", "running")]
    ledger.finish_stage(stage, "passed", "late")
    ledger.finish_run(run, "ok")
    assert rows(ledger.table("runs"), "id", "status") == [(run, "ok")] and ledger.table("stage_runs").count() == 1


# ---- the stream

def test_stream_replays_change_nothing(spark, store, table, tmp_path):
    folder, schema = str(tmp_path / "in"), table(COLUMNS).schema
    table(COLUMNS, (1, at(1), "a"), (2, at(1), None), (3, at(1), "c")).coalesce(1).write.mode("append").parquet(folder)

    def go(checkpoint):
        stream = file_stream(spark, folder, schema)
        ingest(stream, store, "s", "t", ["id"], "at", str(tmp_path / checkpoint), [NotNull("t", ["v"])], Quarantine(50)).awaitTermination()

    go("c1")
    table(COLUMNS, (1, at(2), "a2"), (4, at(0 + 1), "late row")).coalesce(1).write.mode("append").parquet(folder)
    go("c1")
    expected = [(1, "a2"), (3, "c"), (4, "late row")]
    assert rows(store.read("s", "t"), "id", "v") == expected
    assert rows(store.read_rejected("s", "t"), "id", "run_id") == [(2, 0)]
    go("c1")
    assert rows(store.read_rejected("s", "t"), "id") == [(2,)]
    go("lost-checkpoint")
    assert rows(store.read("s", "t"), "id", "v") == expected
    # Files that arrive after a new checkpoint are read, although its batches are numbered from 0 again.
    table(COLUMNS, (5, at(2), "new")).coalesce(1).write.mode("append").parquet(folder)
    go("lost-checkpoint")
    go("another")
    assert rows(store.read("s", "t"), "id", "v") == [*expected, (5, "new")]


def test_loading_a_version_again_changes_nothing(spark, store, table):
    base = table(COLUMNS, (1, at(1), "a"), (2, at(2), "b"))
    store.publish([store.stage("n", "t", base, "1", ["id"], "at")])
    held = store.read("n", "t")
    for _ in range(2):
        store.merge(store.current("n", "t"), table(COLUMNS, (2, at(3), "b2"), (3, at(1), "c")), "2")
        assert rows(store.read("n", "t"), "id", "v") == [(1, "a"), (2, "b2"), (3, "c")]
    store.replace("n", {"u": base}, "1")
    open_reader = store.read("n", "u")
    store.replace("n", {"u": table(COLUMNS, (9, at(1), "z"))}, "1")
    assert rows(open_reader, "id") == [(1,), (2,)] and rows(store.read("n", "u"), "id") == [(9,)] and rows(held, "id") == [(1,), (2,)]


def test_merges_equal_the_newest_row_of_each_key(spark, store, table):
    r = random.Random(6)
    loads = [[(r.randint(1, 12), at(r.randint(1, 9)), f"{n}-{k}") for k in range(6)] for n in range(4)]
    store.publish([store.stage("n", "t", table(COLUMNS, (1, at(5), "base"), (500, at(3), "late")), "0", ["id"], "at")])
    store.merge(store.current("n", "t"), table(COLUMNS, (500, at(1), "older")), "early")
    assert store.current("n", "t").high.startswith(str(at(5))[:10])
    held = {1: (1, at(5), "base"), 500: (500, at(3), "late")}
    for n, load in enumerate(loads):
        newest = {i: (i, when, v) for i, when, v in sorted(load, key=lambda x: (x[1], x[2]))}
        store.merge(store.current("n", "t"), table(COLUMNS, *newest.values()), str(n))
        for i, row in newest.items():
            if i not in held or row[1] >= held[i][1]:
                held[i] = row
        assert rows(store.read("n", "t")) == sorted((i, dt.datetime.fromisoformat(when), v) for i, when, v in held.values())


def test_merges_refuse_or_land_what_they_used_to_drop(spark, store, table):
    store.publish([store.stage("n", "t", table(COLUMNS, (1, at(1), "a")), "1", ["id"], "at")])
    for row in ((None, at(2), "x"), (2, None, "x")):
        with pytest.raises(ValueError, match="without a value"):
            store.merge(store.current("n", "t"), table(COLUMNS, row), "2")
    with pytest.raises(ValueError, match=r"no longer has column\(s\) \['v'\]"):
        store.merge(store.current("n", "t"), table(COLUMNS, (2, at(2), "x")).drop("v"), "2")
    store.merge(store.current("n", "t"), table({**COLUMNS, "w": "int"}, (2, at(2), "b", 7)), "2")
    assert rows(store.read("n", "t"), "id", "v", "w") == [(1, "a", None), (2, "b", 7)]


def test_a_refused_batch_leaves_landing_alone(spark, store, table, tmp_path):
    folder, schema = str(tmp_path / "in"), table(COLUMNS).schema
    table(COLUMNS, (1, at(1), None)).write.parquet(folder)
    query = ingest(file_stream(spark, folder, schema), store, "s", "t", ["id"], "at", str(tmp_path / "c"), [NotNull("t", ["v"])], Quarantine(50))
    with pytest.raises(Exception, match="above the 50% threshold"):
        query.awaitTermination()
    assert store.current("s", "t") is None and store.read_rejected("s", "t").count() == 1


def test_unique_keys_across_batches(spark, store, table, tmp_path):
    columns = {"id": "bigint", "code": "string", "at": "timestamp_ntz", "v": "string", "big": "bigint", "exact": "decimal(30,2)"}
    folder, schema = str(tmp_path / "in"), table(columns).schema
    gates = [NotNull("t", ["v"]), Unique("t", ["code"])]

    def arrive(*listed):
        table(columns, *[(*r, None if r[0] % 3 else (1 << 62) + r[0], "12345678901234567890.12") for r in listed]).coalesce(1).write.mode("append").parquet(folder)

    def go(checkpoint="c"):
        ingest(file_stream(spark, folder, schema), store, "s", "t", ["id"], "at", str(tmp_path / checkpoint), gates, Quarantine(100)).awaitTermination()
        return rows(store.read("s", "t"), "id"), rows(store.read_rejected("s", "t"), "id", "run_id")

    arrive((1, "a", at(1), "x"), (2, "b", at(1), "x"), (3, "c", at(1), "x"), (4, None, at(1), "x"), (5, None, at(1), "x"), (6, "d", at(1), None))
    assert go() == ([(1,), (2,), (3,), (4,), (5,)], [(6, 0)])
    # b comes again, twice: both copies and the landed one are moved. d did not count, a null never does.
    arrive((7, "b", at(2), "x"), (8, "b", at(2), "x"), (9, "d", at(2), "x"), (10, None, at(2), "x"), (11, "e", at(2), "x"))
    second = ([(1,), (3,), (4,), (5,), (9,), (10,), (11,)], [(2, 1), (6, 0), (7, 1), (8, 1)])
    assert go() == second and go() == second
    assert {r.reason for r in store.read_rejected("s", "t").where("id in (2, 7, 8)").collect()} == {"unique: duplicate code"}
    # A batch of rejected rows alone still moves what has landed.
    arrive((12, "e", at(3), "x"), (13, "b", at(3), "x"))
    assert go() == ([(1,), (3,), (4,), (5,), (9,), (10,)], [(2, 1), (6, 0), (7, 1), (8, 1), (11, 2), (12, 2), (13, 2)])
    assert rows(store.read("s", "t").where("id in (1, 9)"), "big", "exact") == [(None, Decimal("12345678901234567890.12")), ((1 << 62) + 9, Decimal("12345678901234567890.12"))]


def test_children_of_landed_parents(spark, store, table, tmp_path):
    columns = {"id": "bigint", "parent": "bigint", "at": "timestamp_ntz"}
    folder, schema = str(tmp_path / "in"), table(columns).schema
    gates = [ReferentialIntegrity("t", "parent", {"table": "p", "column": "key"})]
    for keys, child, landed in (((1, 2), (10, 1, at(1)), [(10,)]), ((1, 2), (11, 3, at(1)), [(10,)]), ((1, 2, 3), (12, 3, at(2)), [(10,), (12,)])):
        store.replace("s", {"parents": table({"key": "bigint"}, *[(k,) for k in keys])}, str(len(keys)))
        table(columns, child).coalesce(1).write.mode("append").parquet(folder)
        ingest(file_stream(spark, folder, schema), store, "s", "t", ["id"], "at", str(tmp_path / "c"), gates, Quarantine(100), {"p": ("s", "parents")}).awaitTermination()
        assert rows(store.read("s", "t"), "id") == landed
    assert rows(store.read_rejected("s", "t"), "id") == [(11,)]


def test_unique_keys_need_no_state_and_only_see_what_earlier_gates_left(spark, store, table, tmp_path):
    columns = {"id": "bigint", "parent": "bigint", "code": "string", "at": "timestamp_ntz"}
    folder, schema = str(tmp_path / "in"), table(columns).schema
    store.replace("s", {"parents": table({"key": "bigint"}, (1,))}, "1")
    orphans, unique = ReferentialIntegrity("t", "parent", {"table": "p", "column": "key"}), Unique("t", ["code"])

    def go(*listed, gates=(orphans, unique)):
        # Several files make one batch of a run.
        table(columns, *listed).repartition(2).write.mode("append").parquet(folder)
        query = ingest(file_stream(spark, folder, schema), store, "s", "t", ["id"], "at", str(tmp_path / "c"), gates, Quarantine(100), {"p": ("s", "parents")})
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
        return rows(store.read("s", "t"), "id"), rows(store.read_rejected("s", "t"), "id", "run_id")

    assert go((1, 9, "a", at(1)), (2, 1, "b", at(1))) == ([(2,)], [(1, 0)])
    # The orphan's code was no copy; b is one.
    assert go((3, 1, "a", at(2)), (4, 1, "b", at(2))) == ([(3,)], [(1, 0), (2, 1), (4, 1)])
    with pytest.raises(Exception, match="2 of the 2 batches before have no keys of gate 0: code"):
        go((5, 1, "c", at(3)), gates=(unique,))
    assert rows(store.read("s", "t"), "id") == [(3,)]
    # The refused batch runs again, then the new one.
    assert go((6, 1, "a", at(3))) == ([(5,)], [(1, 0), (2, 1), (3, 3), (4, 1), (6, 3)])
