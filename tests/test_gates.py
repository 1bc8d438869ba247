import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sluiceway.gates import (
    BusinessRule, Freshness, NotNull, Quarantine, ReferentialIntegrity, RowCountBounds, SchemaContract, Unique,
    gate_from_dict, run_gates, run_gates_one_by_one,
)
from sluiceway.gates.keys import key_counts
from sluiceway.gates.model import GateError
from sluiceway.gates.verdict import ColumnTest, required_gate_problems, required_test_problems, run_column_tests
from sluiceway.gates.verdict import test_run_verdict as run_verdict

BOTH = pytest.mark.parametrize("run", [run_gates, run_gates_one_by_one])
ORDERS = {"order_id": "bigint", "customer_id": "bigint", "amount": "decimal(10,2)"}


@BOTH
def test_bad_rows_reach_quarantine_and_nothing_else(table, run):
    """Ids 1, 2 (no customer), 3 twice, 5: 1 and 5 go on."""
    df = table(ORDERS, (1, 10, "5"), (2, None, "6"), (3, 11, "7"), (3, 12, "8"), (5, 13, "9"))
    out = run({"orders": df}, [NotNull("orders", ["customer_id"]), Unique("orders", ["order_id"])], Quarantine(50), run_id=9)
    assert out.passed
    assert rows(out.tables["orders"], "order_id") == [(1,), (5,)]
    assert rows(out.rejected["orders"], "order_id", "reason", "run_id") == [
        (2, "not_null: one of customer_id is null", 9), (3, "unique: duplicate order_id", 9), (3, "unique: duplicate order_id", 9),
    ]
    assert [(r.rows_checked, r.rows_rejected) for r in out.results] == [(5, 1), (4, 2)]


@BOTH
@pytest.mark.parametrize("ids,passed", [((1, None, 3), True), ((1, None, None), False)])
def test_threshold(table, run, ids, passed):
    df = table({"id": "bigint"}, *[(i,) for i in ids])
    out = run({"orders": df}, [NotNull("orders", ["id"])], Quarantine(50))
    assert out.passed is passed
    # Rows are moved before the verdict, so a failing stage has quarantined too.
    assert out.tables["orders"].count() + out.rejected["orders"].count() == 3
    assert out.rejected["orders"].count() == ids.count(None)


@BOTH
def test_threshold_fails_only_above_it(table, run):
    df = table({"id": "bigint"}, (1,), (None,))
    assert run({"t": df}, [NotNull("t", ["id"])], Quarantine(50)).passed
    assert not run({"t": df}, [NotNull("t", ["id"])], Quarantine(49.9)).passed


@BOTH
def test_without_quarantine_any_reject_fails_and_nothing_moves(table, run):
    df = table({"id": "bigint"}, (1,), (1,), (None,))
    out = run({"t": df}, [NotNull("t", ["id"]), Unique("t", ["id"])])
    assert [r.status for r in out.results] == ["failed", "failed"]
    assert [(r.rows_checked, r.rows_rejected) for r in out.results] == [(3, 1), (3, 2)]
    assert out.tables["t"].count() == 3 and not out.rejected


@BOTH
def test_keys_with_null_never_repeat(table, run):
    df = table({"a": "int", "b": "int"}, (1, None), (1, None), (2, 1), (2, 1), (None, None), (None, None))
    gate = Unique("t", ["a", "b"])
    out = run({"t": df}, [gate], Quarantine(100))
    assert rows(out.rejected["t"], "a", "b") == [(2, 1), (2, 1)]
    assert gate.report(df).count() == 3


@BOTH
def test_children_of_a_quarantined_parent_are_orphans(table, run):
    tables = {
        "parents": table({"id": "int", "name": "string"}, (1, "a"), (2, None)),
        "lines": table({"n": "int", "ref": "int"}, (1, 1), (2, 2), (3, None), (4, 7)),
    }
    gates = [NotNull("parents", ["name"]), ReferentialIntegrity("lines", "ref", {"table": "parents", "column": "id"})]
    out = run(tables, gates, Quarantine(100))
    assert rows(out.tables["lines"], "n") == [(1,), (3,)]
    early = run(tables, gates[::-1], Quarantine(100))
    assert rows(early.tables["lines"], "n") == [(1,), (2,), (3,)]


@BOTH
def test_rule_counts_its_rows_but_moves_every_match(table, run):
    df = table({"id": "int", "v": "int"}, (1, 5), (1, 6), (2, 7), (None, 8))
    rule = BusinessRule("r", "select id from t where v = 5 union all select id from t where v = 5 union all select id from t where v = 8", "t", "id")
    out = run({"t": df}, [rule], Quarantine(100))
    assert (out.results[0].rows_checked, out.results[0].rows_rejected) == (4, 3)
    assert rows(out.rejected["t"], "id", "v") == [(1, 5), (1, 6)]
    assert rows(out.tables["t"], "id") == [(None,), (2,)]


@BOTH
def test_a_rule_sees_the_rows_earlier_gates_left(table, run):
    df = table({"id": "int", "v": "int"}, (1, 5), (1, None), (2, 1), (2, 2))
    rule = BusinessRule("one_row", "select id from t group by id having count(*) > 1", "t", "id")
    out = run({"t": df}, [NotNull("t", ["v"]), rule], Quarantine(100))
    assert rows(out.tables["t"], "id", "v") == [(1, 5)]


@BOTH
def test_a_rule_leaves_the_callers_views_alone(spark, table, run):
    spark.range(7).createOrReplaceTempView("t")
    rule = BusinessRule("r", "select id from t where id = 1", "t", "id")
    out = run({"t": table({"id": "int"}, (1,), (2,)), "u": table({"id": "int"})}, [rule], Quarantine(100))
    assert rows(out.tables["t"]) == [(2,)] and rows(out.rejected["t"], "id") == [(1,)]
    assert spark.table("t").count() == 7 and not spark.catalog.tableExists("u")
    spark.catalog.dropTempView("t")


@BOTH
def test_a_crashing_gate_fails_and_the_rest_still_run(table, run):
    df = table({"id": "int"}, (1,), (None,))
    out = run({"t": df}, [NotNull("t", ["absent"]), BusinessRule("bad", "select nope from t", "t", "id"), NotNull("t", ["id"])], Quarantine(100))
    assert [r.status for r in out.results] == ["failed", "failed", "passed"]
    assert "the gate itself raised" in out.results[0].detail
    assert rows(out.tables["t"]) == [(1,)]


@BOTH
def test_freshness(table, run):
    now = dt.datetime(2026, 1, 10)
    tables = {"t": table({"at": "timestamp_ntz"}, ("2026-01-09T00:00:00",), (None,)), "empty": table({"at": "timestamp_ntz"})}
    ages = ["24h", "1439m", "1d", "86399s"]
    out = run(tables, [Freshness(["t", "empty"], "at", a) for a in ages], now=now)
    assert [r.passed for r in out.results] == [True, False, True, False]


@BOTH
def test_freshness_of_dates_and_instants(spark, table, run, monkeypatch):
    """Instants are read as UTC whatever zone the driver is in; text has no age."""
    import time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    tables = {
        "instants": table({"at": "timestamp"}, ("2026-01-09T00:00:00Z",)), "dates": table({"at": "date"}, ("2026-01-09",)),
        "texts": table({"at": "string"}, ("2026-01-09",)),
    }
    gates = [Freshness([t], "at", a) for t in ("instants", "dates") for a in ("24h", "23h")] + [Freshness(["texts"], "at", "1d")]
    out = run(tables, gates, now=dt.datetime(2026, 1, 10))
    monkeypatch.undo()
    time.tzset()
    assert [r.passed for r in out.results] == [True, False, True, False, False]
    assert "not a date or timestamp" in out.results[-1].detail


@BOTH
def test_row_counts(table, run):
    df = table({"id": "int"}, (1,), (2,), (3,))
    gates = [RowCountBounds("t", min=3, max=3), RowCountBounds("t", min=4), RowCountBounds("t", max=2),
             RowCountBounds("t", max_delta_pct=50), RowCountBounds("t", max_delta_pct=49)]
    assert [r.passed for r in run({"t": df}, gates, previous_counts={"t": 2}).results] == [True, False, False, True, False]
    assert all(r.passed for r in run({"t": df}, gates[3:], previous_counts={"t": 0}).results)
    assert all(r.passed for r in run({"t": df}, gates[3:]).results)


def test_schema_contract(table):
    tables = {"t": table({"id": "bigint", "name": "string", "at": "timestamp_ntz", "n": "decimal(9,2)", "x": "int"})}
    ok = SchemaContract({"t": {"id": "int8", "name": "character varying", "at": "timestamp", "n": "numeric"}})
    bad = SchemaContract({"t": {"id": "text", "gone": "int"}})
    out = run_gates(tables, [ok, bad])
    assert [r.passed for r in out.results] == [True, False]
    assert "gone" in out.results[1].detail


@pytest.mark.parametrize("raw", [
    {"type": "row_count_bounds", "table": "t", "min_rows": 1}, {"type": "unique", "table": "t"}, {"type": "unique", "table": "t", "columns": "id"},
    {"type": "unique", "table": "t", "columns": []}, {"type": "nope"}, {"type": "freshness", "tables": ["t"], "column": "at", "max_age": "1w"},
    {"type": "business_rule", "name": "n", "sql": "s", "table": "t", "id_column": "id"},
    {"type": "business_rule", "name": "n", "sql": "s", "table": "t", "id_column": "id", "expect": "rows"},
    {"type": "schema_contract", "tables": ["t"]}, {"type": "schema_contract", "tables": {}},
    {"type": "referential_integrity", "table": "t", "column": "c", "references": {"table": "p"}},
])
def test_wrong_declarations_are_refused(raw):
    with pytest.raises(GateError):
        gate_from_dict(raw)


def test_declarations(table):
    assert gate_from_dict({"type": "row_count_bounds", "table": "t", "min": 1}) == RowCountBounds("t", min=1)
    assert gate_from_dict({"type": "not_null", "table": "t", "columns": ["a"]}) == NotNull("t", ["a"])
    with pytest.raises(GateError):
        Quarantine(101)


@pytest.mark.parametrize("seed", range(4))
def test_fused_equals_one_by_one_on_random_tables(spark, seed):
    pick = random.Random(seed)

    def value(*choices):
        return pick.choice([None, *choices])

    lines = [(i, value(1, 2, 3, 4, 5), value(1, 2), value(*range(8)), value(1, 2, 3)) for i in range(60)]
    parents = [(value(*range(6)), value("a", "b")) for _ in range(8)]
    tables = {
        "lines": spark.createDataFrame(lines, "n int, a int, b int, ref int, c int"),
        "parents": spark.createDataFrame(parents, "id int, name string"),
    }
    gates = [
        NotNull("lines", ["c"]), Unique("lines", ["a", "b", "c"]), NotNull("parents", ["name"]),
        ReferentialIntegrity("lines", "ref", {"table": "parents", "column": "id"}), RowCountBounds("lines", min=1),
        Unique("parents", ["id"]), Unique("lines", ["ref", "c"]),
        BusinessRule("sum", "select a from lines group by a having sum(c) > 6", "lines", "a"),
        ReferentialIntegrity("lines", "ref", {"table": "parents", "column": "id"}), RowCountBounds("lines", max=3),
    ]
    pick.shuffle(gates)
    fused, single = (run(tables, gates, Quarantine(30), run_id=1) for run in (run_gates, run_gates_one_by_one))
    assert fused.results == single.results
    assert fused.row_counts == single.row_counts
    assert set(fused.rejected) == {t for t, df in single.rejected.items() if df.count()}
    for name in tables:
        assert rows(fused.tables[name]) == rows(single.tables[name])
        if name in fused.rejected:
            assert rows(fused.rejected[name]) == rows(single.rejected[name])


def test_the_wide_pass_shuffles_nothing(spark):
    from sluiceway.gates.fused import flag_rows

    df = spark.range(1000).selectExpr("id % 990 as k", "id", "cast(null as string) as name")
    flagged = flag_rows(df, [Unique("t", ["k"]), ReferentialIntegrity("t", "k", {"table": "p", "column": "id"})], {"p": spark.range(900)})
    assert "Exchange hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in flagged._jdf.queryExecution().executedPlan().toString()


def test_key_sets_too_large_to_broadcast_are_joined_by_shuffle(spark, monkeypatch):
    from sluiceway import skew
    from sluiceway.gates import fused

    monkeypatch.setattr(fused, "stored_side", lambda df, label: skew.stored_side(df, label, max_rows=1))
    df = spark.range(300).selectExpr("id % 100 as k", "id")
    out = run_gates({"t": df}, [Unique("t", ["k"])], Quarantine(100))
    assert out.results[0].rows_rejected == 300 and out.tables["t"].count() == 0


# ---- tests on built tables

def test_column_tests_and_verdict(table):
    tables = {"m": table({"id": "int", "g": "string"}, (1, "1"), (1, "9"), (2, None))}
    declared = [
        ColumnTest("m", "id", "unique"), ColumnTest("m", "id", "not_null"), ColumnTest("m", "g", "not_null", severity="warn"),
        ColumnTest("m", "g", "accepted_values", values=("1", "2-3")), ColumnTest("m", "absent", "unique"),
    ]
    results = run_column_tests(tables, declared)
    assert [(r["status"], r["failures"]) for r in results] == [("fail", 1), ("pass", 0), ("warn", 1), ("fail", 1), ("error", None)]
    assert run_verdict(results, declared, ["m"])["status"] == "failed"


def verdict(statuses, declared=("a", "b"), models=("m",), **kw):
    tests = [ColumnTest("m", c, "unique") for c in declared]
    results = [{"test": f"unique.m.{c}", "status": s} for c, s in statuses.items()]
    return run_verdict(results, tests, list(models), **kw)["status"]


def test_verdicts():
    assert verdict({"a": "pass", "b": "warn"}) == "passed"
    assert verdict({"a": "pass"}) == "failed"
    assert verdict({"a": "pass", "b": "skipped"}) == "failed"
    assert verdict({"a": "pass", "b": "error"}) == "failed"
    assert verdict({"a": "pass", "b": "pass"}, exit_code=1) == "failed"
    assert verdict({}, declared=()) == "not_applicable"
    assert verdict({"a": "pass", "b": "pass"}, models=("m", "untested")) == "incomplete"


def test_required_tests():
    ran = [{"name": "unique", "column": "id", "models": ["m"], "severity": "error", "status": "pass"},
           {"name": "not_null", "column": "id", "models": ["m"], "severity": "warn", "status": "pass"}]
    rule = {"model": "m", "column": "id", "severity": "error"}
    assert required_test_problems(ran, [{**rule, "tests": ["unique"]}]) == []
    assert len(required_test_problems(ran, [{**rule, "tests": ["not_null", "accepted_values"]}])) == 2
    assert required_test_problems([{**ran[0], "status": "fail"}], [{**rule, "tests": ["unique"]}])


def test_required_gates():
    stages = {"landing": ([Unique("c", ["a", "b"]), Unique("c", ["x"])], False), "raw": ([Unique("c", ["a"])], True)}
    need = {"type": "unique", "table": "c", "on_violation": "fail"}
    assert required_gate_problems(stages, [{**need, "stage": "landing", "columns": ["b", "a"]}]) == []
    assert required_gate_problems(stages, [{**need, "stage": "landing", "columns": ["a"]}])
    assert required_gate_problems(stages, [{**need, "stage": "raw", "columns": ["a"]}])
    assert required_gate_problems(stages, [{**need, "stage": "gone", "columns": None}])
    assert required_gate_problems(stages, [{"type": "unique", "table": "c", "stage": "raw", "columns": None}]) == []


def test_key_gates_counted_by_one_aggregate_equal_gates_on_their_own(spark, table):
    r = random.Random(11)
    pick = lambda *values: r.choice([None, *values])
    for _ in range(3):
        df = table({"a": "bigint", "b": "string", "n": "int"}, *[(pick(1, 2, 3, 4), pick("x", "y"), pick(1, 2)) for _ in range(r.choice([0, 9, 25]))])
        tables = {"t": df, "p": table({"id": "bigint", "n": "bigint"}, (1, 1), (1, 2), (None, 3), (3, 3)), "none": table({"id": "bigint"})}
        gates = [
            Unique("t", ["a"]), Unique("t", ["b", "a"]), ReferentialIntegrity("t", "a", {"table": "p", "column": "id"}), Unique("t", ["a"]),
            ReferentialIntegrity("t", "a", {"table": "none", "column": "id"}), ReferentialIntegrity("t", "a", {"table": "p", "column": "n"}),
            ReferentialIntegrity("t", "n", {"table": "p", "column": "id"}), Unique("p", ["id"]), ReferentialIntegrity("t", "a", {"table": "t", "column": "a"}),
        ]
        seen, wanted = run_gates(tables, gates), run_gates_one_by_one(tables, gates)
        assert [(g.rows_checked, g.rows_rejected, g.status) for g in seen.results] == [(g.rows_checked, g.rows_rejected, g.status) for g in wanted.results]


def test_many_keys_and_a_gate_that_crashes(spark, table):
    wide = spark.range(6).select(*[(F.col("id") % (i % 7 + 1)).alias(f"c{i}") for i in range(70)])
    gates = [Unique("t", [f"c{i}"]) for i in range(70)]
    assert key_counts(wide, dict(enumerate(gates)), {"t": wide}) == {i: sum(1 for v in range(6) if sum(w % (i % 7 + 1) == v % (i % 7 + 1) for w in range(6)) > 1) for i in range(70)}
    out = run_gates({"t": wide}, [Unique("t", ["nope"]), Unique("t", ["c0"]), ReferentialIntegrity("t", "c1", {"table": "gone", "column": "x"})])
    assert [g.rows_rejected for g in out.results] == [None, 6, None] and "raised" in out.results[0].detail


def test_large_key_sets_are_joined_once(spark, table, monkeypatch):
    """Rows joined by shuffle are stored before a later gate looks at them, in both ways of running gates."""
    from sluiceway.gates import fused, sequential

    monkeypatch.setattr(fused, "is_small", lambda side: False)
    lines = table({"id": "bigint", "code": "string", "parent": "bigint"}, *[(i, None if i == 5 else f"c{i // 2 if i < 8 else i}", i % 4) for i in range(24)])
    tables = {"t": lines, "p": table({"key": "bigint"}, (0,), (1,), (2,))}
    gates = [
        NotNull("t", ["code"]), Unique("t", ["code"]), ReferentialIntegrity("t", "parent", {"table": "p", "column": "key"}),
        BusinessRule("few", "select id from t where id % 5 = 0 union all select null", "t", "id"), Unique("t", ["id"]),
    ]
    stored = []
    for module, name in ((fused, "cut_lineage"), (sequential, "scratch_path")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real: stored.append(a[1]) or real(*a))
    quick, plain = run_gates(tables, gates, Quarantine(100)), run_gates_one_by_one(tables, gates, Quarantine(100))
    assert stored.count("gate-flagged") == 3 and stored.count("gate-apart") == 5
    assert [(g.rows_checked, g.rows_rejected) for g in quick.results] == [(g.rows_checked, g.rows_rejected) for g in plain.results]
    assert quick.tables["t"].count() and rows(quick.tables["t"]) == rows(plain.tables["t"])
    assert rows(quick.rejected["t"], "id", "reason") == rows(plain.rejected["t"], "id", "reason")
    for outcome in (quick, plain):
        assert "Join" not in outcome.tables["t"]._jdf.queryExecution().toString()
