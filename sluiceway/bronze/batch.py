"""Extract, verify and load of a batch.

Hashing, counting and checking files is done by the tasks that read them, for all tables of a batch together: what the
files, their rows and the manifests say is united, and brought together per object by one aggregate. The driver sees one
registry row and at most 4 096 partial hashes per table, however many files a table has.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.bronze.types import BronzeError, stored_columns, stored_schema, typed_columns
from sluiceway.plans.store import TableStore, Version, landing_namespace
from sluiceway.records import append_records, read_records
from sluiceway.session import scratch_path

FORMAT_VERSION = 1
# An object holds rows of about so many bytes, written as JSON; compressed columns take less. The width of a table's rows
# is measured on at most PROBE_ROWS of them, which only decides how the same rows are dealt over objects.
OBJECT_BYTES = 128 * 1024 * 1024
PROBE_ROWS = 10_000
# A message names so many objects, and says how many more there are.
NAMED = 5
MAX_TABLES = 20

REGISTRY = (
    "batch_id string, flow string, table string, status string, path string, schema string, total_rows bigint, "
    "objects bigint, manifest_hash string, batch_tables int, batch_hash string, extracted_at bigint, seq bigint"
)
MANIFEST_COLUMNS = ("object", "sha256", "size_bytes", "rows")
MANIFEST = "object string, sha256 string, size_bytes bigint, rows bigint"


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The latest state of every batch and table."""
    records = read_records(spark, f"{root}/_registry", REGISTRY)
    return records.groupBy("batch_id", "table").agg(F.max_by(F.struct("*"), "seq").alias("_r")).select("_r.*")


def _record(spark: SparkSession, root: str, rows: list[dict]) -> None:
    seq = time.time_ns()
    append_records(spark, f"{root}/_registry", [{**r, "seq": seq} for r in rows], REGISTRY)


def file_hashes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Table, name, hash and size of each data file of the tables in `paths`. An object fits a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(paths.values()))
    # A batch's folders are told apart by the last two parts of their paths: the table's and the batch's.
    names = F.create_map(*[F.lit(x) for table, path in paths.items() for x in ("/".join(path.split("/")[-2:]), table)])
    folder = F.concat_ws("/", F.slice(F.split("path", "/"), -3, 2))
    return files.select(
        names[folder].alias("table"), F.substring_index("path", "/", -1).alias("object"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"),
    )


def file_rows(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, T.StructType]) -> DataFrame:
    """Table and name of the file of every row; only row counts are read of columnar files."""
    found = None
    for table, path in paths.items():
        rows = spark.read.schema(schemas[table]).option("pathGlobFilter", "*.parquet").parquet(path).select(
            F.lit(table).alias("table"), F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("object")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def object_facts(
    spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, T.StructType] | None, manifests: DataFrame | None = None,
) -> DataFrame:
    """One row per table and object: what its file is (`sha256`, `size_bytes`), the rows read from it (`rows`), and what a
    manifest declares (`declared`). A file without rows (an empty table) is still an object: its count is 0. Without
    `schemas` no rows are read."""
    facts = file_hashes(spark, paths).withColumn("one", F.lit(None).cast("long"))
    if schemas is not None:
        facts = facts.unionByName(file_rows(spark, paths, schemas).withColumn("one", F.lit(1).cast("long")), allowMissingColumns=True)
    if manifests is not None:
        facts = facts.unionByName(manifests.select("table", "object", F.struct(*MANIFEST_COLUMNS).alias("declared")), allowMissingColumns=True)
    return facts.groupBy("table", "object").agg(
        F.max("sha256").alias("sha256"), F.max("size_bytes").alias("size_bytes"), F.coalesce(F.sum("one"), F.lit(0)).alias("rows"),
        *([F.max("declared").alias("declared")] if manifests is not None else []),
    )


def _digest_groups(*more: Column) -> list[Column]:
    """Aggregates over manifest lines whose table and objects' group (`g`) they were grouped by."""
    line = F.concat_ws("|", *MANIFEST_COLUMNS)
    hashed = F.sha2(F.array_join(F.sort_array(F.collect_list(F.when(F.col("object").isNotNull(), line))), "\n"), 256).alias("h")
    return [hashed, F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("rows") > 0).alias("objects"), *more]


def _group() -> Column:
    return F.substring(F.sha2("object", 256), 1, 3).alias("g")


def manifest_hash(parts: Sequence, flow: str, table: str, batch_id: str, schema: str) -> str:
    """Hash of a manifest: its lines hashed in up to 4 096 groups, then the groups and the header."""
    header = [FORMAT_VERSION, flow, table, batch_id, schema, sorted((r["g"], r["h"]) for r in parts)]
    return hashlib.sha256(json.dumps(header, sort_keys=True).encode()).hexdigest()


def batch_hash(flow: str, batch_id: str, tables: Mapping[str, str]) -> str:
    """Hash over every table of a batch and its manifest hash."""
    return hashlib.sha256(json.dumps([FORMAT_VERSION, flow, batch_id, sorted(tables.items())]).encode()).hexdigest()


def rows_per_object(tables: Mapping[str, DataFrame], columns: Mapping[str, list[Column]], object_bytes: int = OBJECT_BYTES) -> dict[str, int]:
    """How many rows of each table fill an object, by the measured width of its rows."""
    probes = [
        df.select(*columns[t]).limit(PROBE_ROWS).select(F.lit(t).alias("table"), F.octet_length(F.to_json(F.struct("*"))).alias("b"))
        for t, df in tables.items()
    ]
    united = probes[0]
    for probe in probes[1:]:
        united = united.unionByName(probe)
    widths = {r["table"]: r["w"] for r in united.groupBy("table").agg(F.avg("b").alias("w")).collect()}
    return {t: max(1, int(object_bytes / max(1.0, widths.get(t, 1.0)))) for t in tables}


def extract(
    spark: SparkSession, root: str, flow: str, tables: Mapping[str, DataFrame], chunk_rows: int | None = None
) -> str:
    """Snapshot tables into a new batch; all become `extracted` by one registry record, or none.

    Objects hold `chunk_rows` rows at most, or what `rows_per_object` finds.
    """
    if not 1 <= len(tables) <= MAX_TABLES:
        raise BronzeError(f"a batch holds 1 to {MAX_TABLES} tables, got {len(tables)}")
    batch_id, started = str(uuid.uuid4()), time.time_ns()
    columns = {t: stored_columns(df.schema) for t, df in tables.items()}
    base = {"batch_id": batch_id, "flow": flow, "batch_tables": len(tables), "extracted_at": started}
    _record(spark, root, [{**base, "table": t, "status": "extracting"} for t in tables])
    try:
        chunks = dict.fromkeys(tables, chunk_rows) if chunk_rows else rows_per_object(tables, columns)
        paths = {t: f"{root}/{flow}/{t}/{batch_id}-{n}" for n, t in enumerate(tables)}
        schemas = {t: df.schema.json() for t, df in tables.items()}
        for table, df in tables.items():
            df.select(*columns[table]).write.option("maxRecordsPerFile", chunks[table]).parquet(paths[table])
        whole = scratch_path(spark, "manifests")
        object_facts(spark, paths, {t: stored_schema(df.schema) for t, df in tables.items()}).write.parquet(whole)
        manifests = spark.read.schema(f"table string, {MANIFEST}").parquet(whole)
        for table, path in paths.items():
            manifests.where(F.col("table") == table).select(*MANIFEST_COLUMNS).write.parquet(f"{path}/_manifest")
        groups = manifests.groupBy("table", _group()).agg(*_digest_groups()).collect()
        done = []
        for table, path in paths.items():
            mine = [g for g in groups if g["table"] == table]
            done.append({
                **base, "table": table, "status": "extracted", "path": path, "schema": schemas[table], "total_rows": sum(g["rows"] for g in mine),
                "objects": sum(g["objects"] for g in mine), "manifest_hash": manifest_hash(mine, flow, table, batch_id, schemas[table]),
            })
        signed = batch_hash(flow, batch_id, {d["table"]: d["manifest_hash"] for d in done})
    except Exception:
        _record(spark, root, [{**base, "table": t, "status": "failed"} for t in tables])
        raise
    _record(spark, root, [{**d, "batch_hash": signed} for d in done])
    return batch_id


def verify(spark: SparkSession, root: str, flow: str, batch_id: str) -> list:
    """Everything that can be checked before landing is touched; returns the batch's registry rows."""
    try:
        uuid.UUID(batch_id)
    except ValueError:
        raise BronzeError(f"{batch_id!r} is not a batch id") from None
    entries = registry(spark, root).where(F.col("batch_id") == batch_id).collect()
    entries.sort(key=lambda e: e["table"])
    if not entries:
        raise BronzeError(f"batch {batch_id} is not in the registry")
    if {e["flow"] for e in entries} != {flow}:
        raise BronzeError(f"batch {batch_id} belongs to {sorted({e['flow'] for e in entries})}, not {flow!r}")
    if len(entries) != entries[0]["batch_tables"]:
        raise BronzeError(f"batch {batch_id} is incomplete: {len(entries)} of {entries[0]['batch_tables']} table(s)")
    states = {e["status"] for e in entries}
    if states == {"loaded"}:
        return entries
    if states != {"extracted"}:
        raise BronzeError(f"batch {batch_id} is {sorted(states)}, not entirely 'extracted'")
    whole = batch_hash(flow, batch_id, {e["table"]: e["manifest_hash"] for e in entries})
    if {e["batch_hash"] for e in entries} != {whole}:
        raise BronzeError(f"batch {batch_id}: its tables do not agree with the batch manifest")
    _verify_files(spark, flow, batch_id, entries)
    return entries


def judged_groups(spark: SparkSession, entries: Sequence, read_rows: bool = True) -> DataFrame:
    """Per table and group of objects: the digest of the manifest's lines, the rows read, and the objects whose hash, size,
    row count or presence differs from the manifest."""
    paths = {e["table"]: e["path"] for e in entries}
    schemas = {e["table"]: stored_schema(T.StructType.fromJson(json.loads(e["schema"]))) for e in entries}
    manifests = None
    for table, path in paths.items():
        lines = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").withColumn("table", F.lit(table))
        manifests = lines if manifests is None else manifests.unionByName(lines)
    problem = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("declared").isNull(), "not in the manifest")
        .when(F.col("size_bytes") != F.col("declared.size_bytes"), "size differs")
        .when(F.col("sha256") != F.col("declared.sha256"), "sha256 differs")
    )
    told = object_facts(spark, paths, schemas if read_rows else None, manifests).select(
        "table", _group(), F.when(problem.isNotNull(), F.concat_ws(" ", "object", problem)).alias("problem"),
        F.col("rows").alias("read"), "declared.*",
    )
    return told.groupBy("table", "g").agg(*_digest_groups(
        F.count_if(F.col("object").isNotNull()).alias("lines"), F.sum("read").alias("read"),
        F.count_if(F.col("problem").isNull() & (F.col("read") != F.col("rows"))).alias("miscounted"),
        F.count("problem").alias("bad"), F.slice(F.sort_array(F.collect_list("problem")), 1, NAMED).alias("named"),
    ))


def _verify_files(spark: SparkSession, flow: str, batch_id: str, entries: Sequence) -> None:
    failure = None
    try:
        groups = judged_groups(spark, entries).collect()
    except (PySparkException, Py4JJavaError) as exc:
        # A damaged file need not be readable as rows; its hash tells which one it is.
        failure, groups = exc, judged_groups(spark, entries, read_rows=False).collect()
    for e in entries:
        mine = [g for g in groups if g["table"] == e["table"]]
        if manifest_hash([g for g in mine if g["lines"]], flow, e["table"], batch_id, e["schema"]) != e["manifest_hash"]:
            raise BronzeError(f"{e['table']}: the manifest changed after it was registered")
        bad, named = sum(g["bad"] for g in mine), sorted(n for g in mine for n in g["named"])[:NAMED]
        if bad:
            more = f" and {bad - len(named)} more" if bad > len(named) else ""
            raise BronzeError(f"{e['table']}: " + "; ".join(named) + more)
        if failure is not None:
            continue
        read = sum(g["read"] for g in mine)
        if read != e["total_rows"] or any(g["miscounted"] for g in mine):
            raise BronzeError(f"{e['table']}: {read} rows read, the manifest says {e['total_rows']}")
        names = T.StructType.fromJson(json.loads(e["schema"])).names
        if e["total_rows"]:
            stored = spark.read.option("pathGlobFilter", "*.parquet").parquet(e["path"]).schema
            if stored.names != names:
                raise BronzeError(f"{e['table']}: columns {stored.names} are not the manifest's {names}")
    if failure is not None:
        raise failure


def load(spark: SparkSession, root: str, flow: str, batch_id: str, store: TableStore, namespace: str | None = None) -> dict:
    """Replace the landing tables of a batch together. Needs the batch files only, not the source.

    Loading a loaded batch changes nothing; a batch older than the newest loaded one is refused, and
    so is one whose columns differ from the landing table's. A table stored in its own types is
    published where it lies; one with widened or text columns is written once in its source types.
    """
    namespace = namespace or landing_namespace(flow)
    entries = verify(spark, root, flow, batch_id)
    tables = {e["table"]: {"rows": e["total_rows"], "objects": e["objects"]} for e in entries}
    if entries[0]["status"] == "loaded":
        return {"batch_id": batch_id, "outcome": "already_loaded", "tables": tables}
    newer = registry(spark, root).where(
        (F.col("flow") == flow) & (F.col("status") == "loaded") & (F.col("extracted_at") > entries[0]["extracted_at"])
        & F.col("table").isin(list(tables))
    ).limit(1).collect()
    if newer:
        raise BronzeError(f"a newer batch ({newer[0]['batch_id']}) is already loaded for {newer[0]['table']}")
    schemas = {e["table"]: T.StructType.fromJson(json.loads(e["schema"])) for e in entries}
    current = store.current_tables(namespace, list(tables))
    for e in entries:
        landed = current.get(e["table"])
        if landed is not None and _shape(landed.struct) != _shape(schemas[e["table"]]):
            raise BronzeError(f"landing table {namespace}.{e['table']} has other columns than the batch; drift is refused")
    staged = []
    for e in entries:
        schema = schemas[e["table"]]
        if stored_schema(schema).simpleString() == schema.simpleString():
            staged.append(Version(namespace, e["table"], batch_id, e["path"], schema.json(), e["total_rows"]))
            continue
        files = spark.read.schema(stored_schema(schema)).option("pathGlobFilter", "*.parquet").parquet(e["path"])
        version = store.stage(namespace, e["table"], files.select(*typed_columns(schema)), batch_id)
        if version.rows != e["total_rows"]:
            raise BronzeError(f"{e['table']}: {version.rows} rows written, the manifest says {e['total_rows']}")
        staged.append(version)
    store.publish(staged)
    _record(spark, root, [{**e.asDict(), "status": "loaded"} for e in entries])
    return {"batch_id": batch_id, "outcome": "loaded", "tables": tables}


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return sorted((f.name, f.dataType.simpleString()) for f in schema.fields)
