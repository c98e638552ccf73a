import json
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hushframe.errors import Conflict, DeclarationMismatch, LimitExceeded, Malformed, QueryError, SnapshotBroken
from hushframe.limits import QueryLimits
from hushframe.model import DatasetSlug, DeclaredSchema, SnapshotVersion, family_of, read_footers
from hushframe.plans.scope import Scope, capped_json
from hushframe.sources import synthetic
from hushframe.sources.mappers import CONTACTS, INVOICES
from hushframe.sources.ndjson import NdjsonLimits, read_ndjson
from hushframe.sources.snapshots import Vault
from hushframe.sources.uploads import Upload, commit_upload, encode_upload, parse_upload
from hushframe.streaming.sync import Scheduler, SyncJob, run_all, stream_sync

NATIONS = DatasetSlug("nations")


@pytest.mark.parametrize("bad", ["", "A", "a b", "a/b", "a.b", "x" * 65])
def test_slugs(bad):
    assert DatasetSlug("upload_a-1").is_upload and not DatasetSlug("crm-2").is_upload
    with pytest.raises(ValueError):
        DatasetSlug(bad)


@pytest.mark.parametrize("bad", ["1-" + "a" * 32, "0" * 20 + "-" + "A" * 32, "0" * 20 + "a" * 32, "0" * 20 + "-" + "a" * 31, "", "0" * 21 + "-" + "a" * 32])
def test_versions(bad):
    assert SnapshotVersion.new(5) < SnapshotVersion.new(6)
    with pytest.raises(ValueError):
        SnapshotVersion(bad)


@pytest.mark.parametrize("text", ["[]", '[{"name":"a","type":"x"}]', '[{"name":"a","type":"string"},{"name":"a","type":"string"}]', '[{"name":"","type":"string"}]', '[{"name":"a","type":"string","z":1}]', '{"a":1}', '[{"name":"a\\u0007","type":"string"}]'])
def test_malformed_schemas(text):
    with pytest.raises(ValueError):
        DeclaredSchema.from_json(text)


def test_families():
    kinds = [(pa.large_string(), "string"), (pa.dictionary(pa.int32(), pa.string()), "string"), (pa.uint8(), "uint8"), (pa.timestamp("ns"), "timestamp"), (pa.date64(), "date"), (pa.decimal128(10, 2), "decimal"), (pa.decimal256(60, 2), None), (pa.list_(pa.int8()), None), (pa.float32(), "float32"), (pa.bool_(), "boolean"), (pa.binary(), None)]
    assert [family_of(k) for k, _ in kinds] == [f for _, f in kinds]


def test_declared_registration_and_limits(spark, tmp_path):
    pq.write_table(pa.table({"id": ["a", "b", "c"], "total": [1.0, 2.0, 3.0]}), tmp_path / "t.parquet")
    path, declared = f"{tmp_path}/t.parquet", DeclaredSchema((("id", "string"), ("total", "float64")))
    scope = Scope(spark, False)
    assert scope.register("invoices", path, declared=declared, row_cap=3) == 3
    assert scope.register("nothing") == 0
    for wrong, cap in ((DeclaredSchema((("id", "string"), ("sum", "float64"))), 3), (DeclaredSchema((("total", "float64"), ("id", "string"))), 3), (declared, 2)):
        with pytest.raises(DeclarationMismatch):
            scope.register("invoices", path, declared=wrong, row_cap=cap)
    with pytest.raises(LimitExceeded):
        Scope(spark, False, limits=QueryLimits(decoded_rows=2)).register("invoices", path)
    for limits in (QueryLimits(result_rows=2), QueryLimits(result_bytes=20)):
        small = Scope(spark, False, limits=limits)
        small.register("invoices", path)
        with pytest.raises(LimitExceeded):
            small.sql("SELECT * FROM invoices")
    assert json.loads(scope.sql("SELECT total / 0 AS x FROM invoices LIMIT 1").json) == [{"x": None}]
    assert capped_json([], 2) == "[]"


def test_a_query_over_its_time_is_stopped(spark, tmp_path):
    pq.write_table(pa.table({"v": list(range(80_000))}), tmp_path / "v.parquet")
    scope = Scope(spark, False, limits=QueryLimits(time=1))
    scope.register("v", f"{tmp_path}/v.parquet")
    with pytest.raises(LimitExceeded) as e:
        scope.sql("SELECT COUNT(*) AS n FROM v a JOIN v b ON a.v + b.v > 10 AND a.v * b.v % 7 = 3")
    assert e.value.limit == "time"


def test_footers_of_several_files(tmp_path):
    for i in range(3):
        pq.write_table(pa.table({"v": [0] * 1000}), tmp_path / f"{i}.parquet")
    footers, count, size = read_footers([str(tmp_path)])
    assert (footers.rows, count) == (3000, 3) and footers.bytes > 0 and size > 0


def test_ndjson_line_numbers_count_from_the_start_of_the_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, bad in (("a", None), ("b", 371), ("c", 5)):
        (folder / f"{name}.ndjson").write_text("".join("{broken\n" if k == bad else "\n" if k % 10 == 0 else f'{{"id":{k}}}\n' for k in range(1, 501)))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", usual):  # files cut into several splits, and several files in one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            with pytest.raises(Malformed, match="line 371 "):
                read_ndjson(spark, str(folder), spark.range(0).schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_ndjson(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, n long, x double, ok boolean").schema
    (tmp_path / "good.ndjson").write_bytes(b'{"id":"a","n":1,"x":1.5,"ok":true}\r\n\n{"id":2,"n":"x","x":3}\n')
    got = read_ndjson(spark, f"{tmp_path}/good.ndjson", schema, NdjsonLimits()).collect()
    assert [tuple(r) for r in got] == [("a", 1, 1.5, True), (None, None, 3.0, None)]
    (tmp_path / "bad.ndjson").write_bytes(b'{"id":"secret"}\n{"id":"secret\n')
    with pytest.raises(Malformed, match="line 2") as e:
        read_ndjson(spark, f"{tmp_path}/bad.ndjson", schema)
    assert "secret" not in str(e.value)
    (tmp_path / "empty.ndjson").write_bytes(b"")
    assert read_ndjson(spark, f"{tmp_path}/empty.ndjson", schema).count() == 0
    for limits in (NdjsonLimits(lines=1), NdjsonLimits(line_bytes=10), NdjsonLimits(total_bytes=20)):
        with pytest.raises(Malformed):
            read_ndjson(spark, f"{tmp_path}/good.ndjson", schema, limits)


@pytest.mark.parametrize("payload", ["no json", "{}", '{"QueryResponse":{"Invoice":5}}', '{"QueryResponse":{"Invoice":[{"TotalAmt":1}]}}', '{"QueryResponse":{"Invoice":[{"Id":7}]}}'])
def test_broken_payloads_fail_whole(spark, payload):
    with pytest.raises(Malformed):
        INVOICES.rows(spark.createDataFrame([(payload,)], "payload string"))


def test_snapshots(spark, tmp_path):
    vault, tenant = Vault(str(tmp_path)), uuid.uuid4()
    assert vault.current(tenant, NATIONS) is None
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    first = vault.commit(tenant, NATIONS, rows)
    second = vault.commit(tenant, NATIONS, rows)
    assert second > first and vault.versions(tenant, NATIONS) == [second]
    assert spark.read.parquet(*vault.current(tenant, NATIONS).objects).count() == 2
    rows.write.parquet(f"{tmp_path}/{tenant}/nations/snapshots/{SnapshotVersion.new()}")  # a write that was never committed
    assert vault.current(tenant, NATIONS).version == second
    with pytest.raises(FileExistsError):
        vault.commit(tenant, NATIONS, rows, version=second)
    manifest = tmp_path / str(tenant) / "nations" / "manifests" / f"{second}.manifest"
    value = json.loads(manifest.read_text())
    manifest.write_text(json.dumps(value | {"objects": value["objects"] * 2}))
    with pytest.raises(SnapshotBroken):
        vault.current(tenant, NATIONS)


def test_uploads(spark, tmp_path):
    vault, tenant, slug = Vault(str(tmp_path)), uuid.uuid4(), DatasetSlug("upload_cohort")
    pq.write_table(pa.table({"condition": ["flu", "flu"], "age": pa.array([30, 40], pa.int64())}), tmp_path / "c.parquet")
    data, declared = (tmp_path / "c.parquet").read_bytes(), DeclaredSchema((("condition", "string"), ("age", "int64")))
    upload = Upload(SnapshotVersion.new(), str(uuid.uuid4()), 2, declared, data)
    body = encode_upload(upload)
    assert parse_upload(body) == upload
    assert commit_upload(spark, vault, tenant, slug, body) == commit_upload(spark, vault, tenant, slug, body)
    assert vault.current(tenant, slug).declared == declared
    for cut in (0, 3, 7, 40, len(body) - len(data) - 1, len(body) - len(data)):
        with pytest.raises(Malformed):
            parse_upload(body[:cut])
    with pytest.raises(DeclarationMismatch):
        commit_upload(spark, vault, tenant, slug, encode_upload(Upload(SnapshotVersion.new(), upload.object, 1, declared, data)))
    for other in (Upload(SnapshotVersion.new(1), upload.object, 2, declared, data), Upload(SnapshotVersion.new(1 << 62), upload.object, 2, declared, data), Upload(SnapshotVersion.new(), upload.object, 2, DeclaredSchema((("diagnosis", "string"), ("age", "int64"))), data)):
        with pytest.raises(Conflict):
            commit_upload(spark, vault, tenant, slug, encode_upload(other))
    with pytest.raises(Conflict):
        commit_upload(spark, vault, tenant, NATIONS, body)


def test_syncs(spark, tmp_path):
    vault, tenant = Vault(str(tmp_path / "vault")), uuid.uuid4()
    good = SyncJob(tenant, DatasetSlug("contacts"), CONTACTS, lambda s: s.createDataFrame([('{"contacts":[{"id":"a"},{"id":"b"}]}',)], "payload string"))
    bad = SyncJob(tenant, DatasetSlug("broken"), CONTACTS, lambda s: s.createDataFrame([("x",)], "payload string"))
    outcomes = run_all(spark, vault, [bad, good])
    assert isinstance(outcomes[0], QueryError) and outcomes[1] == vault.current(tenant, good.slug).version
    scheduler = Scheduler(spark, vault, [good], 0.01)
    scheduler.stop()
    assert scheduler.run() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text('{"contacts":[{"id":"z","stage":"won"}]}')
    stream_sync(spark, vault, tenant, DatasetSlug("streamed"), CONTACTS, f"{tmp_path}/in", f"{tmp_path}/checkpoint").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(*vault.current(tenant, DatasetSlug("streamed")).objects).select("id", "stage").collect()] == [("z", "won")]


def test_synthetic_tables(spark):
    made = synthetic.cohort(spark, 1, 1000, 5)
    assert sorted(made.collect()) == sorted(synthetic.cohort(spark, 1, 1000, 5).collect())
    sizes = {r["condition"]: r["count"] for r in made.groupBy("condition").count().collect()}
    assert [sizes[c] for c in ("under", "exact", "over", "single", "dominated")] == [4, 5, 6, 1, 10]
    costs = sorted(r[0] for r in made.filter("condition = 'dominated'").select("cost_cents").collect())
    assert costs[-1] > 0.95 * sum(costs)
    assert len(synthetic.wide(spark, 1, 10).columns) == 23
    with pytest.raises(ValueError):
        synthetic.cohort(spark, 1, 10, 5)
