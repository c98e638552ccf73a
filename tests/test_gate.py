import pytest

from hushframe.errors import PolicyMissing, QueryError, StatementNotAllowed, Unplannable
from hushframe.limits import QueryLimits
from hushframe.operators.disclosure import Composite, MinimumCount
from hushframe.plans.corpus import CASES, COLUMNS, LOOKALIKE, LOOKALIKE_COLUMNS, SECRET, STATEMENTS, TRIPS, K
from hushframe.plans.scope import Scope


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("trips")
    spark.createDataFrame(TRIPS, COLUMNS).write.parquet(f"{folder}/trips")
    spark.createDataFrame(LOOKALIKE, LOOKALIKE_COLUMNS).write.parquet(f"{folder}/lookalike")
    return folder


def scope(spark, tables, gated=True, k=K):
    made = Scope(spark, gated, None if k is None else MinimumCount(k))
    made.register("trips", f"{tables}/trips")
    made.register("lookalike", f"{tables}/lookalike")
    return made


@pytest.fixture(scope="module")
def gated(spark, tables):
    return scope(spark, tables)


@pytest.mark.parametrize("name,sql,verdict", CASES, ids=[c[0] for c in CASES])
def test_corpus(gated, name, sql, verdict):
    try:
        result = gated.sql(sql)
        got = f"rows:{result.row_count}"
        assert all(r.get("n", r.get("N")) >= K and not SECRET & set(r.values()) for r in result.rows)
    except Unplannable:
        got = "unplannable"
    except QueryError as e:
        got = "refused"
        assert not any(str(s) in str(e) for s in SECRET)
    assert got == verdict


@pytest.mark.parametrize("sql", STATEMENTS)
@pytest.mark.parametrize("mode", [True, False])
def test_statements_are_refused_in_both_modes(spark, tables, gated, sql, mode):
    with pytest.raises(StatementNotAllowed):
        (gated if mode else scope(spark, tables, False, None)).sql(sql)


def test_ungated_scope_runs_rows_joins_and_windows_but_no_files(spark, tables):
    with scope(spark, tables, False, None) as open_scope:
        assert open_scope.sql("SELECT trip FROM trips").row_count == 20
        assert open_scope.sql("SELECT a.trip FROM trips a JOIN trips b ON a.trip = b.trip").row_count == 20
        assert open_scope.sql("SELECT trip, ROW_NUMBER() OVER (ORDER BY trip) AS r FROM trips").row_count == 20
        with pytest.raises(Unplannable):
            open_scope.sql(f"SELECT * FROM parquet.`{tables}/trips`")


def test_without_threshold_every_gated_query_is_refused(spark, tables):
    for k in (None, 0):
        with pytest.raises(PolicyMissing):
            scope(spark, tables, True, k).sql("SELECT line, COUNT(*) AS n FROM trips GROUP BY line")


def test_a_policy_gates_an_open_scope(spark, tables):
    with pytest.raises(QueryError):
        scope(spark, tables, False, 5).sql("SELECT trip FROM trips")


def test_suppressed_rows_are_counted_and_composites_add_up(spark, tables, gated):
    sql = "SELECT line, COUNT(*) AS n FROM trips GROUP BY line"
    assert gated.sql(sql).suppressed_rows == 2
    both = Scope(spark, True, Composite((MinimumCount(2), MinimumCount(K))))
    both.register("trips", f"{tables}/trips")
    assert (both.sql(sql).row_count, both.sql(sql).suppressed_rows) == (3, 2)


def test_result_limit_of_a_gated_query_counts_released_rows_only(spark, tmp_path):
    rows = [(g, i) for g in range(400) for i in range(30 if g % 20 == 0 else 2)]
    spark.createDataFrame(rows, "g int, v int").repartition(6).write.parquet(f"{tmp_path}/many")
    sql = "SELECT g, COUNT(*) AS n FROM many GROUP BY g"
    for most, whole in ((19, False), (20, True), (10_000, True)):
        limited = Scope(spark, True, MinimumCount(11), QueryLimits(result_rows=most))
        limited.session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        limited.session.conf.set("spark.sql.shuffle.partitions", "23")
        limited.register("many", f"{tmp_path}/many")
        if whole:
            found = limited.sql(sql)
            assert (found.row_count, found.suppressed_rows) == (20, 380)
        else:
            with pytest.raises(QueryError):
                limited.sql(sql)
