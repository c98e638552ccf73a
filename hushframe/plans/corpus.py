"""What the disclosure gate must accept, refuse or suppress, rule by rule, over a table of our own: trips on five lines.

RULES has, for each rule of the gate, statements that it must let through with the number of rows that survive suppression, and
statements that it must refuse. CASES lists them all as (name, SQL, verdict): ``rows:N``, ``refused`` or ``unplannable``.
"""

from __future__ import annotations

#: Cohort size of the cases.
K = 4
_SIZES = {"red": 7, "blue": 5, "green": 4}  # released; green just so
_RARE = {"night": [501, 502, 503], "ferry": [900]}  # suppressed

COLUMNS = "trip string, line string, minutes long, fare double"
_COMMON = [(line, 10 * (sum(list(_SIZES.values())[:k]) + i + 1)) for k, (line, size) in enumerate(_SIZES.items()) for i in range(size)]
TRIPS = [(f"{line}-{minutes}", line, minutes, minutes / 4) for line, minutes in [*_COMMON, *((line, m) for line, times in _RARE.items() for m in times)]]
#: Values that no released row may hold.
SECRET = {t[0] for t in TRIPS} | set(_RARE) | {v for t in TRIPS if t[1] in _RARE for v in t[2:]}
#: A table with a column whose name looks like a count.
LOOKALIKE_COLUMNS, LOOKALIKE = "line string, `count(1)` long", [("red", 12345), ("blue", 54321)]


def _lines(select: str = "", where: str = "", tail: str = "") -> str:
    return f"SELECT line, COUNT(*) AS n{select} FROM trips{' WHERE ' * bool(where)}{where} GROUP BY line {tail}".strip()


def _where(*pairs: tuple[str, int]) -> list[tuple[str, int]]:
    return [(_lines(where=condition), rows) for condition, rows in pairs]


def _bad(*conditions: str) -> list[str]:
    return [_lines(where=condition) for condition in conditions]


_BASE = _lines()
_INNER = "SELECT line, COUNT(*) AS n FROM ({}) q GROUP BY line"
_LONG = "r" + "_" * 1000  # 1001 characters

RULES: dict[str, tuple[list[tuple[str, int]], list[str]]] = {
    "one_aggregate": (
        [(_BASE, 3), ("SELECT COUNT(*) AS n FROM trips", 1), (f"SELECT q.line, q.n FROM ({_BASE}) q WHERE q.n >= 5 ORDER BY q.line LIMIT 1", 1), (f"WITH a AS ({_BASE}) SELECT n, line FROM a ORDER BY n OFFSET 2", 3)],
        [
            "SELECT trip, minutes FROM trips", "SELECT DISTINCT line FROM trips", "SELECT * FROM trips LIMIT 3", f"SELECT COUNT(*) AS n, MAX(line) AS last FROM ({_BASE}) q", f"{_BASE} UNION ALL {_BASE}", f"{_BASE} EXCEPT {_BASE}",
            f"SELECT a.line, b.n FROM ({_BASE}) a JOIN ({_BASE}) b ON a.n = b.n", _lines(", RANK() OVER (ORDER BY COUNT(*)) AS place"), "SELECT fare, COUNT(*) OVER (PARTITION BY line) AS n FROM trips", "VALUES ('night', 3)", "SELECT 1000 AS n", "WITH a AS (SELECT trip, fare FROM trips) SELECT * FROM a",
        ],
    ),
    "plain_below": (
        [("SELECT l AS line, COUNT(*) AS n FROM (SELECT line AS l, fare FROM trips WHERE minutes > 0) q GROUP BY l", 3), (_INNER.format("SELECT line FROM (SELECT line, minutes FROM trips WHERE fare > 0.0D) p WHERE minutes < 900"), 3)],
        [
            "SELECT x, COUNT(*) AS n FROM (SELECT minutes * 2 AS x FROM trips) q GROUP BY x", "SELECT COUNT(*) AS n, SUM(x) AS s FROM (SELECT IF(trip = 'ferry-900', fare, 0.0D) AS x FROM trips) q", _INNER.format("SELECT a.line FROM trips a JOIN trips b ON a.trip = b.trip"), _INNER.format("SELECT line FROM trips, range(20)"),
            _INNER.format("SELECT line FROM trips UNION ALL SELECT line FROM trips"), _INNER.format("SELECT line FROM trips INTERSECT SELECT line FROM trips"), _INNER.format("SELECT line, EXPLODE(SEQUENCE(1, 9)) AS i FROM trips"), _INNER.format("SELECT line, SUM(fare) OVER () AS s FROM trips"),
            "SELECT line, COUNT(*) AS n FROM trips LATERAL VIEW EXPLODE(SEQUENCE(1, 9)) e AS i GROUP BY line", "SELECT line, COUNT(*) AS n FROM trips TABLESAMPLE (2 ROWS) GROUP BY line", "SELECT col1 AS line, COUNT(*) AS n FROM (VALUES ('red'), ('red'), ('red'), ('red')) v GROUP BY col1",
        ],
    ),
    "no_subquery": ([], [*_bad("line IN (SELECT line FROM trips WHERE minutes = 900)", "minutes NOT IN (SELECT minutes FROM trips WHERE line = 'night')", "EXISTS (SELECT 1 FROM trips WHERE fare > 200)", "minutes > (SELECT MIN(minutes) FROM trips)"), _lines(", (SELECT MAX(fare) FROM trips) AS top"), _lines(tail="HAVING COUNT(*) > (SELECT 2)")]),
    "no_grouping_sets": ([], ["SELECT line, COUNT(*) AS n FROM trips GROUP BY ROLLUP(line)", "SELECT line, minutes, COUNT(*) AS n FROM trips GROUP BY CUBE(line, minutes)", "SELECT line, COUNT(*) AS n FROM trips GROUP BY line, minutes GROUPING SETS ((line), (minutes))", "SELECT q.n FROM (SELECT line AS l, COUNT(*) AS n FROM trips GROUP BY line WITH ROLLUP) q"]),
    "five_aggregates": (
        [*((_lines(f", {f}({c}) AS x"), 3) for f in ("SUM", "AVG", "MIN", "MAX") for c in ("minutes", "fare")), ("SELECT COUNT(*) AS n, COUNT(DISTINCT line) AS lines, COUNT(fare) AS fares FROM trips", 1), (_lines(", SUM(2) AS twice"), 3)],
        [*(_lines(f", {x} AS x") for x in ("MAX(fare) FILTER (WHERE line = 'ferry')", "SUM(CASE WHEN trip = 'ferry-900' THEN minutes END)", "MIN(IF(line = 'night', minutes, NULL))", "SUM(minutes + 1)", "COLLECT_LIST(trip)", "FIRST(fare)", "STDDEV(fare)", "MEDIAN(minutes)", "MAX_BY(trip, fare)", "APPROX_COUNT_DISTINCT(trip)", "LISTAGG(trip)"))],
    ),
    "no_limit_below": ([(_INNER.format("SELECT * FROM trips ORDER BY fare DESC"), 3)], [_INNER.format("SELECT * FROM trips ORDER BY fare LIMIT 20"), _INNER.format("SELECT * FROM trips ORDER BY fare OFFSET 1"), _INNER.format("SELECT * FROM trips LIMIT 4")]),
    "has_n": ([("SELECT line, COUNT(*) AS N FROM trips GROUP BY line", 3)], ["SELECT line, COUNT(*) AS m FROM trips GROUP BY line", "SELECT MAX(fare) AS top FROM trips", "SELECT line FROM trips GROUP BY line"]),
    "n_counts_rows": (
        [("SELECT line, COUNT(1) AS n FROM trips GROUP BY line", 3), ("SELECT line, COUNT('row') AS n FROM trips GROUP BY line", 3), ("SELECT line, c AS n FROM (SELECT line, COUNT(*) AS c FROM trips GROUP BY line) q", 3)],
        [*(f"SELECT line, {x} AS n FROM trips GROUP BY line" for x in ("SUM(minutes)", "MIN(minutes)", "COUNT(minutes)", "COUNT(DISTINCT trip)", "COUNT(*) FILTER (WHERE fare > 1.0D)", "COUNT(*) + 5", "COUNT(*) * 100", "COUNT(NULL)", "COUNT(IF(line = 'red', 1, NULL))", "77", "CAST(COUNT(*) AS DOUBLE)")), f"SELECT line, n - 1 AS n FROM ({_BASE}) q", "SELECT line, `count(1)` AS n FROM lookalike GROUP BY line, `count(1)`"],
    ),
    "suppressed": (
        [
            ("SELECT trip, COUNT(*) AS n, MAX(fare) AS f FROM trips GROUP BY trip", 0), ("SELECT minutes, COUNT(*) AS n FROM trips GROUP BY minutes", 0), ("SELECT line || trip AS both, COUNT(*) AS n FROM trips GROUP BY line || trip", 0), (_lines(where="line = 'ferry'"), 0), (_lines(where="minutes > 400"), 0),
            (_lines(tail="HAVING COUNT(*) < 4"), 0), (_lines(tail="HAVING COUNT(*) BETWEEN 3 AND 4"), 1), (_lines(", MIN(fare) AS f", tail="HAVING MIN(fare) > 100.0D"), 0), (_lines(tail="ORDER BY n LIMIT 2"), 0), (_lines(", MAX(fare) AS f", tail="ORDER BY f DESC LIMIT 3"), 1), ("SELECT COUNT(*) AS n FROM trips WHERE line = 'night'", 0),
        ],
        [],
    ),
    "negations_and_tests": (_where(("NOT (line = 'red')", 2), ("minutes IS NULL", 0), ("line IS NOT NULL", 3), ("(fare > 0.0D) IS TRUE", 3), ("(line = 'blue') IS NOT FALSE", 1), ("(minutes > 0) IS UNKNOWN", 0)), []),
    "between_and_case": (_where(("minutes BETWEEN 0 AND 1000", 3), ("minutes NOT BETWEEN 75 AND 1000", 1), ("CASE WHEN line = 'red' THEN TRUE ELSE FALSE END", 1), ("IF(line = 'blue', TRUE, FALSE)", 1)), _bad("CASE WHEN minutes DIV minutes > 0 THEN TRUE END", "minutes BETWEEN 0 AND 5 DIV 0")),
    "try_cast": (_where(("TRY_CAST(trip AS BIGINT) IS NULL", 3), ("TRY_CAST(line AS DOUBLE) IS NOT NULL", 0)), _bad("CAST(trip AS BIGINT) IS NULL", "CAST(line AS DOUBLE) IS NOT NULL")),
    "comparisons": (_where(*((f"minutes {op} 900", rows) for op, rows in (("=", 0), ("<>", 3), ("<", 3), ("<=", 3), (">", 0), (">=", 0))), ("line IS DISTINCT FROM 'red'", 2), ("line IS NOT DISTINCT FROM 'red'", 1), ("line || '!' = 'red!'", 1), ("line = 'red' OR line = 'blue'", 2), ("line = 'red' AND minutes < 60", 1)), _bad("trip > 7", "line = 3")),
    "plus_minus_times": (_where(*((f"{c} {op} {c} > {low}", 3) for op in "+-*" for c, low in (("minutes", "-1000000"), ("fare", "-1000000.0D"))), ("minutes + NULL IS NULL", 3)), _bad("minutes * CAST('1.5' AS DECIMAL(3, 1)) > 0", "fare - CAST('1' AS DECIMAL(30, 10)) > 0")),
    "division": (_where(("fare / 2.0D > 0.0D", 3), ("fare % 2.0D >= 0.0D", 3), ("minutes DIV 7 >= 0", 3), ("minutes % 7 >= 0", 3)), _bad(*(f"minutes {op} {by} >= 0" for op in ("DIV", "%") for by in ("0", "minutes", "-1", "NULL")), "minutes / 2 > 0", "fare / minutes > 0")),
    "minus": (_where(("-fare < 0.0D", 3), ("-CAST(minutes AS DOUBLE) < 0.0D", 3)), _bad("-minutes < 0")),
    "like": (_where(("line LIKE 'r%'", 1), ("line NOT LIKE '%e%'", 0), ("line ILIKE 'BL%'", 1), (f"line LIKE '{_LONG[:1000]}'", 0)), _bad(f"line LIKE '{_LONG}'", f"line NOT ILIKE '{_LONG}'", "line LIKE trip", "trip ILIKE line || '%'", "line RLIKE 'r.*'")),
    "in_list": (_where(("line IN ('red', 'green')", 2), ("line NOT IN ('ferry')", 3), ("minutes IN (900, 501)", 0)), _bad("line IN (trip, 'red')", "minutes IN (minutes DIV 2, 10)")),
    "functions": (_where(("lower(line) = 'red'", 1), ("upper(line) = 'BLUE'", 1), ("coalesce(minutes, 0) >= 0", 3), ("nullif(line, 'red') IS NULL", 1)), _bad("abs(minutes) > 0", "length(line) > 2", "substr(trip, 1, 1) = 'r'", "repeat(line, 3) <> ''", "to_date(line) IS NULL", "greatest(minutes, 5) > 0", "java_method('java.lang.Math', 'abs', -1) > 0", "rand() > 0.0D", "raise_error(line) IS NULL", "assert_true(minutes < 900) IS NULL")),
    "casts": (_where(("CAST(minutes AS DOUBLE) > 0.0D", 3), ("CAST(fare AS STRING) <> ''", 3), ("CAST(minutes AS STRING) <> '0'", 3), ("CAST(line AS STRING) = 'red'", 1)), _bad("CAST(fare AS BIGINT) > 0", "CAST(minutes AS INT) > 0", "CAST(minutes AS DECIMAL(2, 0)) > 0", "CAST(line AS BOOLEAN) IS NULL", "CAST(trip AS TIMESTAMP) IS NULL")),
    "constants": (_where(("minutes > 2L + 3L", 3), ("CAST('12' AS BIGINT) < 100", 3), ("minutes > CAST('7' AS BIGINT)", 3)), _bad("CAST('twelve' AS BIGINT) > 0", "minutes > 1 DIV 0", "9223372036854775807 + 1L > minutes", "CAST('soon' AS DATE) IS NULL")),
    "aggregate_calls": ([(_lines(tail="HAVING SUM(minutes) > 0"), 3), (_lines(tail="ORDER BY MAX(fare) DESC LIMIT 3"), 1), (_lines(", COUNT(*) * 100 DIV 20 AS share"), 3)], [_lines(", SUM(minutes) / COUNT(*) AS mean"), _lines(tail="ORDER BY 1 / MAX(minutes)"), _lines(tail="HAVING 10 DIV MIN(minutes) > 0"), _lines(", -SUM(minutes) AS s")]),
}

UNPLANNABLE = [_lines(", SUM(minutes) AS n"), "SELECT COUNT(*) AS n, COUNT(*) AS N FROM trips", "SELECT COUNT(*) AS n FROM ships", "SELECT colour, COUNT(*) AS n FROM trips GROUP BY colour"]

CASES = [(f"{rule}_{verdict}_{i}", sql, expected) for rule, (accepted, refused) in RULES.items() for verdict, some in (("yes", [(s, f"rows:{n}") for s, n in accepted]), ("no", [(s, "refused") for s in refused])) for i, (sql, expected) in enumerate(some)]
CASES += [(f"unplannable_{i}", sql, "unplannable") for i, sql in enumerate(UNPLANNABLE)]

#: Statements that are refused in both modes, by what they would do.
STATEMENTS = [
    *(f"{verb} trips" for verb in ("DROP TABLE", "TRUNCATE TABLE", "CACHE TABLE", "UNCACHE TABLE", "REFRESH TABLE", "DESCRIBE TABLE", "SHOW COLUMNS IN", "ANALYZE TABLE")),
    "CREATE OR REPLACE TEMPORARY VIEW mine AS SELECT * FROM trips", "CREATE TABLE mine AS SELECT * FROM trips", "ALTER TABLE trips RENAME TO mine", "INSERT INTO trips SELECT * FROM trips", "DELETE FROM trips WHERE fare > 1", "UPDATE trips SET fare = 0", "MERGE INTO trips USING trips AS other ON FALSE WHEN MATCHED THEN DELETE",
    "INSERT OVERWRITE LOCAL DIRECTORY '/tmp/out' USING csv SELECT * FROM trips", "SET spark.sql.shuffle.partitions = 3", "RESET", "USE elsewhere", "SHOW DATABASES", "EXPLAIN EXTENDED SELECT COUNT(*) AS n FROM trips", "ADD FILE '/etc/hostname'", "LIST JARS",
    "DECLARE VARIABLE found STRING", "EXECUTE IMMEDIATE 'SELECT COUNT(*) AS n FROM trips'", "BEGIN SELECT COUNT(*) AS n FROM trips; END", "SELECT COUNT(*) AS n FROM trips; SELECT 2", "SELECT TRANSFORM(trip) USING 'sort' FROM trips", "CREATE FUNCTION f AS 'a.B'", "LOAD DATA INPATH '/tmp/x' INTO TABLE trips",
]
