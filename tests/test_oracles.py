"""Every registered query against its SQL on the smallest tables."""

import os
import random

import duckdb
import pytest

from stillwright.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, got.fetchall())


def _covered(events, roles):
    """Five picks by value, an hour apart; then for each missing role the last pick gives way, if another fits."""
    events = sorted(events, key=lambda e: (-e[3], e[0]))
    apart = lambda e, picks: all(abs(e[2] - p[2]) >= 3600 for p in picks)
    picks = []
    for e in events:
        if len(picks) < 5 and apart(e, picks):
            picks.append(e)
    for role in roles:
        if role not in [p[1] for p in picks]:
            found = [e for e in events if e[1] == role and e not in picks and apart(e, picks[:-1])]
            if found:
                picks = [*picks[:-1], found[0]]
    return sorted(picks, key=lambda e: (-e[3], e[0]))


def test_coverage_repairs_keep_the_gap(spark, tmp_path):
    from stillwright.plans.frames import ROLES

    rnd, rows = random.Random(4), []
    rows += [(k, 1, "click", k * 7200, 10.0 - k) for k in range(5)] + [(10, 1, "view", 600, 4.0), (11, 1, "view", 90000, 3.0)]
    for user in range(2, 60):
        rows += [(100 * user + k, user, "click" if k < 20 else rnd.choice(["view", "error", "purchase"]), rnd.randrange(40000), round(rnd.random() + (k < 20), 2)) for k in range(26)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, sec bigint, value double")
    df.selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(sec) ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    want = {(u, i, p[0]) for u in {r[1] for r in rows} for i, p in enumerate(_covered([(r[0], r[2], r[3], r[4]) for r in rows if r[1] == u], ROLES))}
    got = [(r["user_id"], r["idx"], r["event_id"]) for r in QUERIES["coverage_topn"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert (1, 4, 11) in want


def _stills_of(spark, tmp_path, lines):
    """work_stills and its SQL on the smallest tables with other columns of lines."""
    con = duckdb.connect()
    for name, changed in (("orders", "o_orderkey AS o_orderkey"), ("lineitem", lines)):
        con.execute(f"COPY (SELECT * REPLACE ({changed}) FROM '{DATA}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(ORACLES["work_stills"])
    df = QUERIES["work_stills"](spark, str(tmp_path))
    return _rows(df.columns, df.collect()), _rows([d[0] for d in want.description], want.fetchall())


def test_work_stills_of_unknown_prices_and_empty_lines(spark, tmp_path):
    """Lines without a price, and lines of nothing, whose embedding is no number: as the SQL has them."""
    gone = [f"CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN 0 ELSE {c} END AS {c}" for c in ("l_quantity", "l_tax", "l_discount")]
    found, want = _stills_of(spark, tmp_path, ", ".join(["CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice", *gone]))
    assert repr(found) == repr(want)  # nan is not equal to itself
    assert any(x != x for row in found for x in row)


def test_work_stills_of_line_numbers_below_one(spark, tmp_path):
    """Every rank below the main roles' number has an anchor, one below 0 too."""
    found, want = _stills_of(spark, tmp_path, "CASE WHEN l_partkey % 3 = 0 THEN 1 - l_linenumber ELSE l_linenumber END AS l_linenumber")
    assert found == want and found
