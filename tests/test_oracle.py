"""A few registered queries against their SQL on the smallest tables; the driver compares all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["d6_brute_force", "d9_dns_tunnel", "d16_alerts_by_rule", "a1_flows", "c1_incidents", "j3_indicator_domains", "t1_flow_list", "j10_tunnels_as_of", "i2_random_name_alerts", "l4_forest_scores", "x13_modbus", "x14_bacnet", "x15_parking", "x23_dhcp", "x24_poisoned_names", "v19_process_verdicts"])
def test_same_rows(spark, db, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple(round(x, 5) if isinstance(x, float) else str(x) for x in row)
    assert sorted(map(str, map(key, map(tuple, got.select(*columns).collect())))) == sorted(map(str, map(key, want)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
