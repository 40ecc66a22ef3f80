import pytest
from listinglake import queries
from tests.oracle import assert_same, duck


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), duck(sf_dir, queries.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_interval_gate_is_greedy(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().dropna(subset=["user_id", "ts"])
    want = set()
    for _, own in events.sort_values(["ts", "event_id"]).groupby("user_id"):
        last = None
        for ts, event in zip(own["ts"], own["event_id"], strict=True):
            if last is None or (ts - last).total_seconds() >= 3600:
                want.add(event)
                last = ts
    assert {r["event_id"] for r in queries.queries()["interval_gate"](spark, sf_dir).collect()} == want


def test_duplicate_groups_are_components(spark, sf_dir):
    from listinglake.operators import dedupe
    from listinglake.plans.listings import listings

    df = listings(spark, sf_dir)
    edges = [(r["a"], r["b"]) for r in dedupe.scored_pairs(df, dedupe.candidate_pairs(df)).where("duplicate").collect()]
    least = {i: i for e in edges for i in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["id"]: r["group_id"] for r in queries.queries()["duplicate_groups"](spark, sf_dir).collect()}
    assert len(got) == df.count() and edges
    assert all(g == least.get(i, i) for i, g in got.items())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from listinglake.operators import search
    from listinglake.plans.listings import listings

    plan = search.filtered(listings(spark, sf_dir), search.SearchParams(event_from=None), queries.at()).select("listing_id")._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "PushedFilters" in plan
