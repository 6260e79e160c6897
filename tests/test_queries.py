"""Every registered query of the bar engine runs; those with SQL give the rows that the SQL gives."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark import registry as queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(v) if isinstance(v, (int, float, np.number)) else v


def rows(pdf, columns):
    return Counter(tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) > 0
    if name == "stream_equals_batch":
        assert len(got) and (got["differing"] == 0).all()
    if name == "start_invariance":
        assert (got["differing"] == 0).all()
    if name == "transition_audit":
        assert (got["illegal"] == 0).all()


def test_streamed_states_equal_the_batch(spark, sf_dir):
    a, b = (queries.QUERIES[n](spark, sf_dir) for n in ("streamed_lifecycle", "lifecycle_states"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_best_cell_of_equal_sharpe_ratios_is_the_first(spark):
    """Sums of the same returns in another order differ in the last digit; that is a tie."""
    from tidemark.plans import studies

    pdf = pd.DataFrame({"series": ["a", "a", "a", "b", "b"], "cell": [6, 7, 8, 1, 2], "entry": 80, "leave": [10, 20, 40, 10, 20], "sharpe": [1.2094, 1.2645468251269218, 1.2645468251269225, -0.5, -0.4], "total_return": 0.1})
    got = studies.best_cell(spark.createDataFrame(pdf)).toPandas().set_index("series")["cell"]
    assert got.to_dict() == {"a": 7, "b": 2}


@pytest.mark.parametrize("name", ["upsert_funding", "streamed_covered_bars", "streamed_funding_join"])
def test_settlements_of_one_instant(spark, sf_dir, tmp_path, name):
    """Events of one type and instant, alike or not: none is lost from the bars, and a table by instant has one of them."""
    x = pd.read_parquet(f"{sf_dir}/events.parquet")
    more = pd.concat([x[::7].assign(event_id=x["event_id"][::7] + 10_000, value=x["value"][::7] + 0.01), x[::50].assign(event_id=x["event_id"][::50] + 20_000)])
    pd.concat([x, more]).to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want) and rows(got, columns) == rows(want, columns)


def test_unaligned_bars_meet_their_settlements(spark):
    """Bars that open anywhere, with settlements at both of their edges and in other stretches."""
    from tidemark.streaming import signals

    at = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(40) * 60 + 17, unit="min")
    bars = pd.DataFrame({"series": "a", "ts": at, "close": np.arange(40.0)})
    settled = pd.concat([pd.Series(at[::3]), pd.Series(at[::3]) + pd.Timedelta("59min 59s"), pd.Series(at[::9]) - pd.Timedelta("1us")])
    funding = pd.DataFrame({"series": "a", "settled": settled, "rate": np.arange(float(len(settled)))})
    got = signals.withheld_until_funded(spark.createDataFrame(bars), spark.createDataFrame(funding)).toPandas()
    pairs = [(t, s, r) for t in at for s, r in zip(funding["settled"], funding["rate"]) if t <= s < t + pd.Timedelta("1h")]
    alone = {t for t in at} - {t for t, _, _ in pairs}
    assert alone and Counter(zip(got["ts"], got["rate"])) == Counter([(t, r) for t, _, r in pairs] + [(t, 0.0) for t in alone])
