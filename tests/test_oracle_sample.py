"""A sample of registered queries against their DuckDB oracle on the smallest scale factor."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
SAMPLE = ["labels", "outperformance_summary", "asof_benchmark", "chrono_split", "ema", "atr", "high_volume_corr",
          "rolling_beta", "roc_auc", "pr_curve", "registry", "return_corr_matrix", "ks_drift", "resample_bars"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    from oracle_check import compare, duck

    a = E.queries()[name](spark, SF).toPandas()
    b = duck(SF).sql(E.oracle_sql()[name]).df()
    assert compare(a, b) == "OK"


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["ticker", "n", "outperf_rate", "mean_excess_return"]
    assert df.count() > 0
