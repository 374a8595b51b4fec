import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barlens.session import get_session

    s = get_session("local[4]", shuffle_partitions=4, app="barlens-tests")
    yield s
    s.stop()


def day(i: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def make_bars(spark, rows):
    """rows: (ticker, day_index, open, high, low, close, volume)."""
    data = [(t, day(d), float(o), float(h), float(lo), float(c), float(v)) for t, d, o, h, lo, c, v in rows]
    return spark.createDataFrame(data, "ticker string, date date, open double, high double, low double, close double, volume double")


def closes(spark, ticker, values, volume=None, start=0):
    vol = list(volume) if volume is not None else [1000.0] * len(values)
    return [(ticker, start + i, c, c * 1.01, c * 0.99, c, v) for i, (c, v) in enumerate(zip(values, vol))]
