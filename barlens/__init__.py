"""barlens: panel time-series analytics on price/volume bars, expressed as Spark DataFrame plans.

Every operator is a ``DataFrame -> DataFrame`` function built from Catalyst built-ins.  The long
``bars`` table (ticker, date, open, high, low, close, volume) is the central data model; per-series
logic is a window partitioned by ``ticker`` and ordered by ``date``.
"""

from barlens.session import get_session, checkpoint_dir  # noqa: F401
