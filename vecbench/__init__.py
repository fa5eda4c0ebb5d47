"""vecbench: embedding retrieval and evaluation as Spark DataFrame jobs.

Every capability is a DataFrame -> DataFrame function. Dense arithmetic runs
in Arrow batches (``mapInPandas``) over blocks that Spark partitions and
shuffles; everything else is built-in Spark SQL expressions.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package run inside Arrow tasks; pickle them by value.

    Executors then need only pyspark, numpy and pyarrow, not an installed
    copy of this package (``--py-files`` still works and is not required).
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
