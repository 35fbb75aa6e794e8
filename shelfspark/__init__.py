"""shelfspark: catalogue extraction, hybrid product search and event analytics as Spark jobs."""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    # The few Python kernels (Arrow UDFs) are shipped with the plan: pickle this package's
    # functions by value so executors need no installed copy of it.
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001  (older cloudpickle: executors must import the package)
        pass


_pickle_by_value()
