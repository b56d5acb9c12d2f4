"""Product-master-data engine on PySpark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module: str) -> None:
    """Send a module's functions inside the tasks that use them.

    Executors then need no installed copy of this package. Call it in modules that
    hold the few functions which run in Python workers.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
