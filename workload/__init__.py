"""Registered queries over the driver tables, each with an independent SQL check where one exists."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from workload import flow_queries, manifest_queries, pixel_queries, similarity_queries  # noqa: E402, F401
from workload.registry import CHECKS, QUERIES  # noqa: E402

__all__ = ["CHECKS", "QUERIES"]
