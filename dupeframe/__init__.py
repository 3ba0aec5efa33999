"""Spark-native detection and safe reclamation of duplicate content."""

import sys

from pyspark import cloudpickle

from dupeframe.plans.reclaim import ReclaimPlan, plan_reclaim
from dupeframe.plans.scan import ScanResult, scan_table, scan_tree

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ReclaimPlan",
    "ScanResult",
    "scan_table",
    "scan_tree",
    "plan_reclaim",
]
