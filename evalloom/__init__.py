"""Spark-native evaluation of retrieval-augmented question answering."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from evalloom.plans.evaluator import Evaluator, evaluate_suite  # noqa: E402
from evalloom.sources.contract import ContractError, Suite  # noqa: E402

__all__ = ["ContractError", "Evaluator", "Suite", "evaluate_suite"]
