"""vistrata: exploratory analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from vistrata.facade import Profile  # noqa: E402

__all__ = ["Profile"]
__version__ = "0.1.0"
