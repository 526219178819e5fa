"""contrail: disruption analytics for scheduled operations, written as Spark DataFrame jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function with its column names as
parameters. Nothing is collected to the driver except schemas and bounded model metadata.
"""

import sys

from pyspark import cloudpickle

from contrail.session import get_session, checkpoint_dir

# Ship this package's functions by value to the Python workers (Pandas batch operators), so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
