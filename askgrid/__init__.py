"""Table-and-text question answering data work, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers need no copy of this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
