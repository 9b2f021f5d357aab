"""Operators of a training-data pipeline: deduplication, filters, tokens, archives.

The functions that run inside tasks travel with the tasks, so executors need no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
