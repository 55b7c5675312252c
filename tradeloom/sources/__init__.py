"""Readers and writers. What they run inside tasks is pickled by value and ships with the job."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
