"""Retail trading analytics as Spark DataFrame transforms.

Every operator takes DataFrames and returns DataFrames; ``dataset_id`` leads every
grouping key, so one job serves all datasets at once.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
