"""Operators for preparing training corpora.

Each module holds one operator with its general interface; ``queries`` registers the thin
queries. Python that runs inside tasks is pickled by value, so the cluster needs no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
