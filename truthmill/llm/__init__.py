"""Operators for training-text corpora, each with one registered query (``queries.py``).

Helpers that run inside tasks travel with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
