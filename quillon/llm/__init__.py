"""Operators of a training-data pipeline.

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``tests/llm``
imports it.  The Python functions that run on executors travel by value, so
that a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
