"""Operators that prepare text and vectors for model training.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what a task calls travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
