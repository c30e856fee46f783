"""Operators for preparing language-model training data.

Nothing else in the package imports this folder; queries are in ``queries.py``.
Functions of these modules travel to the tasks by value, so executors need not
have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
