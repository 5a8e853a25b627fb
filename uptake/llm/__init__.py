"""Operators for preparing text corpora. Nothing else in the library imports this package.

The functions that run inside tasks travel with the job (pickled by value), so executors need
numpy and pyarrow but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
