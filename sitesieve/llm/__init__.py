"""Operators for preparing training corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
