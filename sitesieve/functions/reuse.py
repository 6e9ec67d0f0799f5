"""Reuse of expressions that do not depend on the data.

An expression over named columns is the same for every frame. Building a large one takes thousands of calls to the JVM,
so it is built once per session and then used again.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")
_built: weakref.WeakKeyDictionary[SparkContext, dict] = weakref.WeakKeyDictionary()


def per_session(key: Hashable, build: Callable[[], T]) -> T:
    context = SparkContext._active_spark_context
    if context is None:
        return build()
    known = _built.setdefault(context, {})
    if key not in known:
        known[key] = build()
    return known[key]
