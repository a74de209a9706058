"""Remember built expressions.

Building a large Column takes thousands of calls into the JVM.  Expressions that
depend only on settings (rules, formats, column names) are built once per JVM and
used again by later scans, and by every micro-batch that plans anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

Built = TypeVar("Built")


def remembered(build: Callable[..., Built]) -> Callable[..., Built]:
    """Keep the results of ``build`` by its (hashable) arguments and the running JVM."""
    known: dict[tuple, Built] = {}

    @wraps(build)
    def get(*args):
        key = (SparkContext._gateway, *args)
        if key not in known:
            known[key] = build(*args)
        return known[key]

    return get
