"""What a physical plan does, for tests and for reading: exchanges, joins and Python stages of a query."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

NODES = re.compile(r"^[\s:|+*()\d-]*([A-Z]\w+)", re.M)


def nodes(df: DataFrame) -> Counter:
    """Names of the operators in the plan that Spark would run, with their number."""
    return Counter(NODES.findall(df._jdf.queryExecution().executedPlan().toString()))


def exchanges(df: DataFrame) -> int:
    """Shuffles and broadcasts."""
    return sum(n for name, n in nodes(df).items() if name in ("Exchange", "BroadcastExchange"))


def python_stages(df: DataFrame) -> int:
    return sum(n for name, n in nodes(df).items() if "Python" in name or "Arrow" in name or "Pandas" in name)
