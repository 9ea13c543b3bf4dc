"""Look at the physical plan of a DataFrame, for plan-shape tests and tuning."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def plan_nodes(df: DataFrame) -> list[str]:
    """Operator names from the tree part of the formatted plan."""
    nodes = []
    for line in plan_text(df).splitlines():
        name = line.lstrip(" :+-*")
        if "(" in name and name.rstrip().endswith(")") and name[:1].isupper():
            nodes.append(name.split("(")[0].strip())
        elif line.startswith("("):
            break
    return nodes


def count_nodes(df: DataFrame, prefix: str) -> int:
    return sum(node.startswith(prefix) for node in plan_nodes(df))
