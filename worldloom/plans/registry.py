"""All registered core queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worldloom.plans import others, problems, relations, rewrites, world

_MODULES = [problems, world, relations, others, rewrites]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
