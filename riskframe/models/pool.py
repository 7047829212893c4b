"""Independent fits side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target

PARALLEL = 8  # Spark jobs of independent fits run side by side


def run_all(spark, tasks: list):
    """Run driver-side callables concurrently; each only submits Spark jobs."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(lambda f: f(), [inheritable_thread_target(spark)(t) for t in tasks]))
