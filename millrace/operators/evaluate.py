"""Evaluation of completions: program assembly and, if asked for, execution."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def function_program(prompt: Column, completion: Column, test: Column, entry: Column) -> Column:
    return F.concat(prompt, completion, F.lit("\n"), test, F.lit("\ncheck("), entry, F.lit(")\n"))


def asserted_program(code: Column, tests: Column, setup: Column) -> Column:
    return F.concat(F.when(F.coalesce(setup, F.lit("")) != "", F.concat(setup, F.lit("\n"))).otherwise(""), code, F.lit("\n"), F.array_join(tests, "\n"))


def executed(programs: DataFrame, program: str = "program", timeout: int = 10, allow: bool = False) -> DataFrame:
    """programs with `passed`: exit status 0 within the time. Runs code from the table, so it must be allowed by name;
    the only guard is the time limit and Python's isolated mode."""
    if not allow:
        raise PermissionError("executed() runs code from the table; pass allow=True in a sandbox")
    schema = programs.select("*", F.lit(False).alias("passed")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def passes(source: str) -> bool:
            with tempfile.NamedTemporaryFile("w", suffix=".py") as file:
                file.write(source or "raise SystemExit(1)")
                file.flush()
                try:
                    return subprocess.run([sys.executable, "-I", file.name], capture_output=True, timeout=timeout).returncode == 0
                except subprocess.TimeoutExpired:
                    return False

        for frame in frames:
            yield frame.assign(passed=frame[program].map(passes))

    return programs.mapInPandas(run, schema)


def harness(benchmarks: dict[str, Callable[[], DataFrame]], names: list[str], folder: str) -> dict:
    """Metrics and seconds of each named benchmark, as a dictionary and as JSON in the folder; unknown names are skipped.

    A benchmark gives (k, problems, pass_at_k), a row for each k.
    """
    began, results = time.time(), {}
    for name in names:
        if name in benchmarks:
            start = time.time()
            rows = benchmarks[name]().collect()  # a row for each k
            results[name] = {"metrics": {f"pass@{r.k}": r.pass_at_k for r in rows}, "elapsed_seconds": time.time() - start}
    out = {"total_elapsed_seconds": time.time() - began, "benchmarks": results}
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"eval_{int(time.time())}.json"), "w") as file:
        json.dump(out, file, indent=2)
    return out
