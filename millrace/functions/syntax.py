"""Python syntax check: the one part of the quality score that needs Python."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def python_syntax_score(code: pd.Series) -> pd.Series:
    """1.0 for code that compiles, else 0.1; null counts as not compiling. Compiled only, never run."""

    def score(text: str | None) -> float:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text or "(", "<text>", "exec")
            return 1.0
        except (SyntaxError, ValueError, UnicodeEncodeError, MemoryError, RecursionError):
            return 0.1

    return code.map(score)


def syntax_of(code: Column, language: Column) -> Column:
    """The score of Python rows; only their code goes to Python. A column of its own: lambdas hold no Python functions."""
    return python_syntax_score(F.when(language == "python", code))
