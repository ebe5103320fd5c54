"""The user's settings: which texts are keys, and which branches mean no task."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions import text as X

MOST_BRANCHES = 100


@dataclass
class Settings:
    """`pattern` is one Java pattern for all key patterns; `generic` are branches without a meaning, those of the library included."""

    pattern: str = X.KEY_PATTERN
    generic: tuple[str, ...] = field(default=tuple(X.GENERIC_BRANCHES))


def parse(text: str, where: str) -> Settings:
    """Settings of a JSON object {"keyPatterns": [...], "ignoreBranches": [...]}; what is wrong is named in the error."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{where} is no JSON: {e}") from None
    if not isinstance(data, dict):
        raise ValueError(f"{where} must be a JSON object")
    out = Settings()
    if "keyPatterns" in data:
        patterns = data["keyPatterns"]
        if not isinstance(patterns, list) or not patterns or not all(isinstance(p, str) and p.strip() for p in patterns):
            raise ValueError(f"{where}: keyPatterns must be a list of patterns that are not empty")
        out.pattern = X.key_pattern(patterns)
    if "ignoreBranches" in data:
        names = data["ignoreBranches"]
        if not isinstance(names, list) or not all(isinstance(b, str) for b in names) or len(names) > MOST_BRANCHES:
            raise ValueError(f"{where}: ignoreBranches must be a list of at most {MOST_BRANCHES} names")
        out.generic = tuple(dict.fromkeys([*out.generic, *(b.strip() for b in names if b.strip())]))
    return out


def read(spark: SparkSession, path: str) -> Settings:
    """Settings of a file that Spark can read; those of the library if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return Settings()
        raise
    return parse(rows[0][0] if rows else "", path)
