"""Sinks: exclusive and atomic writes, appends with a quota, retention."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Parquet that never replaces what is there, nor an input."""
    if path.rstrip("/") in {p.rstrip("/") for p in inputs}:
        raise ValueError("the output is one of the inputs")
    df.write.mode("errorifexists").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_within(df: DataFrame, path: str, used: int, quota: int, bytes_column: str) -> None:
    """Appends only if the rows' bytes still fit the quota."""
    new = df.agg(F.coalesce(F.sum(bytes_column), F.lit(0))).first()[0]
    if used + new > quota:
        raise ValueError(f"{used + new} bytes are over the quota of {quota}")
    df.write.mode("append").parquet(path)


def report(header: dict, path: str) -> None:
    """One small JSON file on the driver, replaced as a whole; numbers must be finite."""
    text = json.dumps(header, allow_nan=False, ensure_ascii=False, sort_keys=True)
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def fingerprint(config: dict, separators: tuple[str, str] = (",", ":"), ascii_only: bool = True) -> str:
    """SHA-256 of a configuration's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=separators, ensure_ascii=ascii_only, allow_nan=False).encode()).hexdigest()
