"""Commit times of notes from one pass over the history."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def is_repository(folder: str) -> bool:
    """Is the folder inside a work tree? False without the program too."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True, check=False)
    except OSError:
        return False
    return done.returncode == 0 and done.stdout.strip() == "true"


def latest(folder: str) -> dict[str, int]:
    """Unix seconds of the last commit of each path, relative to the folder; none where nothing was committed yet."""
    log = subprocess.run(
        ["git", "-C", folder, "-c", "core.quotePath=false", "log", "--format=%x00%ct", "--name-only", "--relative", "-z"],
        capture_output=True, check=False)
    if log.returncode and subprocess.run(["git", "-C", folder, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, check=False).returncode == 0:
        raise RuntimeError(f"the history of {folder} can't be read: {log.stderr.decode('utf-8', 'replace').strip()}")
    out: dict[str, int] = {}
    now: int | None = None
    for token in log.stdout.decode("utf-8", "replace").split("\0"):
        token = token.strip("\n")
        if token.isdigit():
            now = int(token)
        elif token and now is not None:
            out.setdefault(token, now)
    return out


def with_commits(spark: SparkSession, notes: DataFrame, folder: str) -> DataFrame:
    """``notes`` with ``committed_ts``; null for what was never committed and outside a repository."""
    rows = list(latest(folder).items()) if is_repository(folder) else []
    commits = spark.createDataFrame(rows, "path string, committed_ts bigint")
    return notes.join(commits, "path", "left")
