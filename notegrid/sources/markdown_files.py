"""Notes from a folder of Markdown files, as a Spark data source.

    spark.dataSource.register(MarkdownSource)
    spark.read.format("markdown_notes").option("exclude", "static").load(folder)

The planner walks down only until it has ``FOLDERS`` folders to deal; workers
walk these and read the files. What it met on the way is dealt by file. Names that begin with a dot are skipped, names that begin with an
underscore are not; empty files are notes. ``exclude`` names folders at the top
level only. A file that isn't UTF-8 is an error. Columns: title (file stem),
ctx (its folders, null at the root), md_text, path, is_readme (README.md at the
root).
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "title string, ctx array<string>, md_text string, path string, is_readme boolean"
PER_PARTITION, FOLDERS = 2000, 256


def _entries(folder: str, at: str, skip: set[str]) -> tuple[list[str], list[str]]:
    """Notes (relative paths) and folders directly in a folder."""
    notes, folders = [], []
    with os.scandir(at) as entries:
        for e in entries:
            if e.name.startswith("."):
                continue
            if e.is_dir():
                if not (at == folder and os.path.normpath(e.path) in skip):
                    folders.append(e.path)
            elif e.name.endswith(".md") and e.is_file():
                notes.append(os.path.relpath(e.path, folder))
    return notes, folders


def walk(folder: str, exclude: tuple[str, ...] = (), most: int | None = None, begin: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Relative paths of all notes below, sorted; with ``most``, the walk stops when so many folders wait, and they are the second part."""
    skip = {os.path.normpath(os.path.join(folder, x)) for x in exclude if x}
    out, waiting = [], deque([folder] if begin is None else begin)
    while waiting and (most is None or len(waiting) < most):
        notes, folders = _entries(folder, waiting.popleft(), skip)
        out += notes
        waiting += folders
    return sorted(out), sorted(waiting)


def note_row(folder: str, path: str) -> tuple:
    parts = path.split(os.sep)
    with open(os.path.join(folder, path), encoding="utf-8", newline="") as f:
        text = f.read()
    return parts[-1][:-3], parts[:-1] or None, text, "/".join(parts), path == "README.md"


@dataclass
class Part(InputPartition):
    """Notes to read, and a folder whose notes are to be found first."""

    paths: list[str]
    folder: str | None = None


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("a folder of notes is needed: .load(folder)")
        self.folder = os.path.abspath(options["path"])
        self.exclude = tuple(x for x in options.get("exclude", "").split(",") if x)

    def partitions(self) -> list[Part]:
        paths, folders = walk(self.folder, self.exclude, FOLDERS)
        return [*(Part(paths[i : i + PER_PARTITION]) for i in range(0, len(paths), PER_PARTITION)), *(Part([], f) for f in folders)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        paths = partition.paths if partition.folder is None else walk(self.folder, self.exclude, begin=[partition.folder])[0]
        for p in paths:
            yield note_row(self.folder, p)


class MarkdownSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_notes(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ("static", "_site")) -> DataFrame:
    spark.dataSource.register(MarkdownSource)
    return spark.read.format("markdown_notes").option("exclude", ",".join(exclude)).load(folder)


def split_readme(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes of the site, the root README)."""
    return notes.where("not is_readme"), notes.where("is_readme")
