"""A data source of Spark for trees of market documents, which finds its files by company and year and reports those that it cannot read.

<root>/security_id=A/year=2024/<any name> holds a JSON document a line: {"currency": ..., "bars": [{"trading_date", "open", "high", "low", "close", "volume"}]}.
`bars` reads them; of the securities and days asked for, folders of other companies are not listed, files of other years not opened, rows of other days not
sent. Files and folders whose names begin with a dot or an underscore are no documents.

What is asked for goes to the source as options, not by Spark's filter pushdown for Python sources: in Spark 4.1.2 a DataFrame keeps the filters pushed for
one action, and its next action without them lacks rows (df.count() after df.where(...).count(); a test holds our reads against that).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("open", "high", "low", "close", "volume")
_BARS = f"security_id string, trading_date date, currency string, {', '.join(f'{f} double' for f in FIELDS)}"
_PROBLEMS = "security_id string, year int, path string, problem string"


class Files(InputPartition):
    """(security, year, path) of the files that one task reads."""

    def __init__(self, files: list[tuple[str, int, str]]) -> None:
        super().__init__(None)
        self.files = files


def _visible(entries: Iterable[fs.FileInfo]) -> list[fs.FileInfo]:
    return sorted((e for e in entries if not e.base_name.startswith((".", "_"))), key=lambda e: e.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.problems, self.size = options["path"], options.get("problems", "false").lower() == "true", int(options.get("bytes", 32 << 20))
        asked = options.get("securities")
        self.securities = None if asked is None else set(json.loads(asked))
        self.first, self.last = (date.fromisoformat(options[k]) if options.get(k) else None for k in ("first", "last"))

    def _kept(self, day: date) -> bool:
        return (self.first is None or day >= self.first) and (self.last is None or day <= self.last)

    def _year_kept(self, year: int) -> bool:
        return (self.first is None or year >= self.first.year) and (self.last is None or year <= self.last.year)

    def _listed(self) -> Iterator[tuple[str, int, str, int]]:
        system, at = _system(self.root)
        for company in _visible(system.get_file_info(fs.FileSelector(at, allow_not_found=True))):
            name = unquote(company.base_name.removeprefix("security_id="))
            if company.type != fs.FileType.Directory or self.securities is not None and name not in self.securities:
                continue
            for folder in _visible(system.get_file_info(fs.FileSelector(company.path))):
                year = folder.base_name.removeprefix("year=")
                if folder.type == fs.FileType.Directory and year.isdigit() and self._year_kept(int(year)):
                    for f in _visible(system.get_file_info(fs.FileSelector(folder.path, recursive=True))):
                        if f.type == fs.FileType.File:
                            yield name, int(year), f.path, f.size or 0

    def partitions(self) -> list[InputPartition]:
        """Files in order of their paths, together up to `size` bytes; a small file counts as a hundredth of it, as opening one costs too."""
        out, held, weight = [], [], 0
        for name, year, path, size in self._listed():
            size = max(size, self.size // 100)
            if held and weight + size > self.size:
                out, held, weight = [*out, Files(held)], [], 0
            held.append((name, year, path))
            weight += size
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.root)
        for name, year, path in partition.files:
            rows, problem = [], None
            try:
                with system.open_input_stream(path) as f:
                    for line in f.read().decode("utf-8").splitlines():
                        if line.strip():
                            rows += _rows(name, year, json.loads(line))
            except (OSError, ValueError, TypeError, KeyError, AttributeError) as e:
                rows, problem = [], f"{type(e).__name__}: {e}"
            if self.problems:
                if problem is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, year, path, problem), (pa.string(), pa.int32(), pa.string(), pa.string()))], ["security_id", "year", "path", "problem"])
                continue
            rows = [r for r in rows if self._kept(r[1])]
            kinds = [pa.string(), pa.date32(), pa.string(), *[pa.float64()] * len(FIELDS)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["security_id", "trading_date", "currency", *FIELDS])


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _rows(name: str, year: int, document: dict) -> list[tuple]:
    if document.get("security_id", name) != name:
        raise ValueError(f"a document of {document['security_id']}")
    out = []
    for bar in document["bars"]:
        day = date.fromisoformat(bar["trading_date"])
        if day.year != year:
            raise ValueError(f"{day} among the documents of {year}")
        out.append((name, day, document.get("currency"), *[None if bar.get(f) is None else float(bar[f]) for f in FIELDS]))
    return out


class BarDocuments(DataSource):
    """Daily bars; with option problems=true instead the files that cannot be read (broken JSON or bytes, no bars, another company or year), which the bars
    leave out whole. A field that a bar lacks is null; no folder, no rows. Options: securities (a JSON list), first, last, and bytes: how much one task reads."""

    @classmethod
    def name(cls) -> str:
        return "asofkit_bars"

    def schema(self) -> str:
        return _PROBLEMS if self.options.get("problems", "false").lower() == "true" else _BARS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def bars(spark: SparkSession, root: str, securities: Iterable[str] | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """The bars of the securities (all, if not said) from the first to the last day, both included."""
    spark.dataSource.register(BarDocuments)
    asked = {"securities": None if securities is None else json.dumps(sorted(securities)), "first": first and first.isoformat(), "last": last and last.isoformat()}
    return spark.read.format(BarDocuments.name()).options(**{k: v for k, v in asked.items() if v is not None}).load(root)


def problems(spark: SparkSession, root: str) -> DataFrame:
    """security_id, year, path, problem of the files that cannot be read."""
    spark.dataSource.register(BarDocuments)
    return spark.read.format(BarDocuments.name()).option("problems", "true").load(root)
