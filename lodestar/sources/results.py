"""Stored result pages of search engines as a Spark data source.

store() keeps pages (id, html, own) in a folder for each engine and page number.
``spark.read.format("result_pages")`` reads them back as hits: a partition for each
file, filters on engine and page decide which files there are to read at all, and
a page is parsed where its partition runs. What one file holds is read a few rows
at a time.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import html

SCHEMA = "id bigint, engine string, page int, rank_position int, url string, title string, snippet string"
_ARROW = pa.schema([("id", pa.int64()), ("engine", pa.string()), ("page", pa.int32()), ("rank_position", pa.int32()), ("url", pa.string()), ("title", pa.string()), ("snippet", pa.string())])
ROWS = 256


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def store(pages: DataFrame, folder: str, own: Column | None = None) -> None:
    """Result pages (id, engine, page, html), with the engine's own host where it is read in the general way."""
    host = F.lit("") if own is None else own
    pages.select(F.col("id").cast("bigint").alias("id"), "engine", F.col("page").cast("int").alias("page"), "html", host.alias("own")).write.partitionBy("engine", "page").mode("append").parquet(folder)


@dataclass
class Stored(InputPartition):
    """One file of an engine's pages of one number."""

    file: str
    engine: str
    page: int

    def __init__(self, file: str, engine: str, page: int):
        super().__init__(file)
        self.file, self.engine, self.page = file, engine, page


def _test(f: Filter) -> tuple[str, Callable[[str | int], bool]] | None:
    """The column and test of a filter that folders decide, null for others."""
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name not in ("engine", "page"):
        return None
    tests = {
        EqualTo: lambda v: v == f.value, In: lambda v: v in f.value, LessThan: lambda v: v < f.value, LessThanOrEqual: lambda v: v <= f.value,
        GreaterThan: lambda v: v > f.value, GreaterThanOrEqual: lambda v: v >= f.value,
    }
    return (name, tests[type(f)]) if type(f) in tests else None


class ResultPagesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tests: list[tuple[str, Callable[[str | int], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f) if hasattr(f, "attribute") else None
            if test:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            parts = dict(p.split("=", 1) for p in posixpath.dirname(info.path).split("/") if "=" in p)
            if info.type == fs.FileType.File and info.path.endswith(".parquet") and {"engine", "page"} <= parts.keys():
                own = {"engine": parts["engine"], "page": int(parts["page"])}
                if all(test(own[name]) for name, test in self.tests):
                    found.append(Stored(info.path, own["engine"], own["page"]))
        return found or [Stored("", "", 0)]

    def read(self, partition: Stored) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.file) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(ROWS, columns=["id", "html", "own"]):
                rows = []
                for i, body, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows += [(i, partition.engine, partition.page, k, *hit) for k, hit in enumerate(html.hits(body or "", partition.engine, own or ""), 1)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


class ResultPages(DataSource):
    """Hits of stored result pages; a page without any gives no row, a folder that isn't there none at all."""

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ResultPagesReader:
        return ResultPagesReader(self.options["path"])


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of stored result pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultPages)
    return spark.read.format("result_pages").load(folder)
