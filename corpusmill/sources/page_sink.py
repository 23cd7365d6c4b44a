"""Pages as Markdown files: a data source that stages what changed in tasks and moves it in place in one commit.

Tasks write pages whose file is missing or differs below ``_staged/<run>``, and the list of them
beside; what they tell the driver is the name of that list. The commit first writes the lists' names
to ``_commits/<run>``, then moves the files, each by one rename, and at last deletes the commit's file:
``recover`` finishes commits that a lost driver left, and a job that fails deletes what it staged, so the
old pages stay whole. Paths go to any file system that pyarrow opens by URI and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Renames that a commit has under way at once.
MOVES = 16


@dataclass
class Staged(WriterCommitMessage):
    """A task's list of staged pages."""

    name: str
    pages: int


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _bytes(system, path: str) -> bytes | None:
    try:
        with system.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _put(system, path: str, data: bytes) -> None:
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def finish(path: str, run: str) -> None:
    """Move all pages that a commit names, again if it was broken off, and forget the commit."""
    from pyarrow import fs

    system, root = _opened(path)
    held = f"{root}/_staged/{run}"

    def move(page: str) -> None:
        if system.get_file_info(f"{held}/{page}").type != fs.FileType.NotFound:  # else it was moved before
            system.create_dir(f"{root}/{page}".rpartition("/")[0], recursive=True)
            system.move(f"{held}/{page}", f"{root}/{page}")

    with ThreadPoolExecutor(MOVES) as pool:
        for name in json.loads(_bytes(system, f"{root}/_commits/{run}")):  # a task's pages at a time
            listed = (_bytes(system, f"{held}/_lists/{name}") or b"").decode().split("\n")
            list(pool.map(move, filter(None, listed)))
    system.delete_file(f"{root}/_commits/{run}")
    if system.get_file_info(held).type != fs.FileType.NotFound:
        system.delete_dir(held)


def recover(path: str) -> list[str]:
    """Finish commits that were broken off; their runs."""
    from pyarrow import fs

    system, root = _opened(path)
    runs = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True)))
    for run in runs:
        finish(path, run)
    return runs


class PageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        system, root = _opened(self.path)
        task, changed = TaskContext.get(), []
        for row in rows:
            page, data = row.page_path, (row.page_text or "").encode()
            if not page or page.startswith(("/", "_")) or ".." in page.split("/") or "\n" in page:
                raise ValueError(f"a page can't stand at {page!r}")
            if _bytes(system, f"{root}/{page}") != data:
                _put(system, f"{root}/_staged/{self.run}/{page}", data)
                changed.append(page)
        name = f"{task.partitionId()}-{task.attemptNumber()}"
        _put(system, f"{root}/_staged/{self.run}/_lists/{name}", "\n".join(changed).encode())
        return Staged(name, len(changed))

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _opened(self.path)
        _put(system, f"{root}/_commits/{self.run}", json.dumps([m.name for m in messages if m is not None]).encode())
        finish(self.path, self.run)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = _opened(self.path)
        system.delete_dir_contents(f"{root}/_staged/{self.run}", missing_dir_ok=True)


class PageSink(DataSource):
    """``df.write.format("markdown_pages").mode("append").save(path)`` of (page_path, page_text)."""

    @classmethod
    def name(cls) -> str:
        return "markdown_pages"

    def schema(self) -> str:
        return "page_path string, page_text string"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


def write_pages(pages: DataFrame, path: str) -> None:
    """Write pages as files below ``path`` (absolute, or a URI); of several at one path the greatest text stands. Files of other pages are left alone."""
    spark: SparkSession = pages.sparkSession
    recover(path)
    spark.dataSource.register(PageSink)
    rows = pages.groupBy("page_path").agg(F.max(F.coalesce("page_text", F.lit(""))).alias("page_text"))
    rows.write.format("markdown_pages").mode("append").save(path)
