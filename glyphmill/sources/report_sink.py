"""A sink of reports: one JSON file a site, all of a write's or none.

Each attempt of a task writes whole files to a folder of its own, under ``_attempts`` of this write. On commit, the folders that successful
attempts report are moved in place, so what failed, lost or repeated attempts wrote is never seen; then the write's marker
``_SUCCESS-<write>`` is put, and its attempts are removed. On abort they are removed alone; the driver makes their folder before tasks run and moves
it away first, so that a task that still writes, or begins late, finds no place and leaves nothing.

Edges: a null site or payload is left out; of rows of one site one stays; a site's file that is there already is replaced; names of files
are percent-encoded; an empty table leaves the marker alone.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from glyphmill.sources.site_documents import exported

#: Files that the driver moves at once on commit.
MOVES = 16


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class SiteReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_reports"

    def schema(self) -> str:
        return "site_id string, payload string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SiteReportsWriter(self.options["path"], uuid.uuid4().hex)


class SiteReportsWriter(DataSourceWriter):
    def __init__(self, path: str, write: str):
        """In the driver; tasks get a copy."""
        self._path, self._write = path.rstrip("/"), write
        fs, folder = _file_system(self._attempts())
        fs.create_dir(folder, recursive=True)

    def _attempts(self) -> str:
        return f"{self._path}/_attempts/{self._write}"

    def write(self, iterator) -> Attempt:
        folder, n = uuid.uuid4().hex, 0
        fs, base = _file_system(f"{self._attempts()}/{folder}")
        fs.create_dir(base, recursive=False)
        for row in iterator:
            if row["site_id"] is not None and row["payload"] is not None:
                with fs.open_output_stream(f"{base}/{quote(row['site_id'], safe='')}.json") as out:
                    out.write(row["payload"].encode())
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, base = _file_system(self._path)
        fs.create_dir(base, recursive=True)
        attempts = f"{base}/_attempts/{self._write}"
        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message is not None and message.files:
                    for _ in pool.map(lambda f: fs.move(f.path, f"{base}/{f.base_name}"), fs.get_file_info(FileSelector(f"{attempts}/{message.folder}"))):
                        pass
        with fs.open_output_stream(f"{base}/_SUCCESS-{self._write}"):
            pass
        self._remove(fs, attempts)

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, base = _file_system(self._path)
        self._remove(fs, f"{base}/_attempts/{self._write}")

    @staticmethod
    def _remove(fs, folder: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(folder).type == FileType.Directory:
            gone = f"{folder}-gone"
            try:
                fs.move(folder, gone)
            except (OSError, NotImplementedError):  # stores without folders can't move them, nor do new files keep one there from going
                gone = folder
            fs.delete_dir(gone)


def write_site_reports(reports: DataFrame, path: str, mode: str = "live") -> None:
    """A JSON file for each site of reports, as ``site_documents.exported`` makes it, in a folder that driver and executors share."""
    spark = reports.sparkSession
    spark.dataSource.register(SiteReports)
    exported(reports, mode).write.format("site_reports").mode("append").save(path)
