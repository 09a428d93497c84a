"""A sink of files with exact names: tasks stage them, one commit publishes them all or none."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "provenlake_named_files"
SCHEMA = "file string, piece long, content binary"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs), and the path inside it."""
    system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inside.rstrip("/")


def overlaps(path: str, other: str) -> bool:
    """Whether path is the folder `other` or lies in it, whatever the scheme they are written with."""
    a, b = (posixpath.normpath(filesystem(p)[1]) for p in (path, other))
    return a == b or a.startswith(b + "/")


@dataclass
class Staged(WriterCommitMessage):
    """The files that a task staged, where they are published one by one."""

    files: list[str]


class NamedFilesWriter(DataSourceWriter):
    """Writes rows, sorted by file and piece with a file's rows in one task, to a folder of their own
    beside the target, named after this job."""

    def __init__(self, target: str, fresh: bool, job: str):
        self.target, self.fresh, self.staging = target, fresh, f"{target.rstrip('/')}.staging-{job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        system, staging = filesystem(self.staging)
        _, target = filesystem(self.target)
        attempt = TaskContext.get().taskAttemptId()
        staged: list[str] = []
        current, piece, out = None, 0, None

        def finish() -> None:
            out.close()
            here = f"{staging}/{current}.{attempt}"
            if not self.fresh and system.get_file_info(f"{target}/{current}").type != fs.FileType.NotFound:
                if self._differs(system, here, f"{target}/{current}"):
                    raise FileExistsError(f"refusing to overwrite non-identical file: {self.target}/{current}")
                system.delete_file(here)
                return
            # an attempt that ran before this one staged the same bytes
            system.move(here, f"{staging}/{current}")
            if not self.fresh:
                staged.append(current)

        for row in rows:
            if row.file == current:
                if row.piece <= piece:
                    raise ValueError(f"a file stands twice: {current}")
            else:
                if current is not None:
                    finish()
                current = row.file
                parts = current.split("/")
                if current.startswith("/") or ".." in parts or "" in parts:
                    raise ValueError(f"not a path inside the target: {current}")
                system.create_dir(posixpath.dirname(f"{staging}/{current}"), recursive=True)
                out = system.open_output_stream(f"{staging}/{current}.{attempt}", compression=None)
            piece = row.piece
            out.write(bytes(row.content or b""))
        if current is not None:
            finish()
        return Staged(staged)

    @staticmethod
    def _differs(system: fs.FileSystem, new: str, old: str) -> bool:
        """Whether two files have other bytes; compared piece by piece."""
        with system.open_input_stream(new) as a, system.open_input_stream(old) as b:
            while True:
                x, y = a.read(1 << 20), b.read(1 << 20)
                if x != y:
                    return True
                if not x:
                    return False

    def commit(self, messages: list[Staged | None]) -> None:
        """Publishes what was staged: the whole folder by one move where the target is new or made
        afresh, else the files one by one; those that are there already are identical."""
        system, staging = filesystem(self.staging)
        _, target = filesystem(self.target)
        there = system.get_file_info(target).type != fs.FileType.NotFound
        system.create_dir(staging, recursive=True)
        if there and not self.fresh:
            for file in (f for m in messages if m is not None for f in m.files):
                system.create_dir(posixpath.dirname(f"{target}/{file}"), recursive=True)
                system.move(f"{staging}/{file}", f"{target}/{file}")
            system.delete_dir(staging)
            return
        if there:
            system.move(target, f"{staging}.old")
        else:
            system.create_dir(posixpath.dirname(target) or "/", recursive=True)
        system.move(staging, target)
        if there:
            system.delete_dir(f"{staging}.old")

    def abort(self, messages: list[Staged | None]) -> None:
        system, staging = filesystem(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class NamedFiles(DataSource):
    """The data source behind write_named; options: path, and fresh, true or false."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("fresh", "false") == "true", uuid.uuid4().hex)


def write_named(files: DataFrame, path: str, fresh: bool = False) -> None:
    """Writes files(file, content), or files(file, piece, content) in the order of their pieces, below
    the folder path; any other column is ignored.

    With fresh the folder holds these files alone afterwards.  Otherwise files are written where there
    are none, and left as they are where they have the same bytes; other bytes refuse the whole job.  A job
    that fails leaves the folder as it was.  Names are relative, without empty parts and '..', and
    stand once; a row without a name fails the job.
    """
    files.sparkSession.dataSource.register(NamedFiles)
    rows = files if "piece" in files.columns else files.withColumn("piece", F.lit(0).cast("long"))
    name = F.when(F.col("file").isNull(), F.raise_error(F.lit("a file without a name"))).otherwise(F.col("file"))
    rows = rows.select(name.alias("file"), F.col("piece").cast("long").alias("piece"), F.col("content").cast("binary").alias("content"))
    dealt = rows.repartition("file").sortWithinPartitions("file", "piece")
    dealt.write.format(FORMAT).mode("append").option("path", path).option("fresh", str(fresh).lower()).save()
