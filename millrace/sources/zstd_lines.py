"""JSON lines in zstd files: a data source that streams files in and out, and a seeded order for them.

Spark's own codecs need a native library for zstd, so files are read and written by tasks through pyarrow's
file systems; a file is a stream of lines in both directions and never held whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SUFFIX = ".jsonl.zst"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(SUFFIX) and not x.base_name.startswith(("_", "."))]

    def read(self, partition):
        import io

        import zstandard

        system, _ = _open(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_stream(partition.path, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as plain:
            for k, line in enumerate(io.BufferedReader(plain, 1 << 20)):
                yield name, k, line.rstrip(b"\r\n").decode("utf-8", "replace")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, level: int, frame_lines: int):
        self.path, self.level, self.frame_lines = path, level, frame_lines
        system, root = _open(path)
        from pyarrow import fs

        if system.get_file_info(root).type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} exists")

    def write(self, rows):
        import zstandard
        from pyspark import TaskContext

        system, root = _open(self.path)
        system.create_dir(f"{root}/_staging", recursive=True)
        part, n, sink = TaskContext.get().partitionId(), 0, None
        temporary = f"{root}/_staging/{part:05d}-{uuid.uuid4().hex}"
        try:
            for row in rows:
                if sink is None:
                    sink = system.open_output_stream(temporary, compression=None)
                    packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).stream_writer(sink, closefd=False)
                packed.write(row[0].encode() + b"\n")
                n += 1
                if n % self.frame_lines == 0:
                    packed.flush(zstandard.FLUSH_FRAME)
            if sink is not None:
                packed.close()
        finally:
            if sink is not None:
                sink.close()
        return _Written(temporary if n else None, n)

    def commit(self, messages):
        system, root = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{root}/{m.path.rsplit('/', 1)[-1].split('-')[0]}{SUFFIX}")
        system.create_dir(root, recursive=True)
        system.delete_dir_contents(f"{root}/_staging", missing_dir_ok=True)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        system, root = _open(self.path)
        system.delete_dir_contents(root, missing_dir_ok=True)


class ZstdLines(DataSource):
    """Format `zstd_lines`: (file, line, value) of a folder of .jsonl.zst files; written from one string column.

    A partition is a file. Tasks write beside the files and the commit renames what they wrote, so a folder
    without _SUCCESS isn't whole, and a task that is tried again leaves nothing double.
    """

    @classmethod
    def name(cls):
        return "zstd_lines"

    def schema(self):
        return "file string, line long, value string"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("level", 3)), int(self.options.get("frameLines", 4096)))


def write_zstd_lines(lines: DataFrame, path: str, level: int = 3) -> None:
    """One string column as zstd files, one a partition, in a folder that doesn't exist yet. Null lines are left out."""
    lines.sparkSession.dataSource.register(ZstdLines)
    column = lines.columns[0]
    lines.where(F.col(column).isNotNull()).write.format("zstd_lines").option("path", path).option("level", level).mode("append").save()


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their place in the file, counted from 0; malformed UTF-8 is replaced."""
    spark.dataSource.register(ZstdLines)
    return spark.read.format("zstd_lines").option("path", path).load()


FILE_BYTES = 64 << 20  # of text, before compression


def file_count(rows: DataFrame, column: str, least: int = 1) -> int:
    """Files for a text column: one for every FILE_BYTES of it, as a file is written by one task and read by one."""
    size = rows.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(least, -(-size // FILE_BYTES))


def shuffled(lines: DataFrame, column: str, seed: str, files: int) -> DataFrame:
    """`lines` in an order that depends on the seed and the lines alone, cut into about `files` ranges of it.

    A range sort by a seeded digest: memory is that of Spark's sort, which spills, whatever the number of lines.
    Equal lines stand next to each other's digests, so they are told apart by nothing and come together.
    """
    key = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(column)), 256)
    return lines.withColumn("_key", key).repartitionByRange(files, "_key").sortWithinPartitions("_key").drop("_key")
