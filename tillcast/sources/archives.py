"""Pipe-separated tables inside zip archives.

Spark has no zip codec, and an archive's entries can't be cut. The central directory at the end of a file
tells where each entry begins, so a first pass reads only the ends of the archives and lists (archive, entry);
then every entry is a task of its own, which inflates it as a stream through the archive's file system
and yields record batches of bounded size. Neither an archive nor an entry is ever held whole, and a lost task
reads its entry again. Ends that fall short, bad checksums and encrypted entries are errors.

Archives lie on a file system that the executors mount, or in any store that pyarrow reads (``file://``,
``hdfs://``, ``s3://`` and so on).
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of inflated text that are parsed at once, at most (and a line more).
BLOCK = 8 << 20
TIME = "%Y-%m-%d %H:%M:%S"


def _open(path: str):
    """A seekable file; of a path without a scheme, a local one."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive paths -> (archive, entry, size) of their files, from the directory at each archive's end."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as f, zipfile.ZipFile(f) as z:
                found = [i for i in z.infolist() if not i.is_dir()]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([i.filename for i in found], pa.string()),
                                              pa.array([i.file_size for i in found], pa.int64())], ["archive", "entry", "size"])


def blocks(stream, size: int = BLOCK) -> Iterator[bytes]:
    """Whole lines of a stream of bytes, about ``size`` bytes at a time."""
    rest = b""
    while chunk := stream.read(size):
        chunk = rest + chunk
        cut = chunk.rfind(b"\n") + 1
        rest = chunk[cut:]
        if cut:
            yield chunk[:cut]
    if rest:
        yield rest


def _arrow_type(kind: T.DataType) -> pa.DataType:
    of = {T.TimestampNTZType: pa.timestamp("us"), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
          T.StringType: pa.string(), T.DateType: pa.date32()}
    return of[type(kind)]


def reader(schema: T.StructType, sep: str, block: int = BLOCK):
    """(archive, entry) rows -> the rows of these entries. The first line names the columns, in any order; a
    schema column that an entry lacks, a column beyond the schema and a value of the wrong type are errors."""
    import pyarrow.csv as csv

    names = [f.name for f in schema.fields]
    types = {f.name: _arrow_type(f.dataType) for f in schema.fields}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, entry in zip(batch.column("archive").to_pylist(), batch.column("entry").to_pylist()):
                with _open(path) as f, zipfile.ZipFile(f) as z, z.open(entry) as stream:
                    header = [c.strip('"') for c in stream.readline().decode("utf-8-sig").rstrip("\r\n").split(sep)]
                    if header != [""] and sorted(header) != sorted(names):
                        raise ValueError(f"{path}, {entry}: columns {header} instead of {names}")
                    for text in blocks(stream, block):
                        table = csv.read_csv(
                            pa.BufferReader(text), read_options=csv.ReadOptions(column_names=header, block_size=len(text) + 1),
                            parse_options=csv.ParseOptions(delimiter=sep),
                            convert_options=csv.ConvertOptions(column_types=types, strings_can_be_null=True, quoted_strings_can_be_null=False,
                                                               null_values=[""], timestamp_parsers=[csv.ISO8601, TIME]))
                        yield from table.select(names).to_batches()
    return rows


def read_zip(spark: SparkSession, paths, schema: T.StructType, sep: str = "|", pattern: str | None = None) -> DataFrame:
    """The rows of all entries (whose names fit the regular expression ``pattern``, if there is one) of the
    archives, one task an entry."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(len(paths), "archive").mapInArrow(
        entries, "archive string, entry string, size long")
    if pattern:
        listed = listed.where(F.col("entry").rlike(pattern))
    found = listed.orderBy(F.desc("size"), "archive", "entry").collect()  # names only: one row an entry
    if not found:
        return spark.createDataFrame([], schema)
    numbered = spark.createDataFrame([(k, r["archive"], r["entry"]) for k, r in enumerate(found)], "k long, archive string, entry string")
    each = numbered.repartitionByRange(len(found), "k").select("archive", "entry")
    return each.mapInArrow(reader(schema, sep), schema)


def writer(folder: str, sep: str):
    """The rows of a task -> one archive with one entry in the folder, and its path. A task that runs again writes the
    same name."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.csv as csv
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}"
        path, header = f"{folder}/{name}.zip", True
        with _create(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{name}.csv", "w", force_zip64=True) as entry:
            for batch in batches:
                csv.write_csv(pa.Table.from_batches([batch]), entry, csv.WriteOptions(include_header=header, delimiter=sep, quoting_style="needed"))
                header = False
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["archive"])
    return write


def _create(path: str):
    """A new file whose folder exists then."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inside = fs.FileSystem.from_uri(path)
    else:
        system, inside = fs.LocalFileSystem(), path
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inside)


def write_zip(df: DataFrame, folder: str, sep: str = "|") -> list[str]:
    """The rows as zip archives of delimited text with a header, one a task; returns their paths."""
    return [r["archive"] for r in df.mapInArrow(writer(folder, sep), "archive string").collect()]
