"""Zipped CSV archives as a Spark data source, read and written as streams.

``spark.read.format("zipcsv")`` plans one partition for each archive of a folder. An archive is opened where it lies, through the
file system of its URI (local or mounted paths, ``s3://``, ``gs://``, ``hdfs://``), and parsed in pieces; neither the archive nor its table is
ever whole in memory. Only the ``columns`` asked for are parsed. With ``listing`` there is a row for each archive
instead: its name, its year and month, and whether it opens as a zip file, for which its last bytes are read.

``df.write.format("zipcsv")`` writes one archive for each run of equal names in the column ``archive``. Tasks write to a folder of the
attempt; the commit moves what the successful attempts wrote into place, an abort deletes it. So retried or
speculative tasks leave nothing behind, and a reader never meets half an archive.
"""

from __future__ import annotations

import fnmatch
import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pcsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

MONTH = re.compile(r"_(\d{4})[-_](\d{1,2})[^/]*\.zip$")
#: Bytes of CSV that are parsed at a time.
PIECE = 4 << 20
LISTING = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("year", IntegerType()),
                      StructField("month", IntegerType()), StructField("valid", BooleanType())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def archives(uri: str) -> list[pafs.FileInfo]:
    """The zip files of a folder, by name, or those of its files that fit a pattern like ``folder/x_*.zip``; none if the folder does not exist.
    Names that start with a sign of hidden files are passed over."""
    fs, path = file_system(uri)
    folder, name = posixpath.split(path.rstrip("/"))
    folder, name = (folder, name) if set(name) & set("*?[") else (path, "*.[zZ][iI][pP]")
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, name)), key=lambda f: f.path)


def match_headers(headers: list[str], wanted: list[str], where: str = "the table") -> list[str]:
    """The header that stands for each wanted name, in order: equal up to case and underscores. Of several
    the last counts. Raises with every wanted name that ``where`` does not have."""
    plain = {h.replace("_", "").casefold(): h for h in headers}
    found = [plain.get(w.replace("_", "").casefold()) for w in wanted]
    if None in found:
        lost = ", ".join(w for w, h in zip(wanted, found, strict=True) if h is None)
        raise KeyError(f"{where} has no column for: {lost}")
    return found


def opens(file: pa.NativeFile) -> bool:
    """Whether a file has the directory of a zip file at its end."""
    try:
        return zipfile.is_zipfile(file)
    except ValueError:  # shorter than a directory
        return False


@dataclass
class Archive(InputPartition):
    path: str
    size: int


class ZipReader(DataSourceReader):
    def __init__(self, uri: str, columns: list[str], listing: bool):
        self.uri, self.columns, self.listing = uri, columns, listing

    def partitions(self) -> list[InputPartition]:
        # an empty folder still needs a partition
        return [Archive(f.path, f.size) for f in archives(self.uri)] or [Archive("", 0)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.uri)
        with fs.open_input_file(partition.path) as file:
            if self.listing:
                name = MONTH.search(partition.path)
                year, month = (int(x) for x in name.groups()) if name else (None, None)
                yield pa.RecordBatch.from_pylist([{"path": partition.path, "size": partition.size, "year": year, "month": month,
                                                   "valid": opens(file)}], pa.schema([
                    ("path", pa.string()), ("size", pa.int64()), ("year", pa.int32()), ("month", pa.int32()), ("valid", pa.bool_())]))
                return
            with zipfile.ZipFile(file) as archive:
                tables = [m for m in archive.infolist() if m.filename[-4:].lower() == ".csv"]
                if not tables:
                    raise KeyError(f"{partition.path} holds no CSV file")
                with archive.open(tables[0]) as lines:
                    yield from self.rows(io.BufferedReader(lines, 1 << 20), partition.path)

    def rows(self, lines: io.BufferedReader, path: str) -> Iterator[pa.RecordBatch]:
        head = lines.readline().decode("utf-8-sig").rstrip("\r\n")
        names = pcsv.read_csv(io.BytesIO(head.encode() + b"\n"), parse_options=pcsv.ParseOptions(newlines_in_values=True)).column_names if head else []
        use = match_headers(names, self.columns, path)
        if not lines.peek(1):
            return
        places = [f"c{i}" for i in range(len(names))]
        found = [places[len(names) - 1 - names[::-1].index(h)] for h in use]
        table = pcsv.open_csv(lines, pcsv.ReadOptions(column_names=places, block_size=PIECE), pcsv.ParseOptions(newlines_in_values=True),
                              pcsv.ConvertOptions(column_types=dict.fromkeys(places, pa.string()), include_columns=list(dict.fromkeys(found)),
                                                  strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True))
        for batch in table:
            yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows, pa.string()), *[batch.column(c) for c in found]], names=["_source", *self.columns])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ZipWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, names: list[str], overwrite: bool):
        self.uri, self.names, self.overwrite = uri, names, overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.uri)
        at = posixpath.join(root, self.job, uuid.uuid4().hex)
        fs.create_dir(at, recursive=True)
        files: list[str] = []
        name = out = archive = entry = writer = None

        def close() -> None:
            if name is not None:
                for x in (writer, entry, archive, out):
                    x.close()

        for batch in iterator:
            where = batch.schema.get_field_index("archive")
            keys = batch.column(where).to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            rows = batch.drop_columns(["archive"])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != name:
                    close()
                    name = keys[lo]
                    if f"{at}/{name}.zip" in files:
                        raise ValueError(f"the rows of {name} do not follow each other")
                    files.append(f"{at}/{name}.zip")
                    out = fs.open_output_stream(files[-1])
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    entry = archive.open(f"{name}.csv", "w", force_zip64=True)
                    writer = pcsv.CSVWriter(entry, rows.schema)
                writer.write(rows.slice(lo, hi - lo))
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.uri)
        if self.overwrite:
            for old in archives(self.uri):
                fs.delete_file(old.path)
        for message in messages:
            for path in message.files if message else []:
                fs.move(path, posixpath.join(root, posixpath.basename(path)))
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, root = file_system(self.uri)
        if fs.get_file_info(posixpath.join(root, self.job)).type != pafs.FileType.NotFound:
            fs.delete_dir(posixpath.join(root, self.job))


class ZipCsv(DataSource):
    """Options: ``path``; ``columns``, a JSON list, for reading tables; ``listing`` for a row for each archive."""

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> StructType:
        if self.options.get("listing", "false").lower() == "true":
            return LISTING
        return StructType([StructField(c, StringType()) for c in ("_source", *json.loads(self.options["columns"]))])

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options["path"], json.loads(self.options.get("columns", "[]")), self.options.get("listing", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], schema.names, overwrite)


def scan_zips(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """``(_source, columns...)``: the first CSV file of every archive in ``folder`` (or of a pattern in it), headers matched up to case and underscores, all
    values as text, empty ones null."""
    spark.dataSource.register(ZipCsv)
    return spark.read.format("zipcsv").option("columns", json.dumps(columns)).load(folder)


def list_zips(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size, year, month, valid)`` of the archives in ``folder``; year and month from names like ``x_2024-01.zip``, else null."""
    spark.dataSource.register(ZipCsv)
    return spark.read.format("zipcsv").option("listing", "true").load(folder)


def write_zips(df: DataFrame, folder: str, archive: str = "archive", mode: str = "append") -> None:
    """Write ``df`` as archives named by its string column ``archive``, without that column. The rows of a name have to follow each other in
    one partition (``repartition`` by the column and sort by it)."""
    df.sparkSession.dataSource.register(ZipCsv)
    df.withColumnRenamed(archive, "archive").write.format("zipcsv").mode(mode).save(folder)
