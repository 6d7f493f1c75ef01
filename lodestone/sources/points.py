"""A sink of points: batches of files that count once their manifest is there, and the table that they make together.

Each task writes one file and tells what it wrote; the driver's commit writes the batch's manifest, which names the files,
under the batch's own name and only if there is none. So a batch that fails, or is aborted, leaves nothing that is read
(and what a task leaves that outlives it goes when the batch comes again), and one that is written again changes nothing. What a batch says of a document's revision replaces all older revisions of it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "document_id long, revision long, point_id string, payload string"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch, self.attempt = path, batch, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._place()
        name, rows, out = f"files/{self.batch}-{self.attempt}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for b in iterator:
                if out is None:
                    files.create_dir(f"{root}/files", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{name}", b.schema, filesystem=files)
                out.write_batch(b)
                rows += b.num_rows
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, rows)

    def _remove(self, attempt: str, keep: list[str]) -> None:
        """Deletes the batch's files of an attempt (a pattern) but those to keep."""
        files, root = self._place()
        for info in files.get_file_info(fs.FileSelector(f"{root}/files", allow_not_found=True)):
            if re.fullmatch(f"{self.batch}-{attempt}-[0-9a-f]{{32}}\\.parquet", info.base_name) and f"files/{info.base_name}" not in keep:
                files.delete_file(info.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._place()
        names = sorted(m.file for m in messages if m is not None and m.file)
        manifest = f"{root}/manifests/{self.batch}.json"
        if files.get_file_info(manifest).type != fs.FileType.NotFound:
            self._remove(self.attempt, [])  # the batch is there: what was written again is not needed
            return
        files.create_dir(f"{root}/manifests", recursive=True)
        with files.open_output_stream(f"{manifest}.{self.attempt}") as out:
            out.write(json.dumps({"batch": self.batch, "files": names, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        files.move(f"{manifest}.{self.attempt}", manifest)
        self._remove("[0-9a-f]{32}", names)  # of attempts that failed, and of tasks that ran twice

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove(self.attempt, [])


class PointSink(DataSource):
    """df.write.format("lodestone_points").option("batch", name).mode("append").save(folder); batches count in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_points"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        batch = self.options.get("batch", "")
        if overwrite or not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("points are appended, in a batch that has a name of letters, digits, - and _")
        return _Writer(self.options["path"], batch)


def write(points: DataFrame, folder: str, batch: str) -> None:
    """Writes a batch of points (SCHEMA; a row whose point_id is null says that the document's older revisions go, and nothing stays of this one unless other rows have it)."""
    points.sparkSession.dataSource.register(PointSink)
    rows = points.selectExpr("cast(document_id AS long) AS document_id", "cast(revision AS long) AS revision", "cast(point_id AS string) AS point_id", "cast(payload AS string) AS payload").where("document_id IS NOT NULL AND revision IS NOT NULL")
    rows.write.format("lodestone_points").option("batch", batch).mode("append").save(folder)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """batch and rows of the batches that count, and their files."""
    try:
        return spark.read.schema("batch string, files array<string>, rows long").json(f"{folder}/manifests/*.json")
    except Exception as e:  # Spark has no other way to say that a pattern matches nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "batch string, files array<string>, rows long")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The points that are there: of each document its greatest revision, of each of its points what the last batch says of it."""
    named = [r["file"] for r in committed(spark, folder).select(F.explode("files").alias("file")).collect()]  # names of files, as a scan of a folder lists them
    rows = spark.read.schema(SCHEMA).parquet(*[f"{folder}/{n}" for n in named]) if named else spark.createDataFrame([], SCHEMA)
    rows = rows.withColumn("batch", F.regexp_extract(F.input_file_name(), "files/(.*)-[0-9a-f]{32}-[0-9a-f]{32}\\.parquet$", 1)) if named else rows.withColumn("batch", F.lit(""))
    top = rows.groupBy("document_id").agg(F.max("revision").alias("revision"))
    live = rows.join(top, ["document_id", "revision"]).where("point_id IS NOT NULL")
    last = Window.partitionBy("document_id", "point_id").orderBy(F.desc("batch"), F.desc_nulls_last("payload"))
    return live.withColumn("n", F.row_number().over(last)).where("n = 1").select("document_id", "revision", "point_id", "payload")
