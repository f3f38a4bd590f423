"""Sources and sinks (S1–S14) on Spark's own readers and writers.

Paths are whatever the cluster can see (object store, HDFS, shared NFS).  The
writers never go through the driver: every sink is a ``DataFrameWriter``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.session import ensure_checkpoint_dir

# CSV type hints applied when the file name says it holds hotel bookings
# (string-typed codes and the two float columns that carry missing values).
BOOKING_CSV_HINTS: dict[str, T.DataType] = {
    "hotel": T.StringType(),
    "is_canceled": T.StringType(),
    "arrival_date_month": T.StringType(),
    "meal": T.StringType(),
    "country": T.StringType(),
    "market_segment": T.StringType(),
    "distribution_channel": T.StringType(),
    "reserved_room_type": T.StringType(),
    "assigned_room_type": T.StringType(),
    "deposit_type": T.StringType(),
    "agent": T.StringType(),
    "company": T.StringType(),
    "customer_type": T.StringType(),
    "reservation_status": T.StringType(),
    "reservation_status_date": T.StringType(),
    "children": T.DoubleType(),
    "adr": T.DoubleType(),
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV, PERMISSIVE (malformed fields → NULL).

    Without a schema Spark infers the types, which reads the input once more.  When the file name says bookings, the
    hinted columns get their hinted type in the reader's schema, so codes like ``007`` are never parsed as numbers.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        schema = reader.option("inferSchema", True).csv(path).schema
        if "hotel_bookings" in PurePosixPath(path).stem:
            schema = T.StructType([T.StructField(f.name, BOOKING_CSV_HINTS.get(f.name, f.dataType)) for f in schema])
    return reader.option("inferSchema", False).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """S3: the writer creates parent folders itself."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_input_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on suffix; anything else is an error."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in (".parquet", ".pq"):
        return read_parquet(spark, path)
    raise ValueError(f"Unsupported input format: {suffix or '<none>'} ({path})")


def write_json_report(df: DataFrame, path: str) -> None:
    """S5 sink: reports are small DataFrames; one JSON file per task."""
    df.write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S5 source: multi-line JSON documents (objects or arrays of objects)."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


_EVAL_LINE = "query string, expected_chunk_ids array<string>, expected_chunk_id string, _corrupt_record string"


def _eval_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of a JSONL evaluation set, or None if the file is one JSON document (array or ``samples`` object)."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    first = head[0]["value"].strip() if head else ""
    try:
        one = json.loads(first)
    except ValueError:
        one = {} if first.endswith("}") else None  # a broken line of its own, or the start of a document
    if not isinstance(one, dict) or "samples" in one:
        return None
    return spark.read.schema(_EVAL_LINE).json(path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from a JSON array, a ``{"samples": [...]}`` object or JSONL.

    Returns (query string, expected_ids array<string>) where ``expected_ids``
    merges a list field ``expected_chunk_ids`` with a single ``expected_chunk_id`` (U5).
    A JSONL line that is no JSON is left out (``count_bad_eval_lines`` tells how many) and harms no other line.
    """
    rows = _eval_lines(spark, path)
    if rows is not None:
        rows = rows.where(F.col("_corrupt_record").isNull())
    else:
        rows = spark.read.option("multiLine", True).json(path)
    if "samples" in rows.columns:
        rows = rows.select(F.explode("samples").alias("s")).select("s.*")
    if "query" not in rows.columns:
        return spark.createDataFrame([], "query string, expected_ids array<string>")
    many = F.col("expected_chunk_ids").cast("array<string>") if "expected_chunk_ids" in rows.columns else F.array()
    one = F.col("expected_chunk_id").cast("string") if "expected_chunk_id" in rows.columns else F.lit(None)
    ids = F.array_union(F.coalesce(many, F.array().cast("array<string>")), F.array_compact(F.array(one)))
    return rows.select(F.col("query").cast("string").alias("query"), F.array_sort(ids).alias("expected_ids"))


def count_bad_eval_lines(spark: SparkSession, path: str) -> int:
    """Lines of a JSONL evaluation set that are no JSON (0 for one JSON document)."""
    rows = _eval_lines(spark, path)
    return 0 if rows is None else rows.agg(F.count("_corrupt_record"), F.max("query")).first()[0]


def upsert_snapshot(df: DataFrame, path: str, key: str = "run_id") -> None:
    """Replace the partitions of the run ids present in ``df``; keep the others.

    Dynamic partition overwrite is an atomic per-partition replace, so a rerun
    of the same run id after an executor loss rewrites the same rows.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` runs updated last, newest first; ties by run id."""
    return runs.orderBy(F.col("updated_at").desc_nulls_last(), "run_id").limit(limit)


def append_dead_letter(df: DataFrame, path: str, created_at: str | None = None) -> None:
    """(created_at, payload JSON) rows appended to a dead-letter folder."""
    ts = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    out = df.select(ts.alias("created_at"), F.to_json(F.struct(*df.columns)).alias("payload"))
    out.write.mode("append").json(path)


def persist_splits(df: DataFrame, path: str, split_col: str = "split") -> DataFrame:
    """One table partitioned by split; returns split metadata (size and positive rate)."""
    write_parquet(df, path, [split_col])
    return df.sparkSession.read.parquet(path).groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


def save_model(model, path: str) -> None:
    """Spark ML writer (any ``MLWritable``)."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


#: Length of a file whose bytes a task holds at once, and of the pieces that a longer one is read in.
WHOLE_BYTES = 8 << 20
PIECE_BYTES = 256 << 10
#: Names whose text Spark would unpack; such a file is read whole.
PACKED_NAME = r"(?i)\.(deflate|gz|bz2|lz4|snappy|zst|passthrough)$"
#: A mark that Spark's text reader leaves out at the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def file_checksums(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SHA-256 of whole files, computed on executors (one row per file).

    Files over WHOLE_BYTES are read as lines, by split; the pieces meet in the order of the file in one task, which holds
    one batch of them.  Only a line longer than a piece is held as a line.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    name = F.col("_metadata.file_name")
    whole = [files.where(F.col("length") <= WHOLE_BYTES), files.where(F.col("length") > WHOLE_BYTES).where(name.rlike(PACKED_NAME))]
    small = whole[0].unionByName(whole[1]).select("path", "length", F.sha2("content", 256).alias("sha256"))
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
    lines = spark.read.option("lineSep", "\n").text(paths).where(F.col("_metadata.file_size") > WHOLE_BYTES).where(~name.rlike(PACKED_NAME))
    pieces = lines.select(*meta, F.col("value").cast("binary").alias("data")).mapInArrow(
        _pieces, "file_path string, file_size long, file_block_start long, piece long, data binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartition(parts, "file_path").sortWithinPartitions("file_path", "file_block_start", "piece")
    hashes = ordered.mapInArrow(_hashes, "_at string, _hash string")
    large = files.where(F.col("length") > WHOLE_BYTES).where(~name.rlike(PACKED_NAME)).select("path", "length", F.col("_metadata.file_path").alias("_at"))
    missing = F.raise_error(F.concat(F.lit("no lines of "), F.col("path"))).cast("string")
    return small.unionByName(large.join(hashes, "_at", "left").select("path", "length", F.coalesce("_hash", missing).alias("sha256")))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each split, every one with its end, joined to pieces that are numbered within the split."""
    of: tuple | None = None
    held, size, piece = [], 0, 0

    def cut() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, piece
        data, held, size = b"".join(held), [], 0
        for i in range(0, len(data), PIECE_BYTES):
            row = [*of, piece, data[i:i + PIECE_BYTES]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["file_path", "file_size", "file_block_start", "piece", "data"])
            piece += 1

    for batch in batches:
        path, start = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
        runs = [0, *(i + 1 for i in ((path[1:] != path[:-1]) | (start[1:] != start[:-1])).nonzero()[0].tolist()), batch.num_rows] if batch.num_rows else []
        for a, b in zip(runs[:-1], runs[1:]):
            here = tuple(batch.column(c)[a].as_py() for c in range(3))
            if here != of:
                if of is not None:
                    yield from cut()
                of, piece = here, 0
            for i in range(a, b, 1000):
                held.append(b"\n".join(batch.column(3).slice(i, min(1000, b - i)).to_pylist()) + b"\n")
                size += len(held[-1])
                if size >= PIECE_BYTES:
                    yield from cut()
    if of is not None:
        yield from cut()


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its pieces, which come in order.  The last line's end is there or not, as the length says."""
    of, total, plain, marked, end = None, 0, None, None, b""

    def done() -> pa.RecordBatch:
        path, size = of
        spare = total - size  # 0: the file ends with a line's end, 1: it does not; 3 bytes less with a mark
        if spare not in (0, 1, -3, -2):
            raise RuntimeError(f"read {total} bytes of {path}, which has {size}")
        h = plain if spare >= 0 else marked
        if spare in (0, -3):
            h.update(end)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h.hexdigest()])], ["_at", "_hash"])

    for batch in batches:
        for path, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)):
            if (path, size) != of:
                if of is not None:
                    yield done()
                of, total, plain, marked, end = (path, size), 0, hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK), b""
            data = memoryview(data.as_buffer())
            for h in (plain, marked):
                h.update(end)
                h.update(data[:-1])
            end, total = bytes(data[-1:]), total + len(data)
    if of is not None:
        yield done()


def load_metric_files(spark: SparkSession, glob: str, required: Sequence[str] = ("roc_auc", "f1", "precision", "recall")) -> DataFrame:
    """Per-model metric JSON files; model name from the file name; keep complete rows."""
    df = spark.read.option("multiLine", True).json(glob)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_metrics\.json$", 1)
    df = df.withColumn("model_name", name).where(F.col("model_name") != "calibration")
    cond = F.lit(True)
    for r in required:
        if r not in df.columns:
            return df.limit(0)
        cond = cond & F.col(r).isNotNull()
    return df.where(cond & (F.col("model_name") != ""))


def write_actions(df: DataFrame, path: str, run_id: str) -> None:
    """Actions table (with its key column) partitioned by run id."""
    upsert_snapshot(df.withColumn("run_id", F.lit(run_id)), path)


def append_lineage(spark: SparkSession, path: str, record: Mapping[str, object]) -> None:
    """Append one lineage record (small, driver-built) to the lineage table."""
    spark.createDataFrame([dict(record)]).write.mode("append").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
