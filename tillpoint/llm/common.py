"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillpoint.session import checkpoint_dir

# Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
# Every other byte becomes a space, so ``bytes.split`` gives the words.
TO_SPACES = bytes(b if b in WORD_BYTES else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that extra columns never clash: pick(df, id="doc_id")."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def local_path(folder: str, mount: dict[str, str] | None) -> str:
    """The folder as the workers' file path; ``mount`` maps a URI to the path where it is mounted."""
    for uri, path in (mount or {}).items():
        if folder.startswith(uri):
            return path + folder[len(uri):]
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder} is no file path: give its mount point on the workers as mount={{uri: path}}")
    return folder


def written(df: DataFrame, what: str, rows: int | None = None, task_rows: int = 100_000) -> DataFrame:
    """``df`` as a table written once to the shared folder: lineage is cut, a lost executor costs nothing.

    Where at most ``rows`` rows are known to come, no more tasks write it than one for each ``task_rows`` of them, and eight.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    if rows is not None:
        df = df.coalesce(8 + rows // task_rows)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased; no text has none."""
    return [] if text is None else encoded(text).lower().translate(TO_SPACES).split()


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_char_spans(text: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points, end exclusive) of the words with these numbers, in the text as it stands."""
    data = encoded(text)
    raw = np.frombuffer(data.lower().translate(TO_SPACES), np.uint8) != 0x20
    edge = np.diff(raw.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return first[starts[wanted]], first[ends[wanted]]


def md5_hex(c: Column) -> Column:
    """md5 of a column as text; null counts as the empty text."""
    return F.md5(F.coalesce(c.cast("string"), F.lit("")))


def ddl(df: DataFrame) -> str:
    """The columns of a DataFrame as a schema text."""
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Lists, numpy or Arrow arrays as a batch of the schema."""
    def array(values, kind):
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            return values if values.type == kind else values.cast(kind)
        return pa.array(values, type=kind)
    return pa.RecordBatch.from_arrays([array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(batch: pa.RecordBatch, piece_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of about ``piece_bytes``; a larger row is a piece of its own."""
    if piece_bytes is None or batch.num_rows < 2 or batch.nbytes <= piece_bytes:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), piece_bytes)
    yield from pieces(batch.slice(half), piece_bytes)


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str,
                piece_bytes: int | None = None) -> DataFrame:
    """Arrow batches of ``df`` through a function that ``start`` makes once per task.

    The function yields dicts of columns; columns of the batch may be handed
    on as they are, so ids of any type and nulls stay exact.  With
    ``piece_bytes`` it gets a batch in pieces of about that size: what it
    makes of a whole batch of long texts is many times the batch.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = start()
        for batch in batches:
            for piece in pieces(batch, piece_bytes):
                for columns in work(piece):
                    yield record_batch(columns, arrow)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
