"""Shared pieces of the training-data operators: reading, staging, row-wise Arrow maps and byte tokenisers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Java regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if b in _UPPER else b for b in range(256))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(
    b + 32 if b in _UPPER else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """White-space words of a text with A-Z lower-cased, as UTF-8. None has no words."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and non-ASCII characters with A-Z lower-cased. None has no words."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="palisade-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: The folders of the staged frames that are still referred to.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged frames that nothing will read again."""
    for df in frames:
        path = _FOLDERS.pop(df, None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df but for those whose names clash with new ones (Spark's names ignore case)."""
    lowered = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lowered]


def short_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Texts are long: send them to Python in batches of fewer rows than Spark's default, so that a task stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Give the system back what a finished task's arrays left behind: Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def map_columns(
    df: DataFrame,
    inputs: list[str],
    carry: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    rows: int = 512,
) -> DataFrame:
    """Append columns row by row through Arrow, with no shuffle.

    make() runs once in each task and returns the function from the input arrays to the new arrays. Columns of
    carry pass through untouched; one whose name clashes with a new field is replaced by it. Batches are cut to
    `rows` rows, so that a batch of very long texts stays small.
    """
    short_batches(df.sparkSession)
    carry = [c for c in carry if c.lower() not in {f.name.lower() for f in fields}]
    packed = df.select(*[F.col(f"`{c}`") for c in carry], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*[packed.schema[i] for i in range(len(carry))], *fields])
    k, names = len(carry), [*carry, *[f.name for f in fields]]
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns = [batch.column(i) for i in range(batch.num_columns)]
                new = fn(columns[k:])
                new = [pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(new, target)]
                yield pa.RecordBatch.from_arrays([*columns[:k], *new], names=names)
        release()

    return packed.mapInArrow(run, schema)
