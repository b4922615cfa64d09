"""Shared helpers of the training-data operators."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


#: Writers look at a page's size every few rows and close row groups early, so that very long texts do not pile up in them.
SMALL_PAGES = {"parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "64", "parquet.block.size.row.check.min": "16", "parquet.block.size": str(32 << 20)}
#: Folders that ``cut`` makes are noted in the innermost open list.
_NOTED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only in local mode where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.options(**SMALL_PAGES).parquet(path)
    if _NOTED:
        _NOTED[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``cut`` gave and that nothing reads any more."""
    for f in frames:
        if path := getattr(f, "_cut_at", None):
            remove(f.sparkSession, path)


@contextmanager
def noting():
    """The folders that ``cut`` makes inside the block, for ``sweep``."""
    _NOTED.append([])
    try:
        yield _NOTED[-1]
    finally:
        _NOTED.pop()


def sweep(paths: list[str], reader: DataFrame) -> list[str]:
    """Delete the noted folders that ``reader`` does not read; those it does read come back."""
    files = set(reader.inputFiles()) if paths else set()
    read = {p for p in paths if any(p.rsplit("/", 1)[1] in f for f in files)}
    for p in paths:
        if p not in read:
            remove(reader.sparkSession, p)
    return [p for p in paths if p in read]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(df: DataFrame, columns=None):
    """The caller's columns as one struct ``_row``, so that no name of ours can clash with one of theirs."""
    return F.struct(*[F.col(quoted(c)) for c in (df.columns if columns is None else columns)]).alias("_row")


def unboxed(columns, *new):
    """Columns for a select: the caller's from ``_row``, then ours. Of equal names ours stays; ``new`` holds (name, column)."""
    ours = [n for n, _ in new]
    return [F.col(f"_row.{quoted(c)}").alias(c) for c in columns if c not in ours] + [c.alias(n) for n, c in new]


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound Arrow batches, so that very long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sample(rows: DataFrame, text: str, doc_id: str, most: int) -> list[str | None]:
    """Texts of the ``most`` rows of smallest id hash. The cut-off is found without texts, so tasks return about ``most`` texts in all."""
    hashed = rows.select(text, F.xxhash64(doc_id).alias("_o"), doc_id)
    last = hashed.select("_o").orderBy("_o").limit(most).agg(F.max("_o")).first()[0]
    if last is None:
        return []
    return [r[0] for r in hashed.where(F.col("_o") <= last).orderBy("_o", doc_id).limit(most).collect()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text):
    """Number of words without building them: blanks that end a word, counted by lengths."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(squeezed, BLANK, "")).cast("long")


def let(value, body):
    """Bind ``value`` once inside ``body``, so that Catalyst cannot copy the expression into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)
