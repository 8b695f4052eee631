"""What the operators share: token rules, held-out rules, ids, free names and kept tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_RUNS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters, that is of characters of Unicode's classes L; numbers such as ² and ½ are none."""
    found = _RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


_KEPT: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine (``local[n]``) a folder of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cubelith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame, buckets: int = 0, by: str = "") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor makes no task before this point run
    again, and every later reader sees the same rows.  With ``buckets`` the table is
    bucketed by the column ``by``, so that a later grouping by it needs no shuffle.
    Tables are deleted by :func:`release`, by :func:`passing_on`, or when the driver ends.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/cubelith-llm/{name}"
    if buckets:
        table = f"cubelith_{name}"
        df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
        out = spark.table(table)
    else:
        table, schema = None, df.schema
        df.write.parquet(path)
        out = spark.read.schema(schema).parquet(path)
    _KEPT.append((spark, path, table))
    out._kept = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete kept tables that nothing reads any more; other frames are left alone."""
    own = {p for f in frames if (p := getattr(f, "_kept", None))}
    _drop([k for k in _KEPT if k[1] in own])


@contextlib.contextmanager
def passing_on():
    """Of the tables kept inside, only the last is left in the end."""
    before = list(_KEPT)
    yield
    _drop([k for k in _KEPT[:-1] if k not in before])


def _drop(kept: list[tuple[SparkSession, str, str | None]]) -> None:
    for entry in kept:
        _KEPT.remove(entry)
        spark, path, table = entry
        with contextlib.suppress(Exception):
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget() -> None:
    """Delete all kept tables."""
    _drop(list(_KEPT))


atexit.register(forget)


def id_hash(doc_id: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def with_id(docs: DataFrame, doc_id: str | Column, *others: Column) -> DataFrame:
    """``doc_id`` and ``others``; ids that are whole numbers become longs, ids of other types stay as they are."""
    out = docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).alias("doc_id"), *others)
    kind = out.schema["doc_id"].dataType
    return out.withColumn("doc_id", F.col("doc_id").cast("long")) if isinstance(kind, T.IntegralType | T.NullType) else out


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}{n}"
    return name


def n_words(text: str | Column) -> Column:
    """Number of words as long; a null text has none.

    Counts the places where a word begins: after all white space has become a
    single space, one more than the inner spaces.
    """
    c = F.col(text) if isinstance(text, str) else text
    flat = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), GAP, " "), F.lit(" "))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, to size partitions by."""
    row = df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()
    return int(row[0] or 0)
