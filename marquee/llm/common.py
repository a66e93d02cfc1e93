"""What the text operators share: words, lower-casing, hashes and stored intermediate tables."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpoint_dir

#: White space as every operator here understands it: a space, or U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SHINGLE = 5


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` does just that where a text is ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, an empty text or white space alone."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(columns: list[str], name: str) -> str:
    """`name`, or a variant of it that no column bears (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(df: DataFrame, label: str) -> str:
    """A new folder name inside the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = shared_folder(df, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1_000) -> None:
    """Texts are long: lets at most `rows` of them pass to Python at a time, which bounds the memory of a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= rows:
        df.sparkSession.conf.set(name, str(rows))
