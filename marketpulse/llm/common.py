"""What the operators of this folder share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words, as a Java and as an RE2 character class.
SPACES = r"[\x20\x09-\x0D]"
#: A character of a word: a text without one has no words, which is found without splitting it.
WORD = r"[^\x20\x09-\x0D]"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(column: Column) -> Column:
    """The words of a text: runs of anything but space, tab, line and page breaks."""
    return F.array_remove(F.split(column, SPACES + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plus_fields(schema: StructType, *fields: tuple[str, str]) -> StructType:
    """``schema`` with further (name, type) fields, as a new object: frames cache theirs."""
    out = StructType(list(schema.fields))
    for name, kind in fields:
        out.add(name, kind)
    return out


def byte_slices(batch: pa.RecordBatch, column: str | int, most: int):
    """Cut a batch into slices whose texts (a column's, by name or place) hold about ``most`` bytes; a longer text is alone."""
    index = column if isinstance(column, int) else batch.schema.get_field_index(column)
    sizes = pa.compute.binary_length(batch.column(index)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
