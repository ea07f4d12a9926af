"""What several operators of this subpackage share: text rules and written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.tables import dropped, work_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Smallest long: stands for a null identifier inside the operators.
NULL_ID = -(2**63)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Bytes of text that a Python worker turns into strings at a time.
PART_BYTES = 2_000_000

_kept: dict[str, dict] = {}


def check_id(docs: DataFrame, name: str) -> None:
    """Identifiers are ordered as integers: anything else is refused before a job starts."""
    if docs.schema[name].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{name}: identifiers are integers, not {docs.schema[name].dataType.simpleString()}")


def row_key(name: str) -> Column:
    """The identifier as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def digest128(*parts: Column) -> Column:
    """A binary digest of 128 bits of columns without nulls; the bytes of each are preceded by their number."""
    return F.unhex(F.md5(F.concat(*(x for part in parts for x in (F.octet_length(part).cast("string"), F.lit(":"), part)))))


def row_tag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows apart whose identifiers are equal or null: 128 bits of identifier and text."""
    return digest128(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def worker_memory(owner: str) -> dict:
    """What an operator keeps in its Python worker from task to task.

    Workers are used again by later stages, so that what other operators keep is let go first.
    """
    if owner not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            trim()
        _kept[owner] = {}
    return _kept[owner]


def trim() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    try:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run):
    """Of a function over batches: when its input ends it gives freed memory back, which idle workers would hold."""

    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


def text_parts(batch: pa.RecordBatch, column: int | str, most: int = PART_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with `most` bytes and one text more at most.

    Only one run at a time becomes Python strings, however long the rows of the batch are.
    """
    for i, texts in array_parts(batch, column, most):
        yield i, texts.to_pylist()


def array_parts(batch: pa.RecordBatch, column: int | str, most: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The same runs as slices of the Arrow column."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 32
    if not len(size):
        return
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for i, j in zip(cuts, cuts[1:]):
        yield i, texts.slice(i, j - i)


def shipped(spark: SparkSession) -> None:
    """Executors can import this package even where it isn't installed on their machines."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_netloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="netloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/netloom_code.zip", "w") as z:
        for d, _, names in os.walk(f"{root}/netloom"):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(f"{d}/{n}", os.path.relpath(f"{d}/{n}", root))
    sc.addPyFile(f"{folder}/netloom_code.zip")
    sc._netloom_shipped = True
