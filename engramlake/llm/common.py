"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty where there is none."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fold(value: Column) -> Column:
    """Row barrier: the value becomes a column of its own and is not computed again by expressions above it."""
    return F.explode(F.array(value))


def aside(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``keep`` under names of their own (in_0, in_1, ...), and the name of each.

    So no column of the input can meet a name that an operator uses while it works; ``restored`` gives them back.
    """
    names = {c: c if c in keep else f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that their functions can be imported there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
