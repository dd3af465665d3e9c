"""What the operators share: durable tables between steps, word rules, size checks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import cut, drop_cut, new_path, ranked, remove, shared_dir  # noqa: F401  for the operators

#: White space that ends a word: the space and U+0009 to U+000D, as in bytes.split().
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context, for workers that don't have it on their path.
    To be called before a Python function is bound to a plan."""
    sc = spark.sparkContext
    if getattr(sc, "_sparrowtext_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="sparrowtext-")) / "sparrowtext_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._sparrowtext_shipped = True


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def words_of(c):
    """Column: the words [^\\x20\\x09-\\x0D]+ of a text; null or blank text: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
