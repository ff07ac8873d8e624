"""The registrant's profile: what is given goes over the defaults, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import Store

#: Fields of a profile; a deployment gives its own defaults.
DEFAULT = {
    "name": "Example Registrant, Inc.",
    "state": "Delaware",
    "file_number": "000-00000",
    "address": "1 Main Street",
    "phone": "(000) 000-0000",
    "signer_name": "A. Signer",
    "signer_title": "Chief Executive Officer",
}
SCHEMA = ", ".join(f"{field} string" for field in DEFAULT)


def merged(given: DataFrame, default: dict[str, str] = DEFAULT) -> DataFrame:
    """given, with the defaults for fields that are null or that it lacks; its other columns stay."""
    have = set(given.columns)
    fields = [F.coalesce(F.col(f), F.lit(v)).alias(f) if f in have else F.lit(v).alias(f) for f, v in default.items()]
    return given.select(*(c for c in given.columns if c not in default), *fields)


def load(spark: SparkSession, path: str, default: dict[str, str] = DEFAULT) -> DataFrame:
    """One row: the JSON file over the defaults; the defaults alone for a file that is missing or malformed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return merged(spark.range(1).drop("id"), default)
    text = spark.read.text(path, wholetext=True)
    return merged(text.select(F.from_json("value", SCHEMA).alias("p")).select("p.*"), default)


def save(store: Store, given: DataFrame, default: dict[str, str] = DEFAULT) -> DataFrame:
    """Writes the given profile over the defaults as the store's current one and returns it as read again."""
    store.write("registrant", merged(given, default).select(*default))
    return merged(store.read("registrant", SCHEMA), default)
