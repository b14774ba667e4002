"""Registry and profiles kept as YAML files, which are configuration of a few hundred rows at most, read on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def yaml_rows(spark: SparkSession, path: str, key: str) -> list[str]:
    """The entries of the list `key` of a YAML file as JSON texts, in order; entries that aren't maps stay what they are.

    The file is read by Spark, so it may lie wherever Spark reads. Needs PyYAML.
    """
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs PyYAML; JSON rows don't") from error
    text = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(text[0]) if text else None
    listed = found if isinstance(found, list) else (found or {}).get(key) or []
    return [json.dumps(x, default=str) for x in listed]


def yaml_registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML source registry as JSON rows (position, id, source_json) for load_registry()."""
    rows = [(i, i, x) for i, x in enumerate(yaml_rows(spark, path, "sources"))]
    return spark.createDataFrame(rows, "position int, id int, source_json string")


def yaml_profiles(spark: SparkSession, path: str) -> DataFrame:
    """YAML profiles as JSON rows (place, profile_json) for load_profiles()."""
    rows = [(i, x) for i, x in enumerate(yaml_rows(spark, path, "profiles"))]
    return spark.createDataFrame(rows, "place int, profile_json string")
