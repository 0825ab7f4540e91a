"""Checks of the environment, as a DataFrame of name, ok and detail."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

from quarrylight.plans.store import Store, StoreError
from quarrylight.sources import config as configs


def health(spark: SparkSession, root: str) -> DataFrame:
    """Python, Java, packages, the repository's folder, its configuration and its index."""
    rows = [("python", sys.version_info >= (3, 10), sys.version.split()[0]), ("spark", True, spark.version)]
    rows.append(("java", shutil.which("java") is not None or "JAVA_HOME" in os.environ, os.environ.get("JAVA_HOME", "")))
    rows += [(name, importlib.util.find_spec(name) is not None, "") for name in ("pandas", "pyarrow")]
    rows.append(("writable", os.access(root, os.W_OK), root))
    try:
        configs.load(root)
        rows.append(("configuration", True, ""))
    except configs.ConfigError as e:
        rows.append(("configuration", False, str(e)[:500]))
    try:
        active = Store(spark, os.path.join(root, configs.FOLDER)).active()
        rows.append(("index", active is not None, active or "not indexed"))
    except StoreError as e:
        rows.append(("index", False, str(e)[:500]))
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")
