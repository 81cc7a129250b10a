"""The given small tables, for tests of this folder."""

import os

SF_DIR = "/root/testdata/sf0.001"
PRESENT = os.path.isdir(SF_DIR)


def read(spark, name):
    import pytest

    if not PRESENT:
        pytest.skip("the given tables are absent")
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def documents(spark):
    return read(spark, "documents")


def labels(spark):
    return read(spark, "labels")
