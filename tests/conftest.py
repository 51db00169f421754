import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lodgeflow.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def listing_row():
    """Factory for hand-written listing rows with every field defaulted."""
    from lodgeflow.schema import LISTING

    def make(**kw):
        base = {f.name: ("" if f.dataType.typeName() == "string" else None) for f in LISTING.fields}
        base["housing_type"] = "market"
        base.update(kw)
        return tuple(base[f.name] for f in LISTING.fields)
    return make


@pytest.fixture(scope="session")
def listings(spark, listing_row):
    from lodgeflow.schema import LISTING

    def make(*rows):
        return spark.createDataFrame([listing_row(**r) for r in rows], LISTING)
    return make
