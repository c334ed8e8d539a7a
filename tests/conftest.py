from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import get_session

    session = get_session(
        app_name="vitrine-tests",
        master="local[*]",
        shuffle_partitions=8,
        extra_conf={"spark.sql.ansi.enabled": "true"},
    )
    yield session
    session.stop()


@pytest.fixture(params=["true", "false"], ids=["ansi_on", "ansi_off"])
def ansi(spark, request):
    """Run a test with ANSI mode on and off; results must not differ."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.fixture(scope="session")
def catalog(spark):
    from __spark_entry__ import PERIOD
    from vitrine.plans.pipeline import catalog_for

    return catalog_for(spark, SF_SMALL, **PERIOD)
