import datetime
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from helpers import day  # noqa: E402

from factmark.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: compiling whole stages would cost more than running them.
    session = local_session("8", **{"spark.sql.codegen.wholeStage": "false",
                                    "spark.sql.shuffle.partitions": "4"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel_of(spark):
    """Panel with one row per day from plain lists of prices."""
    def build(start="2000-01-01", **series):
        first = day(start)
        rows = [(name, first + datetime.timedelta(days=i), float(v))
                for name, values in series.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "entity_id string, effective_date date, value double")
    return build


@pytest.fixture(scope="session")
def facts_of(spark):
    """Facts from (entity, field, value, effective, knowledge) tuples, one version."""
    def build(rows, version=1):
        data = [(e, f, v, day(eff), day(know), version) for e, f, v, eff, know in rows]
        return spark.createDataFrame(
            data, "entity_id string, field string, value double, effective_date date, "
                  "knowledge_date date, version_number int")
    return build
