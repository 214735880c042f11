import pytest
from pyspark.sql import SparkSession

from boxquery.session import ship


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("boxquery-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def points(spark, sf_dir):
    from boxquery.session import written
    from checks.fixtures import points3

    return written(points3(spark, sf_dir), "test-points")


@pytest.fixture(scope="session")
def index(spark, points):
    from boxquery import build_index
    from checks.fixtures import DIMS

    return build_index(points, DIMS)


@pytest.fixture()
def few_rows(monkeypatch):
    """Make every size check fail, so that the plans for large sides run on small data."""
    import boxquery.operators.grid as grid
    import boxquery.operators.runs as runs
    import boxquery.plans.candidates as candidates
    import boxquery.plans.range_count as counting
    import boxquery.plans.range_search as searching
    import boxquery.session as session

    for module in (grid, runs, candidates, counting, searching, session):
        for name in ("BROADCAST_ROWS", "NESTED_LOOP_BOXES"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, 4)
    monkeypatch.setattr(candidates, "FEW_SEGMENTS", 1)
    monkeypatch.setattr(candidates, "FLAT_BLOCKS", 4)
    monkeypatch.setattr(candidates, "UNFOLD", 3)
    monkeypatch.setattr(runs, "RUN_CHUNK", 8)
    monkeypatch.setattr(session, "HOT_MIN_ROWS", 5)
    monkeypatch.setattr(session.skew_join, "__defaults__", (5,))
