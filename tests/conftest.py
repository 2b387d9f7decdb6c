import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluates a column function on literal arguments."""
    from pyspark.sql import functions as F

    def run(function, *args, **kwargs):
        columns = [F.lit(a) if not isinstance(a, list) else F.array(*map(F.lit, a)) for a in args]
        names = [f"c{i}" for i in range(len(args))]
        # through a table, so that the expression is not folded away
        row = spark.range(1).select(*[c.alias(n) for c, n in zip(columns, names)]).select(function(*[F.col(n) for n in names], **kwargs).alias("out")).first()
        return row["out"]

    return run
