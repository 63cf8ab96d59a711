import json
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlens.fixtures import Views  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4, driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return Views(spark, SF_DIR)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def values(df, *columns):
    """Rows of ``columns`` as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one_column(spark, items, kind="string"):
    """A numbered column ``x`` of ``items``."""
    return spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")


def evaluate(spark, items, expression, kind="string"):
    """Value of ``expression(col x)`` for every item, in order."""
    from pyspark.sql import functions as F

    rows = one_column(spark, items, kind).select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def stream_of(spark, df, folder, order, parts=3):
    """Write ``df`` as ``parts`` files in ``order`` and open them as a stream, one file per micro-batch."""
    rows = df.orderBy(order).toPandas()
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = spark.createDataFrame(rows.iloc[i * size : (i + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(stream, folder, mode, name):
    """Run a stream over all its input and return the sink's rows."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/cp")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(180)
    return spark.table(name)


def dumps(value):
    return json.dumps(value)
