import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weftline.session import builder, prepare

    made = builder("tests", "local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield prepare(made)
    made.stop()
