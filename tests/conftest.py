import pytest

from evalloom.runtime import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # The tables are tiny: compiling code for every plan would take most of the time.
    session = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "3g", "spark.default.parallelism": "2", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.ui.showConsoleProgress": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
