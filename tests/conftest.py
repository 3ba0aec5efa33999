import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dupeframe.session import HOT_ROWS_KEY, build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests",
        spark__sql__shuffle__partitions="4",
        # inputs are tiny: compiling each plan would take most of the time
        spark__sql__codegen__wholeStage="false",
        spark__sql__codegen__factoryMode="NO_CODEGEN",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[1_000_000, 1], ids=["no-hot-keys", "all-keys-hot"])
def hot(spark, request):
    """Run a test with the usual limit and with every key treated as hot."""
    spark.conf.set(HOT_ROWS_KEY, str(request.param))
    yield request.param
    spark.conf.unset(HOT_ROWS_KEY)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in picked.collect()), key=repr)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def make_tree(root, files: dict[str, bytes]):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return root
