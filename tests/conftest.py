import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


@pytest.fixture(autouse=True)
def code(request):
    """Queries run with whole-stage code generation, as users run them. Unit tests of a few rows do without: compiling is most of their time."""
    if "spark" in request.fixturenames:
        whole = "queries" in request.module.__name__ or "llm" in str(request.path)
        request.getfixturevalue("spark").conf.set("spark.sql.codegen.wholeStage", str(whole).lower())


@pytest.fixture
def cells(spark):
    """Cells of one session from field values; None is a null, a missing key an absent field."""

    def make(rows, session="s"):
        from runledger.sources.parsers import cell, epoch

        out = []
        for i, row in enumerate(rows):
            for name in sorted(row):
                out.append((session, i, name, *cell(row[name]), epoch(row[name])))
        return spark.createDataFrame(out, "session_id string, record_index long, field string, kind string, text string, num double, t double")

    return make


@pytest.fixture
def records(spark):
    def make(rows, session="s"):
        from runledger.sources.parsers import canonical

        return spark.createDataFrame([(session, i, canonical(r), sorted(r), len(r)) for i, r in enumerate(rows)], "session_id string, record_index long, payload string, schema_key array<string>, field_count int")

    return make


@pytest.fixture
def either_sketch(monkeypatch):
    """As on several executors: a sketch follows the order in which its parts arrive, and comes out as one of two each time. All cuts are right ones."""
    from pyspark.sql import functions as F

    real = F.percentile_approx
    either = F.udf(lambda a, b: a if os.urandom(1)[0] < 128 else b, "array<double>").asNondeterministic()
    wider = lambda near, accuracy: [min(1.0, max(0.0, s + (2 * (k % 2) - 1) * 10 / accuracy)) for k, s in enumerate(near)]
    monkeypatch.setattr(F, "percentile_approx", lambda x, near, accuracy: either(real(x, near, accuracy), real(x, wider(near, accuracy), accuracy)))
