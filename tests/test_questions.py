import pytest
from pyspark.sql import functions as F

from tidelog.operators import questions as q


@pytest.mark.parametrize(
    "text, level, service, host, span, keyword",
    [
        ("Show me all Errors from service Payment in the last 30 minutes", "error", "payment", None, "30m", "Errors"),
        ("warnings in service  api  past day", "warn", "api", None, "24h", "warnings"),
        ("service:web host:h1 info", "info", "web", "h1", "1h", "service:web"),
        ("in service a but from service b", None, "b", None, "1h", None),
        ("why timeouts on host: db-1 this past week?", None, None, "db-1", "7d", "timeouts"),
        ("nothing follows service:", None, None, None, "1h", "nothing"),
        ("5 minutes or 1 hour", None, None, None, "1h", "minutes"),
        ("INFORMATION", "info", None, None, "1h", "INFORMATION"),
        ("", None, None, None, "1h", None),
    ],
)
def test_tags(spark, text, level, service, host, span, keyword):
    got = q.tag_questions(spark.createDataFrame([(text,)], "text string")).first()
    assert tuple(got)[1:] == (level, service, host, span, keyword)


def test_null_text(spark):
    got = q.tag_questions(spark.createDataFrame([(None,)], "text string")).first()
    assert tuple(got)[1:] == (None, None, None, "1h", None)
