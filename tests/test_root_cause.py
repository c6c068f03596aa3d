import pytest

from tidelog.operators import root_cause as rc


def row(level, message, service="pay", minute=0):
    return {"ts_raw": f"2026-05-24T10:{minute:02d}:00Z", "level": level, "message": message, "service": service, "source": "a"}


def causes(df):
    return [(r.cause, r.confidence, r.evidence) for r in df.orderBy("confidence").collect()]


def ranked(logs, service="pay", **kw):
    return [(r.rank, r.cause, r.confidence) for r in rc.rank_causes(logs, service, **kw).orderBy("rank").collect()]


def test_upstream(made):
    logs = made(row("ERROR", "x", "db"), row("ERROR", "y", "db"), row("ERROR", "z", None), row("INFO", "i", "other"))
    got = causes(rc.upstream_errors(logs, "pay"))
    assert got == [
        ("Errors in upstream service 'unknown'", 0.55, "1 error(s) from unknown during incident window"),
        ("Errors in upstream service 'db'", 0.6, "2 error(s) from db during incident window"),
    ]
    assert causes(rc.upstream_errors(logs, "pay", strict=True)) == []


def test_confidence_is_capped(made):
    logs = made(*[row("ERROR", "same", "db")] * 20, *[row("ERROR", "db timeout")] * 20)
    assert causes(rc.upstream_errors(logs, "pay"))[0][1] == 0.95
    assert causes(rc.recurring_messages(logs, "pay"))[0][1] == 0.9
    assert [c[1] for c in causes(rc.infrastructure_keywords(logs, "pay"))] == [0.85, 0.85]


def test_recurring_messages(made):
    long = "L" * 100
    logs = made(*[row("ERROR", long)] * 3, *[row("ERROR", "b")] * 2, row("ERROR", "c"), row("ERROR", "d"), row("INFO", "e"))
    got = causes(rc.recurring_messages(logs, "pay"))
    assert [(c, n) for c, _, n in got] == [
        ("Recurring error: c", "1 occurrence(s)"), ("Recurring error: b", "2 occurrence(s)"),
        ("Recurring error: " + "L" * 80, "3 occurrence(s)"),
    ]


def test_keywords(made):
    logs = made(row("ERROR", "DB Connection REFUSED"), row("ERROR", "database unavailable"), row("INFO", "timeout"))
    got = {c: n for c, _, n in causes(rc.infrastructure_keywords(logs, "pay"))}
    assert set(got) == {f"Infrastructure issue: '{w}' detected" for w in ("db", "connection", "refused", "database", "unavailable")}


@pytest.mark.parametrize("warnings, errors, hit", [(3, 2, True), (2, 2, False), (1, 0, True), (0, 0, False)])
def test_warning_spike(made, warnings, errors, hit):
    rows = [row("WARN" if i % 2 else "WARNING", "w", "other") for i in range(warnings)] + [row("ERROR", "e")] * errors
    got = causes(rc.warning_spike(made(*(rows or [row("INFO", "i")])), "pay"))
    assert got == ([("Warning spike preceding errors", 0.6, f"{warnings} warnings vs {errors} errors")] if hit else [])


def test_ranking(made):
    logs = made(
        *[row("ERROR", "same", "db")] * 2, *[row("ERROR", "down", "api")] * 2, *[row("ERROR", "db gone")] * 4,
        *[row("WARN", "w")] * 5, row("ERROR", "P" * 80 + "1"), row("ERROR", "P" * 80 + "2"),
    )
    assert ranked(logs) == [
        (1, "Infrastructure issue: 'db' detected", 0.65),
        (2, "Errors in upstream service 'api'", 0.6),
        (3, "Errors in upstream service 'db'", 0.6),
        (4, "Recurring error: db gone", 0.6),
        (5, "Recurring error: " + "P" * 80, 0.45),
    ]


def test_report_and_timeline(made):
    logs = made(row("ERROR", "late", minute=9), row("INFO", "early", "web", 1))
    got = rc.root_cause(logs, "pay", symptom="slow")
    assert got.report.first().asDict() == {"service": "pay", "symptom": "slow", "error_count": 1}
    assert [r.message for r in got.timeline.collect()] == ["early", "late"]
    assert ranked(made(row("INFO", "fine"))) == []
