from datetime import date

from evalloom.llm.survivor import surviving_fields

SCHEMA = "first_id long, record_id long, trust string, observed_at date, expires_at date, license string, evaluation_date date, rank int, age int"
DAY = date(2026, 6, 1)


def run(spark, rows):
    df = spark.createDataFrame([(*r, DAY, 9, 9) for r in rows], SCHEMA)
    return {(r.first_id, r.field_name): (r.from_record_id, r.value) for r in surviving_fields(df, "first_id", "record_id").collect()}


def test_order_and_absence(spark):
    got = run(spark, [
        (1, 1, "blocked", date(2026, 5, 1), date(2027, 1, 1), "MIT"),
        (1, 2, " TRUSTED ", date(2026, 1, 1), None, "n/a"),
        (1, 3, "trusted", date(2026, 9, 9), date(1999, 1, 1), " "),
        (1, 4, None, date(2026, 5, 31), date(2028, 1, 1), "CC0"),
        (1, 5, "untrusted", None, None, None),
    ])
    assert got == {(1, "trust"): (2, " TRUSTED "), (1, "observed_at"): (2, "2026-01-01"), (1, "expires_at"): (1, "2027-01-01"), (1, "license"): (1, "MIT")}


def test_ties_repeats_and_nothing(spark):
    row = (2, 7, "trusted", date(2026, 1, 1), None, "?")
    got = run(spark, [row, row, (2, 6, "trusted", date(2026, 1, 1), None, "TBD"), (3, 8, "odd", date(1970, 1, 1), None, None)])
    assert got == {(2, "trust"): (6, "trusted"), (2, "observed_at"): (6, "2026-01-01")}
    assert run(spark, []) == {}


def test_the_order_alone_decides(spark):
    # Values that a vote would choose, being many or alike, count for nothing; nothing is aligned in Python, nor written for it.
    rows = [(1, i, "untrusted", date(2026, 5, i), None, "Creative Commons 4.0") for i in range(2, 9)] + [(1, 9, "trusted", None, None, "MIT"), (2, 4, "trusted", None, None, "b"), (2, 4, "trusted", None, None, "a")]
    df = spark.createDataFrame([(*r, DAY, 9, 9) for r in rows], SCHEMA)
    found = surviving_fields(df, "first_id", "record_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("InPandas", "Python", "FileScan"))
    assert run(spark, rows) == {(1, "trust"): (9, "trusted"), (1, "observed_at"): (8, "2026-05-08"), (1, "license"): (9, "MIT"), (2, "trust"): (4, "trusted"), (2, "license"): (4, "a")}
