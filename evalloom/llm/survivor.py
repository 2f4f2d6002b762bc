"""The surviving value of each field of a duplicate group.

The rule wanted is an order of preference: the first record, by trust, date and id, that has a field gives its value. No
two records share a place in it, so that no vote is left to be taken and the consensus of consensus.py has no part here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.consensus import preferred_values

# What stands for an unknown license, in lower case and without outer spaces.
NO_LICENSE = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "tbd", "tba", "todo", "unknown", "unspecified", "undefined", "missing", "not specified", "not available", "..."]
TRUST_ORDER = ["trusted", "untrusted", "blocked"]
EARLIEST = "2000-01-01"


def _plain(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "^[\\s\\x{A0}\\x{200B}]+|[\\s\\x{A0}\\x{200B}]+$", ""))


def surviving_fields(members: DataFrame, set_col: str, id_col: str) -> DataFrame:
    """For each set and each of trust, observed_at, expires_at and license, the record whose value survives.

    `members` holds `set_col`, `id_col`, the four fields and `evaluation_date` (of the record's own suite, may be null;
    then no observed_at is too late). Result: set_col, `field_name`, `from_record_id`, `value` (as a string). A
    field that no record has gives no row; a trust outside the three known words counts as absent, as do null and
    blank. Dates before 2000 are absent. Repeated rows change nothing, and an empty table gives none.
    """
    trust = _plain(F.col("trust"))
    observed = F.col("observed_at").cast("date")
    expires = F.col("expires_at").cast("date")
    seen = F.when((observed >= F.lit(EARLIEST).cast("date")) & ~F.coalesce(observed > F.col("evaluation_date"), F.lit(False)), observed)
    known_license = ~_plain(F.col("license")).isin(*NO_LICENSE)
    rank = F.coalesce(*(F.when(trust == word, F.lit(i)) for i, word in enumerate(TRUST_ORDER)), F.lit(len(TRUST_ORDER)))
    present = {
        "trust": F.when(trust.isin(*TRUST_ORDER), F.col("trust")),
        "observed_at": seen.cast("string"),
        "expires_at": F.when(expires >= F.lit(EARLIEST).cast("date"), expires).cast("string"),
        "license": F.when(known_license, F.col("license")),
    }
    # Absent dates come last: every real one is after 1970 and so gives a negative number.
    found = F.array(*(F.struct(F.lit(k).alias("field_name"), v.alias("value")) for k, v in present.items()))
    rows = members.select(F.col(set_col).alias("set"), rank.alias("rank"), F.coalesce(-F.datediff(seen, F.lit("1970-01-01").cast("date")), F.lit(1)).alias("age"), F.col(id_col).alias("id"), F.explode(found).alias("f"))
    listed = rows.select("set", "rank", "age", "id", "f.*").where("value is not null")
    return preferred_values(listed, "set").select(F.col("set").alias(set_col), "field_name", "from_record_id", "value")
