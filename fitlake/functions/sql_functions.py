"""The reference's pure scalar functions as Spark SQL functions.

`CREATE TEMPORARY FUNCTION … RETURN <expr>` defines SQL-bodied functions:
Catalyst inlines the body into the calling plan, so they run inside
whole-stage codegen like any built-in expression (no Python).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# ---- fixed values that must equal the reference's ---------------------------
_FUNCTIONS = {
    "age_group": """(age INT) RETURNS STRING RETURN
        CASE WHEN age < 18 THEN 'Teen'
             WHEN age BETWEEN 18 AND 25 THEN 'Young Adult'
             WHEN age BETWEEN 26 AND 40 THEN 'Adult'
             WHEN age BETWEEN 41 AND 60 THEN 'Middle Age'
             ELSE 'Senior' END""",
    "duration_hhmm": """(minutes INT) RETURNS STRING RETURN
        concat(lpad(CAST(CAST(floor(minutes / 60) AS BIGINT) AS STRING), 2, '0'), ':',
               lpad(CAST(minutes % 60 AS STRING), 2, '0'))""",
    "expiry_days": """(join_date DATE, months INT, as_of DATE) RETURNS INT RETURN
        datediff(add_months(join_date, months), as_of)""",
}


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions for this session; returns their names."""
    names = []
    for name, body in _FUNCTIONS.items():
        full = f"{prefix}{name}"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {full}{body}")
        names.append(full)
    return names
