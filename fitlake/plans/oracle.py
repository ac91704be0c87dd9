"""Portable SQL (DuckDB dialect) that rebuilds the nine derived tables and the
request tables from the raw test tables, with the same formulas as
`fitlake.sources.tables`.  Every oracle query is `PREFIX + <operator SQL>`.

The SQL side is an independent statement of each operator's semantics; the
Spark side never runs it.
"""

from __future__ import annotations

AS_OF = "DATE '2024-01-30'"

_TABLES = r"""
gym AS (
  SELECT CAST(r_regionkey AS BIGINT) AS Gym_ID, r_name AS Location,
         CAST(100 + 50 * r_regionkey AS INT) AS Capacity
  FROM region),
membership_type AS (
  SELECT CAST(n_nationkey AS BIGINT) AS Type_ID,
         CASE n_nationkey % 3 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' ELSE 'Platinum' END AS Name,
         CAST(CASE n_nationkey % 3 WHEN 1 THEN 6 ELSE 12 END AS INT) AS Duration,
         CAST(5000 + 500 * n_nationkey AS DECIMAL(8,2)) AS Price,
         CAST(n_regionkey AS BIGINT) AS Gym_ID
  FROM nation),
member AS (
  SELECT CAST(c_custkey AS BIGINT) AS M_ID, c_name AS Name,
         concat(CASE WHEN c_custkey % 10 = 7 THEN 'M' ELSE 'm' END, CAST(c_custkey AS VARCHAR), '@example.org') AS Email,
         CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(8 + c_custkey % 95 AS INT) END AS Age,
         CAST(DATE '2022-12-01' + CAST(c_custkey % 425 AS INT) AS DATE) AS JoinDate,
         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS Phone,
         CASE WHEN c_custkey % 4 = 0 THEN NULL
              ELSE CAST(CAST(DATE '2022-12-01' + CAST(c_custkey % 425 AS INT) AS DATE)
                        + to_months(CASE c_nationkey % 3 WHEN 1 THEN 6 ELSE 12 END) AS DATE)
         END AS MembershipEndDate,
         c_acctbal > 0 AS IsActive,
         CAST(c_nationkey AS BIGINT) AS MembershipType_ID,
         CAST(n_regionkey AS BIGINT) AS Gym_ID
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
trainer AS (
  SELECT CAST(s_suppkey AS BIGINT) AS T_ID, s_name AS Name,
         concat(CASE WHEN s_suppkey % 34 = 0 THEN 'T' ELSE 't' END, CAST(CASE WHEN s_suppkey % 17 = 0 THEN s_suppkey % 34 ELSE s_suppkey END AS VARCHAR), '@example.org') AS Email,
         CASE s_suppkey % 4 WHEN 0 THEN 'Strength' WHEN 1 THEN 'Yoga' WHEN 2 THEN 'Cardio' END
           AS Specialization,
         CAST(n_regionkey AS BIGINT) AS Gym_ID
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
session AS (
  SELECT CAST(p_partkey AS BIGINT) AS S_ID, p_name AS Details,
         CAST(DATE '2024-01-21' + CAST(p_partkey % 21 AS INT) AS DATE) AS SessionDate,
         concat(lpad(CAST(6 + p_size % 15 AS VARCHAR), 2, '0'), ':30:00') AS SessionTime,
         CAST(30 + 15 * (p_size % 5) AS INT) AS Duration,
         CAST((p_partkey * p_size) % (SELECT count(*) FROM supplier) AS BIGINT) AS T_ID,
         CAST(1 + p_size % 4 AS INT) AS MaxParticipants,
         CASE WHEN p_partkey % 5 = 0 THEN 'cancelled'
              WHEN p_partkey % 21 < 9 AND p_partkey % 3 = 0 THEN 'completed'
              ELSE 'scheduled' END AS Status
  FROM part),
workout_log AS (
  SELECT CAST(event_id AS BIGINT) AS L_ID, CAST(user_id AS BIGINT) AS M_ID,
         CASE WHEN event_type = 'signup' AND user_id % 10 <> 0
              THEN CAST((event_id * 7) % (SELECT count(*) FROM part) AS BIGINT) END AS S_ID,
         CASE WHEN event_type = 'signup' AND user_id % 10 <> 0 THEN 'Session Booking' ELSE event_type END AS Exercise,
         CASE WHEN event_type = 'signup' AND user_id % 10 <> 0
              THEN CAST(DATE '2024-01-21' + CAST(((event_id * 7) % (SELECT count(*) FROM part)) % 21 AS INT) AS DATE)
              WHEN (user_id % 5 = 0 AND CAST(ts AS DATE) >= DATE '2024-01-14')
                   OR (user_id % 5 = 1 AND CAST(ts AS DATE) >= DATE '2024-01-21') THEN CAST(CAST(ts AS DATE) - 40 AS DATE)
              ELSE CAST(ts AS DATE) END AS Date,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(3 + (event_id * 11) % 320 AS INT) END AS Duration,
         CASE WHEN (event_type = 'signup' AND user_id % 10 <> 0) OR event_id % 17 = 0 THEN NULL
              ELSE CAST(((event_id * 37) % 210000) / 100.0 AS DECIMAL(6,2)) END AS CaloriesBurnt,
         CASE WHEN event_id % 3 = 0 THEN NULL
              ELSE CAST(((event_id * 13) % 5200) / 100.0 AS DECIMAL(6,2)) END AS Distance,
         CASE WHEN event_type = 'signup' AND user_id % 10 <> 0 THEN 'Booked' END AS Progress
  FROM events),
admin AS (SELECT CAST(1 AS BIGINT) AS A_ID, 'Site Admin' AS Name, 'admin@example.org' AS Email),
health_metrics AS (
  SELECT CAST(o_orderkey AS BIGINT) AS Metric_ID, CAST(o_custkey AS BIGINT) AS M_ID,
         CAST(DATE '2023-11-20' + CAST((o_orderkey * 11) % 72 AS INT) AS DATE) AS Date,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL
              ELSE CAST((150 + (o_orderkey * 7) % 2900) / 10.0 AS DECIMAL(5,2)) END AS Weight,
         CAST(95 + o_custkey % 160 AS DECIMAL(5,2)) AS Height,
         CAST(o_orderkey % 11 AS INT) AS SleepHours,
         CAST((o_orderkey % 105) / 10.0 AS DECIMAL(4,2)) AS WaterLiters,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 12000 AS INT) END AS Steps
  FROM orders),
notifications AS (
  SELECT CAST(c_custkey AS BIGINT) AS Notif_ID, CAST(c_custkey AS BIGINT) AS M_ID,
         'Renewal notice' AS Message, 'renewal' AS Type, c_custkey % 5 = 0 AS IsRead,
         CAST(CAST(DATE '2024-01-30' - CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 8
                                                 ELSE c_custkey % 130 END AS INT) AS DATE) AS TIMESTAMP) AS CreatedAt
  FROM customer
  UNION ALL
  SELECT CAST(10000000 + event_id AS BIGINT), CAST(user_id AS BIGINT),
         CASE event_id % 5 WHEN 0 THEN 'Reminder for cold widget' WHEN 1 THEN 'Reminder for small widget'
              WHEN 2 THEN 'We miss you' WHEN 3 THEN 'We have missed you' ELSE 'Milestone' END,
         CASE WHEN event_id % 5 <= 1 THEN 'session_reminder' WHEN event_id % 5 <= 3 THEN 'system'
              ELSE 'progress' END,
         event_id % 8 <= 1, CAST(ts AS TIMESTAMP)
  FROM events),
booking_requests AS (
  SELECT event_id AS request_id, CAST(user_id AS BIGINT) AS M_ID,
         CAST(event_id % (SELECT count(*) FROM part) AS BIGINT) AS S_ID
  FROM events WHERE event_type = 'view'),
cancel_requests AS (
  SELECT event_id AS request_id, CAST(event_id AS BIGINT) AS L_ID,
         CAST(CASE WHEN event_id % 7 < 4 THEN user_id ELSE user_id + 1 END AS BIGINT) AS M_ID
  FROM events),
seat_requests AS (
  SELECT 8 * event_id AS request_id, 'book' AS kind, CAST(user_id AS BIGINT) AS M_ID,
         CAST((event_id * 7) % greatest((SELECT count(*) FROM part) // 8, 1) AS BIGINT) AS S_ID,
         CAST(NULL AS BIGINT) AS L_ID, CAST(NULL AS BIGINT) AS booking
  FROM events WHERE event_type = 'view'
  UNION ALL
  SELECT 8 * (event_id + 300) + 1, 'book', user_id, (event_id * 7) % greatest((SELECT count(*) FROM part) // 8, 1), NULL, NULL
  FROM events WHERE event_type = 'view' AND event_id % 2 = 0
  UNION ALL
  SELECT 8 * (event_id + 700) + 2, 'cancel', CASE WHEN event_id % 9 = 0 THEN user_id + 1 ELSE user_id END, NULL, NULL, 8 * event_id
  FROM events WHERE event_type = 'view' AND event_id % 3 = 0
  UNION ALL
  SELECT 8 * (event_id + 1000) + 3, 'book', user_id, (event_id * 7) % greatest((SELECT count(*) FROM part) // 8, 1), NULL, NULL
  FROM events WHERE event_type = 'view' AND event_id % 6 = 0
  UNION ALL
  SELECT 8 * (event_id + 100) + 4, 'cancel', user_id, NULL, event_id, NULL
  FROM events WHERE event_type = 'signup' AND event_id % 2 = 0),
workout_requests AS (
  SELECT event_id AS request_id, CAST(user_id AS BIGINT) AS M_ID,
         CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Cycling' ELSE 'Rowing' END AS Exercise,
         CAST(DATE '2024-01-30' - CAST(event_id % 3 AS INT) AS DATE) AS Date,
         CAST(20 + event_id % 60 AS INT) AS Duration,
         CAST((event_id % 90000) / 100.0 AS DECIMAL(6,2)) AS CaloriesBurnt,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST((event_id % 2000) / 100.0 AS DECIMAL(6,2)) END AS Distance,
         'Logged' AS Progress
  FROM events WHERE event_type = 'purchase'),
metric_updates AS (
  SELECT o_orderkey AS request_id, CAST(o_custkey AS BIGINT) AS M_ID,
         CASE WHEN o_orderkey % 2 = 0
              THEN CAST(DATE '2023-11-20' + CAST((o_orderkey * 11) % 72 AS INT) AS DATE)
              ELSE CAST(DATE '2024-02-01' + CAST(o_orderkey % 5 AS INT) AS DATE) END AS Date,
         CAST((500 + o_orderkey % 1000) / 10.0 AS DECIMAL(5,2)) AS Weight,
         CAST(150 + o_custkey % 50 AS DECIMAL(5,2)) AS Height,
         CAST(4 + o_orderkey % 6 AS INT) AS SleepHours,
         CAST((o_orderkey % 40) / 10.0 AS DECIMAL(4,2)) AS WaterLiters,
         CAST((o_orderkey * 13) % 15000 AS INT) AS Steps
  FROM orders),
member_registrations AS (
  SELECT c_custkey AS request_id, c_name AS Name,
         CASE WHEN c_custkey % 11 = 0 THEN NULL
              WHEN c_custkey % 3 = 0 THEN concat('m', CAST(c_custkey AS VARCHAR), '@Example.org')
              ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN 'New' ELSE 'new' END, CAST(c_custkey % 97 AS VARCHAR), '@example.org') END AS Email,
         CAST(18 + c_custkey % 50 AS INT) AS Age,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS Phone,
         CAST(c_nationkey AS BIGINT) AS MembershipType_ID,
         CAST(c_nationkey % 5 AS BIGINT) AS Gym_ID
  FROM customer),
trainer_registrations AS (
  SELECT s_suppkey AS request_id, s_name AS Name,
         CASE WHEN s_suppkey % 2 = 0 THEN concat('T', CAST(s_suppkey AS VARCHAR), '@example.org')
              ELSE concat('coach', CAST(s_suppkey AS VARCHAR), '@example.org') END AS Email,
         CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'Pilates' END AS Specialization,
         CAST(s_nationkey % 5 AS BIGINT) AS Gym_ID
  FROM supplier),
member_delete_requests AS (
  SELECT c_custkey AS request_id,
         CAST(CASE WHEN c_acctbal < 0 THEN c_custkey ELSE c_custkey + 100000 END AS BIGINT) AS M_ID
  FROM customer),
trainer_delete_requests AS (
  SELECT s_suppkey AS request_id,
         CAST(CASE WHEN s_acctbal < 0 THEN s_suppkey ELSE s_suppkey + 100000 END AS BIGINT) AS T_ID
  FROM supplier),
bench_log AS (
  SELECT CAST(o_custkey AS BIGINT) AS M_ID, CAST(NULL AS BIGINT) AS S_ID, l_returnflag AS Exercise,
         CAST(l_shipdate AS DATE) AS Date, CAST(floor(l_quantity) AS INT) AS Duration,
         CAST(l_extendedprice % 2000 AS DECIMAL(6,2)) AS CaloriesBurnt,
         CAST(NULL AS DECIMAL(6,2)) AS Distance, CAST(NULL AS VARCHAR) AS Progress
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
questions AS (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
"""

PREFIX = "WITH " + _TABLES.strip() + "\n"


def q(body: str) -> str:
    """Oracle statement: derived-table CTEs, then `body` (which may add CTEs
    by starting with a comma)."""
    body = body.strip()
    if body.startswith(","):
        return PREFIX + body + "\n"
    return PREFIX + body + "\n"


# ---- exact-arithmetic SQL snippets (non-negative inputs) --------------------

def avg_exact(x: str, in_scale: int = 0, where: str | None = None) -> str:
    """MySQL AVG over `x` with DECIMAL(., in_scale) input: exact mean, half-up
    to in_scale + 4 decimals, as DECIMAL(18, in_scale + 4)."""
    v = x if where is None else f"CASE WHEN {where} THEN {x} END"
    units = f"CAST({v} * {10 ** in_scale} AS HUGEINT)" if in_scale else f"CAST({v} AS HUGEINT)"
    out_scale = in_scale + 4
    cnt = f"COUNT({v})"
    num = f"(SUM({units}) * 20000 + {cnt})"
    return (f"CASE WHEN {cnt} = 0 THEN NULL ELSE "
            f"CAST({num} // (2 * {cnt}) AS DECIMAL(18,0)) * {_unit(out_scale)} END")


def round_half_up(x: str, from_scale: int, to_scale: int) -> str:
    """Half-up rounding of a non-negative DECIMAL(., from_scale) to `to_scale`."""
    k = 10 ** (from_scale - to_scale)
    return (f"CAST((CAST({x} * {10 ** from_scale} AS HUGEINT) + {k // 2}) // {k} AS DECIMAL(18,0)) "
            f"* {_unit(to_scale)}")


def _unit(scale: int) -> str:
    """Exact DECIMAL literal 10^-scale (DuckDB turns decimal division into DOUBLE)."""
    if scale == 0:
        return "CAST(1 AS DECIMAL(1,0))"
    return f"CAST(0.{'0' * (scale - 1)}1 AS DECIMAL({scale + 1},{scale}))"


def ratio_half_up(num: str, den: str, scale: int) -> str:
    """num / den (non-negative integers) half-up to `scale` decimals, exact."""
    m = 10 ** scale
    return (f"CAST((CAST({num} AS HUGEINT) * {2 * m} + CAST({den} AS HUGEINT)) "
            f"// (2 * CAST({den} AS HUGEINT)) AS DECIMAL(18,0)) * {_unit(scale)}")
