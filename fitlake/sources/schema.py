"""Table schemas, domain constants and the foreign-key action graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Keys are 64 bits wide: a log of 100 TB has more than 2**31 rows.
L = T.LongType()
I, S, D, B = T.IntegerType(), T.StringType(), T.DateType(), T.BooleanType()


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


GYM = _st(("Gym_ID", L), ("Location", S), ("Capacity", I))
MEMBERSHIP_TYPE = _st(("Type_ID", L), ("Name", S), ("Duration", I), ("Price", dec(8, 2)),
                      ("Gym_ID", L))
MEMBER = _st(("M_ID", L), ("Name", S), ("Email", S), ("Age", I), ("JoinDate", D), ("Phone", S),
             ("MembershipEndDate", D), ("IsActive", B), ("MembershipType_ID", L), ("Gym_ID", L))
TRAINER = _st(("T_ID", L), ("Name", S), ("Email", S), ("Specialization", S), ("Gym_ID", L))
ADMIN = _st(("A_ID", L), ("Name", S), ("Email", S))
SESSION = _st(("S_ID", L), ("Details", S), ("SessionDate", D), ("SessionTime", S),
              ("Duration", I), ("T_ID", L), ("MaxParticipants", I), ("Status", S))
WORKOUT_LOG = _st(("L_ID", L), ("M_ID", L), ("S_ID", L), ("Exercise", S), ("Date", D),
                  ("Duration", I), ("CaloriesBurnt", dec(6, 2)), ("Distance", dec(6, 2)),
                  ("Progress", S))
HEALTH_METRICS = _st(("Metric_ID", L), ("M_ID", L), ("Date", D), ("Weight", dec(5, 2)),
                     ("Height", dec(5, 2)), ("SleepHours", I), ("WaterLiters", dec(4, 2)),
                     ("Steps", I))
NOTIFICATIONS = _st(("Notif_ID", L), ("M_ID", L), ("Message", S), ("Type", S), ("IsRead", B),
                    ("CreatedAt", T.TimestampNTZType()))

SCHEMAS = {
    "gym": GYM, "membership_type": MEMBERSHIP_TYPE, "member": MEMBER, "trainer": TRAINER,
    "admin": ADMIN, "session": SESSION, "workout_log": WORKOUT_LOG,
    "health_metrics": HEALTH_METRICS, "notifications": NOTIFICATIONS,
}
TABLE_NAMES = tuple(SCHEMAS)

# Request tables for the write-style operators.
BOOKING_REQUEST = _st(("request_id", L), ("M_ID", L), ("S_ID", L))
CANCEL_REQUEST = _st(("request_id", L), ("L_ID", L), ("M_ID", L))
WORKOUT_REQUEST = _st(("request_id", L), ("M_ID", L), ("Exercise", S), ("Date", D),
                      ("Duration", I), ("CaloriesBurnt", dec(6, 2)), ("Distance", dec(6, 2)),
                      ("Progress", S))
METRIC_UPDATE = _st(("request_id", L), ("M_ID", L), ("Date", D),
                    ("Weight", dec(5, 2)), ("Height", dec(5, 2)), ("SleepHours", I),
                    ("WaterLiters", dec(4, 2)), ("Steps", I))
MEMBER_REGISTRATION = _st(("request_id", L), ("Name", S), ("Email", S), ("Age", I),
                          ("Phone", S), ("MembershipType_ID", L), ("Gym_ID", L))
TRAINER_REGISTRATION = _st(("request_id", L), ("Name", S), ("Email", S),
                           ("Specialization", S), ("Gym_ID", L))

# ---- fixed values that must equal the reference's -------------------------
# Marker stored in WorkoutLog.Exercise for a session booking row.
BOOKING = "Session Booking"
# Enum domains.
SESSION_STATUSES = ("scheduled", "completed", "cancelled")
NOTIFICATION_TYPES = ("renewal", "session_reminder", "progress", "system")

# Foreign-key actions (child table, child column, parent table, parent key, action).
FK_GRAPH = (
    ("membership_type", "Gym_ID", "gym", "Gym_ID", "cascade"),
    ("member", "MembershipType_ID", "membership_type", "Type_ID", "set_null"),
    ("member", "Gym_ID", "gym", "Gym_ID", "set_null"),
    ("trainer", "Gym_ID", "gym", "Gym_ID", "cascade"),
    ("session", "T_ID", "trainer", "T_ID", "cascade"),
    ("workout_log", "M_ID", "member", "M_ID", "cascade"),
    ("workout_log", "S_ID", "session", "S_ID", "set_null"),
    ("health_metrics", "M_ID", "member", "M_ID", "cascade"),
    ("notifications", "M_ID", "member", "M_ID", "cascade"),
)
PRIMARY_KEYS = {
    "gym": "Gym_ID", "membership_type": "Type_ID", "member": "M_ID", "trainer": "T_ID",
    "admin": "A_ID", "session": "S_ID", "workout_log": "L_ID", "health_metrics": "Metric_ID",
    "notifications": "Notif_ID",
}
UNIQUE_KEYS = {"member": ("Email",), "trainer": ("Email",), "admin": ("Email",)}
