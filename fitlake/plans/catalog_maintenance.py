"""Registered table maintenance, cascades and write-style request operators
(§2.3, §2.5 writes, §2.6 registration)."""

from __future__ import annotations

from fitlake.operators import maintenance as MT
from fitlake.operators import writes as W
from fitlake.plans.oracle import q
from fitlake.plans.registry import register, tables
from fitlake.sources import tables as S

_MEMBER_COLS = ("M_ID, Name, Email, Age, JoinDate, Phone, {end} AS MembershipEndDate, {active} AS IsActive, "
                "MembershipType_ID, Gym_ID")


def _member_sql(end="MembershipEndDate", active="IsActive"):
    return _MEMBER_COLS.format(end=end, active=active)


@register("backfill_end_dates_type", q(f"""
SELECT {_member_sql(end="CASE WHEN MembershipType_ID = 1 AND MembershipEndDate IS NULL THEN CAST(JoinDate + to_months(12) AS DATE) ELSE MembershipEndDate END")}
FROM member"""))
def _backfill_end_dates_type(spark, d):
    return MT.backfill_end_dates_type(tables(spark, d))


@register("backfill_end_dates", q(f"""
SELECT {_member_sql(end="CASE WHEN m.MembershipEndDate IS NULL AND mt.Duration IS NOT NULL THEN CAST(m.JoinDate + to_months(mt.Duration) AS DATE) ELSE m.MembershipEndDate END")
        .replace("M_ID, Name, Email, Age, JoinDate, Phone", "m.M_ID, m.Name, m.Email, m.Age, m.JoinDate, m.Phone")
        .replace("IsActive AS IsActive, MembershipType_ID, Gym_ID", "m.IsActive AS IsActive, m.MembershipType_ID, m.Gym_ID")}
FROM member m LEFT JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID"""))
def _backfill_end_dates(spark, d):
    return MT.backfill_end_dates(tables(spark, d))


@register("backfill_end_dates_result", q("""
SELECT 'Updated ' || CAST(COUNT(*) AS VARCHAR) || ' member(s) with membership end dates' AS Result
FROM member m JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID
WHERE m.MembershipEndDate IS NULL"""))
def _backfill_end_dates_result(spark, d):
    return MT.backfill_end_dates_result(tables(spark, d))


_SESSION_COLS = "S_ID, Details, SessionDate, SessionTime, Duration, T_ID, MaxParticipants, {status} AS Status"


@register("complete_past_sessions", q(f"""
SELECT {_SESSION_COLS.format(status="CASE WHEN SessionDate < DATE '2024-01-30' AND Status = 'scheduled' AND EXISTS (SELECT 1 FROM workout_log wl WHERE wl.S_ID = s.S_ID) THEN 'completed' ELSE Status END")}
FROM session s"""))
def _complete_past_sessions(spark, d):
    return MT.complete_past_sessions(tables(spark, d))


@register("complete_past_sessions_on_touch", q(f"""
SELECT {_SESSION_COLS.format(status="CASE WHEN SessionDate < DATE '2024-01-30' AND Status = 'scheduled' THEN 'completed' ELSE Status END")}
FROM session"""))
def _complete_past_sessions_on_touch(spark, d):
    return MT.complete_past_sessions_on_touch(tables(spark, d))


@register("mark_read", q("""
SELECT Notif_ID, M_ID, Message, Type, CASE WHEN IsRead = FALSE THEN TRUE ELSE IsRead END AS IsRead, CreatedAt
FROM notifications"""))
def _mark_read(spark, d):
    return MT.mark_read(tables(spark, d))


@register("refresh_activity_flag", q(f"""
SELECT {_member_sql(active="CASE WHEN (SELECT MAX(Date) FROM workout_log wl WHERE wl.M_ID = m.M_ID) < DATE '2024-01-30' - 60 THEN FALSE ELSE TRUE END")}
FROM member m"""))
def _refresh_activity_flag(spark, d):
    return MT.refresh_activity_flag(tables(spark, d))


_OLD_READ = "COALESCE(IsRead = TRUE AND CreatedAt < TIMESTAMP '2023-11-01 00:00:00', FALSE)"


@register("purge_read_notifications", q(f"""
SELECT * FROM notifications WHERE NOT {_OLD_READ}"""))
def _purge_read_notifications(spark, d):
    return MT.purge_read_notifications(tables(spark, d))[0]


@register("purge_read_notifications_archive", q(f"""
SELECT * FROM notifications WHERE {_OLD_READ}"""))
def _purge_read_notifications_archive(spark, d):
    return MT.purge_read_notifications(tables(spark, d))[1]


@register("purge_read_notifications_result", q(f"""
SELECT 'Cleaned up ' || CAST(COUNT(*) AS VARCHAR) || ' old notification(s)' AS Result
FROM notifications WHERE {_OLD_READ}"""))
def _purge_read_notifications_result(spark, d):
    return MT.purge_read_notifications_result(tables(spark, d))


_GONE_SESSIONS = "(SELECT S_ID FROM session WHERE Status = 'cancelled' AND SessionDate < DATE '2024-01-30' - 30)"


@register("purge_cancelled_sessions", q(f"""
SELECT * FROM session WHERE S_ID NOT IN {_GONE_SESSIONS}"""))
def _purge_cancelled_sessions(spark, d):
    return MT.purge_cancelled_sessions(tables(spark, d)).session


@register("purge_cancelled_sessions_log", q(f"""
SELECT L_ID, M_ID, CASE WHEN S_ID IN {_GONE_SESSIONS} THEN NULL ELSE S_ID END AS S_ID, Exercise, Date,
       Duration, CaloriesBurnt, Distance, Progress
FROM workout_log"""))
def _purge_cancelled_sessions_log(spark, d):
    return MT.purge_cancelled_sessions(tables(spark, d)).workout_log


def _rows_sql(member="member", trainer="trainer", session="session", log="workout_log",
              hm="health_metrics", notif="notifications"):
    parts = [("gym", "gym", "Gym_ID", "NULL"), ("membership_type", "membership_type", "Type_ID", "Gym_ID"),
             ("member", member, "M_ID", "Gym_ID"), ("trainer", trainer, "T_ID", "Gym_ID"),
             ("admin", "admin", "A_ID", "NULL"), ("session", session, "S_ID", "T_ID"),
             ("workout_log", log, "L_ID", "S_ID"), ("health_metrics", hm, "Metric_ID", "M_ID"),
             ("notifications", notif, "Notif_ID", "M_ID")]
    return "\n UNION ALL ".join(f"SELECT '{n}' AS table_name, {k} AS id, CAST({c} AS BIGINT) AS link FROM {src} x"
                                for n, src, k, c in parts)


def _counts_sql(member="member", trainer="trainer", session="session", log="workout_log",
                hm="health_metrics", notif="notifications"):
    parts = [("gym", "gym"), ("membership_type", "membership_type"), ("member", member),
             ("trainer", trainer), ("admin", "admin"), ("session", session),
             ("workout_log", log), ("health_metrics", hm), ("notifications", notif)]
    sql = "\n UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {src} x"
                               for n, src in parts)
    return sql + (f"\n UNION ALL SELECT 'workout_log.S_ID is null', COUNT(*) FROM {log} x "
                  "WHERE x.S_ID IS NULL")


_GONE_MEMBERS = """(SELECT M_ID FROM member WHERE IsActive = FALSE
                      AND date_diff('day', JoinDate, DATE '2024-01-30') > 365)"""


@register("delete_inactive_members", q(_counts_sql(
    member=f"(SELECT * FROM member WHERE M_ID NOT IN {_GONE_MEMBERS})",
    log=f"(SELECT * FROM workout_log WHERE M_ID NOT IN {_GONE_MEMBERS})",
    hm=f"(SELECT * FROM health_metrics WHERE M_ID NOT IN {_GONE_MEMBERS})",
    notif=f"(SELECT * FROM notifications WHERE M_ID NOT IN {_GONE_MEMBERS})")))
def _delete_inactive_members(spark, d):
    return MT.table_counts(MT.delete_inactive_members(tables(spark, d)))


def _without(col, gone):
    return {"member": f"(SELECT * FROM member WHERE {col} NOT IN {gone})",
            "log": f"(SELECT * FROM workout_log WHERE {col} NOT IN {gone})",
            "hm": f"(SELECT * FROM health_metrics WHERE {col} NOT IN {gone})",
            "notif": f"(SELECT * FROM notifications WHERE {col} NOT IN {gone})"}


@register("delete_inactive_members_rows", q(_rows_sql(**_without("M_ID", _GONE_MEMBERS))))
def _delete_inactive_members_rows(spark, d):
    return MT.remaining_rows(MT.delete_inactive_members(tables(spark, d)))


@register("delete_trainers", q("""
, f AS (SELECT T_ID, MIN(request_id) AS first FROM trainer_delete_requests GROUP BY T_ID)
SELECT r.request_id, r.T_ID,
       CASE WHEN EXISTS (SELECT 1 FROM trainer t WHERE t.T_ID = r.T_ID) AND r.request_id = f.first
            THEN 'Trainer deleted successfully.' ELSE 'Trainer not found' END AS status
FROM trainer_delete_requests r JOIN f ON r.T_ID = f.T_ID"""))
def _delete_trainers(spark, d):
    return W_delete(spark, d, "trainer")[0]


_GONE_TRAINERS = "(SELECT T_ID FROM trainer_delete_requests)"
_GONE_TSESS = f"(SELECT S_ID FROM session WHERE T_ID IN {_GONE_TRAINERS})"


@register("delete_trainers_cascade", q(_counts_sql(
    trainer=f"(SELECT * FROM trainer WHERE T_ID NOT IN {_GONE_TRAINERS})",
    session=f"(SELECT * FROM session WHERE T_ID NOT IN {_GONE_TRAINERS})",
    log=f"""(SELECT L_ID, CASE WHEN S_ID IN {_GONE_TSESS} THEN NULL ELSE S_ID END AS S_ID
             FROM workout_log)""")))
def _delete_trainers_cascade(spark, d):
    return MT.table_counts(W_delete(spark, d, "trainer")[1])


@register("delete_trainers_rows", q(_rows_sql(
    trainer=f"(SELECT * FROM trainer WHERE T_ID NOT IN {_GONE_TRAINERS})",
    session=f"(SELECT * FROM session WHERE T_ID NOT IN {_GONE_TRAINERS})",
    log=f"""(SELECT L_ID, CASE WHEN S_ID IN {_GONE_TSESS} THEN NULL ELSE S_ID END AS S_ID
             FROM workout_log)""")))
def _delete_trainers_rows(spark, d):
    return MT.remaining_rows(W_delete(spark, d, "trainer")[1])


@register("delete_members", q("""
, f AS (SELECT M_ID, MIN(request_id) AS first FROM member_delete_requests GROUP BY M_ID)
SELECT r.request_id, r.M_ID,
       CASE WHEN EXISTS (SELECT 1 FROM member m WHERE m.M_ID = r.M_ID) AND r.request_id = f.first
            THEN 'Member deleted successfully.' ELSE 'Member not found' END AS status
FROM member_delete_requests r JOIN f ON r.M_ID = f.M_ID"""))
def _delete_members(spark, d):
    return W_delete(spark, d, "member")[0]


_GONE_M = "(SELECT M_ID FROM member_delete_requests)"


@register("delete_members_cascade", q(_counts_sql(
    member=f"(SELECT * FROM member WHERE M_ID NOT IN {_GONE_M})",
    log=f"(SELECT * FROM workout_log WHERE M_ID NOT IN {_GONE_M})",
    hm=f"(SELECT * FROM health_metrics WHERE M_ID NOT IN {_GONE_M})",
    notif=f"(SELECT * FROM notifications WHERE M_ID NOT IN {_GONE_M})")))
def _delete_members_cascade(spark, d):
    return MT.table_counts(W_delete(spark, d, "member")[1])


@register("delete_members_rows", q(_rows_sql(**_without("M_ID", _GONE_M))))
def _delete_members_rows(spark, d):
    return MT.remaining_rows(W_delete(spark, d, "member")[1])


def W_delete(spark, d, which):
    t = tables(spark, d)
    if which == "trainer":
        return MT.delete_trainers(t, S.trainer_delete_requests(spark, d))
    return MT.delete_members(t, S.member_delete_requests(spark, d))


_BOOK = """
, req AS (
  SELECT r.request_id, r.M_ID, r.S_ID, s.S_ID IS NOT NULL AS found, s.MaxParticipants AS mx
  FROM booking_requests r LEFT JOIN session s ON r.S_ID = s.S_ID),
  bk AS (SELECT * FROM workout_log WHERE Exercise = 'Session Booking' AND S_ID IS NOT NULL),
  cnt AS (SELECT S_ID, COUNT(*) AS n FROM bk GROUP BY S_ID),
  r2 AS (
  SELECT req.*, EXISTS (SELECT 1 FROM bk WHERE bk.M_ID = req.M_ID AND bk.S_ID = req.S_ID) AS booked,
         COALESCE(cnt.n, 0) AS n0
  FROM req LEFT JOIN cnt ON req.S_ID = cnt.S_ID),
  live AS (
  SELECT *, row_number() OVER (PARTITION BY M_ID, S_ID ORDER BY request_id) AS occ,
         MIN(request_id) OVER (PARTITION BY M_ID, S_ID) AS first
  FROM r2 WHERE found AND NOT booked),
  firsts AS (
  SELECT *, row_number() OVER (PARTITION BY S_ID ORDER BY request_id) AS rk FROM live WHERE occ = 1),
  adm AS (SELECT request_id FROM firsts WHERE mx IS NULL OR rk <= mx - n0),
  seq AS (
  SELECT r2.*, live.first, live.occ,
         r2.request_id IN (SELECT request_id FROM adm) AS admitted,
         live.first IN (SELECT request_id FROM adm) AS first_admitted,
         -- seats taken by earlier admitted candidates of the same session
         (SELECT COUNT(*) FROM firsts f WHERE f.S_ID = r2.S_ID AND f.request_id < r2.request_id
             AND f.request_id IN (SELECT request_id FROM adm)) AS before_adm
  FROM r2 LEFT JOIN live ON r2.request_id = live.request_id),
  st AS (
  SELECT request_id, M_ID, S_ID, {status} AS status FROM seq)
SELECT st.*, CASE WHEN status IN ('SUCCESS: Session booked successfully', 'Session booked successfully.')
                  THEN CAST((SELECT MAX(L_ID) FROM workout_log) + row_number() OVER (
           PARTITION BY status IN ('SUCCESS: Session booked successfully', 'Session booked successfully.')
           ORDER BY request_id) AS BIGINT) END AS L_ID
FROM st"""

_PROC = """CASE WHEN NOT found THEN 'ERROR: Session not found'
               WHEN booked THEN 'ERROR: You have already booked this session'
               WHEN occ > 1 AND first_admitted THEN 'ERROR: You have already booked this session'
               WHEN occ > 1 THEN 'ERROR: Session is full'
               WHEN admitted THEN 'SUCCESS: Session booked successfully'
               ELSE 'ERROR: Session is full' END"""
_APP = """CASE WHEN NOT found THEN 'Session not found'
               WHEN mx IS NOT NULL AND n0 + before_adm >= mx THEN 'Session is full'
               WHEN booked OR occ > 1 THEN 'You have already booked this session'
               ELSE 'Session booked successfully.' END"""


@register("apply_bookings", q(_BOOK.format(status=_PROC)))
def _apply_bookings(spark, d):
    return W.apply_bookings(tables(spark, d), S.booking_requests(spark, d))


@register("apply_bookings_app", q(_BOOK.format(status=_APP)))
def _apply_bookings_app(spark, d):
    return W.apply_bookings(tables(spark, d), S.booking_requests(spark, d), precedence="app")


@register("cancel_bookings", q("""
, f AS (SELECT L_ID, M_ID, MIN(request_id) AS first FROM cancel_requests GROUP BY L_ID, M_ID)
SELECT r.request_id, r.L_ID, r.M_ID,
       CASE WHEN r.request_id = f.first AND EXISTS (
              SELECT 1 FROM workout_log wl WHERE wl.L_ID = r.L_ID AND wl.M_ID = r.M_ID
                AND wl.Exercise = 'Session Booking')
            THEN 'Session booking canceled.'
            ELSE 'Booking not found or you do not have permission to cancel it' END AS status
FROM cancel_requests r JOIN f ON r.L_ID = f.L_ID AND r.M_ID = f.M_ID"""))
def _cancel_bookings(spark, d):
    return W.cancel_bookings(tables(spark, d), S.cancel_requests(spark, d))[0]


@register("cancel_bookings_log", q("""
SELECT * FROM workout_log wl WHERE NOT (wl.Exercise = 'Session Booking' AND EXISTS (
  SELECT 1 FROM cancel_requests r WHERE r.L_ID = wl.L_ID AND r.M_ID = wl.M_ID))
  OR wl.Exercise IS NULL"""))
def _cancel_bookings_log(spark, d):
    return W.cancel_bookings(tables(spark, d), S.cancel_requests(spark, d))[1]


@register("add_workouts", q("""
, st AS (
  SELECT r.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM member m WHERE m.M_ID = r.M_ID AND m.IsActive = TRUE)
      THEN 'ERROR: Member not found or inactive'
    WHEN r.Duration IS NOT NULL AND (r.Duration < 5 OR r.Duration > 300) THEN 'Workout duration must be between 5 and 300 minutes'
    WHEN r.CaloriesBurnt IS NOT NULL AND (r.CaloriesBurnt < 0 OR r.CaloriesBurnt > 2000) THEN 'Calories burnt must be between 0 and 2000'
    WHEN r.Distance IS NOT NULL AND (r.Distance < 0 OR r.Distance > 50) THEN 'Distance must be between 0 and 50 km'
    WHEN r.Date > DATE '2024-01-30' THEN 'Workout date cannot be in the future'
    ELSE 'SUCCESS: Workout logged successfully' END AS status
  FROM workout_requests r)
SELECT st.*, CASE WHEN status = 'SUCCESS: Workout logged successfully' THEN CAST(
         (SELECT MAX(L_ID) FROM workout_log) + row_number() OVER (
           PARTITION BY status = 'SUCCESS: Workout logged successfully' ORDER BY request_id) AS BIGINT) END AS L_ID
FROM st"""))
def _add_workouts(spark, d):
    return W.add_workouts(tables(spark, d), S.workout_requests(spark, d))


_HM_VIOL = """CASE
  WHEN Weight IS NOT NULL AND (Weight < 20 OR Weight > 300) THEN 'Weight must be between 20 and 300 kg'
  WHEN Height IS NOT NULL AND (Height < 100 OR Height > 250) THEN 'Height must be between 100 and 250 cm'
  WHEN SleepHours IS NOT NULL AND (SleepHours < 0 OR SleepHours > 24) THEN 'Sleep hours must be between 0 and 24'
  WHEN WaterLiters IS NOT NULL AND (WaterLiters < 0 OR WaterLiters > 10) THEN 'Water intake must be between 0 and 10 liters'
  WHEN Steps IS NOT NULL AND (Steps < 0 OR Steps > 100000) THEN 'Steps must be between 0 and 100,000'
  END"""


@register("upsert_health_metrics", q(f"""
, u AS (SELECT *, {_HM_VIOL} AS v,
               row_number() OVER (PARTITION BY M_ID, Date ORDER BY request_id DESC) AS rlast
        FROM metric_updates),
  lastv AS (SELECT * FROM u WHERE rlast = 1),
  firstok AS (SELECT M_ID, Date, MIN(request_id) AS f FROM u WHERE v IS NULL GROUP BY M_ID, Date),
  newk AS (
  SELECT l.*, fo.f FROM lastv l JOIN firstok fo ON l.M_ID = fo.M_ID AND l.Date = fo.Date
  WHERE NOT EXISTS (SELECT 1 FROM health_metrics h WHERE h.M_ID = l.M_ID AND h.Date = l.Date))
SELECT h.Metric_ID, h.M_ID, h.Date,
       CASE WHEN l.M_ID IS NOT NULL THEN l.Weight ELSE h.Weight END AS Weight,
       CASE WHEN l.M_ID IS NOT NULL THEN l.Height ELSE h.Height END AS Height,
       CASE WHEN l.M_ID IS NOT NULL THEN l.SleepHours ELSE h.SleepHours END AS SleepHours,
       CASE WHEN l.M_ID IS NOT NULL THEN l.WaterLiters ELSE h.WaterLiters END AS WaterLiters,
       CASE WHEN l.M_ID IS NOT NULL THEN l.Steps ELSE h.Steps END AS Steps
FROM health_metrics h LEFT JOIN lastv l ON h.M_ID = l.M_ID AND h.Date = l.Date
UNION ALL
SELECT CAST((SELECT MAX(Metric_ID) FROM health_metrics) + row_number() OVER (ORDER BY f) AS BIGINT),
       M_ID, Date, Weight, Height, SleepHours, WaterLiters, Steps
FROM newk"""))
def _upsert_health_metrics(spark, d):
    return W.upsert_health_metrics(tables(spark, d), S.metric_updates(spark, d))


@register("upsert_statuses", q(f"""
, u AS (SELECT *, {_HM_VIOL} AS v FROM metric_updates),
  firstok AS (SELECT M_ID, Date, MIN(request_id) AS f FROM u WHERE v IS NULL GROUP BY M_ID, Date)
SELECT u.request_id, u.M_ID, u.Date,
       CASE WHEN EXISTS (SELECT 1 FROM health_metrics h WHERE h.M_ID = u.M_ID AND h.Date = u.Date)
              THEN 'SUCCESS: Health metrics updated'
            WHEN fo.f IS NOT NULL AND u.request_id > fo.f THEN 'SUCCESS: Health metrics updated'
            WHEN u.v IS NULL THEN 'SUCCESS: Health metrics added'
            ELSE u.v END AS status
FROM u LEFT JOIN firstok fo ON u.M_ID = fo.M_ID AND u.Date = fo.Date"""))
def _upsert_statuses(spark, d):
    return W.upsert_statuses(tables(spark, d), S.metric_updates(spark, d))


_REG = """
, pre AS (
  SELECT r.*, CASE WHEN {missing} THEN 'Missing required fields'
                   {rule}
                   WHEN lower(r.Email) IN (SELECT lower(Email) FROM {table}) THEN 'Email already exists'
              END AS p,
         {fk} AS fk
  FROM {requests} r),
  win AS (SELECT lower(Email) AS mail, MIN(request_id) AS w FROM pre WHERE p IS NULL AND fk GROUP BY mail),
  st AS (
  SELECT pre.request_id, pre.Email,
         CASE WHEN p IS NOT NULL THEN p
              WHEN win.w IS NOT NULL AND pre.request_id > win.w THEN 'Email already exists'
              WHEN NOT fk THEN 'ERROR: foreign key constraint fails'
              ELSE '{ok}' END AS status
  FROM pre LEFT JOIN win ON lower(pre.Email) = win.mail)
SELECT st.*, CASE WHEN status = '{ok}' THEN CAST(
         (SELECT MAX({pk}) FROM {table}) + row_number() OVER (
           PARTITION BY status = '{ok}' ORDER BY request_id) AS BIGINT) END AS {pk}
FROM st"""


@register("register_members", q(_REG.format(
    missing="r.Name IS NULL OR r.Email IS NULL OR r.Age IS NULL OR r.MembershipType_ID IS NULL OR r.Gym_ID IS NULL",
    rule="WHEN r.Age < 10 OR r.Age > 100 THEN 'Member age must be between 10 and 100 years'",
    table="member", requests="member_registrations", ok="Member added successfully.", pk="M_ID",
    fk="(EXISTS (SELECT 1 FROM membership_type mt WHERE mt.Type_ID = r.MembershipType_ID) "
       "AND EXISTS (SELECT 1 FROM gym g WHERE g.Gym_ID = r.Gym_ID))")))
def _register_members(spark, d):
    return W.register_members(tables(spark, d), S.member_registrations(spark, d))


@register("register_trainers", q(_REG.format(
    missing="r.Name IS NULL OR r.Email IS NULL OR r.Specialization IS NULL OR r.Gym_ID IS NULL",
    rule="", table="trainer", requests="trainer_registrations", ok="Trainer added successfully.",
    pk="T_ID", fk="EXISTS (SELECT 1 FROM gym g WHERE g.Gym_ID = r.Gym_ID)")))
def _register_trainers(spark, d):
    return W.register_trainers(tables(spark, d), S.trainer_registrations(spark, d))


@register("add_workouts_app", q("""
, st AS (
  SELECT r.*, CASE
    WHEN r.Exercise IS NULL OR r.Date IS NULL OR r.Duration IS NULL THEN 'Missing required fields: exercise, date, duration.'
    WHEN r.Duration IS NOT NULL AND (r.Duration < 5 OR r.Duration > 300) THEN 'Workout duration must be between 5 and 300 minutes'
    WHEN r.CaloriesBurnt IS NOT NULL AND (r.CaloriesBurnt < 0 OR r.CaloriesBurnt > 2000) THEN 'Calories burnt must be between 0 and 2000'
    WHEN r.Distance IS NOT NULL AND (r.Distance < 0 OR r.Distance > 50) THEN 'Distance must be between 0 and 50 km'
    WHEN r.Date > DATE '2024-01-30' THEN 'Workout date cannot be in the future'
    ELSE 'success' END AS status
  FROM (SELECT request_id, M_ID, Exercise, Date, Duration,
               CAST(CASE WHEN floor(CaloriesBurnt) <> 0 THEN floor(CaloriesBurnt) END AS DECIMAL(6,2)) AS CaloriesBurnt,
               CASE WHEN Distance <> 0 THEN Distance END AS Distance, Progress
        FROM workout_requests) r)
SELECT st.*, CASE WHEN status = 'success' THEN CAST(
         (SELECT MAX(L_ID) FROM workout_log) + row_number() OVER (
           PARTITION BY status = 'success' ORDER BY request_id) AS BIGINT) END AS L_ID
FROM st"""))
def _add_workouts_app(spark, d):
    reqs = W.normalize_workout_form(S.workout_requests(spark, d))
    return W.add_workouts(tables(spark, d), reqs, form="app")


# The rows that accepted requests write, from the status statements above.
def _accepted(statuses: str, select: str) -> str:
    head, _, tail = statuses.rpartition("\nSELECT st.*,")
    return f"{head},\n  done AS (SELECT st.*,{tail})\n{select}"


from fitlake.plans.registry import _SQL  # noqa: E402


@register("booking_rows", _accepted(_SQL["apply_bookings"], """
SELECT d.L_ID, d.M_ID, d.S_ID, 'Session Booking' AS Exercise, s.SessionDate AS Date, s.Duration,
       CAST(NULL AS DECIMAL(6,2)) AS CaloriesBurnt, CAST(NULL AS DECIMAL(6,2)) AS Distance, 'Booked' AS Progress
FROM done d JOIN session s USING (S_ID) WHERE d.L_ID IS NOT NULL"""))
def _booking_rows(spark, d):
    t = tables(spark, d)
    return W.booking_rows(t, W.apply_bookings(t, S.booking_requests(spark, d)))


@register("workout_rows", _accepted(_SQL["add_workouts"], """
SELECT L_ID, M_ID, CAST(NULL AS BIGINT) AS S_ID, Exercise, Date, Duration, CaloriesBurnt, Distance, Progress
FROM done WHERE L_ID IS NOT NULL"""))
def _workout_rows(spark, d):
    return W.workout_rows(W.add_workouts(tables(spark, d), S.workout_requests(spark, d)))


@register("new_member_rows", _accepted(_SQL["register_members"], """
SELECT d.M_ID, r.Name, r.Email, r.Age, DATE '2024-01-30' AS JoinDate, COALESCE(r.Phone, '') AS Phone,
       CAST(NULL AS DATE) AS MembershipEndDate, TRUE AS IsActive, r.MembershipType_ID, r.Gym_ID
FROM member_registrations r JOIN done d USING (request_id) WHERE d.M_ID IS NOT NULL"""))
def _new_member_rows(spark, d):
    t, r = tables(spark, d), S.member_registrations(spark, d)
    return W.new_member_rows(t, r, W.register_members(t, r))


@register("new_trainer_rows", _accepted(_SQL["register_trainers"], """
SELECT d.T_ID, r.Name, r.Email, r.Specialization, r.Gym_ID
FROM trainer_registrations r JOIN done d USING (request_id) WHERE d.T_ID IS NOT NULL"""))
def _new_trainer_rows(spark, d):
    r = S.trainer_registrations(spark, d)
    return W.new_trainer_rows(r, W.register_trainers(tables(spark, d), r))
