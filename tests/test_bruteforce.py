"""Set-based operators vs a literal sequential simulation of the
reference's row-at-a-time semantics, on small random fixtures."""

import datetime as dt
import os
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fitlake.operators import notices as N
from fitlake.operators import rules as RU
from fitlake.operators import writes as W
from fitlake.sources import schema as SC
from fitlake.sources.tables import frames

AS_OF = dt.date(2024, 1, 30)
BK = SC.BOOKING
SETTINGS = settings(max_examples=int(os.environ.get("FITLAKE_HYPOTHESIS_EXAMPLES", "6")), deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

caps = st.lists(st.sampled_from([None, 0, 1, 2, 3]), min_size=1, max_size=4)
log_rows = st.lists(st.tuples(st.integers(1, 3), st.sampled_from([BK, BK, "Run", None]),
                              st.integers(1, 5), st.sampled_from([None, 3, 30, 400]),
                              st.integers(-3, 2)), max_size=25)
reqs = st.lists(st.tuples(st.integers(1, 3), st.integers(1, 5)), max_size=25)


def _tables(spark, capacities, logs):
    sessions = [(i + 1, f"S{i + 1}", AS_OF + dt.timedelta(days=(i % 3) - 1), "07:00:00", 30, 1, c,
                 "scheduled") for i, c in enumerate(capacities)]
    log = []
    for i, (m, ex, s, dur, day) in enumerate(logs):
        sid = s if ex == BK else None
        log.append((i + 1, m, sid, ex, AS_OF + dt.timedelta(days=day), dur, None, None, None))
    return frames(spark, {"session": sessions, "workout_log": log,
                          "member": [(m, f"M{m}", f"m{m}@x", 30, AS_OF, None, None, True, 1, 1)
                                     for m in (1, 2, 3)]})


@SETTINGS
@given(caps, log_rows, reqs, st.sampled_from(["procedure", "app"]))
def test_bookings_equal_sequential(spark, capacities, logs, requests, precedence):
    t = _tables(spark, capacities, logs)
    req = spark.createDataFrame([(i + 10, m, s) for i, (m, s) in enumerate(requests)],
                                SC.BOOKING_REQUEST)
    got = {r.request_id: (r.status, r.L_ID) for r in W.apply_bookings(t, req, precedence).collect()}

    cap = {i + 1: c for i, c in enumerate(capacities)}
    booked = {(r[1], r[2]) for r in t.workout_log.collect() if r[3] == BK and r[2] is not None}
    count = {}
    for r in t.workout_log.collect():
        if r[3] == BK and r[2] is not None:
            count[r[2]] = count.get(r[2], 0) + 1
    next_id = len(logs)
    msgs = ((W.BOOK_OK, W.BOOK_ALREADY, W.BOOK_FULL, W.BOOK_NOT_FOUND) if precedence == "procedure"
            else (W.APP_BOOK_OK, W.APP_BOOK_ALREADY, W.APP_BOOK_FULL, W.APP_BOOK_NOT_FOUND))
    ok, already, full, missing = msgs
    want = {}
    for i, (m, s) in enumerate(requests):
        is_full = cap.get(s) is not None and count.get(s, 0) >= cap[s]
        if s not in cap:
            want[i + 10] = (missing, None)
            continue
        checks = [((m, s) in booked, already), (is_full, full)]
        if precedence == "app":
            checks.reverse()
        status = next((msg for cond, msg in checks if cond), ok)
        if status == ok:
            next_id += 1
            booked.add((m, s))
            count[s] = count.get(s, 0) + 1
            want[i + 10] = (ok, next_id)
        else:
            want[i + 10] = (status, None)
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from([BK, "Run", "Run", None])),
                min_size=0, max_size=60))
def test_milestones_equal_sequential(spark, rows):
    logs = [(i + 1, m, None, ex, AS_OF, 30, None, None, None) for i, (m, ex) in enumerate(rows)]
    t = frames(spark, {"workout_log": logs})
    got = sorted((r.M_ID, r.L_ID) for r in N.workout_milestones(t, AS_OF).collect())
    counts, want = {}, []
    for lid, m, _s, ex, *_ in logs:
        if ex is not None and ex != BK:
            counts[m] = counts.get(m, 0) + 1
        if counts.get(m, 0) in N.MILESTONES:
            want.append((m, lid))
    assert got == sorted(want)


@SETTINGS
@given(caps, log_rows)
def test_log_rules_equal_sequential_triggers(spark, capacities, logs):
    t = _tables(spark, capacities, logs)
    got = {r.L_ID: r.violation for r in RU.validate_log_rows(t, AS_OF).collect()}
    sess = {r.S_ID: r for r in t.session.collect()}
    accepted, want = {}, {}
    for r in sorted(t.workout_log.collect(), key=lambda r: r.L_ID):
        bk = r.S_ID is not None and r.Exercise == BK
        s = sess.get(r.S_ID)
        v = None
        if bk and s is not None and s.MaxParticipants is not None \
                and accepted.get(r.S_ID, 0) >= s.MaxParticipants:
            v = RU.MSG_FULL
        elif r.Duration is not None and not (5 <= r.Duration <= 300):
            v = RU.MSG_DURATION
        elif r.Date > AS_OF:
            v = RU.MSG_FUTURE
        elif bk and s is not None and s.SessionDate < AS_OF:
            v = RU.MSG_PAST_SESSION
        if v is None and bk:
            accepted[r.S_ID] = accepted.get(r.S_ID, 0) + 1
        want[r.L_ID] = v
    assert got == want


upd = st.lists(st.tuples(st.integers(1, 2), st.integers(0, 2), st.sampled_from([10, 60, 80, 400])),
               max_size=15)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 2)), max_size=5), upd)
def test_upsert_equal_sequential(spark, existing, updates):
    hm = [(i + 1, m, AS_OF + dt.timedelta(days=d), Decimal("70.00"), None, None, None, None)
          for i, (m, d) in enumerate(existing)]
    t = frames(spark, {"health_metrics": hm})
    req = spark.createDataFrame(
        [(i + 1, m, AS_OF + dt.timedelta(days=d), Decimal(w), None, None, None, None)
         for i, (m, d, w) in enumerate(updates)], SC.METRIC_UPDATE)
    got = sorted((r.Metric_ID, r.M_ID, r.Date, r.Weight) for r in W.upsert_health_metrics(t, req).collect())
    table = [list(r) for r in hm]
    next_id = len(hm)
    for i, (m, d, w) in enumerate(updates):
        day = AS_OF + dt.timedelta(days=d)
        rows = [r for r in table if r[1] == m and r[2] == day]
        if rows:
            for r in rows:
                r[3] = Decimal(w)
        elif 20 <= w <= 300:
            next_id += 1
            table.append([next_id, m, day, Decimal(w), None, None, None, None])
    assert got == sorted((r[0], r[1], r[2], r[3]) for r in table)


regs = st.lists(st.tuples(st.sampled_from(["a@x", "b@x", "c@x", None]), st.sampled_from([30, 5, None]),
                          st.sampled_from([1, 9])), max_size=12)


@SETTINGS
@given(regs)
def test_registration_equal_sequential(spark, requests):
    t = frames(spark, {"gym": [(1, "G", 100)],
                       "membership_type": [(1, "Gold", 12, Decimal("1.00"), 1)],
                       "member": [(7, "Old", "a@x", 30, AS_OF, None, None, True, 1, 1)]})
    req = spark.createDataFrame([(i + 1, "N", e, a, None, 1, g) for i, (e, a, g) in enumerate(requests)],
                                SC.MEMBER_REGISTRATION)
    got = {r.request_id: (r.status, r.M_ID) for r in W.register_members(t, req).collect()}
    taken, next_id, want = {"a@x"}, 7, {}
    for i, (e, a, g) in enumerate(requests):
        if e is None or a is None:
            want[i + 1] = (W.REG_MISSING, None)
        elif not 10 <= a <= 100:
            want[i + 1] = (RU.MSG_AGE, None)
        elif e in taken:
            want[i + 1] = (W.REG_DUPLICATE, None)
        elif g != 1:
            want[i + 1] = (W.REG_FK, None)
        else:
            taken.add(e)
            next_id += 1
            want[i + 1] = (W.MEMBER_ADDED, next_id)
    assert got == want


@SETTINGS
@given(st.lists(st.integers(1, 3), max_size=3),                      # types' gyms
       st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), max_size=5),   # members (gym, type)
       st.lists(st.integers(1, 3), max_size=3),                      # trainers' gyms
       st.lists(st.integers(1, 3), max_size=5),                      # sessions' trainers
       st.lists(st.tuples(st.integers(1, 5), st.one_of(st.none(), st.integers(1, 5))), max_size=8),
       st.sets(st.integers(1, 3), max_size=2))
def test_cascade_equal_fk_actions(spark, type_gyms, members, trainer_gyms, sess_trainers, logs, gone):
    from fitlake.operators.maintenance import cascade_delete
    rows = {
        "gym": [(g, f"G{g}", 100) for g in (1, 2, 3)],
        "membership_type": [(i + 1, "T", 12, Decimal("1.00"), g) for i, g in enumerate(type_gyms)],
        "member": [(i + 1, "M", f"m{i}@x", 30, AS_OF, None, None, True, ty, g)
                   for i, (g, ty) in enumerate(members)],
        "trainer": [(i + 1, "T", f"t{i}@x", "Yoga", g) for i, g in enumerate(trainer_gyms)],
        "session": [(i + 1, "S", AS_OF, "07:00:00", 30, tr, 5, "scheduled") for i, tr in enumerate(sess_trainers)],
        "workout_log": [(i + 1, m, s, "Run", AS_OF, 30, None, None, None) for i, (m, s) in enumerate(logs)],
    }
    t = frames(spark, rows)
    out = cascade_delete(t, "gym", spark.createDataFrame([(g,) for g in gone], "Gym_ID int"))
    types_gone = {r[0] for r in rows["membership_type"] if r[4] in gone}
    trainers_gone = {r[0] for r in rows["trainer"] if r[4] in gone}
    sessions_gone = {r[0] for r in rows["session"] if r[5] in trainers_gone}
    want = {
        "gym": sorted(r[0] for r in rows["gym"] if r[0] not in gone),
        "membership_type": sorted(r[0] for r in rows["membership_type"] if r[0] not in types_gone),
        "member": sorted((r[0], None if r[8] in types_gone else r[8], None if r[9] in gone else r[9])
                         for r in rows["member"]),
        "trainer": sorted(r[0] for r in rows["trainer"] if r[0] not in trainers_gone),
        "session": sorted(r[0] for r in rows["session"] if r[0] not in sessions_gone),
        "workout_log": sorted((r[0], None if r[2] in sessions_gone else r[2]) for r in rows["workout_log"]),
    }
    got = {
        "gym": sorted(r.Gym_ID for r in out.gym.collect()),
        "membership_type": sorted(r.Type_ID for r in out.membership_type.collect()),
        "member": sorted((r.M_ID, r.MembershipType_ID, r.Gym_ID) for r in out.member.collect()),
        "trainer": sorted(r.T_ID for r in out.trainer.collect()),
        "session": sorted(r.S_ID for r in out.session.collect()),
        "workout_log": sorted((r.L_ID, r.S_ID) for r in out.workout_log.collect()),
    }
    key = lambda v: (v is None, v)
    assert {k: sorted(v, key=lambda x: tuple(map(key, x)) if isinstance(x, tuple) else key(x))
            for k, v in got.items()} == \
        {k: sorted(v, key=lambda x: tuple(map(key, x)) if isinstance(x, tuple) else key(x))
         for k, v in want.items()}
