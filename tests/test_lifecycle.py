"""The lifecycle against a plain sequential interpreter of the transition map, and its known corner cases."""

import random
from datetime import datetime, timedelta

import pytest

from caseflow import schema as S
from caseflow.operators import lifecycle
from caseflow.operators.duplicates import canonical_roots

T0 = datetime(2024, 1, 1)
CATEGORIES = [(d * 10 + n, d, f"c{n}", f"C{n}", sla) for d in (0, 1) for n, sla in ((1, 48), (2, 10), (3, 1))]


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame(CATEGORIES, S.CATEGORY)


def cmd(seq, cid, op, hours=None, domain=0, **kw):
    row = dict(seq=seq, ts=T0 + timedelta(hours=seq if hours is None else hours), complaint_id=cid, domain_id=domain, op=op, to_status=None,
               category_id=None, priority=None, assignee=None, canonical_id=None, prediction_id=None, actor_id=7, note="")
    row.update(kw)
    return tuple(row[c.split()[0]] for c in S.COMMAND.split(", "))


def move(seq, cid, to, **kw):
    return cmd(seq, cid, "transition", to_status=to, **kw)


def triage(seq, cid, category=1, priority="low", **kw):
    return cmd(seq, cid, "triage", category_id=category, priority=priority, **kw)


def mark(seq, cid, canonical, **kw):
    return cmd(seq, cid, "mark_duplicate", canonical_id=canonical, **kw)


def interpret(rows):
    """One command after the other, as written down in the transition map."""
    names = [c.split()[0] for c in S.COMMAND.split(", ")]
    commands = sorted((dict(zip(names, r)) for r in rows), key=lambda c: (c["ts"], c["seq"]))
    cats = {c[0]: c for c in CATEGORIES}
    domains = {c["complaint_id"]: c["domain_id"] for c in commands}
    state = {c: dict(status="submitted", slug=None, priority=None, assignee=None, dup=None, triaged=None, due=None, resolved=None) for c in domains}
    events, refusals = [], []

    for c in commands:
        s, seq, op = state[c["complaint_id"]], c["seq"], c["op"]

        def emit(kind, old, new, note="", prediction=None):
            events.append((seq, sum(e[0] == seq for e in events), kind, old, new, note, prediction))

        if op == "transition":
            if c["to_status"] not in S.TRANSITIONS[s["status"]] or c["to_status"] == "duplicate":
                refusals.append((seq, "illegal_transition"))
                continue
            emit("status", s["status"], c["to_status"], c["note"])
            s["status"] = c["to_status"]
            if s["status"] == "resolved" and s["resolved"] is None:
                s["resolved"] = c["ts"]
        elif op == "triage":
            cat = cats.get(c["category_id"])
            reason = "unknown_category" if cat is None else "foreign_category" if cat[1] != c["domain_id"] else "unknown_priority" if c["priority"] not in S.PRIORITIES else None
            if reason:
                refusals.append((seq, reason))
                continue
            emit("category", s["slug"], cat[2], prediction=c["prediction_id"])
            emit("priority", s["priority"], c["priority"])
            s.update(slug=cat[2], priority=c["priority"], triaged=s["triaged"] or c["ts"])
            s["due"] = s["triaged"] + timedelta(hours=cat[4])
            if s["status"] == "submitted":
                emit("status", "submitted", "in_review", "Triaged")
                s["status"] = "in_review"
        elif op == "assign":
            emit("assignment", s["assignee"], c["assignee"])
            s["assignee"] = c["assignee"]
        else:
            k = c["canonical_id"]
            reason = (
                "unknown_canonical" if k not in domains else "self_duplicate" if k == c["complaint_id"]
                else "canonical_is_duplicate" if state[k]["status"] == "duplicate" else "cross_domain" if domains[k] != c["domain_id"]
                else "status" if "duplicate" not in S.TRANSITIONS[s["status"]] else None
            )
            if reason:
                refusals.append((seq, reason))
                continue
            emit("status", s["status"], "duplicate")
            emit("duplicate", None, str(k), prediction=c["prediction_id"])
            s.update(status="duplicate", dup=k)
    return state, events, refusals


def check(spark, categories, rows, snapshot=None):
    got = lifecycle.run(spark.createDataFrame(rows, S.COMMAND), categories, snapshot=snapshot)
    state, events, refusals = interpret(rows)
    got_state = {
        r.complaint_id: dict(status=r.status, slug=r.category_slug, priority=r.priority, assignee=r.assignee, dup=r.duplicate_of, triaged=r.triaged_at, due=r.due_at, resolved=r.resolved_at)
        for r in got.state().collect()
    }
    assert got_state == state
    assert sorted((r.seq, r.ord, r.kind, r.from_value, r.to_value, r.note, r.prediction_id) for r in got.events().collect()) == sorted(events)
    assert sorted((r.seq, r.reason) for r in got.refusals().collect()) == sorted(refusals)
    return got_state


def random_commands(seed, n, complaints):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        cid = rng.randrange(complaints)
        domain = cid % 2
        kind = rng.random()
        hours = seq // 3  # ties in ts
        if kind < 0.25:
            rows.append(triage(seq, cid, rng.choice([domain * 10 + 1, domain * 10 + 2, domain * 10 + 3, (1 - domain) * 10 + 1, 99]), rng.choice(["low", "high", "critical", "urgent"]),
                               domain=domain, hours=hours, prediction_id=rng.choice([None, 5])))
        elif kind < 0.75:
            rows.append(move(seq, cid, rng.choice(["submitted", "in_review", "in_progress", "in_progress", "resolved", "resolved", "closed", "duplicate"]), domain=domain, hours=hours, note=rng.choice(["", "n"])))
        elif kind < 0.85:
            rows.append(cmd(seq, cid, "assign", domain=domain, hours=hours, assignee=rng.choice([None, "ann", "bob"])))
        else:
            rows.append(mark(seq, cid, rng.choice([rng.randrange(complaints), rng.randrange(complaints) // 2 * 2 + domain, 10_000]), domain=domain, hours=hours))
    return rows


@pytest.mark.parametrize("seed,n,complaints", [(1, 400, 30), (2, 600, 60), (3, 300, 4)])
def test_matches_sequential_interpreter(spark, categories, seed, n, complaints):
    state = check(spark, categories, random_commands(seed, n, complaints))
    assert len({s["status"] for s in state.values()}) >= 2


def test_one_complaint_with_most_commands(spark, categories):
    """A hot complaint spans several range partitions and still folds in order."""
    rows = [r for r in random_commands(4, 300, 2)] + random_commands(5, 0, 1)
    rows += [triage(1000 + i, 0, 1 + i % 3, "low") for i in range(500)]
    check(spark, categories, rows)


def test_every_transition(spark, categories):
    """From each status, each target is accepted exactly when the map says so."""
    path = {
        "submitted": [], "in_review": ["in_review"], "in_progress": ["in_review", "in_progress"],
        "resolved": ["in_review", "in_progress", "resolved"], "closed": ["in_review", "in_progress", "resolved", "closed"],
    }
    rows, seq, expected = [], 0, {}
    for i, (status, steps) in enumerate(path.items()):
        for j, target in enumerate(S.STATUSES):
            cid = i * 10 + j
            for step in steps:
                rows.append(move(seq, cid, step)); seq += 1
            rows.append(move(seq, cid, target)); seq += 1
            expected[seq - 1] = target in S.TRANSITIONS[status] and target != "duplicate"
    refused = {r.seq for r in lifecycle.run(spark.createDataFrame(rows, S.COMMAND), categories).refusals().collect()}
    assert {s for s, ok in expected.items() if not ok} == refused


def test_clock_and_reopen(spark, categories):
    rows = [
        triage(0, 1, 1), triage(3, 1, 3, "high"),  # re-triage keeps the clock: due is 1 h after the first triage
        move(4, 1, "in_progress"), move(5, 1, "resolved"), move(6, 1, "in_progress"), move(9, 1, "resolved"), move(10, 1, "closed"), triage(11, 1, 1),
        triage(0, 2, 1), mark(1, 2, 1), triage(2, 2, 2),
    ]
    rows = [tuple([i] + list(r[1:])) for i, r in enumerate(rows)]
    state = check(spark, categories, rows)
    assert state[1]["triaged"] == T0 and state[1]["due"] == T0 + timedelta(hours=48)
    assert state[1]["resolved"] == T0 + timedelta(hours=5)
    assert state[2]["status"] == "duplicate" and state[2]["due"] == T0 + timedelta(hours=10)


def test_chain_forms_when_the_link_comes_first(spark, categories):
    rows = [mark(0, 1, 2), mark(1, 2, 3), triage(2, 3, 1), mark(3, 4, 2), mark(4, 3, 1)]
    state = check(spark, categories, rows)
    assert (state[1]["dup"], state[2]["dup"]) == (2, 3)
    assert state[4]["status"] == "submitted" and state[3]["status"] == "in_review"


def test_marks_that_depend_on_each_other(spark, categories):
    """Acceptance alternates along a chain of marks made in reverse order."""
    n = 12
    rows = [mark(n - i, i, i + 1) for i in range(n)] + [triage(50, n, 1)]
    state = check(spark, categories, rows)
    assert sum(s["status"] == "duplicate" for s in state.values()) == n // 2


def test_snapshot_gives_the_same_as_one_run(spark, categories):
    rows = sorted(random_commands(7, 500, 40), key=lambda r: (r[1], r[0]))
    whole, _, _ = interpret(rows)
    first, second = rows[:260], rows[260:]
    before = lifecycle.run(spark.createDataFrame(first, S.COMMAND), categories)
    known = spark.createDataFrame([(c, c % 2) for c in {r[2] for r in rows}], "complaint_id LONG, domain_id LONG")
    before = lifecycle.run(spark.createDataFrame(first, S.COMMAND), categories, known=known)
    after = lifecycle.run(spark.createDataFrame(second, S.COMMAND), categories, known=known, snapshot=before.state())
    got = {r.complaint_id: (r.status, r.category_slug, r.priority, r.assignee, r.duplicate_of, r.triaged_at, r.due_at, r.resolved_at) for r in after.state().collect()}
    assert got == {c: (s["status"], s["slug"], s["priority"], s["assignee"], s["dup"], s["triaged"], s["due"], s["resolved"]) for c, s in whole.items()}


def test_roots_of_chains_and_cycles(spark):
    edges = [(i, i - 1) for i in range(1, 40)] + [(0, None), (100, 101), (101, 100), (102, 100), (103, 102), (200, 200), (201, 200)]
    got = {r.id: (r.root, r.hops) for r in canonical_roots(spark.createDataFrame(edges, "id LONG, duplicate_of LONG")).collect()}
    assert all(got[i] == (0, i) for i in range(1, 40))
    assert got[100] == got[101] == got[102] == got[103] == (None, None)
    assert got[201] == (200, 1) and 200 not in got


def test_roots_of_a_cycle_alone_take_few_rounds(spark, monkeypatch):
    from caseflow.operators import duplicates

    pins = []
    monkeypatch.setattr(duplicates, "pin", lambda df, label, original=duplicates.pin: pins.append(label) or original(df, label))
    rows = canonical_roots(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id LONG, duplicate_of LONG")).collect()
    assert {(r.id, r.root, r.hops) for r in rows} == {(1, None, None), (2, None, None), (3, None, None)}
    assert len(pins) <= 4
