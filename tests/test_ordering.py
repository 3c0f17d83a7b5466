"""Batches against the requests handled one after the other in plain Python."""

import random

import pytest

from campusledger.operators import changes as C
from campusledger.operators.account_stream import account_stream
from campusledger.operators.ordering import first_takers, names_in_order
from campusledger.plans import jobs
from campusledger.sources.tables import SCHEMAS

AS_OF = "2025-06-01 09:00:00"
NEW = "seq long, email string, username string, name string, userType string, password string"


def users_of(spark, rows):
    """(email, username, type, status) rows as the accounts table."""
    return spark.createDataFrame([(e, u, "N", "D", t, s, None, None) for e, u, t, s in rows], SCHEMAS["users"])


def low(x):
    return None if x is None else x.lower()


# ---- names handed out in order -----------------------------------------------------------------

@pytest.mark.parametrize("rest", [0, 40, 10 ** 6])
def test_first_takers(spark, rest):
    r = random.Random(1)
    for n, names in ((0, 1), (60, 4), (150, 60)):
        rows = [(i, f"e{r.randrange(names)}", r.choice([None, f"u{r.randrange(names)}"]) if n == 60 else f"u{r.randrange(names)}")
                for i in r.sample(range(1000), n)]
        took, want = (set(), set()), set()
        for i, e, u in sorted(rows):
            if e not in took[0] and (u is None or u not in took[1]):
                took[0].add(e), took[1].add(u)
                want.add(i)
        got = first_takers(spark.createDataFrame(rows, "seq long, e string, u string"), ["e", "u"], rest)
        assert {x.seq for x in got.collect()} == want


def test_first_takers_in_a_chain(spark):
    """Each request conflicts with the next: every other one gets its keys."""
    rows = [(i, f"e{(i + 1) // 2}", f"u{i // 2}") for i in range(8)]
    got = first_takers(spark.createDataFrame(rows, "seq long, e string, u string"), ["e", "u"], 0)
    assert sorted(x.seq for x in got.collect()) == [0, 2, 4, 6]


def insert_one_by_one(accounts, requests):
    emails, names = {low(a[0]) for a in accounts}, {low(a[1]) for a in accounts}
    out = {}
    for seq, e, u, name, kind, password in sorted(requests, key=lambda q: q[0]):
        if not all((e, u, name, kind, password)):
            out[seq] = "rejected:missing_fields"
        elif low(e) in emails:
            out[seq] = "rejected:duplicate:email"
        elif low(u) in names:
            out[seq] = "rejected:duplicate:username"
        else:
            out[seq] = "applied"
            emails.add(low(e)), names.add(low(u))
    return out


@pytest.mark.parametrize("seed,pool,rest", [(1, 5, 0), (2, 30, 20), (3, 120, None)])
def test_insert_users_one_by_one(spark, monkeypatch, seed, pool, rest):
    r = random.Random(seed)
    if rest is not None:
        monkeypatch.setattr(C, "first_takers", lambda a, b: first_takers(a, b, rest))
    accounts = [(f"E{i}@x", f"U{i}", "Staff", "Active") for i in range(0, pool, 7)]
    requests = [(i, r.choice([f"e{r.randrange(pool)}@x", f"E{r.randrange(pool)}@X"]), f"u{r.randrange(pool)}", "N", "Staff",
                 r.choice(["p"] * 9 + [""])) for i in r.sample(range(10 ** 6), 120)]
    w = C.insert_users(users_of(spark, accounts), spark.createDataFrame(requests, NEW), AS_OF)
    want = insert_one_by_one(accounts, requests)
    assert {x.seq: x.status for x in w.status.collect()} == want
    assert w.rows.count() == sum(s == "applied" for s in want.values())
    table = w.table.collect()
    assert len({low(x.u_email) for x in table}) == len({low(x.u_username) for x in table}) == len(table)


def test_a_request_that_loses_its_username_frees_its_email(spark):
    requests = [(1, "a@x", "one", "N", "Staff", "p"), (2, "b@x", "one", "N", "Staff", "p"), (3, "b@x", "two", "N", "Staff", "p")]
    w = C.insert_users(users_of(spark, []), spark.createDataFrame(requests, NEW), AS_OF)
    assert {x.seq: x.status for x in w.status.collect()} == {1: "applied", 2: "rejected:duplicate:username", 3: "applied"}


def rename_one_by_one(accounts, requests):
    names = {low(e): u for e, u, *_ in accounts}
    out = {}
    for seq, e, u, department in sorted(requests, key=lambda q: q[0]):
        e = low(e)
        if u is None and department is None:
            out[seq] = "rejected:no_fields"
        elif e not in names:
            out[seq] = "not_found"
        elif u is not None and any(low(v) == low(u) for k, v in names.items() if k != e and v is not None):
            out[seq] = "rejected:duplicate:username"
        else:
            out[seq] = "applied"
            if u is not None:
                names[e] = u
    return out, names


@pytest.mark.parametrize("seed,n_accounts,n_names,rest", [(1, 5, 6, None), (2, 12, 12, None), (3, 40, 200, 0), (4, 9, 12, 30)])
def test_update_users_one_by_one(spark, monkeypatch, seed, n_accounts, n_names, rest):
    r = random.Random(seed)
    if rest is not None:        # the rounds, to the end or up to the last few requests
        monkeypatch.setattr(C, "names_in_order", lambda a, b: names_in_order(a, b, rest))
    accounts = [(f"A{i}@x", f"name{i}" if i % 5 else None, "Staff", "Active") for i in range(n_accounts)]
    requests = [(i, r.choice([f"a{r.randrange(n_accounts + 2)}@x", f"A{r.randrange(n_accounts)}@X"]),
                 r.choice([None, f"NAME{r.randrange(n_names)}", f"name{r.randrange(n_names)}"]), r.choice([None, "dep"]))
                for i in r.sample(range(10 ** 6), 60)]
    w = C.update_users(users_of(spark, accounts), spark.createDataFrame(requests, "seq long, email string, username string, department string"))
    status, names = rename_one_by_one(accounts, requests)
    assert {x.seq: x.status for x in w.status.collect()} == status
    assert {low(x.u_email): x.u_username for x in w.table.collect()} == names


def test_names_move_round(spark):
    """a gives up its name, b takes it, c takes b's; an unknown account takes none."""
    requests = [(1, "b@x", "one"), (2, "a@x", "free"), (3, "b@x", "one"), (4, "c@x", "two"), (5, "zz@x", "late"), (6, "a@x", "late")]
    w = C.update_users(users_of(spark, [("a@x", "one", "S", "Active"), ("b@x", "two", "S", "Active"), ("c@x", "three", "S", "Active")]),
                       spark.createDataFrame(requests, "seq long, email string, username string"))
    assert {x.seq: x.status for x in w.status.collect()} == {
        1: "rejected:duplicate:username", 2: "applied", 3: "applied", 4: "applied", 5: "not_found", 6: "applied"}
    assert {x.u_email: x.u_username for x in w.table.collect()} == {"a@x": "late", "b@x": "one", "c@x": "two"}


def test_names_in_order_of_nothing(spark):
    empty = spark.createDataFrame([], "seq long, account string, name string")
    assert names_in_order(empty, empty.select("account", "name")).collect() == []


# ---- one stream of activations, deactivations and deletions ---------------------------------------

def stream_one_by_one(accounts, requests):
    state = {low(e): [t, s] for e, _, t, s in accounts}

    def admins(active):
        return sum(low(t) == "administrator" and (not active or low(s) == "active") for t, s in state.values())

    out, did = {}, {}
    for seq, e, action in sorted(requests, key=lambda q: q[0]):
        e = low(e)
        if e not in state:
            out[seq] = "not_found"
            continue
        kind, status = state[e]
        if action == "deactivate":
            if kind == "Administrator" and admins(True) <= 1:
                out[seq] = "rejected:last_active_administrator"
            elif low(status) != "active":
                out[seq] = "rejected:already_inactive"
            else:
                out[seq], state[e][1], did[e] = "applied", "Inactive", action
        elif action == "activate":
            if low(status) != "inactive":
                out[seq] = "rejected:already_active"
            else:
                out[seq], state[e][1], did[e] = "applied", "Active", action
        elif action == "delete":
            if status == "Active":
                out[seq] = "rejected:active_user"
            elif kind == "Administrator" and admins(False) <= 1:
                out[seq] = "rejected:last_administrator"
            else:
                out[seq] = "applied"
                del state[e]
        else:
            out[seq] = "rejected:unknown_action"
    return out, {e: s for e, (_, s) in state.items()}, did


def check_stream(spark, accounts, requests, bucket):
    w = account_stream(users_of(spark, accounts), spark.createDataFrame(requests, "seq long, email string, action string"), AS_OF, bucket)
    out, state, did = stream_one_by_one(accounts, requests)
    assert {x.seq: x.status for x in w.status.collect()} == out
    table = w.table.collect()
    assert {low(x.u_email): x.u_status for x in table} == state
    for x in table:
        assert (x.deactivated_at is not None) == (did.get(low(x.u_email)) == "deactivate")
    return out


@pytest.mark.parametrize("seed,n,bucket", [(1, 6, 1 << 16), (2, 6, 25), (3, 3, 12), (4, 30, 40)])
def test_stream_one_by_one(spark, seed, n, bucket):
    r = random.Random(seed)
    accounts = [(f"a{i}@x", f"u{i}", r.choice(["Administrator", "Administrator", "administrator", "Staff", None]),
                 r.choice(["Active", "active", "Inactive", "INACTIVE", "Locked", None])) for i in range(n)]
    requests = [(i, r.choice([f"a{r.randrange(n)}@x", f"A{r.randrange(n + 1)}@X"]),
                 r.choice(["activate", "activate", "deactivate", "deactivate", "delete", "rename"])) for i in r.sample(range(10 ** 6), 100)]
    check_stream(spark, accounts, requests, bucket)


def test_two_administrators_take_turns(spark):
    """The guard bites again and again, in several buckets."""
    accounts = [("a@x", "a", "Administrator", "Active"), ("b@x", "b", "Administrator", "Active"), ("c@x", "c", "Staff", "Active")]
    requests = []
    for k in range(5):
        for action, e in (("deactivate", "a@x"), ("deactivate", "b@x"), ("delete", "b@x"), ("activate", "a@x"), ("deactivate", "c@x"),
                          ("activate", "c@x")):
            requests.append((len(requests), e, action))
    out = check_stream(spark, accounts, requests, 7)
    assert sum(s == "rejected:last_active_administrator" for s in out.values()) == 5


def test_last_administrator_of_any_status(spark):
    accounts = [("a@x", "a", "Administrator", "Inactive"), ("b@x", "b", "Administrator", "Inactive"), ("c@x", "c", "Administrator", "Active")]
    requests = [(1, "a@x", "delete"), (2, "c@x", "delete"), (3, "c@x", "deactivate"), (4, "b@x", "activate"), (5, "c@x", "deactivate"),
                (6, "c@x", "delete"), (7, "b@x", "deactivate"), (8, "b@x", "delete"), (9, "c@x", "activate"), (10, None, "delete")]
    for bucket in (1, 2, 100):
        check_stream(spark, accounts, requests, bucket)


def test_empty_stream(spark):
    accounts = [("a@x", "a", "Administrator", "Active")]
    check_stream(spark, accounts, [], 10)
    check_stream(spark, [], [(1, "a@x", "delete")], 10)


def test_stream_job(spark, tmp_dir):
    jobs.publish_tables({"users": users_of(spark, [("a@x", "a", "Administrator", "Active"), ("b@x", "b", "Staff", "Active")])}, tmp_dir)
    requests = spark.createDataFrame([(1, "b@x", "deactivate"), (2, "b@x", "delete"), (3, "a@x", "deactivate")],
                                     "seq long, email string, action string")
    jobs.run_account_stream(spark, tmp_dir, requests, AS_OF)
    assert [x.u_email for x in jobs._table(spark, tmp_dir, "users").collect()] == ["a@x"]
    status = jobs._table(spark, tmp_dir, "account_stream_status").collect()
    assert {x.seq: x.status for x in status} == {1: "applied", 2: "applied", 3: "rejected:last_active_administrator"}


def take_names_in_turn(held, requests):
    """Names per account as they are, and the outcome of each request, in plain Python."""
    own, out = {}, {}
    for account, name in held:
        own.setdefault(account, set()).add(name)
    for seq, account, name in sorted(requests):
        out[seq] = not any(name in names for other, names in own.items() if other != account)
        if out[seq]:
            own[account] = {name}
    return out


@pytest.mark.parametrize("kind,most", [("one name", 3), ("few names", 8), ("there and back", 13)])
def test_many_requests_for_few_names_take_few_rounds(spark, monkeypatch, kind, most):
    """Rounds do not grow with the requests for one name, nor with chains of them."""
    from campusledger.operators import ordering as O
    n = 120
    held = [(f"a{i}", f"own{i}") for i in range(n)]
    if kind == "one name":
        requests = [(i, f"a{i}", "same") for i in range(n)]
    elif kind == "few names":
        requests = [(2 * i + j, f"a{i * 7 % n}", f"own{(i * 7 + 1) % n}" if j == 0 else f"free{i % 5}") for i in range(n) for j in (0, 1)]
    else:       # each takes the one name and gives it up again
        requests = [(2 * i + j, f"a{i}", "same" if j == 0 else f"own{i}") for i in range(n) for j in (0, 1)]
    rounds, plain = [], O.written
    monkeypatch.setattr(O, "written", lambda df, name: rounds.append(name) or plain(df, name))
    got = names_in_order(spark.createDataFrame(requests, "seq long, account string, name string"),
                         spark.createDataFrame(held, "account string, name string"), 20)
    assert {x.seq: x.ok for x in got.collect()} == take_names_in_turn(held, requests)
    assert len(rounds) <= 2 + 6 * most
