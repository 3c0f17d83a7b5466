"""Activations, deactivations and deletions of accounts in one stream.

The requests take effect in the order of ``seq``, whatever their kind, and the
guards of the last administrator look at the accounts as they are at that moment.
A request's outcome thus depends on its account's state and on two running counts,
the active administrators and all administrators.

The stream is cut into buckets of at most ``BUCKET`` requests in order, and scanned
like a prefix sum:

1. each bucket folds the requests of each account into a transfer function, as if no
   guard ever held anything back. A state is one of five letters, so a function is a
   word of five letters, and composing two is ``translate``;
2. composing the transfers of an account bucket by bucket gives its state at the start
   of each bucket; the changes of all accounts in a bucket, summed over the buckets
   before, give the counts there;
3. each bucket then runs its requests one by one from these states and counts.

Where a guard holds a change back in some bucket, the first such bucket is still
exact (nothing before it was held back): its accounts' transfers are replaced by what
they really became, and steps 2 and 3 are repeated. So the rounds are one more than
the buckets in which a guard bites, and one round is the rule.

A task holds one bucket, or one account's list of transfers (one per bucket at most),
never all requests of an account or all accounts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusledger.functions.semantics import as_of_column, ci_eq
from campusledger.operators.changes import USER_ORDER, Written, sequence_ids
from campusledger.session import written

ACTIVATE, DEACTIVATE, DELETE = "activate", "deactivate", "delete"
BUCKET = 1 << 16

# States: exactly 'Active', active in another spelling, inactive, any other status, no such account.
STATES = "AaIOX"
_ACTIVE = "Aa"
# What each action makes of each state when no guard holds it back.
_MAKES = {DEACTIVATE: "IIIOX", ACTIVATE: "AaAOX", DELETE: "AXXXX"}


def _state(status: Column) -> Column:
    return (F.when(status == "Active", "A").when(ci_eq(status, "Active"), "a")
            .when(ci_eq(status, "Inactive"), "I").otherwise("O"))


def _transfers(rows: pa.Table) -> pa.Table:
    """One bucket: the transfer function of each account."""
    made: dict = {}
    for row in rows.sort_by("seq").to_pylist():
        step = _MAKES.get(row["action"], STATES)
        made[row["e"]] = "".join(step[STATES.index(s)] for s in made.get(row["e"], STATES))
    return pa.table({"bucket": pa.repeat(rows["bucket"][0], len(made)), "e": pa.array(list(made), pa.string()),
                     "f": pa.array(list(made.values()), pa.string())})


def _run_bucket(rows: pa.Table, accounts: pa.Table) -> pa.Table:
    """One bucket: its requests one by one. ``held`` marks a change that a guard held back."""
    known = {a["e"]: a for a in accounts.to_pylist()}
    state = {e: a["came"] for e, a in known.items()}
    active, total = rows["active"][0].as_py(), rows["total"][0].as_py()
    out = []
    for row in rows.sort_by("seq").to_pylist():
        e, action = row["e"], row["action"]
        s = state.get(e, "X")
        held, status = False, "applied"
        if s == "X":
            status = "not_found"
        elif action == DEACTIVATE:
            if known[e]["guarded"] and active <= 1:
                status, held = "rejected:last_active_administrator", s in _ACTIVE
            elif s not in _ACTIVE:
                status = "rejected:already_inactive"
        elif action == ACTIVATE:
            if s != "I":
                status = "rejected:already_active"
        elif action == DELETE:
            if s == "A":
                status = "rejected:active_user"
            elif known[e]["guarded"] and total <= 1:
                status, held = "rejected:last_administrator", True
        else:
            status = "rejected:unknown_action"
        if status == "applied":
            now = _MAKES[action][STATES.index(s)]
            if known[e]["admin"]:
                active += (now in _ACTIVE) - (s in _ACTIVE)
                total -= now == "X"
            state[e] = now
        out.append((row["seq"], e, status, held))
    seq, e, status, held = zip(*out)
    return pa.table({"bucket": pa.repeat(rows["bucket"][0], len(out)), "seq": pa.array(seq, pa.int64()),
                     "e": pa.array(e, pa.string()), "status": pa.array(status, pa.string()), "held": pa.array(held, pa.bool_()),
                     "left": pa.array([state.get(x) for x in e], pa.string())})


_DONE = "bucket long, seq long, e string, status string, held boolean, left string"


def _arrivals(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """bucket, e, came, left, admin, guarded: each account's state before and after each bucket it is in."""
    # state -> state through one function: the letter of f at the state's place
    letter = "substring(t.f, instr('%s', {s}), 1)" % STATES
    walk = f"""aggregate(ts, named_struct('s', start, 'out', cast(array() as array<struct<bucket:bigint,came:string,left:string>>)),
        (acc, t) -> named_struct('s', {letter.format(s='acc.s')}, 'out', concat(acc.out, array(named_struct(
            'bucket', t.bucket, 'came', acc.s, 'left', {letter.format(s='acc.s')})))), acc -> acc.out)"""
    listed = transfers.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("bucket", "f"))).alias("ts"))
    return (listed.join(accounts, "e").select("e", "admin", "guarded", F.explode(F.expr(walk)).alias("w"))
            .select("w.bucket", "e", "w.came", "w.left", "admin", "guarded"))


def account_stream(users: DataFrame, requests: DataFrame, as_of=None, bucket: int = BUCKET) -> Written:
    """Apply ``requests`` (seq, email, action) in the order of ``seq``.

    Actions are ``activate``, ``deactivate`` and ``delete``; any other is
    ``rejected:unknown_action``. E-mails are compared ignoring case. A repeated
    request is judged like any other, by the state it meets; a request for an
    account deleted earlier in the stream is ``not_found``.
    """
    ts = as_of_column(as_of)
    asked = requests.select(F.col("seq").cast("bigint").alias("seq"), "email", F.lower("email").alias("e"),
                            F.lower("action").alias("action"))
    asked = sequence_ids(asked, ["seq"], F.lit(-1), "_n").withColumn("bucket", F.expr(f"_n div {bucket}")).drop("_n")
    asked = written(asked, "accounts")
    admin = F.coalesce(ci_eq("u_type", "Administrator"), F.lit(False))
    counts = users.agg(F.count_if(admin & F.coalesce(ci_eq("u_status", "Active"), F.lit(False))).alias("a"),
                       F.count_if(admin).alias("t")).first()       # two numbers
    accounts = written(users.select(F.lower("u_email").alias("e"), "u_type", "u_status")
                    .join(asked.select("e").distinct(), "e", "left_semi")
                    .groupBy("e").agg(F.min(F.struct(
                        _state(F.col("u_status")).alias("start"), admin.alias("admin"),
                        F.coalesce(F.col("u_type") == "Administrator", F.lit(False)).alias("guarded"))).alias("x"))
                    .select("e", "x.*"), "accounts")
    transfers = written(asked.select("bucket", "seq", "e", "action").groupBy("bucket")
                     .applyInArrow(_transfers, "bucket long, e string, f string"), "accounts")
    exact = -1          # buckets up to this one hold exact transfers
    while True:
        arrived = written(_arrivals(transfers, accounts), "accounts")

        def change(condition: Column) -> Column:
            return F.sum(F.when(F.col("admin"), condition.cast("int")).otherwise(0))

        shift = arrived.groupBy("bucket").agg(
            (change(F.col("left").isin(*_ACTIVE)) - change(F.col("came").isin(*_ACTIVE))).alias("da"),
            (change(F.col("left") != "X") - change(F.col("came") != "X")).alias("dt"))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)     # one row per bucket
        at = (asked.select("bucket").distinct().join(shift, "bucket", "left")
              .select("bucket", (F.coalesce(F.sum("da").over(before), F.lit(0)) + counts["a"]).alias("active"),
                      (F.coalesce(F.sum("dt").over(before), F.lit(0)) + counts["t"]).alias("total")))
        todo = asked.join(at, "bucket").select("bucket", "seq", "e", "action", "active", "total")
        done = written(todo.groupBy("bucket").cogroup(arrived.groupBy("bucket")).applyInArrow(_run_bucket, _DONE), "accounts")
        first = done.where(F.col("held") & (F.col("bucket") > exact)).agg(F.min("bucket")).first()[0]
        if first is None:
            break
        exact = first
        became = done.where(F.col("bucket") == first).select(
            "bucket", "e", F.repeat("left", len(STATES)).alias("f")).distinct().where(F.col("f").isNotNull())
        transfers = written(transfers.where(F.col("bucket") != first).unionByName(became), "accounts")

    status = asked.select("seq", "email", "e", "action").join(done.select("seq", "status"), "seq")
    last = (status.where(F.col("status") == "applied").groupBy("e").agg(F.max_by("action", "seq").alias("_did")))
    keyed = users.withColumn("e", F.lower("u_email")).join(last, "e", "left")
    did = F.col("_did")
    sets = {"u_status": F.when(did == DEACTIVATE, "Inactive").when(did == ACTIVATE, "Active").otherwise(F.col("u_status")),
            "deactivated_at": F.when(did == DEACTIVATE, ts).when(did.isNull(), F.col("deactivated_at"))}
    after = keyed.select(*(sets.get(c, F.col(c)).alias(c) for c in USER_ORDER), "_did")
    table = after.where(F.coalesce(did != DELETE, F.lit(True))).drop("_did")
    rows = after.where(did.isNotNull() & (did != DELETE)).drop("_did")
    return Written(table, rows, status.select("seq", "email", "status"))
