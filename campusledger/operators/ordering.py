"""Requests whose outcome depends on the outcome of earlier ones (O48e, O49e, O69).

The account screens handle one request after the other; a batch must leave what
they would leave. The outcomes are worked out in rounds over the requests that are
still open, and each round decides all that no earlier open request can touch:

* :func:`first_takers` -- unique keys, given out in the order of ``seq``;
* :func:`names_in_order` -- accounts that change their unique name, freeing the old one.

Every round is written to the shared folder and read back, so a lost executor costs a
re-read. Rounds are few unless requests form long chains (each conflicting with the
next on another key). As soon as no more than ``REST`` requests are open, one task
takes them one by one, which bounds what it holds. For names, a round that decides
fewer than ``REST`` is followed by a task that takes the earliest ``REST`` open ones,
so there are never more rounds than ``REST`` fits into the batch.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.session import written

REST = 50_000       # open requests that one task may finish


def _in_one_task(open_: DataFrame, other: DataFrame, work, schema: str) -> DataFrame:
    """``work(open, other)`` over all rows of two bounded tables."""
    one = F.lit(0).alias("_one")
    return open_.groupBy(one).cogroup(other.groupBy(one)).applyInArrow(work, schema)


def _take_in_turn(keys: list[str]):
    def run(open_: pa.Table, _other: pa.Table) -> pa.Table:
        taken: list[set] = [set() for _ in keys]
        got = []
        for row in open_.sort_by("seq").to_pylist():
            if not any(row[k] in t for k, t in zip(keys, taken)):
                got.append(row["seq"])
                for k, t in zip(keys, taken):
                    if row[k] is not None:
                        t.add(row[k])
        return pa.table({"seq": pa.array(got, pa.int64())})
    return run


def first_takers(requests: DataFrame, keys: list[str], rest: int = REST) -> DataFrame:
    """The ``seq`` of the requests that get all their keys, handed out in order.

    A request fails if an earlier one that did not fail took one of its keys. In
    each round the earliest open request of each of its keys wins; whoever asks for
    a key of a winner fails and frees its other keys. A NULL key is in nobody's way.
    """
    wait = written(requests.select(F.col("seq").cast("bigint").alias("seq"), *keys), "requests")
    got = wait.select("seq").limit(0)
    while (left := wait.count()) > rest:
        marked = wait
        for i, k in enumerate(keys):
            first = wait.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("seq").alias(f"_m{i}"))
            marked = marked.join(first, k, "left")
        wins = F.lit(True)
        for i in range(len(keys)):
            wins = wins & (F.coalesce(F.col(f"_m{i}"), F.col("seq")) == F.col("seq"))
        marked = written(marked.select("seq", *keys, wins.alias("_wins")), "requests")
        winners, wait = marked.where("_wins"), marked.where("NOT _wins").drop("_wins")
        for k in keys:
            wait = wait.join(winners.select(k), k, "left_anti")
        got = got.unionByName(winners.select("seq"))
        wait = written(wait.select("seq", *keys), "requests")
    if left:
        got = got.unionByName(_in_one_task(wait, wait.limit(0), _take_in_turn(keys), "seq bigint"))
    return got


def _rename_in_turn(open_: pa.Table, held: pa.Table) -> pa.Table:
    holders: dict[str, set] = {}
    own: dict[str, set] = {}
    for row in held.to_pylist():
        holders.setdefault(row["name"], set()).add(row["account"])
        own.setdefault(row["account"], set()).add(row["name"])
    rows, ok = open_.sort_by("seq"), []
    for row in rows.to_pylist():
        account, name = row["account"], row["name"]
        free = not holders.get(name, set()) - {account}
        if free:
            for former in own.get(account, ()):
                holders[former].discard(account)
            holders.setdefault(name, set()).add(account)
            own[account] = {name}
        ok.append(free)
    return rows.select(["seq", "account", "name"]).append_column("ok", pa.array(ok, pa.bool_()))


def _one_by_one(open_: DataFrame, names: DataFrame) -> DataFrame:
    """The open requests with their outcome, taken in turn by one task."""
    return _in_one_task(open_, names, _rename_in_turn, "seq bigint, account string, name string, ok boolean")


def _of_requests(names: DataFrame, requests: DataFrame) -> DataFrame:
    """The names held by the requests' accounts, and the holders of the names they ask for."""
    return names.join(requests.select("account").distinct(), "account", "left_semi").unionByName(
        names.join(requests.select("name").distinct(), "name", "left_semi").select("account", "name")).distinct()


def _after(names: DataFrame, turn: DataFrame) -> DataFrame:
    """The names held once the decided requests of ``turn`` took effect."""
    taken = turn.where("ok").groupBy("account").agg(F.max_by("name", "seq").alias("name"))
    return names.join(taken.select("account"), "account", "left_anti").unionByName(taken)


def names_in_order(requests: DataFrame, held: DataFrame, rest: int = REST) -> DataFrame:
    """``seq`` and ``ok`` of requests ``(seq, account, name)`` for a unique name (O49e).

    ``held`` (account, name) are the names before the batch. A request fails if
    another account holds the name when its turn comes; one that succeeds gives up
    the account's former names. A request touches its account, the name it asks for
    and the names it would free, so the earliest open one on everything it touches
    can be decided. So can every request for a name whose holder has no open request
    before it: only its own request makes an account give a name up.
    """
    wait = written(requests.select(F.col("seq").cast("bigint").alias("seq"), "account", "name"), "requests")
    names = written(_of_requests(held, wait), "requests")
    done = wait.select("seq", F.lit(True).alias("ok")).limit(0)
    never = F.lit((1 << 63) - 1)
    while (left := wait.count()) > rest:
        turns = wait.groupBy("account").agg(F.min("seq").alias("_turn"))
        steady = names.join(turns, "account", "left").groupBy("name").agg(F.max(F.struct(
            F.coalesce("_turn", never).alias("until"), F.col("account").alias("holder"))).alias("_s"))
        lost = (F.col("_s.until") > F.col("seq")) & (F.col("_s.holder") != F.col("account"))
        marked = written(wait.join(steady, "name", "left").select(
            "seq", "account", "name", F.coalesce(lost, F.lit(False)).alias("_lost")), "requests")
        done = done.unionByName(marked.where("_lost").select("seq", F.lit(False).alias("ok")))
        wait = marked.where("NOT _lost").drop("_lost")
        freed = wait.select("seq", "account").join(names, "account")
        touched = (wait.select("seq", F.concat(F.lit("a:"), "account").alias("key"))
                   .unionByName(wait.select("seq", F.concat(F.lit("n:"), "name").alias("key")))
                   .unionByName(freed.select("seq", F.concat(F.lit("n:"), "name").alias("key"))))
        first = touched.groupBy("key").agg(F.min("seq").alias("_first"))
        ready = touched.join(first, "key").groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("_first")).alias("_ready"))
        turn = wait.join(ready.where("_ready").select("seq"), "seq")
        others = names.select(F.col("account").alias("_holder"), "name")
        clash = (turn.join(others, "name").where(F.col("_holder") != F.col("account")).select("seq").distinct()
                 .withColumn("_clash", F.lit(True)))
        turn = written(turn.join(clash, "seq", "left").select("seq", "account", "name", F.col("_clash").isNull().alias("ok")), "requests")
        names = written(_after(names, turn), "requests")
        done = done.unionByName(turn.select("seq", "ok"))
        wait = written(wait.join(turn.select("seq"), "seq", "left_anti").select("seq", "account", "name"), "requests")
        still = wait.count()
        if still > rest > left - still:
            last = wait.orderBy("seq").select("seq").limit(rest).agg(F.max("seq")).first()[0]      # one number
            early = wait.where(F.col("seq") <= last)
            turn = written(_one_by_one(early, _of_requests(names, early)), "requests")
            names = written(_after(names, turn), "requests")
            done = done.unionByName(turn.select("seq", "ok"))
            wait = wait.where(F.col("seq") > last)
    if left:
        done = done.unionByName(_one_by_one(wait, names).select("seq", "ok"))
    return done
