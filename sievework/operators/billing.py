"""Quotas, plans and subscription replay."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.operators.skew import (
    first_per_key,
    flag_members,
    rank_top,
    running_before,
    running_max_before,
)
from sievework.session import materialise

# --------------------------------------------------------------------- quota, plans


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def active_subscriptions(subs: DataFrame, as_of: Column) -> DataFrame:
    return subs.filter(
        F.col("status").isin(lx.PRO_STATUSES) & (F.col("current_period_end") > as_of)
    )


def scans_used(scans: DataFrame, as_of: Column) -> DataFrame:
    """Scans per creator in the month of ``as_of``; colleagues' scans do not count."""
    return (
        scans.filter(F.col("created_at") >= F.date_trunc("month", as_of))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("scans_used"))
    )


def monthly_usage(events: DataFrame) -> DataFrame:
    """Counters per (user, month).  ``events``: user_id, ts, kind in (scan, assessment)."""
    return events.groupBy("user_id", month_of(F.col("ts")).alias("period")).agg(
        F.count_if(F.col("kind") == "scan").alias("count"),
        F.count_if(F.col("kind") == "assessment").alias("assessments_used"),
    )


def quota_admission(
    requests: DataFrame, pro_users: DataFrame, key: str = "event_id"
) -> DataFrame:
    """Add ``admitted``: Pro users always, others the first N of the month per kind.

    ``requests``: event_id (unique), user_id, ts, kind.  Only the admitted few per
    (user, month) are ranked and shuffled; they meet the log again by ``event_id``.
    """
    flagged = requests.join(
        pro_users.select("user_id").distinct().withColumn("_pro", F.lit(True)), "user_id", "left"
    ).withColumns(
        {"_pro": F.coalesce("_pro", F.lit(False)), "period": month_of(F.col("ts"))}
    )
    metered = flagged.filter(~F.col("_pro"))
    limits = {"scan": lx.FREE_SCANS, "assessment": lx.FREE_ASSESSMENTS}
    winners = None
    for kind, limit in limits.items():
        top = rank_top(
            metered.filter(F.col("kind") == kind).select("user_id", "period", "ts", key),
            ["user_id", "period"],
            [F.col("ts"), F.col(key)],
            limit,
            "_rank",
        ).select(key)
        winners = top if winners is None else winners.unionByName(top)
    return (
        flag_members(flagged, winners, key, "_won")
        .withColumn("admitted", F.col("_pro") | F.col("_won"))
        .drop("_pro", "_won")
    )


def effective_plan(
    users: DataFrame, subs: DataFrame, org_subs: DataFrame, usage: DataFrame, as_of: Column
) -> DataFrame:
    """Plan, source and usage per user.

    ``users``: user_id, org_id; ``usage``: user_id, period, count, assessments_used.
    """
    live = active_subscriptions(subs, as_of).select("user_id", F.lit(True).alias("_own"))
    live_org = active_subscriptions(org_subs, as_of).select("org_id", F.lit(True).alias("_org"))
    now = usage.filter(F.col("period") == month_of(as_of)).select(
        "user_id", F.col("count").alias("scans_used"), "assessments_used"
    )
    any_sub = subs.select(
        "user_id", F.col("status").alias("status"), "current_period_end"
    )
    own, org = F.coalesce("_own", F.lit(False)), F.coalesce("_org", F.lit(False))
    return (
        users.join(live, "user_id", "left")
        .join(live_org, "org_id", "left")
        .join(any_sub, "user_id", "left")
        .join(now, "user_id", "left")
        .select(
            "user_id",
            "org_id",
            F.when(own | org, "pro").otherwise("free").alias("plan"),
            (own | org).alias("is_pro"),
            (org & ~own).alias("via_org"),
            F.coalesce("scans_used", F.lit(0)).alias("scans_used"),
            F.lit(lx.FREE_SCANS).alias("scan_limit"),
            F.coalesce("assessments_used", F.lit(0)).alias("assessments_used"),
            F.lit(lx.FREE_ASSESSMENTS).alias("assessment_limit"),
            "status",
            "current_period_end",
        )
    )


# ------------------------------------------------------------- subscription replay


def dedupe_events(events: DataFrame, order: str = "arrival_no") -> DataFrame:
    """Each event id once: its first arrival."""
    firsts = first_per_key(events, ["event_id"], order)
    return events.join(firsts.select(order), order, "left_semi")


def billing_fields(events: DataFrame) -> DataFrame:
    """Flatten parsed events of any type to the fields the replay reads.

    ``owner`` is the id named by the event itself: the organisation's when the
    scope says so, else the user's.
    """
    obj = F.col("object")
    meta = obj["metadata"]
    is_org = F.coalesce(meta["scope"], F.lit("user")) == "org"
    checkout = F.col("event_type") == lx.CHECKOUT_EVENT
    named = F.when(is_org, meta["org_id"]).otherwise(
        F.coalesce(
            F.when(checkout, F.nullif(obj["client_reference_id"], F.lit(""))), meta["user_id"]
        )
    )
    return events.select(
        "event_id",
        "event_type",
        "created",
        "arrival_no",
        F.when(is_org, "org").otherwise("user").alias("scope"),
        F.nullif(named, F.lit("")).alias("owner"),
        F.nullif(obj["customer"], F.lit("")).alias("customer"),
        F.when(checkout, obj["subscription"]).otherwise(obj["id"]).alias("subscription_id"),
        F.when(~checkout, F.nullif(obj["status"], F.lit(""))).alias("status"),
        F.timestamp_seconds(obj["current_period_end"]).alias("period_end"),
    )


def only_billing(rows: DataFrame) -> DataFrame:
    """The events that can change an account."""
    return rows.filter(F.col("event_type").isin([*lx.SUBSCRIPTION_EVENTS, lx.CHECKOUT_EVENT]))


def billing_rows(events: DataFrame) -> DataFrame:
    """The fields of the events that can change an account."""
    return billing_fields(only_billing(events))


STORED = "stored"  # a row of the state table, put before all events
EARLIER = 1 << 62
CHUNK = 1_000_000  # arrivals of one key that a task holds at most
FEW = 200_000  # contested events that one task may decide in order of arrival


def _effective(rows: DataFrame) -> DataFrame:
    """The events that can change an account, narrow: ``arrival_no, scope, owner, customer, hard, created``.

    ``hard`` ones (checkouts, stored rows) take their customer whoever holds it.  ``created`` is null where the
    event does not tell how new it is.  All other events can be mapped to nobody.
    """
    hard = F.col("event_type").isin(lx.CHECKOUT_EVENT, STORED)
    able = F.col("customer").isNotNull() & F.when(hard, F.col("owner").isNotNull()).otherwise(
        F.col("status").isNotNull()
    )
    return rows.filter(able).select(
        "arrival_no", "scope", "owner", "customer", hard.alias("hard"),
        F.when(F.col("event_type") != lx.CHECKOUT_EVENT, F.unix_micros("created")).alias("created"),
    )


def _customers(events: DataFrame) -> DataFrame:
    """``scope, customer, first, sole``: first arrival that names an owner, and the owner of a customer that no
    other owner ever names, who in turn never names another customer; null where it is contested."""
    named = events.filter("owner is not null").groupBy("scope", "owner", "customer").agg(
        F.min("arrival_no").alias("first")
    )
    faithful = named.groupBy("scope", "owner").agg(F.count("*").alias("n")).filter("n = 1").select(
        "scope", F.col("owner").alias("sole"), F.lit(True).alias("faithful")
    )
    by_customer = named.groupBy("scope", "customer").agg(
        F.min("first").alias("first"), F.when(F.count("*") == 1, F.min("owner")).alias("sole")
    )
    return by_customer.join(faithful, ["scope", "sole"], "left").select(
        "scope", "customer", "first", F.when(F.col("faithful"), F.col("sole")).alias("sole")
    )


def _newer(last: str) -> Column:
    return F.col(last).isNull() | F.col("created").isNull() | (F.col("created") > F.col(last))


def _settled(events: DataFrame, chunk: int) -> DataFrame:
    """Decisions where one owner and one customer only know each other: nothing can collide, the owner holds
    the customer from the first event that names them, and an event counts if it is newer than all before."""
    mapped = F.col("hard") | F.col("owner").isNotNull() | (F.col("arrival_no") > F.col("first"))
    seen = running_before(
        events.withColumn("mapped", F.coalesce(mapped, F.lit(False))), ["scope", "customer"], "arrival_no",
        {"last": ("max", F.when(F.col("mapped"), F.col("created")))}, chunk,
    )
    return seen.select(
        "arrival_no",
        F.when(F.col("mapped"), F.col("sole")).alias("resolved"),
        F.when(F.col("mapped"), "mapped").otherwise("unmappable").alias("disposition"),
        (F.col("mapped") & (F.col("hard") | _newer("last"))).alias("applied"),
    )


class _Accounts:
    """Accounts of one scope, changed event by event."""

    def __init__(self):
        self.last: dict[str, int | None] = {}  # owner -> time of the newest event applied
        self.born: dict[str, int] = {}
        self.customer: dict[str, str] = {}
        self.owners: dict[str, set[str]] = {}  # customer -> owners that hold it
        self.ages: dict[str, list[tuple[int, str]]] = {}  # customer -> heap of (born, owner), some of which hold it no more
        self.more: dict[str, int] = {}  # customer -> holders besides these, all younger than the oldest of these
        self.changed: set[str] = set()

    def add(self, owner: str, customer: str, created: int | None, born: int) -> None:
        """An account as it was found."""
        self.last[owner], self.born[owner] = created, born
        self._hold(owner, customer)

    def _hold(self, owner: str, customer: str) -> None:
        self.customer[owner] = customer
        self.owners.setdefault(customer, set()).add(owner)
        heapq.heappush(self.ages.setdefault(customer, []), (self.born[owner], owner))

    def oldest(self, customer: str) -> str:
        """The oldest account that holds the customer; those that left are dropped when they come up."""
        ages, holders = self.ages[customer], self.owners[customer]
        while ages[0][1] not in holders:
            heapq.heappop(ages)
        return ages[0][1]

    def put(self, owner: str, customer: str, created: int | None, born: int) -> None:
        self.born.setdefault(owner, born)
        old = self.customer.get(owner)
        if old != customer:
            if old is not None:
                self.owners[old].discard(owner)
            self._hold(owner, customer)
        if created is not None or owner not in self.last:
            self.last[owner] = created
        self.changed.add(owner)

    def apply(self, hard, owner, customer, created, born) -> tuple[str | None, str, bool]:
        """Resolved owner, disposition, and whether the event changes the account; ``born`` tells an account's age."""
        holders = self.owners.get(customer, ())
        if not hard:
            if owner not in self.last and holders:
                owner = self.oldest(customer)
            if owner is None:
                return None, "unmappable", False
            if customer in self.more or any(h != owner for h in holders):
                return owner, "collision", False
            last = self.last.get(owner)
            if last is not None and created is not None and created <= last:
                return owner, "mapped", False
        self.put(owner, customer, created, born)
        return owner, "mapped", True


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (scope, arrival_no)."""
    current, accounts = None, _Accounts()
    for batch in batches:
        found = []
        fields = ("scope", "hard", "owner", "customer", "created")
        for scope, *event in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in fields), strict=True):
            if scope != current:
                current, accounts = scope, _Accounts()
            found.append(accounts.apply(*event, len(accounts.born)))
        columns = zip(*found, strict=True) if found else ((), (), ())
        names = ("resolved", "disposition", "applied")
        yield pd.DataFrame({"arrival_no": batch["arrival_no"], **{n: pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)}})


# Kinds of rows that a stretch of events is replayed from, in the order in which they are read.
_ACCOUNT, _CROWD, _EVENT = 0, 1, 2
_STRETCH_IN = (
    "scope string, part long, kind int, arrival_no long, owner string, customer string, created long, born long, "
    "hard boolean, others long"
)
_STRETCH_OUT = (
    "scope string, part long, kind int, arrival_no long, owner string, customer string, created long, born long, "
    "disposition string, applied boolean"
)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (scope, part, kind, arrival_no): the accounts that a stretch of events meets, then the events.

    Returns a row per event, with the owner it goes to, and one per account that was changed, as it was at the end."""
    schema = pa.schema([
        ("scope", pa.string()), ("part", pa.int64()), ("kind", pa.int32()), ("arrival_no", pa.int64()), ("owner", pa.string()),
        ("customer", pa.string()), ("created", pa.int64()), ("born", pa.int64()), ("disposition", pa.string()), ("applied", pa.bool_()),
    ])
    current, accounts = None, _Accounts()

    def ends() -> list[tuple]:
        return [
            (*current, _ACCOUNT, None, o, accounts.customer[o], accounts.last[o], accounts.born[o], None, None)
            for o in accounts.changed
        ]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        rows = []
        names = [f.split()[0] for f in _STRETCH_IN.split(", ")]
        columns = (batch.column(n).to_pylist() for n in names)
        for scope, part, kind, arrival_no, owner, customer, created, born, hard, others in zip(*columns, strict=True):
            if (scope, part) != current:
                rows += ends()
                current, accounts = (scope, part), _Accounts()
            if kind == _EVENT:
                to, fate, applied = accounts.apply(hard, owner, customer, created, arrival_no)
                rows.append((scope, part, kind, arrival_no, to, None, None, None, fate, applied))
            else:
                accounts.add(owner, customer, created, born)
                if others:
                    accounts.more[customer] = others
        yield out(rows)
    yield out(ends())


def _known_at(named: DataFrame, ends: DataFrame) -> DataFrame:
    """Lines of accounts: a row per (account, stretch that names or changes it) with the account as it was when the
    stretch began (``old``, null if it was not there) and when it was over (``new``); ``asks`` where it is named."""
    rows = named.select("scope", "owner", "part", F.lit(True).alias("asks")).join(
        ends.select("scope", "owner", "part", F.struct("customer", "created").alias("end"), "born"),
        ["scope", "owner", "part"], "full",
    )
    line = Window.partitionBy("scope", "owner").orderBy("part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    until = line.rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead("part").over(line)
    return rows.select(
        "scope", "owner", "part", F.coalesce("asks", F.lit(False)).alias("asks"),
        F.last("end", ignorenulls=True).over(before).alias("old"), F.min("born").over(before).alias("old_born"),
        F.last("end", ignorenulls=True).over(until).alias("new"), F.min("born").over(until).alias("new_born"),
        after.alias("next"), F.lead(F.coalesce("asks", F.lit(False))).over(line).alias("next_asks"),
    )


def _covers(first: str, last: str, levels: int) -> str:
    """SQL: the fewest dyadic ranges ``(level, place)`` that make up the stretches ``first`` to ``last``."""
    low = f"(({first} + shiftleft(1L, l) - 1) div shiftleft(1L, l))"
    high = f"(({last} + 1) div shiftleft(1L, l) - 1)"
    return (
        f"filter(flatten(transform(sequence(0, {levels}), l -> array("
        f"CASE WHEN {low} <= {high} AND {low} % 2 = 1 THEN named_struct('level', l, 'place', {low}) END, "
        f"CASE WHEN {low} <= {high} AND {high} % 2 = 0 THEN named_struct('level', l, 'place', {high}) END))), "
        "x -> x IS NOT NULL)"
    )


def _found_by(named: DataFrame, asked: DataFrame, ends: DataFrame, parts: int) -> DataFrame:
    """What every stretch finds when it begins, given how accounts were left by the ones before: the accounts it names,
    and per customer it names the oldest of the other holders and how many more there are.

    The others do not move while the stretch lasts, as only events that name an account move it.  The stretches an account
    lasts without being named are taken apart into dyadic ranges, so a stretch meets one row per level and customer.
    """
    lines = materialise(_known_at(named, ends), "ownership")
    own = lines.filter("asks and old is not null").select(
        "scope", "part", F.lit(_ACCOUNT).alias("kind"), "owner", "old.customer", "old.created",
        F.col("old_born").alias("born"), F.lit(0).cast("long").alias("others"),
    )
    levels = max(parts - 1, 1).bit_length()
    idle = lines.filter("new is not null").select(
        "scope", "new.customer", F.struct(F.col("new_born").alias("born"), "owner", "new.created").alias("holder"),
        (F.col("part") + 1).alias("since"),
        F.coalesce(F.col("next") - F.when(F.col("next_asks"), 1).otherwise(0), F.lit(parts - 1)).alias("until"),
    )
    ranges = (
        idle.filter("since <= until").withColumn("at", F.explode(F.expr(_covers("since", "until", levels))))
        .groupBy("scope", "customer", "at.level", "at.place")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("holder").alias("oldest"))
    )
    meets = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn(
        "place", F.expr("part div shiftleft(1L, level)")
    )
    crowd = (
        meets.join(ranges, ["scope", "customer", "level", "place"])
        .groupBy("scope", "part", "customer")
        .agg(F.sum("holders").alias("holders"), F.min("oldest").alias("oldest"))
        .select(
            "scope", "part", F.lit(_CROWD).alias("kind"), "oldest.owner", "customer", "oldest.created",
            "oldest.born", (F.col("holders") - 1).alias("others"),
        )
    )
    return own.unionByName(crowd)


def _by_stretches(events: DataFrame, size: int) -> DataFrame:
    """Decisions of stretches of about ``size`` events, each replayed from the accounts that the ones before it leave.

    At first the accounts are guessed: events that take their customer whoever holds it count, no others.  A stretch
    that finds other accounts than it was replayed from is replayed again, until none is.  A stretch depends on
    earlier ones only, so every turn settles at least one more; in practice a guess is soon forgotten, as accounts keep
    little of what came before.
    """
    spark = events.sparkSession
    parts = -(-events.count() // size)
    dealt = events.repartitionByRange(max(parts, 1), "scope", "arrival_no").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt.withColumn("part", F.col("_part").cast("long")).drop("_part"), "stretches")
    parts = dealt.agg(F.max("part")).first()[0] + 1
    named = materialise(dealt.filter("owner is not null").select("scope", "owner", "part").distinct(), "ownership")
    asked = materialise(dealt.select("scope", "customer", "part").distinct(), "ownership")
    ends = dealt.filter("hard").groupBy("scope", "part", "owner").agg(
        F.max_by("customer", "arrival_no").alias("customer"), F.max("created").alias("created"), F.min("arrival_no").alias("born")
    )
    schema = "scope string, part long, turn int"
    done, last, turn = None, {}, 0
    while True:
        found = materialise(_found_by(named, asked, ends, parts), "ownership")
        # A stretch is known by two sums over what it finds; the driver holds one row per stretch.
        rows = F.xxhash64("kind", "owner", "customer", "created", "born", "others")
        seen = dealt.select("scope", "part").distinct().join(
            found.groupBy("scope", "part").agg(F.bit_xor(rows).alias("mixed"), F.sum(rows.cast("decimal(20, 0)")).alias("sum")),
            ["scope", "part"], "left",
        )
        now = {(r.scope, r.part): (r.mixed, r.sum) for r in seen.collect()}
        anew = [k for k, v in now.items() if k not in last or last[k][0] != v]
        if not anew:
            break
        last |= {k: (now[k], turn) for k in anew}
        wanted = F.broadcast(spark.createDataFrame([(*k, turn) for k in anew], schema).drop("turn"))
        fields = [f.split()[0] for f in _STRETCH_IN.split(", ")]
        input_rows = (
            dealt.withColumn("kind", F.lit(_EVENT)).unionByName(found, allowMissingColumns=True).join(wanted, ["scope", "part"]).select(*fields)
            .repartition(len(anew), "scope", "part").sortWithinPartitions("scope", "part", "kind", "arrival_no")
        )
        replayed = materialise(input_rows.mapInArrow(_stretches, _STRETCH_OUT).withColumn("turn", F.lit(turn)), "stretches")
        done = replayed if done is None else done.unionByName(replayed)
        # Only the latest replay of a stretch counts.
        current = F.broadcast(spark.createDataFrame([(*k, t) for k, (_, t) in last.items()], schema))
        valid = done.join(current, ["scope", "part", "turn"])
        ends = valid.filter(F.col("kind") == _ACCOUNT).select("scope", "part", "owner", "customer", "created", "born")
        turn += 1
    return valid.filter(F.col("kind") == _EVENT).select("arrival_no", F.col("owner").alias("resolved"), "disposition", "applied")


def _contested(events: DataFrame, chunk: int, few: int) -> DataFrame:
    """Decisions where owners share customers: of up to ``few`` events in order of arrival, one task a scope,
    of more by stretches."""
    events = events.select("arrival_no", "scope", "owner", "customer", "hard", "created")
    if events.limit(few + 1).count() > few:
        return _by_stretches(events, min(chunk, FEW))
    return events.repartition("scope").sortWithinPartitions("scope", "arrival_no").mapInPandas(
        _in_order, "arrival_no long, resolved string, disposition string, applied boolean"
    )


def replay(rows: DataFrame, chunk: int = CHUNK, few: int = FEW) -> DataFrame:
    """Add ``resolved`` owner, ``disposition`` (mapped, collision, unmappable) and ``applied``.

    An event goes to the owner it names; a newcomer, or nobody, gives way to whoever holds the
    customer id at that moment.  An event whose customer id another owner holds by then is refused, and
    one older than what its owner has seen changes nothing.

    Events that name no customer, or no status, are nobody's.  Owners and customers that only know each other
    are decided in one pass.  The others depend on who holds their customer when they arrive, and that on
    earlier decisions.  Up to ``few`` of them are decided one after the other.  Beyond, they are cut into stretches that are
    replayed side by side, each from the accounts that those before leave, until none finds other accounts than it was
    replayed from: then all decisions are those of the order of arrival.  No task holds more than a stretch, of ``chunk``
    events at most, and what it finds.
    """
    rows = materialise(rows, "billing-rows")
    events = materialise(_effective(rows), "billing-events")
    known = events.join(_customers(events), ["scope", "customer"], "left").withColumn(
        "contested", F.col("sole").isNull() & F.col("first").isNotNull()
    )
    known = materialise(known, "billing-known")
    decided = _settled(known.filter(~F.col("contested")), chunk).unionByName(
        _contested(known.filter("contested"), chunk, few)
    )
    return rows.join(decided, "arrival_no", "left").withColumns(
        {
            "disposition": F.coalesce("disposition", F.lit("unmappable")),
            "applied": F.coalesce("applied", F.lit(False)),
        }
    )


def resolve_owner(rows: DataFrame) -> DataFrame:
    """Add ``resolved`` owner and ``disposition`` at the moment each event arrives."""
    return replay(rows).drop("applied")


def customer_collisions(rows: DataFrame) -> DataFrame:
    return resolve_owner(rows).filter(F.col("disposition") == "collision")


def applied_events(
    rows: DataFrame, keys: list[str], chunk_rows: int = 1_000_000
) -> DataFrame:
    """Add ``applied``: newer than everything of its key that arrived before.

    Skipped events never raise the maximum, so the running maximum over all
    earlier arrivals equals the one over applied arrivals.  An event without a
    creation time always applies.
    """
    chunk = F.floor(F.col("arrival_no") / chunk_rows)
    seen = running_max_before(rows, keys, "arrival_no", F.col("created"), "_seen", chunk)
    return seen.withColumn(
        "applied",
        F.col("created").isNull() | F.col("_seen").isNull() | (F.col("created") > F.col("_seen")),
    ).drop("_seen")


def subscription_state(replayed: DataFrame) -> DataFrame:
    """State per owner after the replay, from partial aggregates only."""
    live = replayed.filter("applied")
    # A stored row speaks for the events behind it; while these were checkouts, it has no status.
    change = ~F.coalesce(
        (F.col("event_type") == lx.CHECKOUT_EVENT) | F.col("from_checkout"), F.lit(False)
    ) if "from_checkout" in replayed.columns else F.col("event_type") != lx.CHECKOUT_EVENT
    at = F.col("arrival_no")
    first = F.when(F.col("event_type") == STORED, at + F.lit(EARLIER)).otherwise(at)

    def last(value: str, when: Column) -> Column:
        return F.max_by(value, F.when(when, at))

    return live.groupBy("scope", F.col("resolved").alias("owner")).agg(
        last("customer", F.lit(True)).alias("customer"),
        last("subscription_id", F.col("subscription_id").isNotNull()).alias("subscription_id"),
        F.coalesce(last("status", change), F.lit("incomplete")).alias("status"),
        last("period_end", change).alias("current_period_end"),
        F.max(F.when(change, F.col("created"))).alias("last_event_at"),
        # Nothing but checkouts so far: the status is a placeholder, not an event's.
        (F.count_if(change) == 0).alias("from_checkout"),
        F.min(first).alias("since"),
    )
