"""Which operations of a change set the target takes, as if they came one after the other, and the ledger of those it took.

An operation (scope columns, key, operation, operation_id, payload, base_revision, an order) is judged by the rules that a
target service applies at its turn. Whether an address is free then depends on earlier operations: on the one by which
its owner gives it up, and on others that want it. With one operation a record every operation waits for at most one
other, the owner's, which comes earlier; so the waits form chains, and chains of any length are settled in as many
rounds as their length has binary digits, by pointer jumping. Rounds are written to the shared folder.

Of operations that share an id in a change set the first counts: equal requests share its outcome, others are refused
(`key_reused`). Of several operations on a record the first counts, the others are refused (`second_operation`): they name
a revision that nobody has seen yet. An address that several target records hold is free only when none holds it, and
that is never in one change set. Blank addresses are free to all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.shipping import Steps, spread_join

LEDGER = "operation_id string, request_hash string, operation string"


def request_hash(key: str) -> Column:
    """The digest of all that an operation asks for, whatever the order of its payload."""
    asked = F.struct("operation", F.col(key).cast("string").alias("key"), "base_revision", F.array_sort(F.map_entries("payload")).alias("payload"))
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256)


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out &= left[a] == right[b]
    return out


def _settled(chains: DataFrame, by: list[str], steps: Steps) -> DataFrame:
    """by, taken of rows (by, parent, taken): a row without `taken` has the one of the row that its parent names."""
    turn, node = 0, [f"_{c}" for c in by]
    while not chains.filter("taken is null").isEmpty():
        up = chains.select(*(F.col(c).alias(n) for c, n in zip(by, node, strict=True)), F.col("parent").alias("_parent"), F.col("taken").alias("_taken"))
        on = [(c, n) for c, n in zip(by[:-1], node[:-1], strict=True)] + [("parent", node[-1])]
        open_ = chains.filter("taken is null")
        moved = open_.join(up, _same(open_, up, on)).select(*by, F.col("_parent").alias("parent"), F.col("_taken").alias("taken"))
        chains = steps.table(chains.filter("taken is not null").unionByName(moved), f"chains-{turn}")
        turn += 1
    return chains.select(*by, "taken")


def admit(changes: DataFrame, target: DataFrame, key: str, email: str, ledger: DataFrame | None = None, scope: Sequence[str] = (), order: str | None = None, steps: Steps | None = None) -> DataFrame:
    """changes with request_hash, replayed (the ledger, or this set, took the same request before) and error: key_reused,
    second_operation, exists, not_found, stale_revision, email_taken, or null. One row for each row of changes. scope
    names columns, such as an organisation, that changes, target and ledger share; without an order the ids count.
    A DELETE without base_revision takes any revision."""
    spark = changes.sparkSession
    steps = steps or Steps(spark)
    by, names = [*scope, key], changes.columns
    c = changes.withColumns({"request_hash": request_hash(key), "_row": F.monotonically_increasing_id()})
    c = steps.table(c.withColumn("_at", F.struct(F.col(order or "operation_id").alias("order"), "_row")), "changes")
    firsts = c.groupBy(*scope, "operation_id").agg(F.min_by(F.struct("_at", "request_hash"), "_at").alias("_first"))
    c = c.join(firsts, [*scope, "operation_id"])
    c = c.withColumn("_again", F.col("_at") != F.col("_first._at")).withColumn("_reused", F.col("request_hash") != F.col("_first.request_hash"))
    if ledger is not None:
        held = ledger.select(*scope, "operation_id", F.col("request_hash").alias("_held"))
        c = c.join(held, [*scope, "operation_id"], "left")
    else:
        c = c.withColumn("_held", F.lit(None).cast("string"))
    # the first operation of each record that is neither a replay nor a reused id
    fresh = ~F.col("_again") & F.col("_held").isNull()
    c = steps.table(c, "read")
    turns = c.filter(fresh).groupBy(*by).agg(F.min("_at").alias("_turn"))
    t = target.select(*by, F.col("revision").alias("_revision"), text.nonblank(F.lower(F.col(email))).alias("_email"), F.lit(True).alias("_there"))
    c = c.join(turns, by, "left").join(t, by, "left")
    create, delete, at_rest = F.col("operation") == "CREATE", F.col("operation") == "DELETE", F.col("base_revision").isNull()
    error = (
        F.when(F.col("_held").isNotNull(), F.when(F.col("_held") != F.col("request_hash"), "key_reused")).when(F.col("_again"), F.when(F.col("_reused"), "key_reused"))
        .when(F.col("_at") != F.col("_turn"), "second_operation").when(create & F.col("_there"), "exists").when(~create & F.col("_there").isNull(), "not_found")
        .when(~create & ~(delete & at_rest) & ~F.col("base_revision").eqNullSafe(F.col("_revision")), "stale_revision")
    )
    wanted = text.nonblank(F.lower(F.try_element_at("payload", F.lit(email))))
    c = c.withColumns({"error": error, "_fresh": fresh, "_wanted": F.when(~delete & ~wanted.eqNullSafe(F.col("_email")), wanted)})
    says = F.coalesce(F.map_contains_key("payload", F.lit(email)), F.lit(False))
    cleared = delete | (F.col("operation") == "REPLACE") & wanted.isNull() | (F.col("operation") == "UPDATE") & says & wanted.isNull()
    gives = F.col("_email").isNotNull() & (F.col("_wanted").isNotNull() | cleared)
    c = steps.table(c.withColumn("_gives", gives), "judged")
    ok = c.filter("_fresh and error is null")
    # who holds an address, and from when on the holder's own operation may give it up
    owners = target.select(*scope, F.col(key).alias("_owner"), text.nonblank(F.lower(F.col(email))).alias("_wanted")).filter("_wanted is not null")
    owners = owners.groupBy(*scope, "_wanted").agg(F.min("_owner").alias("_owner"), F.count("*").alias("_owners"))
    givers = ok.filter("_gives").select(*scope, F.col("_email").alias("_wanted"), F.col(key).alias("_owner"), F.col("_at").alias("_given"))
    holders = owners.join(givers, [*scope, "_wanted", "_owner"], "left").withColumn("_given", F.when(F.col("_owners") == 1, F.col("_given")))
    takers = steps.table(ok.filter("_wanted is not null").select(*by, "_wanted", "_at"), "takers")
    holders = takers.groupBy(*scope, "_wanted").agg(F.count("*").alias("n")).join(holders, [*scope, "_wanted"], "left")
    placed = spread_join(takers, steps.table(holders, "holders"), [*scope, "_wanted"])
    possible = steps.table(placed.filter("_owner is null or _given < _at").select(*by, "_wanted", "_at", F.col("_owner").alias("parent")), "possible")
    winners = possible.groupBy(*scope, "_wanted").agg(F.min_by(F.struct(F.col(key).alias("key"), "parent"), "_at").alias("w")).select(*scope, F.col("w.key").alias(key), F.col("w.parent").alias("parent"), F.lit(True).alias("_won"))
    nodes = ok.select(*by, "_wanted").join(winners, by, "left")
    taken = F.when(F.col("_wanted").isNull(), True).when(F.col("_won").isNull(), False).when(F.col("parent").isNull(), True)
    chains = steps.table(nodes.select(*by, "parent", taken.alias("taken")), "chains")
    c = c.join(_settled(chains, by, steps), by, "left")
    c = c.withColumn("error", F.when(F.col("_fresh") & F.col("error").isNull() & ~F.col("taken"), "email_taken").otherwise(F.col("error")))
    c = steps.table(c.select(*names, "request_hash", "error", "_fresh", "_again", "_held", "_reused"), "settled")
    outcome = c.filter("_fresh").select(*scope, "operation_id", F.col("error").alias("_error"))
    c = c.join(outcome, [*scope, "operation_id"], "left")
    repeat = F.col("_again") & F.col("_held").isNull() & ~F.col("_reused")
    replayed = F.col("error").isNull() & F.when(F.col("_held").isNotNull(), True).otherwise(repeat & F.col("_error").isNull())
    return c.select(*names, "request_hash", F.when(repeat, F.col("_error")).otherwise(F.col("error")).alias("error"), replayed.alias("replayed"))


def to_apply(admitted: DataFrame) -> DataFrame:
    """Operations that change the target: admitted ones, not replays."""
    return admitted.filter("error is null and not replayed")


def remembered(admitted: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The rows that a change set adds to the ledger, which only grows: refused operations may come again."""
    return to_apply(admitted).select(*scope, "operation_id", "request_hash", "operation")
