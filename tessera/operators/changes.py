"""Logs of property changes: (obj, prop, val, seq), where seq is a total order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dml import free_name, numbered
from tessera.session import checkpointed

#: Flags of a property's options.
INIT, ON_DEMAND, SERVER, CLIENT, RECEIVE_ONLY, CONSTANT, STATIC, RESET_STATE, SEND_ONLY = (1 << i for i in range(9))
#: Sync modes.
MODES = ("Enabled", "Disabled", "Automatic", "ClientToServer", "ServerToClient", "Default")


def change_log(events: DataFrame, obj: str, prop: str, val: str, order: Sequence[str]) -> DataFrame:
    """The log of events; seq is a struct of the ordering columns, which orders as they do without a global sort."""
    return events.select(F.col(obj).alias("obj"), F.col(prop).alias("prop"), F.col(val).alias("val"), F.struct(*order).alias("seq"))


def deduped(log: DataFrame, keys: Sequence[str] = ("obj", "prop")) -> DataFrame:
    """The first event of each key: while it is queued, later ones of its kind add nothing."""
    others = [c for c in log.columns if c not in keys]
    first = log.groupBy(*keys).agg(F.min_by(F.struct(*others), "seq").alias("_row"))
    return first.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in log.columns])


def by_priority(log: DataFrame, priority: str, seq: str = "seq") -> DataFrame:
    """Dispatch order: higher priorities first, and in the order they came within one."""
    return log.orderBy(F.col(priority).desc(), F.col(seq).asc())


def dispatch_order(log: DataFrame, priority: str, seq: str = "seq", place: str = "place") -> DataFrame:
    """The log with each event's place (from 1) in the order of dispatch. Ranges of the order are numbered apart, not in one task."""
    down = free_name(log.columns, "_down")
    return numbered(log.withColumn(down, -F.col(priority)), [down, seq], place).drop(down)


def without_same_values(log: DataFrame) -> DataFrame:
    """Changes whose value differs from the one before, of the same object and property."""
    before = F.lag("val").over(Window.partitionBy("obj", "prop").orderBy("seq"))
    first = F.row_number().over(Window.partitionBy("obj", "prop").orderBy("seq")) == 1
    return log.withColumn("_same", before.eqNullSafe(F.col("val")) & ~first).where("NOT _same").drop("_same")


def latest(log: DataFrame) -> DataFrame:
    """The last value of each property of each object: pre-aggregated, without a sort."""
    return log.groupBy("obj", "prop").agg(F.max_by("val", "seq").alias("val"))


def overridden(log: DataFrame) -> DataFrame:
    """The log with overridden: whether a later change of the same property follows. One window, which needs one shuffle."""
    last = F.max("seq").over(Window.partitionBy("obj", "prop"))
    return log.withColumn("overridden", F.col("seq") < last)


def net_changes(log: DataFrame) -> DataFrame:
    """obj, prop, first and last value of the properties that end with another value than they began with."""
    ends = log.groupBy("obj", "prop").agg(F.min_by("val", "seq").alias("first_val"), F.max_by("val", "seq").alias("last_val"))
    return ends.where(~F.col("first_val").eqNullSafe(F.col("last_val")))


def initial_values(values: DataFrame, options: DataFrame) -> DataFrame:
    """Values for a first snapshot: with a default, those that differ from it; without one, those that are set and of
    properties flagged INIT. options: prop, flags, default (null: none)."""
    o = options.select(F.col("prop").alias("_prop"), "flags", F.col("default").alias("_default"))
    joined = values.join(o, F.col("prop") == F.col("_prop"))
    wanted = F.when(F.col("_default").isNotNull(), ~F.col("val").eqNullSafe(F.col("_default"))).otherwise(
        (F.col("flags").bitwiseAND(F.lit(INIT)) != 0) & F.col("val").isNotNull()
    )
    return joined.where(wanted).select(*values.columns)


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def sent(flags: Column, from_server: bool) -> Column:
    """Whether a property's changes are sent from this side: never what is received only, constant or on demand; what is
    sent only goes from the server."""
    blocked = has_flag(flags, RECEIVE_ONLY | CONSTANT | ON_DEMAND)
    return ~blocked & (F.lit(from_server) | ~has_flag(flags, SEND_ONLY))


def crosses(mode: Column, from_server: bool, shared: Column | None = None) -> Column:
    """Whether changes of a mode go to the other side. Automatic needs a type that both sides have."""
    one_way = F.lit("ServerToClient" if from_server else "ClientToServer")
    shared = F.lit(True) if shared is None else shared
    return (mode == "Enabled") | (mode == one_way) | ((mode == "Automatic") & shared)


#: States of the sync machine, and those in which changes are recorded.
STATES = ("RecordingChanges", "Initializing", "InitializingLocal", "ApplyingChanges", "Disabled", "CopyingPrevious")
RECORDED = ("RecordingChanges",)


def recorded(log: DataFrame, state: str = "state") -> DataFrame:
    """Changes that were made in a state in which they are recorded: not while the other side's are applied or sync is off."""
    return log.where(F.col(state).isin(*RECORDED))


def type_counts(log: DataFrame, column: str = "type") -> DataFrame:
    """The number of distinct objects of each type."""
    return log.groupBy(column).agg(F.countDistinct("obj").alias("n"))


def of_types(log: DataFrame, types: DataFrame, column: str = "type") -> DataFrame:
    """Changes of the listed types."""
    return log.join(types.select(column).distinct(), column, "left_semi")


def routed(log: DataFrame, subscriptions: DataFrame, origin: str = "origin") -> DataFrame:
    """A row for each change and scope that subscribes to its object, but for the scope it came from."""
    s = subscriptions.select(F.col("scope"), F.col("obj").alias("_obj"))
    joined = log.join(s, F.col("obj") == F.col("_obj")).where(~F.col("scope").eqNullSafe(F.col(origin)))
    return joined.drop("_obj")


def alive(entries: DataFrame, last_used: str, now: Column, seconds: int = 900) -> DataFrame:
    """Cache entries that were used within the last `seconds`."""
    return entries.where(F.col(last_used) + F.expr(f"INTERVAL {int(seconds)} SECONDS") >= now)


def answered(calls: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Calls with their result, and state: pending until there is one."""
    r = results.select(F.col(key).alias("_key"), F.col("result"))
    joined = calls.join(r, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("state", F.when(F.col("_key").isNull(), "pending").otherwise("done")).drop("_key")


def reverse_changes(changes: DataFrame, child: str, before: str, after: str) -> DataFrame:
    """What changed references do to the lists on the other side: parent, child and change (removed or added) for each of the
    changes of a child's reference from `before` to `after`; null is none, and the same parent no change."""
    sides = F.array(
        F.struct(F.col(before).alias("parent"), F.lit("removed").alias("change")), F.struct(F.col(after).alias("parent"), F.lit("added").alias("change"))
    )
    rows = changes.where(~F.col(before).eqNullSafe(F.col(after))).select(F.col(child).alias("child"), F.inline(sides))
    return rows.where("parent IS NOT NULL").select("parent", "child", "change")


def bound(rows: DataFrame, left: str, right: str, forward: Column, backward: Column | None, changed: str | None = None) -> DataFrame:
    """rows with a binding between two columns applied: left gets `forward` (of right), and right `backward` (of left). With
    `changed`, a column that names the side that changed last, each row goes from that side to the other; a null there leaves the row
    as it is. Without it the binding is one-way: forward, or backward if forward is None."""
    if changed is None:
        return rows.withColumn(left, forward) if forward is not None else rows.withColumn(right, backward)
    from_right, from_left = F.col(changed) == right, F.col(changed) == left
    made = free_name(rows.columns, "_left")
    rows = rows.withColumn(made, F.when(from_right, forward).otherwise(F.col(left)))
    return rows.withColumn(right, F.when(from_left, backward).otherwise(F.col(right))).withColumn(left, F.col(made)).drop(made)


# The wire format: {"sync": [command, ...]}; a command is a change of one object's property, or has one of these names.

#: Names of commands by kind of change.
COMMANDS = {"new": "$new", "method": "$meth", "result": "$methReturn", "fetch": "$get", "rename": "$cn", "renameAck": "$nc", "state": "$syncState", "clearReset": "$clearResetState"}


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def wire(changes: DataFrame, scope: str = "scope") -> DataFrame:
    """scope and doc: the changes of each scope as one document, in the order of seq.

    changes has kind (prop or one of COMMANDS), pkg, obj, name, val (JSON), args (a JSON array), call_id and seq. prop sets the
    property `name` of obj to val; new makes obj of the type `name` with args; method calls `name` of obj; result gives
    val, of the type `name`, to the call; fetch asks for the property `name`; rename and renameAck tell of obj's new name; state has a
    state in `name`; clearReset names obj. Where the package changes, a $pkg command comes first; missing values are null. A scope's
    document is one value, as it is sent: give each batch of a stream its own.
    """
    one = lambda key, value: F.concat(F.lit("{"), key, F.lit(":"), value, F.lit("}"))
    pair = lambda key, value: F.concat(F.lit(f',"{key}":'), value)
    word = lambda kind: F.lit(f'"{COMMANDS[kind]}"')
    obj, name = _quoted(F.col("obj")), _quoted(F.col("name"))
    val, args, call = F.coalesce("val", F.lit("null")), F.coalesce("args", F.lit("null")), _quoted(F.col("call_id"))
    text = (
        F.when(F.col("kind") == "new", one(word("new"), F.concat(F.lit("["), obj, F.lit(","), name, F.lit(","), args, F.lit("]"))))
        .when(F.col("kind") == "method", one(obj, one(word("method"), F.concat(name, pair("callId", call), pair("args", args)))))
        .when(F.col("kind") == "result", one(word("result"), F.concat(val, pair("callId", call), pair("retType", name))))
        .when(F.col("kind") == "fetch", one(obj, one(word("fetch"), name)))
        .when(F.col("kind") == "rename", one(word("rename"), F.concat(obj, pair("newName", name))))
        .when(F.col("kind") == "renameAck", one(word("renameAck"), F.concat(obj, pair("newName", name))))
        .when(F.col("kind") == "state", one(word("state"), name))
        .when(F.col("kind") == "clearReset", one(word("clearReset"), obj))
        .otherwise(one(obj, one(name, val)))
    )
    order = Window.partitionBy(scope).orderBy("seq")
    moves = ~F.coalesce("pkg", F.lit("")).eqNullSafe(F.lag(F.coalesce("pkg", F.lit(""))).over(order))
    full = F.concat(F.when(moves, F.concat(one(F.lit('"$pkg"'), _quoted(F.coalesce("pkg", F.lit("")))), F.lit(","))).otherwise(F.lit("")), text)
    listed = F.array_sort(F.collect_list(F.struct("seq", F.col("_text"))))
    rows = changes.select(scope, "seq", full.alias("_text")).groupBy(scope).agg(listed.alias("_listed"))
    return rows.select(scope, F.concat(F.lit('{"sync":['), F.array_join(F.transform("_listed", lambda x: x["_text"]), ","), F.lit("]}")).alias("doc"))


def unwired(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """The changes in wire() documents: the columns of docs but doc, then at (place in the document), kind, pkg, obj, name, val, args
    and call_id. What is no such document has no changes."""
    parsed = F.from_json(F.col(doc), "sync array<map<string,string>>")["sync"]
    rows = docs.select(*[c for c in docs.columns if c != doc], F.posexplode(parsed).alias("at", "_command"))
    get = lambda key: F.try_element_at("_command", F.lit(key))
    names = F.array_except(F.map_keys("_command"), F.array(F.lit("callId"), F.lit("retType"), F.lit("newName"), F.lit("args")))
    rows = rows.withColumn("_key", F.get(names, 0))
    inner = F.from_json(F.try_element_at("_command", F.col("_key")), "map<string,string>")
    rows = rows.withColumn("_inner", F.when(~F.col("_key").startswith("$"), inner))
    rows = rows.withColumn("_name", F.get(F.array_except(F.map_keys("_inner"), F.array(F.lit("callId"), F.lit("args"))), 0))
    last = F.last(F.when(F.col("_key") == "$pkg", get("$pkg")), ignorenulls=True)
    keys = [c for c in docs.columns if c != doc]
    rows = rows.withColumn("pkg", last.over(Window.partitionBy(*keys).orderBy("at"))).where("_key <> '$pkg'")
    made = F.from_json(get("$new"), "array<string>")
    kind = F.lit("prop")
    for k, command_ in COMMANDS.items():
        kind = F.when((F.col("_key") == command_) | (F.col("_name") == command_), F.lit(k)).otherwise(kind)
    inside = lambda key: F.try_element_at("_inner", F.lit(key))
    simple = F.col("_key").startswith("$")
    return rows.select(
        *keys,
        "at",
        kind.alias("kind"),
        "pkg",
        F.when(~simple, F.col("_key")).otherwise(F.coalesce(F.get(made, 0), get("$cn"), get("$nc"), get("$clearResetState"))).alias("obj"),
        F.when(simple, F.coalesce(F.get(made, 1), get("newName"), get("retType"), get("$syncState"))).otherwise(F.coalesce(inside("$meth"), inside("$get"), F.col("_name"))).alias("name"),
        F.when(simple, get("$methReturn")).when(~F.col("_name").startswith("$"), F.try_element_at("_inner", F.col("_name"))).alias("val"),
        F.coalesce(F.get(made, 2), inside("args")).alias("args"),
        F.coalesce(get("callId"), inside("callId")).alias("call_id"),
    )


def jobs_between(jobs: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Jobs with priorities from low up to high (not included)."""
    if low is not None:
        jobs = jobs.where(F.col("priority") >= low)
    return jobs.where(F.col("priority") < high) if high is not None else jobs


def jobs_in_order(jobs: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Jobs with priorities from low up to high (not included), higher ones first, then as they came."""
    return by_priority(jobs_between(jobs, low, high), "priority")


#: Fixed value: rounds of jobs after which no more are run.
ROUNDS = 16


def run_jobs(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], low: int | None = None, high: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs the jobs between low and high, then the jobs that these add, and so on, for ROUNDS more rounds at most: all runs (with
    round), and the jobs that wait.

    run() gets a round's jobs and gives those that they add, with the same columns. A round is stored before the next
    one, so that no job runs twice. Jobs outside the range wait, whichever round adds them, as do those of a round too many.
    """
    done = waiting = None
    for number in range(ROUNDS + 2):
        inside = jobs_between(jobs, low, high)
        outside = jobs.join(inside.select("seq"), "seq", "left_anti").select(*jobs.columns)
        waiting = outside if waiting is None else waiting.unionByName(outside)
        inside = checkpointed(inside)
        if inside.isEmpty():
            break
        if number > ROUNDS:
            waiting = waiting.unionByName(inside)
            break
        marked = inside.withColumn("round", F.lit(number))
        done = marked if done is None else done.unionByName(marked)
        jobs = checkpointed(run(inside))
    return (jobs.limit(0).withColumn("round", F.lit(0)) if done is None else done), waiting


def check_acyclic(bindings: dict[str, Sequence[str]]) -> list[str]:
    """Properties so that each comes after those its expression reads; a loop is an error."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter(bindings).static_order())
