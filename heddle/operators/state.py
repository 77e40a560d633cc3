"""The state of repositories under commands, and the outcome of pushes to and from remotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.graph import Graph


def land_in_phases(updates: DataFrame, refs: DataFrame) -> DataFrame:
    """``updates`` (command, ord, refname, old, new) with ``phase`` and ``reason`` (null: landed).

    A command that deletes a ref and sets it again lands its deletes first, in phase 0, so that the set
    meets a ref that is gone if its delete landed.  Any other command has one phase.
    """
    of_ref = Window.partitionBy("command", "refname")
    deletes = F.col("new").isNull()
    again = F.max(deletes).over(of_ref) & F.max(~deletes).over(of_ref)
    rows = updates.withColumn("again", again).withColumn("split", F.max("again").over(Window.partitionBy("command")))
    rows = rows.join(refs.select(F.col("name").alias("refname"), F.col("oid").alias("now")), "refname", "left")
    gone = F.max(deletes & F.col("again") & F.col("old").eqNullSafe(F.col("now"))).over(of_ref)
    meets = F.when(~deletes & gone, F.lit(None)).otherwise(F.col("now"))
    phase = F.when(F.col("split") & ~deletes, 1).otherwise(0)
    reason = F.when(~F.col("old").eqNullSafe(F.col("meets")), "STALE_OLD_VALUE")
    return rows.withColumns({"meets": meets, "phase": phase}).select("command", "ord", "refname", "phase", reason.alias("reason"))


def guarded(commands: DataFrame, repositories: DataFrame) -> DataFrame:
    """``commands`` (command, repo, epoch, action) with ``refusal``: for another incarnation, or for a deleted repository."""
    met = commands.join(repositories.select("repo", F.col("epoch").alias("now"), "deleted"), "repo", "left")
    refusal = (
        F.when(F.col("now").isNull(), "UNKNOWN_REPOSITORY")
        .when(F.col("epoch") != F.col("now"), "OTHER_INCARNATION")
        .when(F.col("deleted") & (F.col("action") != "delete"), "DELETED")
    )
    return met.select("command", "repo", "epoch", "action", refusal.alias("refusal"))


def advance(repositories: DataFrame, landed: DataFrame) -> DataFrame:
    """(repo, version, last_push) after commands (repo, at, refs, layers, head: whether each changed).

    The version grows by one for each command that changed anything; the last push only where a ref moved, and never back.
    """
    changed = F.col("refs") | F.col("layers") | F.col("head")
    sums = landed.groupBy("repo").agg(F.count_if(changed).alias("steps"), F.max(F.when(F.col("refs"), F.col("at"))).alias("pushed"))
    met = repositories.join(sums, "repo", "left")
    return met.select("repo", (F.col("version") + F.coalesce("steps", F.lit(0))).alias("version"), F.greatest("last_push", "pushed").alias("last_push"))


def applicable(changes: DataFrame) -> DataFrame:
    """The changes (repo, version, before, chain) that apply: each follows on the version and the chain of the one before.

    From the first that doesn't, a repository's changes wait for a fresh state.
    """
    order = Window.partitionBy("repo").orderBy("version")
    broken = (F.col("version") != F.lag("version").over(order) + 1) | ~F.col("before").eqNullSafe(F.lag("chain").over(order))
    first = F.row_number().over(order) == 1
    rows = changes.withColumn("broken", ~first & broken)
    so_far = F.max("broken").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stop", so_far).where("not stop").select("repo", "version", "before", "chain")


def at_version(changes: DataFrame, version: int | None = None) -> DataFrame:
    """The refs (name, oid, version) of a feed at a pinned version; without one, at the latest."""
    from heddle.operators.refs import fold

    return fold(changes if version is None else changes.where(F.col("version") <= version))


def remote_listing(listed: DataFrame, prefixes: list[str]) -> DataFrame:
    """A remote's refs (name, oid) under the prefixes; a name that is listed twice is an error."""
    from heddle.operators.refs import list_refs

    if not listed.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("the remote lists a ref twice")
    return list_refs(listed, prefixes)


def fast_forwards(graph: Graph, steps: DataFrame) -> DataFrame:
    """Steps (push, destination, old, new, force, action); what would rewind without force is rejected here."""
    plain = (F.col("action") == "send") & ~F.col("force") & F.col("old").isNotNull() & F.col("new").isNotNull()
    asked = graph.is_ancestor(steps.where(plain).select(F.col("old").alias("a"), F.col("new").alias("d")))
    met = steps.join(asked, (F.col("old") == F.col("a")) & (F.col("new") == F.col("d")), "left")
    action = F.when(plain & ~F.coalesce("is_ancestor", F.lit(False)), "reject_not_forward").otherwise(F.col("action"))
    return met.select("push", "destination", "old", "new", "force", action.alias("action"))


def hold_back(steps: DataFrame) -> DataFrame:
    """Of a push that lands every ref or none, nothing is sent once any step is rejected here."""
    refused = F.max(F.col("action").startswith("reject")).over(Window.partitionBy("push"))
    return steps.withColumn("action", F.when(refused & F.col("action").isin("send", "delete"), "reject_held_back").otherwise(F.col("action")))


def outcomes(steps: DataFrame, report: DataFrame) -> DataFrame:
    """Steps with their ``status`` after the remote's report (push, refname, why); a ref it is silent about was rejected."""
    said = report.select("push", F.col("refname").alias("destination"), "why", F.lit(True).alias("said"))
    met = steps.join(said, ["push", "destination"], "left")
    sent = F.col("action").isin("send", "delete")
    status = (
        F.when(~sent, F.col("action"))
        .when(F.col("said").isNull(), "rejected: no answer")
        .when(F.col("why").isNotNull(), F.concat(F.lit("rejected: "), "why"))
        .when(F.col("action") == "delete", "deleted")
        .otherwise("updated")
    )
    return met.select("push", "destination", status.alias("status"))


def common_haves(haves: DataFrame, objects: DataFrame) -> DataFrame:
    """The haves (ord, oid) that are stored, in the client's order."""
    return haves.join(objects.select("oid").distinct(), "oid", "left_semi").select("ord", "oid")


def to_pack(wants: DataFrame, haves: DataFrame, objects: DataFrame) -> DataFrame:
    """Wants (ord, oid) once each and without the haves, at their first place; a want that isn't stored is an error."""
    if not wants.join(objects, "oid", "left_anti").isEmpty():
        raise ValueError("a wanted object is missing")
    return wants.groupBy("oid").agg(F.min("ord").alias("ord")).join(haves.select("oid"), "oid", "left_anti").select("ord", "oid")
