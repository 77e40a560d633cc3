"""Listing, comparing and updating references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.scalars import ref_name_ok


def with_prefix(name: Column, prefixes: list[str], at_most: int = 65_535) -> Column:
    """Any of the prefixes; none, or too many to be a filter, means all."""
    if not prefixes or len(prefixes) > at_most:
        return F.lit(True)
    out = name.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | name.startswith(p)
    return out


def list_refs(refs: DataFrame, prefixes: list[str] = ()) -> DataFrame:
    """The refs under any of the prefixes, in byte order of their names."""
    return refs.where(with_prefix(F.col("name"), list(prefixes))).orderBy("name")


def visible(refs: DataFrame, hidden: DataFrame) -> DataFrame:
    return refs.join(hidden, "name", "left_anti")


def head_line(refs: DataFrame, heads: DataFrame, hidden: DataFrame) -> DataFrame:
    """(repo, name, oid, symref) of each repository's HEAD, from refs (repo, name, oid) and heads (repo, head).

    HEAD is hidden with its branch; one that names a branch that does not exist (unborn) has no oid and stays.
    """
    at = heads.join(refs.select("repo", F.col("name").alias("head"), "oid"), ["repo", "head"], "left")
    at = at.join(hidden.select("repo", F.col("name").alias("head")), ["repo", "head"], "left_anti")
    return at.select("repo", F.lit("HEAD").alias("name"), "oid", F.col("head").alias("symref"))


def advertise(refs: DataFrame, heads: DataFrame, hidden: DataFrame, peeled: DataFrame, prefixes: list[str] = (), symrefs: bool = True, unborn: bool = True) -> DataFrame:
    """What a caller is told of refs: (repo, name, oid, symref, peeled), HEAD first, then byte order.

    ``peeled``: oid of an annotated tag, and what it names in the end.  An unborn HEAD is listed only
    with its target.  HEAD is filtered by the prefixes as a ref named ``HEAD``.
    """
    seen = refs.join(hidden.select("repo", "name"), ["repo", "name"], "left_anti").withColumn("symref", F.lit(None).cast("string"))
    head = head_line(refs, heads, hidden).where(F.col("oid").isNotNull() | F.lit(symrefs and unborn))
    if not symrefs:
        head = head.withColumn("symref", F.lit(None).cast("string"))
    rows = seen.select("repo", "name", "oid", "symref").unionByName(head).where(with_prefix(F.col("name"), list(prefixes)))
    return rows.join(peeled.select("oid", "peeled"), "oid", "left").select("repo", "name", "oid", "symref", "peeled").orderBy("repo", F.col("name") != "HEAD", "name")


def head_fixup(refs: DataFrame, heads: DataFrame, keep_head: bool = False) -> DataFrame:
    """(repo, head): HEAD's branch, or main, or master, or the first branch where it is missing, unless it is to be kept."""
    if keep_head:
        return heads.select("repo", "head")
    branches = refs.where(F.col("name").startswith("refs/heads/")).select("repo", "name")
    named = branches.groupBy("repo").agg(*(F.max(F.when(F.col("name") == f"refs/heads/{b}", F.col("name"))).alias(b) for b in ("main", "master")), F.min("name").alias("first"))
    there = heads.join(branches.select("repo", F.col("name").alias("head"), F.lit(True).alias("there")), ["repo", "head"], "left")
    return there.join(named, "repo", "left").select("repo", F.when(F.col("there"), F.col("head")).otherwise(F.coalesce("main", "master", "first", "head")).alias("head"))


def evaluate(updates: DataFrame, refs: DataFrame, atomic: bool) -> DataFrame:
    """``updates`` (command, ord, refname, old, new) against the state before them, with ``reason`` (null: landed).

    No old value means that the ref must not exist.  In an atomic command any refusal
    refuses the rest too, each keeping its own reason where it has one.
    """
    met = updates.join(refs.select(F.col("name").alias("refname"), F.col("oid").alias("now")), "refname", "left")
    own = F.when(~F.col("old").eqNullSafe(F.col("now")), F.lit("STALE_OLD_VALUE"))
    out = met.withColumn("reason", own)
    if atomic:
        any_refused = F.max(F.col("reason").isNotNull()).over(Window.partitionBy("command"))
        out = out.withColumn("reason", F.when(any_refused & F.col("reason").isNull(), "ATOMIC_FAILURE").otherwise(F.col("reason")))
    return out.select("command", "ord", "refname", "reason")


def prechecks(updates: DataFrame, objects: DataFrame, head: str) -> DataFrame:
    """``updates`` (command, atomic, ord, refname, new) with the reason for which each is refused before it is compared.

    A delete needs a name that may be deleted and must not name HEAD's branch; a set needs a name that may be
    set, an object, and for a branch a commit.  Whatever has no such reason is refused if its command updates the
    ref again; deletes are a phase of their own unless the command is atomic.
    """
    gone = F.col("new").isNull()
    known = updates.join(objects.select(F.col("oid").alias("new"), "kind"), "new", "left")
    own = F.when(
        gone, F.when(~ref_name_ok(F.col("refname"), deleting=True), "INVALID_NAME").when(F.col("refname") == head, "DELETES_HEAD")
    ).otherwise(
        F.when(~ref_name_ok(F.col("refname")), "INVALID_NAME")
        .when(F.col("kind").isNull(), "MISSING_OBJECT")
        .when(F.col("refname").startswith("refs/heads/") & (F.col("kind") != "commit"), "NON_COMMIT")
    )
    times = F.count("*").over(Window.partitionBy("command", "refname", gone & ~F.col("atomic")))
    return known.select("command", "ord", "refname", F.coalesce(own, F.when(times > 1, "REPEATED_REF")).alias("reason"))


def mirror_plan(ours: DataFrame, theirs: DataFrame, prefixes: list[str]) -> DataFrame:
    """(name, old, new) that makes ours like theirs under the prefixes; unchanged refs are left out."""
    if not prefixes or not all(p.startswith("refs/") for p in prefixes):
        raise ValueError("prefixes must be given and lie under refs/")
    a = list_refs(ours, prefixes).select("name", F.col("oid").alias("old"))
    b = list_refs(theirs, prefixes).select("name", F.col("oid").alias("new"))
    return a.join(b, "name", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def push_plan(specs: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Refspecs (source, destination, force) with what each comes to: delete, up to date, reject or send."""
    if specs.groupBy("destination").count().where("count > 1").limit(1).count():
        raise ValueError("a destination is named twice")
    s = specs.join(ours.select(F.col("name").alias("source"), F.col("oid").alias("new")), "source", "left").join(theirs.select(F.col("name").alias("destination"), F.col("oid").alias("old")), "destination", "left")
    action = F.when(F.col("source").isNull(), F.when(F.col("old").isNull(), "up_to_date").otherwise("delete")).when(F.col("new").isNull(), "reject_not_held").when(F.col("new") == F.col("old"), "up_to_date").otherwise("send")
    return s.select("source", "destination", "old", "new", action.alias("action"))


def judge(commands: DataFrame, judgements: DataFrame) -> DataFrame:
    """``commands`` (push, ord, refname) with ``verdict``: a refusal wins, its first reason stays, and an unjudged command fails its whole push."""
    said = judgements.groupBy("push", "refname").agg(F.min_by("reason", F.when(~F.col("allow"), F.col("seq"))).alias("reason"), F.min("allow").alias("allow"))
    met = commands.join(said, ["push", "refname"], "left")
    unjudged = F.max(F.col("allow").isNull()).over(Window.partitionBy("push"))
    return met.select("push", "ord", "refname", F.when(unjudged, "UNJUDGED").when(~F.col("allow"), F.concat(F.lit("REFUSED: "), "reason")).otherwise("ALLOWED").alias("verdict"))


def page(rows: DataFrame, key: str, prefix: str, after: str | None, limit: int, most: int = 100) -> DataFrame:
    """One page in byte order and the token of the next one; rows marked deleted use up places."""
    if after is not None and not after.startswith(prefix):
        raise ValueError("the token lies outside the prefix")
    n = min(limit or most, most)
    here = rows.where(F.col(key).startswith(prefix) & (F.lit(True) if after is None else F.col(key) > after))
    some = here.orderBy(key).limit(n + 1).withColumn("place", F.row_number().over(Window.orderBy(key)))
    more = F.max("place").over(Window.partitionBy()) > n
    token = F.when(more, F.max(F.when(F.col("place") <= n, F.col(key))).over(Window.partitionBy()))
    return some.withColumn("next_token", token).where((F.col("place") <= n) & ~F.col("deleted")).drop("place")


def fold(changes: DataFrame) -> DataFrame:
    """Current state of a change feed: the last value of each key; deletions drop out."""
    last = changes.groupBy("name").agg(F.max_by(F.struct("oid", "version"), F.col("version")).alias("last"))
    return last.select("name", "last.oid", "last.version").where("oid is not null")
