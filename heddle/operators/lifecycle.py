"""Repositories coming and going, tags, tree checks and what a commit brings."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.scalars import like_dot_git, like_dot_gitmodules

from heddle.plans.climb import contracted
from heddle.plans.durable import materialize


def current_repositories(log: DataFrame) -> DataFrame:
    """(repo, epoch, head) that live after a log of creates and deletes (repo, seq, action, head).

    A create of a live repository changes nothing, nor does a delete of one that is gone;
    a create after a delete begins a new epoch.  The default branch counts on first creation only.
    """
    order = Window.partitionBy("repo").orderBy("seq")
    begins = (F.col("action") == "create") & (F.coalesce(F.lag("action").over(order), F.lit("delete")) == "delete")
    rows = log.withColumn("begins", begins)
    ended = rows.groupBy("repo").agg(
        F.max_by("action", "seq").alias("last"),
        F.count_if("begins").alias("epoch"),
        F.max_by("head", F.when(F.col("begins"), F.col("seq"))).alias("head"),
    )
    return ended.where("last = 'create'").select("repo", "epoch", F.coalesce("head", F.lit("refs/heads/main")).alias("head"))


def peel(starts: DataFrame, tags: DataFrame, most: int = 64) -> DataFrame:
    """(oid, peeled): what each start names behind its chain of tags; null if a chain is longer than ``most``.

    ``tags``: tag, target.  Tags that a task reads with what they name are followed in memory, and only the starts move along
    what is left.  Starts that still move after two rounds find links twice as long in each further one.
    """
    hop = contracted(tags.select(F.col("tag").alias("id"), F.col("target").alias("to")))
    front = starts.select("oid", F.col("oid").alias("at"), F.lit(0).cast("long").alias("n")).distinct()
    moves = []
    while True:
        step = front.join(hop.hint("merge"), F.col("at") == F.col("id")).select("oid", F.col("to").alias("at"), (front["n"] + hop["n"]).alias("n"))
        moves.append(materialize(step, "peeling"))
        front = moves[-1].where(F.col("n") <= most)
        if front.isEmpty():
            break
        if len(moves) > 1:
            far = hop.select(F.col("id").alias("id2"), F.col("to").alias("to2"), F.col("n").alias("n2")).hint("merge")
            hop = materialize(hop.join(far, F.col("to") == F.col("id2"), "left").select("id", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "hops")
    ended = reduce(DataFrame.unionByName, moves).groupBy(F.col("oid").alias("tag")).agg(F.max("n").alias("n"), F.max_by("at", "n").alias("at"))
    ended = ended.select("tag", F.when(F.col("n") <= most, F.col("at")).alias("end")).hint("merge")
    return starts.join(ended, F.col("oid") == F.col("tag"), "left").select("oid", F.when(F.col("tag").isNull(), F.col("oid")).otherwise(F.col("end")).alias("peeled"))


def include_tags(tags: DataFrame, sent: DataFrame) -> DataFrame:
    """Tags whose peeled target is among the objects sent."""
    return tags.join(sent.select(F.col("oid").alias("target")).distinct(), "target", "left_semi").select("tag", "target")


def tree_faults(entries: DataFrame) -> DataFrame:
    """(tree, ord, fault): the first fault of each entry (tree, ord, mode, name, oid), in stored order."""
    order = Window.partitionBy("tree").orderBy("ord")
    key = lambda name, mode: F.concat(name, F.when(mode.isin("40000", "040000"), "/").otherwise("")).cast("binary")
    before = F.lag(key(F.col("name"), F.col("mode"))).over(order)
    fault = (
        F.when(F.col("oid").rlike("^0+$"), "NULL_OID")
        .when(F.col("name") == "", "EMPTY_NAME")
        .when(F.col("name").contains("/"), "FULL_PATH")
        .when(F.col("name") == ".", "DOT")
        .when(F.col("name") == "..", "DOT_DOT")
        .when(like_dot_git(F.col("name")), "DOT_GIT")
        .when(F.col("mode").startswith("0"), "ZERO_PADDED_MODE")
        .when(F.octet_length("name") > 4096, "LONG_NAME")
        .when((F.col("mode") == "120000") & like_dot_gitmodules(F.col("name")), "GITMODULES_LINK")
        .when(F.count("*").over(Window.partitionBy("tree", "name")) > 1, "DUPLICATE")
        .when(before >= key(F.col("name"), F.col("mode")), "OUT_OF_ORDER")
    )
    return entries.withColumn("fault", fault).where("fault is not null").select("tree", "ord", "fault")


def brought(files: DataFrame, parents: DataFrame) -> DataFrame:
    """Files (commit, path, oid) that differ from every parent at their path; ``parents``: commit, parent, path, oid."""
    same = parents.select("commit", "path", "oid").distinct()
    return files.join(same, ["commit", "path", "oid"], "left_anti")


def topological(generations: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, generation, place) in an order where parents come first; ties by pack order."""
    return generations.join(packed, "id").select("id", "generation", "place").orderBy("generation", "place")


def push_order(commits: DataFrame) -> DataFrame:
    """(push, id, nth): the order in which each push's commits are taken in; a cycle is an error.

    ``commits``: push, id, place (in the push's pack), parents (null: none; those of other pushes don't count).  A commit
    follows all its parents, and directly follows the last of them unless siblings that became free with it, or what
    follows from those, come earlier in the pack.  A push is one pack, so one task holds the ids of one pack.
    """
    kind = commits.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "id", "parents")), strict=True), key=lambda r: r[0], reverse=True)
        here = {oid for _, oid, _ in rows}
        waits = {oid: {p for p in parents or () if p in here} for _, oid, parents in rows}
        children: dict = {oid: [] for oid in here}
        for _, oid, _ in rows:  # last in the pack first, as what is added last is taken first
            for parent in waits[oid]:
                children[parent].append(oid)
        free, order = [oid for _, oid, _ in rows if not waits[oid]], []
        while free:
            order.append(free.pop())
            for child in children[order[-1]]:
                waits[child].discard(order[-1])
                if not waits[child]:
                    free.append(child)
        if len(order) < len(rows):
            raise ValueError("the commits of a push form a cycle")
        return pa.table({"push": pa.array([table.column("push")[0].as_py()] * len(order), table.schema.field("push").type), "id": pa.array(order, table.schema.field("id").type), "nth": pa.array(range(len(order)), pa.int64())})

    return commits.select("push", "id", "place", "parents").groupBy("push").applyInArrow(run, f"push {commits.schema['push'].dataType.simpleString()}, id {kind}, nth long")


def created(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """Repositories (repo, head) that a batch of creates adds to those there; a key that lives, or comes twice, is created once.

    Of several creates of a key the first (smallest ``seq``) says the default branch.
    """
    first = asked.groupBy("repo").agg(F.min(F.struct("seq", "head")).alias("f")).select("repo", F.coalesce("f.head", F.lit("refs/heads/main")).alias("head"))
    return first.join(existing.select("repo"), "repo", "left_anti")


def described(log: DataFrame, key: str) -> DataFrame:
    """What :func:`current_repositories` says of one repository; no row if it does not live."""
    return current_repositories(log.where(F.col("repo") == key))
