"""What an outside service decides about a request: who may act, which refs are seen, and what is told afterwards."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.scalars import repo_key_ok


def authorize(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests`` (request, path, actor, access) with ``repo`` and ``denial``.

    The repository's key is the path without slashes at its ends and without ``.git``.  ``grants``: repo, actor, access;
    to write implies to read.  Nothing granted is a denial, as is a path that is no key.
    """
    repo = F.regexp_replace(F.trim(F.col("path"), F.lit("/")), r"\.git$", "")
    asked = requests.withColumn("repo", F.when(repo_key_ok(repo), repo))
    may = grants.groupBy("repo", "actor").agg(F.max(F.col("access") == "write").alias("writes"))
    met = asked.join(may, ["repo", "actor"], "left")
    denial = F.when(F.col("repo").isNull(), "BAD_PATH").when(F.col("writes").isNull(), "NOT_GRANTED").when((F.col("access") == "write") & ~F.col("writes"), "READ_ONLY")
    return met.select("request", "path", "actor", "access", F.when(denial.isNull(), F.col("repo")).alias("repo"), denial.alias("denial"))


def visible_refs(refs: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """Refs (name) that a rule lets a caller see; names that the rule knows and the refs don't have no effect."""
    return refs.where(F.coalesce(rule(F.col("name")), F.lit(False)))


def landed(commands: DataFrame) -> DataFrame:
    """What is told after a push: its commands (push, ord, refname, old, new, reason) that landed, in order; a push without any is not told of."""
    return commands.where("reason is null").groupBy("push").agg(F.array_sort(F.collect_list(F.struct("ord", "refname", "old", "new"))).alias("commands"))


def post_receive(tell: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch function for ``foreachBatch`` that tells of landed commands; its errors are only logged, as the push is done."""

    def batch(commands: DataFrame, number: int) -> None:
        try:
            tell(landed(commands))
        except Exception:
            logging.getLogger(__name__).exception("post-receive of batch %d failed", number)

    return batch
