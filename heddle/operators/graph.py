"""Questions about the commit graph.

Commits are laid out on chains: a commit continues the chain of its first parent
if it is that parent's smallest such child, all other edges cross between chains.
The chain and the place on it are found by following links where they lie and
doubling what is left, in rounds that grow with the logarithm of the longest chain.  What is reachable from a commit
is then one number for each chain, the highest place, and grows along cross
edges only; rounds follow the number of crossings, not the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.lifecycle import peel
from heddle.plans.climb import climb
from heddle.plans.durable import materialize, release


def forks(edges: DataFrame) -> DataFrame:
    """(parent, least) of each commit that is the first parent of several: its smallest such child."""
    found = edges.where("ord = 0").groupBy("parent").agg(F.min("child").alias("least"), F.max("child").alias("most")).where("least < most")
    return materialize(found.select("parent", "least"), "forks")


def told(edges: DataFrame, split: DataFrame, few: int = 1 << 17) -> DataFrame:
    """``edges`` with ``onward``: the child continues the parent's chain.  Few forks go to where the edges lie; else edges move to the forks and back to their blocks."""
    onward = ((F.col("ord") == 0) & (F.col("least").isNull() | (F.col("least") == F.col("child")))).alias("onward")
    if split.limit(few + 1).count() <= few:
        return edges.join(F.broadcast(split), "parent", "left").select("child", "parent", "ord", onward)
    blocks = edges.withColumn("block", F.shiftright(F.monotonically_increasing_id(), 16))
    met = blocks.join(split.hint("merge"), "parent", "left").select("child", "parent", "ord", onward, "block")
    return met.repartition("block").sortWithinPartitions("block").select("child", "parent", "ord", "onward")


def crossings(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges (child, parent, ord) that leave a chain: child, its chain and place, and the parent's."""
    edge = F.struct("child", "parent", "ord").alias("edge")
    ends = edges.select(edge, F.explode(F.array(F.struct(F.col("child").alias("id"), F.lit(True).alias("is_child")), F.struct(F.col("parent").alias("id"), F.lit(False).alias("is_child")))).alias("end"))
    met = ends.select("edge", "end.*").join(places, "id")
    of = lambda col, child: F.max(F.when(F.col("is_child") == child, F.col(col)))
    both = met.groupBy("edge").agg(of("chain", True).alias("c_chain"), of("pos", True).alias("c_pos"), of("chain", False).alias("p_chain"), of("pos", False).alias("p_pos"))
    return both.where("not (c_chain = p_chain and c_pos = p_pos + 1)").select("edge.*", "c_chain", "c_pos", "p_chain", "p_pos")


class Graph:
    """A commit graph laid out once, for any number of questions."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, shallow: DataFrame | None = None):
        """``shallow``: commits (id) that are taken to have no parents."""
        if shallow is not None:
            edges = edges.join(shallow.select(F.col("id").alias("child")), "child", "left_anti")
        edges = materialize(edges.select("child", "parent", "ord"), "edges")
        edges = told(edges, forks(edges))
        places = climb(nodes, edges.where("onward").select(F.col("child").alias("id"), F.col("parent").alias("to")), "chains")
        # as large as the history: joins with them are never broadcast
        self.places = places.select("id", F.col("to").alias("chain"), "pos").hint("merge")
        self.cross = materialize(crossings(edges.where("not onward"), self.places), "crossings").hint("merge")

    def reach(self, seeds: DataFrame) -> DataFrame:
        """(seed, chain, pos): all commits up to pos on the chain are reachable; seeds: (seed, id)."""
        now = seeds.join(self.places, "id").groupBy("seed", "chain").agg(F.max("pos").alias("pos")).withColumn("old", F.lit(-1).cast("long"))
        now = materialize(now.select("seed", "chain", "pos", "old"), "reach")
        while True:
            fresh = now.where("pos > old")
            step = fresh.join(self.cross, (F.col("chain") == F.col("c_chain")) & (F.col("c_pos") <= F.col("pos")) & (F.col("c_pos") > F.col("old")))
            step = step.select("seed", F.col("p_chain").alias("chain"), F.col("p_pos").alias("pos"), F.lit(-1).cast("long").alias("old"))
            both = now.select("seed", "chain", "pos", F.col("pos").alias("old")).unionByName(step).groupBy("seed", "chain").agg(F.max("pos").alias("pos"), F.max("old").alias("old"))
            after = materialize(both, "reach")
            release(now)
            now = after
            if now.where("pos > old").isEmpty():
                return now.select("seed", "chain", "pos")

    def ancestors(self, seeds: DataFrame) -> DataFrame:
        """(seed, id) of every commit reachable from each seed, itself included."""
        r = self.reach(seeds).select("seed", F.col("chain").alias("on"), F.col("pos").alias("top"))
        return r.join(self.places, (F.col("on") == F.col("chain")) & (F.col("pos") <= F.col("top"))).select("seed", "id")

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, d) with ``is_ancestor``; reflexive, and false for unknown commits."""
        r = self.reach(pairs.select(F.col("d").alias("seed"), F.col("d").alias("id")).distinct()).select("seed", F.col("chain").alias("on"), F.col("pos").alias("top"))
        at = pairs.distinct().join(self.places.select(F.col("id").alias("a"), "chain", "pos"), "a", "left")
        met = at.join(r, (F.col("d") == F.col("seed")) & (F.col("chain") == F.col("on")), "left")
        return met.select("a", "d", F.coalesce(F.col("top") >= F.col("pos"), F.lit(False)).alias("is_ancestor"))

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """(a, b, base) for every best common ancestor of each pair."""
        seeds = pairs.select(F.explode(F.array("a", "b")).alias("seed")).distinct().select("seed", F.col("seed").alias("id"))
        r = materialize(self.reach(seeds), "reach")
        left = r.select(F.col("seed").alias("a"), F.col("chain").alias("ca"), F.col("pos").alias("pa"))
        right = r.select(F.col("seed").alias("b"), F.col("chain").alias("cb"), F.col("pos").alias("pb"))
        common = pairs.distinct().join(left, "a").join(right, "b").where("ca = cb").select("a", "b", F.col("ca").alias("chain"), F.least("pa", "pb").alias("pos"))
        common = materialize(common, "common")
        tops = common.join(self.places, ["chain", "pos"]).select("a", "b", F.col("id").alias("base"))
        below = common.join(self.cross, (F.col("chain") == F.col("c_chain")) & (F.col("c_pos") <= F.col("pos"))).select("a", "b", F.col("parent").alias("base")).distinct()
        return tops.join(below, ["a", "b", "base"], "left_anti")

    def between(self, wants: DataFrame, haves: DataFrame) -> DataFrame:
        """Ids reachable from ``wants`` and not from ``haves`` (each: id)."""
        one = lambda df: self.reach(df.select(F.lit(0).alias("seed"), "id"))
        w, h = one(wants).select("chain", F.col("pos").alias("w")), one(haves).select("chain", F.col("pos").alias("h"))
        spans = w.join(h, "chain", "left").select(F.col("chain").alias("on"), "w", F.coalesce("h", F.lit(-1)).alias("h"))
        return spans.join(self.places, (F.col("on") == F.col("chain")) & (F.col("pos") <= F.col("w")) & (F.col("pos") > F.col("h"))).select("id")

    def list_commits(self, starts: DataFrame, limit: int = 0, most: int = 100) -> DataFrame:
        """(start, place, id, next_token): a page of first parents from each start (start; a commit, or the token of the page before).

        The walk reads one commit more than a page holds, which is the next page's token.  It takes what it needs
        of a chain at once, so rounds follow the chains a page crosses.  A start that is no commit is an error.
        """
        size = min(limit or most, most)
        at = starts.select("start").distinct().join(self.places.withColumnRenamed("id", "start"), "start", "left")
        front = materialize(at.select("start", "chain", F.col("pos").alias("top"), F.lit(0).cast("long").alias("place")), "page")
        if not front.where("chain is null").isEmpty():
            raise ValueError("a history starts at a commit")
        onward = self.cross.where("ord = 0 and c_pos = 0").select(F.col("c_chain").alias("chain"), "p_chain", "p_pos")
        out = None
        while True:
            took = F.least(F.col("top") + 1, F.lit(size + 1) - F.col("place"))
            asked = front.select("start", "chain", F.explode(F.sequence(F.lit(0).cast("long"), took - 1)).alias("k"), "top", "place").select("start", "chain", (F.col("top") - F.col("k")).alias("pos"), (F.col("place") + F.col("k")).cast("int").alias("place"))
            found = asked.join(self.places, ["chain", "pos"]).select("start", "place", "id")
            out = found if out is None else out.unionByName(found)
            left = front.withColumn("took", took).where(F.col("place") + F.col("took") <= size)
            front = materialize(left.join(onward, "chain").select("start", F.col("p_chain").alias("chain"), F.col("p_pos").alias("top"), (F.col("place") + F.col("took")).alias("place")), "page")
            if front.isEmpty():
                break
        token = F.max(F.when(F.col("place") == size, F.col("id"))).over(Window.partitionBy("start"))
        return out.withColumn("next_token", token).where(F.col("place") < size).select("start", "place", "id", "next_token")

    def generations(self, block: int = 1 << 16) -> DataFrame:
        """(id, generation): 1 for a root, else one more than the largest of its parents.

        Chains are passed over in blocks of places, each sorted by itself; what the blocks before hold at most is carried in.
        """
        cross = materialize(self.cross.select("child", "parent", "c_chain", "c_pos", "p_chain", "p_pos", F.lit(0).cast("long").alias("lead")), "leads")

        def best(asks: DataFrame, leads: DataFrame) -> DataFrame:
            """The largest lead at or before each asked place of a chain."""
            rows = leads.select(F.col("c_chain").alias("chain"), F.col("c_pos").alias("pos"), F.lit(0).alias("rank"), "lead", F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"))
            rows = rows.unionByName(asks.select("chain", "pos", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("lead"), "ask")).withColumn("block", F.floor(F.col("pos") / block))
            before = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            carried = rows.groupBy("chain", "block").agg(F.max("lead").alias("most")).select("chain", "block", F.max("most").over(before).alias("carried"))
            top = F.max("lead").over(Window.partitionBy("chain", "block").orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, 0))
            met = rows.withColumn("top", top).where("rank = 1").join(carried, ["chain", "block"])
            return met.select("ask", "chain", "pos", F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("carried", F.lit(0)), F.lit(0)).alias("best"))

        while True:
            asks = cross.select(F.struct("child", "parent", "c_chain", "c_pos", "p_chain", "p_pos").alias("ask"), F.col("p_chain").alias("chain"), F.col("p_pos").alias("pos"))
            lead = F.greatest(F.col("ask.p_pos") + 1 + F.col("best") + 1 - (F.col("ask.c_pos") + 1), F.lit(0))
            after = materialize(best(asks, cross).select("ask.*", lead.alias("lead")), "leads")
            if after.agg(F.sum("lead")).first()[0] == cross.agg(F.sum("lead")).first()[0]:
                break
            cross = after
        asks = self.places.select(F.col("id").alias("ask"), "chain", "pos")
        return best(asks, cross).select(F.col("ask").alias("id"), (F.col("pos") + 1 + F.col("best")).alias("generation"))


def history(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): first-parent depth of every commit."""
    return climb(nodes, edges.where("ord = 0").select(F.col("child").alias("id"), F.col("parent").alias("to")), "history").select("id", F.col("pos").alias("depth"))


def pushed_walk(pushed: DataFrame, edges: DataFrame, stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (old, new) whether old is met, walking back from new through the pushed commits (id), and ``edge``, the stored commits (id) where the walk ends."""
    inner = edges.join(pushed.select(F.col("id").alias("child")), "child", "left_semi")
    graph = Graph(pushed, inner.join(pushed.select(F.col("id").alias("parent")), "parent", "left_semi"))
    met = graph.ancestors(pairs.select(F.col("new").alias("seed"), F.col("new").alias("id")).distinct())
    ends = met.join(inner.select(F.col("child").alias("id"), "parent"), "id").select("seed", F.col("parent").alias("id"))
    ends = ends.unionByName(pairs.select(F.col("new").alias("seed"), F.col("new").alias("id"))).join(stored.select("id"), "id", "left_semi").distinct()
    seen = met.unionByName(ends).select(F.col("seed").alias("new"), F.col("id").alias("old"), F.lit(True).alias("reached")).distinct()
    edge = ends.groupBy(F.col("seed").alias("new")).agg(F.array_sort(F.collect_list("id")).alias("edge"))
    out = pairs.join(seen, ["old", "new"], "left").join(edge, "new", "left")
    return out.select("old", "new", F.coalesce("reached", F.lit(False)).alias("reached"), F.coalesce("edge", F.array().cast(edge.schema["edge"].dataType)).alias("edge"))


def deepen(edges: DataFrame, wants: DataFrame, depth: int) -> DataFrame:
    """(id, depth, shallow) of commits within ``depth`` of the wants; those at the boundary are shallow."""
    front = wants.select("id", F.lit(1).alias("depth")).distinct()
    seen = materialize(front, "deepen")
    for d in range(2, depth + 1):
        below = seen.where(F.col("depth") == d - 1).join(edges, F.col("id") == F.col("child")).select(F.col("parent").alias("id")).distinct()
        front = below.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        after = materialize(seen.unionByName(front), "deepen")
        release(seen)
        seen = after
        if seen.where(F.col("depth") == d).isEmpty():
            break
    return seen.select("id", "depth", (F.col("depth") >= depth).alias("shallow"))


def deepen_relative(edges: DataFrame, shallow: DataFrame, more: int) -> DataFrame:
    """(id, depth, shallow) of what lies up to ``more`` below a client's shallow commits (id)."""
    return deepen(edges, shallow, more + 1).where("depth > 1").select("id", (F.col("depth") - 1).alias("depth"), "shallow")


def unshallowed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Commits (id) that a client held as shallow and that :func:`deepen` (id, depth, shallow) now gives whole."""
    return before.select("id").join(after.where("not shallow").select("id"), "id", "left_semi")


def force_flags(graph: Graph, updates: DataFrame, tags: DataFrame, most: int = 15) -> DataFrame:
    """``updates`` (refname, old, new) with ``force``: the old tip isn't an ancestor of the new one.

    Both tips are peeled through annotated tags (tag, target), at most ``most`` in a row.  A create or a delete is no
    force; what can't be shown to be a fast-forward is one, as is a tip that ends in no commit.
    """
    asked = updates.where("old is not null and new is not null")
    ends = materialize(peel(asked.select(F.explode(F.array("old", "new")).alias("oid")).distinct(), tags, most), "peeled")
    old, new = (ends.select(F.col("oid").alias(k), F.col("peeled").alias(c)) for k, c in (("old", "a"), ("new", "d")))
    met = materialize(asked.join(old, "old", "left").join(new, "new", "left").select("refname", "old", "new", "a", "d"), "moves")
    shown = graph.is_ancestor(met.where("a is not null and d is not null").select("a", "d")).where("is_ancestor").select("a", "d", F.lit(True).alias("shown"))
    known = graph.places.select(F.col("id").alias("a"), F.lit(True).alias("known"))
    moved = met.join(shown, ["a", "d"], "left").join(known, "a", "left").select("refname", "old", "new", (~(F.coalesce("shown", F.lit(False)) & F.coalesce("known", F.lit(False)))).alias("force"))
    return moved.unionByName(updates.where("old is null or new is null").withColumn("force", F.lit(False)).select("refname", "old", "new", "force"))
