"""More queries: repository state, object checks, pushes to remotes and upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.operators import checks, graph, maintain, state
from heddle.registry import CLOSURE, MODEL, ORACLE_SQL, QUERIES, commit_texts, query, the_graph, tips
from heddle.sources import model
from heddle.sources.model import table


@query(MODEL + """, u AS (
    SELECT branch // 10 AS command, branch * 2 AS ord, 'refs/heads/u' || branch AS refname, CASE WHEN branch % 6 = 0 THEN oid + 1 ELSE oid END AS old, CAST(NULL AS BIGINT) AS new FROM tips WHERE branch % 3 = 0
    UNION ALL SELECT branch // 10, branch * 2 + 1, 'refs/heads/u' || branch, CASE WHEN branch % 3 <> 0 THEN oid END, oid + 5 FROM tips),
m AS (SELECT u.*, r.oid AS now, u.new IS NULL AND u.old = r.oid AS lands FROM u JOIN refs r ON r.name = u.refname)
SELECT command, ord, refname, CASE WHEN new IS NULL THEN 0 WHEN bool_or(new IS NULL) OVER (PARTITION BY command) THEN 1 ELSE 0 END AS phase,
    CASE WHEN old IS DISTINCT FROM CASE WHEN new IS NOT NULL AND bool_or(lands) OVER (PARTITION BY refname) THEN NULL ELSE now END THEN 'STALE_OLD_VALUE' END AS reason FROM m""")
def phased_updates(spark, sf_dir):
    b, t = F.col("branch"), tips(spark, sf_dir)
    name, command = F.concat(F.lit("refs/heads/u"), b).alias("refname"), F.floor(b / 10).alias("command")
    gone = t.where(b % 3 == 0).select(command, (b * 2).alias("ord"), name, F.when(b % 6 == 0, F.col("oid") + 1).otherwise(F.col("oid")).alias("old"), F.lit(None).cast("long").alias("new"))
    sets = t.select(command, (b * 2 + 1).alias("ord"), name, F.when(b % 3 != 0, F.col("oid")).alias("old"), (F.col("oid") + 5).alias("new"))
    return state.land_in_phases(gone.unionByName(sets), model.refs(spark, sf_dir))


@query("""SELECT o_orderkey AS command, o_custkey AS repo, o_orderkey % 3 AS epoch, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'push' END AS action,
    CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_REPOSITORY' WHEN o_orderkey % 3 <> c_nationkey % 3 THEN 'OTHER_INCARNATION' WHEN c_custkey % 7 = 0 AND o_orderstatus <> 'F' THEN 'DELETED' END AS refusal
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) ON c_custkey = o_custkey""")
def guarded_commands(spark, sf_dir):
    repos = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("repo"), (F.col("c_nationkey") % 3).alias("epoch"), (F.col("c_custkey") % 7 == 0).alias("deleted"))
    commands = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("command"), F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 3).alias("epoch"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("push").alias("action"))
    return state.guarded(commands, repos)


@query("""SELECT c_custkey AS repo, c_nationkey + count(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS version,
    greatest(c_custkey * 10, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0)) AS last_push FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey""")
def advanced_state(spark, sf_dir):
    k = F.col("o_orderkey")
    repos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_nationkey").alias("version"), (F.col("c_custkey") * 10).alias("last_push"))
    landed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), k.alias("at"), (k % 2 == 0).alias("refs"), (k % 3 == 0).alias("layers"), (k % 5 == 0).alias("head"))
    return state.advance(repos, landed)


FEED = MODEL + ", feed AS (SELECT branch AS repo, id, row_number() OVER (PARTITION BY branch ORDER BY ts, id) AS version FROM commits), changes AS (SELECT repo, version, CASE WHEN id % 37 = 0 THEN -1 ELSE version - 1 END AS before, version AS chain FROM feed)\n"


@query(FEED + "SELECT repo, version, before, chain FROM changes c WHERE version < coalesce((SELECT min(version) FROM changes d WHERE d.repo = c.repo AND d.before = -1 AND d.version > 1), 1000000)")
def applicable_changes(spark, sf_dir):
    version = F.row_number().over(Window.partitionBy("branch").orderBy("ts", "id")).cast("long")
    c = model.commits(spark, sf_dir).select(F.col("branch").alias("repo"), "id", version.alias("version"))
    return state.applicable(c.select("repo", "version", F.when(F.col("id") % 37 == 0, -1).otherwise(F.col("version") - 1).alias("before"), F.col("version").alias("chain")))


@query(FEED + "SELECT 'b' || repo AS name, id AS oid, version FROM feed WHERE version <= 10 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY version DESC) = 1")
def read_at_version(spark, sf_dir):
    version = F.row_number().over(Window.partitionBy("branch").orderBy("ts", "id")).cast("long")
    return state.at_version(model.commits(spark, sf_dir).select(F.concat(F.lit("b"), "branch").alias("name"), F.col("id").alias("oid"), version.alias("version")), 10)


STEPS = MODEL + """, steps AS (SELECT t.branch // 10 AS push, 'refs/heads/u' || t.branch AS destination, CASE WHEN t.branch % 7 <> 0 THEN o.id END AS old, t.oid AS new, t.branch % 5 = 0 AS force, 'send' AS action
    FROM tips t JOIN (SELECT branch, min(id) AS id FROM commits GROUP BY 1) o ON o.branch = t.branch - t.branch % 2), seeds AS (SELECT DISTINCT new AS seed, new AS id FROM steps)""" + CLOSURE + """, checked AS (
    SELECT push, destination, old, new, force, CASE WHEN NOT force AND old IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.seed = new AND r.id = old) THEN 'reject_not_forward' ELSE action END AS action FROM steps)
"""


@query(STEPS + "SELECT * FROM checked")
def fast_forward_check(spark, sf_dir):
    t, b = tips(spark, sf_dir), F.col("branch")
    oldest = model.commits(spark, sf_dir).groupBy(F.col("branch").alias("b")).agg(F.min("id").alias("o"))
    steps = t.join(oldest, b - b % 2 == F.col("b")).select(F.floor(b / 10).alias("push"), F.concat(F.lit("refs/heads/u"), b).alias("destination"), F.when(b % 7 != 0, F.col("o")).alias("old"), F.col("oid").alias("new"), (b % 5 == 0).alias("force"), F.lit("send").alias("action"))
    return state.fast_forwards(the_graph(spark, sf_dir), steps)


PUSH = MODEL + """, steps AS (SELECT branch // 3 AS push, 'u' || branch AS destination, branch, CASE WHEN branch % 11 = 0 THEN 'reject_not_held' WHEN branch % 5 = 0 THEN 'delete' WHEN branch % 7 = 0 THEN 'up_to_date' ELSE 'send' END AS action FROM tips),
held AS (SELECT push, destination, branch, CASE WHEN bool_or(action = 'reject_not_held') OVER (PARTITION BY push) AND action IN ('send', 'delete') THEN 'reject_held_back' ELSE action END AS action FROM steps)
"""


@query(PUSH + """SELECT push, destination, CASE WHEN action NOT IN ('send', 'delete') THEN action WHEN branch % 4 = 3 THEN 'rejected: no answer' WHEN branch % 4 = 1 THEN 'rejected: hook'
    WHEN action = 'delete' THEN 'deleted' ELSE 'updated' END AS status FROM held""")
def push_outcomes(spark, sf_dir):
    t, b = tips(spark, sf_dir), F.col("branch")
    push, name = F.floor(b / 3).alias("push"), F.concat(F.lit("u"), b)
    action = F.when(b % 11 == 0, "reject_not_held").when(b % 5 == 0, "delete").when(b % 7 == 0, "up_to_date").otherwise("send")
    report = t.where(b % 4 != 3).select(push, name.alias("refname"), F.when(b % 4 == 1, "hook").alias("why"))
    return state.outcomes(state.hold_back(t.select(push, name.alias("destination"), action.alias("action"))), report)


@query("SELECT event_id AS ord, event_id * 2 AS oid FROM events WHERE event_id * 2 IN (SELECT event_id FROM events)")
def negotiated_haves(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return state.common_haves(e.select(F.col("event_id").alias("ord"), (F.col("event_id") * 2).alias("oid")), e.select(F.col("event_id").alias("oid")))


@query("SELECT min(event_id) AS ord, event_id % 500 + 1 AS oid FROM events WHERE (event_id % 500 + 1) % 3 <> 0 GROUP BY 2")
def pack_wants(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), (F.col("event_id") % 500 + 1).alias("oid"))
    objects = table(spark, sf_dir, "events").select(F.col("event_id").alias("oid"))
    return state.to_pack(e, objects.where("oid % 3 = 0"), objects)


FAULTS = [("", "", None), ("tree ", "treE ", "NO_TREE"), ("tree ", "tree g", "BAD_TREE"), ("author ", "writer ", "NO_AUTHOR"), ("committer ", "comitter ", "NO_COMMITTER"), (" <", "<", "NO_SPACE_BEFORE_EMAIL"), ("> 1", ">1", "NO_SPACE_BEFORE_DATE"), ("> 17", "> 017", "ZERO_PADDED_DATE")]


def broken_text(column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN replace({column}, '{a}', '{b}')" for k, (a, b, _) in enumerate(FAULTS) if a)
    return f"CASE id % {len(FAULTS)} {cases} ELSE {column} END"


@query(f"SELECT event_id AS id, CASE event_id % {len(FAULTS)} " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, _, c) in enumerate(FAULTS) if c) + " END AS fault FROM events")
def commit_fsck(spark, sf_dir):
    whole = commit_texts(spark, sf_dir).select("id", F.regexp_replace("content", r"(?m)^committer [^\n]*$", "committer U <u@example.org> 1700000000 +0000").alias("content"))
    return whole.select("id", F.expr(broken_text("content")).alias("content")).select("id", checks.commit_fault(F.col("content")).alias("fault"))


@query(MODEL + """SELECT 'c' || id AS source, 't' || id AS oid, 'tree' AS kind FROM commits UNION ALL SELECT 'c' || child, 'c' || parent, 'commit' FROM edges
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'blob' ELSE 'tree' END FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT 'v' || oid, 'c' || oid, 'commit' FROM refs WHERE starts_with(name, 'refs/tags/')""")
def object_references(spark, sf_dir):
    named = lambda p, c: F.concat(F.lit(p), F.col(c))
    parents = model.edges(spark, sf_dir).groupBy(F.col("child").alias("id")).agg(F.collect_list(named("c", "parent")).alias("parents"))
    commits = model.commits(spark, sf_dir).join(parents, "id", "left").select(named("c", "id").alias("oid"), named("t", "id").alias("tree"), "parents")
    mode = F.get(F.array(F.lit(33188), F.lit(16384), F.lit(57344)), (F.col("c_custkey") % 3).cast("int"))
    entries = table(spark, sf_dir, "customer").select(named("n", "c_nationkey").alias("tree"), mode.alias("mode"), named("c", "c_custkey").alias("oid"))
    tags = model.refs(spark, sf_dir).where("name like 'refs/tags/%'").select(named("v", "oid").alias("oid"), named("c", "oid").alias("target"), F.lit("commit").alias("kind"))
    return checks.references(commits, entries, tags)


@query(MODEL + "SELECT lang AS tree, CAST(row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS INT) AS ord, 33188 AS mode, CAST(doc_id AS VARCHAR) AS name, oid FROM files JOIN documents USING (doc_id)")
def tree_round_trip(spark, sf_dir):
    f = model.files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("tree"), F.lit("100644").alias("mode"), F.col("doc_id").cast("string").alias("name"), "oid")
    return checks.parse_trees(checks.tree_bytes(f)).withColumn("name", F.col("name").cast("string"))


@query(MODEL + ", walk AS (SELECT oid AS id, 0 AS depth FROM tips WHERE branch % 2 = 0 UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth, min(depth) >= 3 AS shallow FROM walk GROUP BY id HAVING min(depth) > 0")
def deepen_relative(spark, sf_dir):
    return graph.deepen_relative(model.edges(spark, sf_dir), tips(spark, sf_dir).where("branch % 2 = 0").select(F.col("oid").alias("id")), 3)


@query("""SELECT o_custkey AS repo, CASE WHEN count(*) >= 20 THEN 'count' WHEN sum(o_orderkey % 1000) >= 8000 THEN 'bytes' WHEN 100000 - min(o_orderkey) >= 99000 THEN 'age' END AS due FROM orders GROUP BY 1""")
def flush_due(spark, sf_dir):
    layers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 1000).alias("bytes"), F.col("o_orderkey").alias("at"))
    return maintain.flush_due(layers, 100_000, 99_000, 8000, 20)


@query("""SELECT o_custkey AS repo, o_orderkey AS seq, o_orderkey % 1000 AS bytes FROM orders o WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderstatus = 'P'), 1000000000)""")
def stored_prefix(spark, sf_dir):
    return maintain.stored_prefix(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000).alias("bytes"), (F.col("o_orderstatus") == "P").alias("inline")))


@query("""SELECT repo, version FROM (SELECT o_custkey AS repo, max(o_orderkey) AS version, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1) WHERE done IS NULL OR done < version""")
def pending_repositories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("version"), "o_orderstatus")
    return maintain.pending(o, o.where("o_orderstatus = 'F'"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS file FROM lineitem JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) ON s_suppkey = l_suppkey WHERE l_partkey % 25 <= s_nationkey AND 5000000 - l_partkey * 1000 > 4900000""")
def reclaim_ended(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo"), F.lit(1).alias("epoch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), (F.col("l_partkey") % 25).alias("generation"), (F.col("l_partkey") * 1000).alias("since"))
    ended = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("repo"), F.lit(1).alias("epoch"), F.col("s_nationkey").alias("marker"))
    return maintain.reclaimable(listed, ended, 5_000_000, 4_900_000)
