"""Queries over identifiers, names, listings, layers and requests, each with SQL written from its rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions import scalars
from heddle.operators import checks, graph, hooks, lifecycle, maintain, state, trees
from heddle.registry import LEVELS, MODEL, SNAPSHOTS, query, snapshots, tips
from heddle.sources import model, packs
from heddle.sources.model import table


@query("""SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 32, '0') || '-' || lpad(lower(to_hex(o_custkey)), 16, '0') || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS layer,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS generation FROM orders""")
def layer_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    layer = F.concat(scalars.layer_id(F.col("o_orderkey"), F.col("o_custkey")), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    return o.select("o_orderkey", layer.alias("layer")).withColumn("generation", scalars.layer_generation(F.col("layer")))


KEYS = ["a", "a/b", "a//b", "/a", "a/", ".", "a/..", "a/./b", "a.b-c_d", "a b", "é", "x" * 300, ""]
KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"


@query(f"""SELECT c_custkey, key, strlen(key) <= 256 AND len(list_filter(string_split(key, '/'), lambda p: p = '' OR p = '.' OR p = '..' OR regexp_matches(p, '[^A-Za-z0-9._-]'))) = 0 AS ok
    FROM (SELECT c_custkey, replace(c_name, '#', '-') || '/' || {KEYS_SQL}[CAST(c_custkey % {len(KEYS)} AS INT) + 1] AS key FROM customer)""")
def repository_keys(spark, sf_dir):
    key = F.concat(F.regexp_replace("c_name", "#", "-"), F.lit("/"), F.get(F.array(*map(F.lit, KEYS)), (F.col("c_custkey") % len(KEYS)).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key")).withColumn("ok", scalars.repo_key_ok(F.col("key")))


@query("""SELECT event_id, event_type <> 'logout' AND (event_id % 11 <> 0) AND event_id % 7 <> 0 AND (event_id % 13) * 30 % 60 = 0 AND event_id % 17 <> 3 AS ok FROM events""")
def identities_writable(spark, sf_dir):
    k = F.col("event_id")
    name = F.when(F.col("event_type") == "logout", "a<b").when(k % 11 == 0, "").otherwise("U V")
    seconds, offset = F.when(k % 7 == 0, -1).otherwise(k), F.when(k % 17 == 3, 100 * 3600).otherwise((k % 13) * 30)
    return table(spark, sf_dir, "events").select("event_id", scalars.identity_ok(name, F.lit("u@v"), seconds, offset).alias("ok"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE sha1('x' || event_id) END AS target FROM events""")
def tag_targets(spark, sf_dir):
    k = F.col("event_id")
    oid = F.sha1(F.concat(F.lit("x"), k.cast("string")).cast("binary"))
    text = F.concat(F.when(k % 4 == 0, "objekt ").otherwise("object "), oid, F.lit("\ntype commit\nobject 0\n"))
    return table(spark, sf_dir, "events").select("event_id", scalars.tag_target(text).alias("target"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE 'r' || n_regionkey || '/' END || n_name || chr(65533) AS path FROM nation")
def joined_paths(spark, sf_dir):
    prefix = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("r"), "n_regionkey"))
    raw = F.concat(F.col("n_name").cast("binary"), F.lit(b"\xff"))  # a byte that is no UTF-8
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.join_path(prefix, scalars.lossy(raw)).alias("path"))


@query(f"SELECT path, kind, oid, depth, (SELECT count(*) FROM ({LEVELS})) > 100 AS truncated FROM ({LEVELS}) ORDER BY depth, path LIMIT 100")
def list_tree_cut(spark, sf_dir):
    return trees.cut(trees.list_tree(model.tree_entries(spark, sf_dir), "root"), ["depth", "path"], 100)


@query(SNAPSHOTS + """, d AS (SELECT path, CASE WHEN a.oid IS NULL THEN 'added' WHEN b.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.oid AS old_oid, b.oid AS new_oid FROM a FULL JOIN b USING (path) WHERE a.oid IS DISTINCT FROM b.oid)
SELECT *, (SELECT count(*) FROM d) > 50 AS truncated FROM d ORDER BY path LIMIT 50""")
def diff_in_order(spark, sf_dir):
    return trees.in_path_order(trees.diff(*snapshots(spark, sf_dir)), 50)


#: The nested tree, and one where some customers moved, one nation is gone and a region became a file.
NESTED = """WITH old AS (SELECT r_name || '/' || n_name || '/' || c_name AS path, 'c' || c_custkey AS oid, c_custkey, n_nationkey, r_regionkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
new AS (SELECT path, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE oid END AS oid FROM old WHERE n_nationkey <> 5 AND r_regionkey <> 4 UNION ALL SELECT r_name, 'file' FROM region WHERE r_regionkey = 4)
"""


@query(NESTED + "SELECT path, CASE WHEN o.oid IS NULL THEN 'added' WHEN n.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.oid AS old_oid, n.oid AS new_oid FROM old o FULL JOIN new n USING (path) WHERE o.oid IS DISTINCT FROM n.oid")
def diff_nested_trees(spark, sf_dir):
    old = model.tree_entries(spark, sf_dir)
    touched = table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("n"), "c_nationkey").alias("oid")).distinct()
    nations = old.where("oid like 'n%'").join(touched, "oid", "left_semi").select("oid", "tree")
    # directories above a change have new ids, and so new entries; all others are shared
    moved = nations.select("oid").unionByName(nations.select(F.col("tree").alias("oid"))).unionByName(table(spark, sf_dir, "nation").where("n_nationkey = 5").select(F.concat(F.lit("r"), "n_regionkey").alias("oid"))).distinct()
    fresh = old.join(moved.unionByName(old.where("tree = 'root'").select(F.col("tree").alias("oid")).distinct()).select(F.col("oid").alias("tree")), "tree", "left_semi")
    fresh = fresh.join(moved.select("oid", F.lit(True).alias("moved")), "oid", "left").where("oid <> 'n5'")
    changed = (F.col("kind") == "blob") & (F.substring("oid", 2, 20).cast("long") % 9 == 0)
    region = (F.col("tree") == "root") & (F.col("oid") == "r4")
    oid = F.when(region, "file").when(changed, "x").when(F.col("moved"), F.concat("oid", F.lit("'"))).otherwise(F.col("oid"))
    new = fresh.select(F.concat("tree", F.lit("'")).alias("tree"), "name", F.when(region, "blob").otherwise(F.col("kind")).alias("kind"), oid.alias("oid"))
    return trees.diff_trees(old.unionByName(new), "root", "root'")


@query("SELECT o_orderkey, 5 AS generation FROM orders WHERE o_orderkey % 9 <> 0 AND o_custkey % 8 < 3")
def republished(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("generation"), F.lit(5).alias("current"), (F.col("o_orderkey") % 9 == 0).alias("inline"))
    return maintain.republish(maintain.admit(u)).select("o_orderkey", F.col("generation").cast("int").alias("generation"))


@query(MODEL + "SELECT name, oid FROM refs WHERE starts_with(name, 'refs/tags/')")
def remote_refs(spark, sf_dir):
    return state.remote_listing(model.refs(spark, sf_dir), ["refs/tags/"])


#: Each order's lines are layers of ten ids; the run of an order replaces some of them.
REPLACED = "WITH runs AS (SELECT l_orderkey AS run, count(*) AS lines FROM lineitem GROUP BY 1)"


@query(REPLACED + """SELECT run, fault FROM (SELECT run, CASE WHEN run % 6 = 1 THEN 'GONE' WHEN run % 6 = 2 AND lines >= 3 THEN 'NOT_CONSECUTIVE' WHEN run % 6 = 3 OR (run % 6 = 2 AND lines = 2) THEN 'OUTSIDE' WHEN run % 6 = 4 THEN 'EMPTY' END AS fault FROM runs) WHERE fault IS NOT NULL""")
def layer_replacements(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("n"))
    layers = lines.select("repo", F.concat_ws("-", "repo", "n").alias("layer"), (F.col("n") * 10).alias("first_id"), F.lit(10).alias("id_span"))
    run = F.col("repo") % 6
    removed = layers.select(F.col("repo").alias("run"), "repo", F.when((run == 1) & (F.col("first_id") == 10), "lost").otherwise(F.col("layer")).alias("layer"), "first_id")
    removed = removed.where(~((F.col("run") % 6 == 2) & (F.col("first_id") == 20)))
    added = layers.groupBy(F.col("repo").alias("run")).agg(F.min("first_id").alias("first_id"), (F.max("first_id") + 10 - F.min("first_id")).alias("id_span"))
    k = F.col("run") % 6
    added = added.select("run", "first_id", F.when(k == 3, F.col("id_span") + 1).when(k == 4, F.lit(0)).otherwise(F.col("id_span")).alias("id_span"))
    return maintain.replacement_faults(layers, removed, added)


@query("""SELECT CAST(node + before AS BIGINT) AS node, CAST(CASE WHEN parent < 0 THEN parent ELSE parent + before END AS BIGINT) AS parent FROM (
    SELECT seq, node, CASE WHEN node = 0 THEN -1 ELSE node - 1 END AS parent, coalesce((SELECT sum(nodes) FROM (SELECT event_id // 100 AS s, count(*) AS nodes FROM events GROUP BY 1) WHERE s < seq), 0) AS before
    FROM (SELECT event_id // 100 AS seq, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS node FROM events))""")
def concatenated_graphs(spark, sf_dir):
    layer = Window.partitionBy("seq")
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("seq"), "event_id")
    e = e.withColumns({"node": F.row_number().over(layer.orderBy("event_id")).cast("long") - 1, "nodes": F.count("*").over(layer)})
    return maintain.concatenated(e.withColumn("parent", F.when(F.col("node") == 0, F.lit(-1)).otherwise(F.col("node") - 1)))


@query("SELECT c_custkey AS repo FROM customer WHERE c_nationkey % 3 <> 0 AND 1000 - c_custkey % 1000 > 300")
def idle_views(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), (F.col("c_custkey") % 1000).alias("used_at"), (F.col("c_nationkey") % 3 == 0).alias("busy"))
    return maintain.idle(v, 1000, 300)


@query(MODEL + "SELECT path, oid, size FROM files WHERE doc_id % 3 = 0 AND size < 1000")
def objects_of_a_kind(spark, sf_dir):
    f = model.files(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "blob").otherwise("tag"))
    return checks.of_kind(checks.within_limit(f, 999), "blob").select("path", "oid", "size")


@query("""SELECT 'repo' || branch AS repo, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) AS BIGINT) AS epoch, arg_max('h' || id, id) FILTER (WHERE begins) AS head FROM (
    SELECT user_id AS branch, event_id AS id, event_type, event_type <> 'purchase' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'purchase') = 'purchase' AS begins FROM events WHERE user_id = 3)
    GROUP BY branch HAVING arg_max(event_type, id) <> 'purchase'""")
def one_repository(spark, sf_dir):
    c = model.commits(spark, sf_dir)
    log = c.select(F.concat(F.lit("repo"), "branch").alias("repo"), F.col("id").alias("seq"), F.when(F.col("kind") == "purchase", "delete").otherwise("create").alias("action"), F.concat(F.lit("h"), "id").alias("head"))
    return lifecycle.described(log, "repo3")


@query("SELECT c_custkey AS repo, 'b' || min(o_orderkey) AS head FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0 GROUP BY 1")
def created_repositories(spark, sf_dir):
    there = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("repo"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("b"), "o_orderkey").alias("head"))
    return lifecycle.created(there, asked)


@query("""SELECT o_orderkey AS request, CASE WHEN denial IS NULL THEN repo END AS repo, denial FROM (SELECT o_orderkey, 'r' || o_custkey AS repo, CASE WHEN o_orderkey % 10 = 0 THEN 'BAD_PATH' WHEN o_custkey % 4 = 0 THEN 'NOT_GRANTED' WHEN o_orderstatus = 'F' AND o_custkey % 4 = 1 THEN 'READ_ONLY' END AS denial FROM orders)""")
def authorized_requests(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    path = F.concat(F.lit("/r"), k, F.when(F.col("o_orderkey") % 10 == 0, "/../x").when(F.col("o_orderkey") % 3 == 0, ".git").otherwise("/"))
    asked = o.select(F.col("o_orderkey").alias("request"), path.alias("path"), F.lit("u").alias("actor"), F.when(F.col("o_orderstatus") == "F", "write").otherwise("read").alias("access"))
    grants = o.where(k % 4 != 0).select(F.concat(F.lit("r"), k).alias("repo"), F.lit("u").alias("actor"), F.when(k % 4 == 1, "read").otherwise("write").alias("access"))
    return hooks.authorize(asked, grants).select("request", "repo", "denial")


@query(MODEL + "SELECT branch // 10 AS push, string_agg('refs/heads/u' || branch, ',' ORDER BY branch) AS told FROM tips WHERE branch % 3 <> 0 GROUP BY 1")
def told_after_push(spark, sf_dir):
    b = F.col("branch")
    commands = tips(spark, sf_dir).select(F.floor(b / 10).alias("push"), b.alias("ord"), F.concat(F.lit("refs/heads/u"), b).alias("refname"), F.lit(None).cast("long").alias("old"), F.col("oid").alias("new"), F.when(b % 3 == 0, "STALE_OLD_VALUE").alias("reason"))
    return hooks.landed(commands).select("push", F.array_join("commands.refname", ",").alias("told"))


@query(MODEL + "SELECT name, oid FROM refs WHERE starts_with(name, 'refs/heads/u1')")
def refs_by_rule(spark, sf_dir):
    return hooks.visible_refs(model.refs(spark, sf_dir), lambda name: name.startswith("refs/heads/u1") | (name == "refs/heads/nobody")).select("name", "oid")


#: Commits of the newest half of events are pushed, the others stored.
PUSHED = MODEL + """, half AS (SELECT quantile_disc(id, 0.5) AS h FROM commits), walk AS (SELECT oid AS new, oid AS id FROM tips UNION SELECT w.new, e.parent FROM walk w JOIN edges e ON e.child = w.id, half WHERE w.id > h)
, met AS (SELECT DISTINCT new, id, id <= h AS stored FROM walk, half), firsts AS (SELECT t.oid AS new, min(c.id) AS old FROM tips t JOIN commits c ON c.branch = t.branch - t.branch % 2 GROUP BY 1)
"""


@query(PUSHED + "SELECT old, new, EXISTS (SELECT 1 FROM met m WHERE m.new = f.new AND m.id = f.old) AS reached, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM met m WHERE m.new = f.new AND stored), '') AS edge FROM firsts f")
def pushed_commits(spark, sf_dir):
    c, t, b = model.commits(spark, sf_dir), tips(spark, sf_dir), F.col("branch")
    half = c.agg(F.percentile_disc(0.5).within_group("id") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY id)")).first()[0]
    oldest = c.groupBy(F.col("branch").alias("b")).agg(F.min("id").alias("old"))
    pairs = t.join(oldest, b - b % 2 == F.col("b")).select("old", F.col("oid").alias("new"))
    found = graph.pushed_walk(c.where(F.col("id") > half).select("id"), model.edges(spark, sf_dir), c.where(F.col("id") <= half).select("id"), pairs)
    return found.withColumn("edge", F.array_join(F.col("edge").cast("array<string>"), ","))


@query(MODEL + """, bare AS (SELECT * FROM edges WHERE child % 11 <> 0), walk AS (SELECT branch % 2 AS seed, oid AS id FROM tips UNION SELECT w.seed, e.parent FROM walk w JOIN bare e ON e.child = w.id)
SELECT id FROM walk WHERE seed = 1 EXCEPT SELECT id FROM walk WHERE seed = 0""")
def shallow_walk(spark, sf_dir):
    c, t = model.commits(spark, sf_dir).select("id"), tips(spark, sf_dir)
    g = graph.Graph(c, model.edges(spark, sf_dir), shallow=c.where("id % 11 = 0"))
    return g.between(t.where("branch % 2 = 1").select(F.col("oid").alias("id")), t.where("branch % 2 = 0").select(F.col("oid").alias("id")))


@query(MODEL + """, walk AS (SELECT oid AS id, 1 AS depth FROM tips UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.id WHERE w.depth < 5),
near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT id FROM near WHERE depth = 4 OR (depth < 5 AND id % 10 = 0 AND depth <> 4)""")
def unshallowed_commits(spark, sf_dir):
    e, wants = model.edges(spark, sf_dir), tips(spark, sf_dir).select(F.col("oid").alias("id"))
    deeper = graph.deepen(e, wants, 5)
    held = deeper.where("depth = 4 or id % 10 = 0").select("id")
    return graph.unshallowed(held, deeper)


FILTERS = {"blob:none": "kind <> 'blob'", "blob:limit=1k": "kind <> 'blob' OR size < 1024", "tree:0": "kind NOT IN ('blob', 'tree')"}


@query(MODEL + ", o AS (SELECT doc_id, size, CASE doc_id % 3 WHEN 0 THEN 'blob' WHEN 1 THEN 'tree' ELSE 'commit' END AS kind FROM files) " + " UNION ALL ".join(f"SELECT '{spec}' AS spec, doc_id, kind FROM o WHERE {rule} OR doc_id % 97 = 0" for spec, rule in FILTERS.items()))
def object_filters(spark, sf_dir):
    k = F.col("doc_id") % 3
    o = model.files(spark, sf_dir).select("doc_id", "size", F.when(k == 0, "blob").when(k == 1, "tree").otherwise("commit").alias("kind"), (F.col("doc_id") % 97 == 0).alias("wanted"))
    out = None
    for spec in FILTERS:
        part = checks.filtered(o, spec).select(F.lit(spec).alias("spec"), "doc_id", "kind")
        out = part if out is None else out.unionByName(part)
    return out


@query(MODEL + "SELECT DISTINCT oid, 'blob' AS kind, size FROM files")
def packed_objects(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(scalars.blob_id(F.col("text")).alias("oid"), F.lit("blob").alias("kind"), F.col("text").cast("binary").alias("content"))
    return packs.read_packs(packs.write_packs(d, 4 << 20)).select("oid", "kind", "size")


@query()
def push_order(spark, sf_dir):
    c = model.commits(spark, sf_dir).select(F.floor(F.col("branch") / 10).alias("push"), "id", F.col("id").alias("place"))
    parents = model.edges(spark, sf_dir).groupBy(F.col("child").alias("id")).agg(F.collect_list("parent").alias("parents"))
    return lifecycle.push_order(c.join(parents, "id", "left"))


@query()
def compaction_runs(spark, sf_dir):
    layers = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("repo"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").alias("bytes"))
    return maintain.compaction_runs(layers, 8, 1000)
