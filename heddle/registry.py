"""Queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import scalars
from heddle.operators import graph, lifecycle, maintain, refs, trees
from heddle.sources import model
from heddle.sources.model import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The derived model in SQL, as common table expressions.
MODEL = r"""
WITH RECURSIVE commits AS (SELECT event_id AS id, user_id AS branch, ts, event_type AS kind FROM events),
edges AS (
    SELECT id AS child, lag(id) OVER (PARTITION BY branch ORDER BY ts, id) AS parent, 0 AS ord FROM commits QUALIFY parent IS NOT NULL
    UNION ALL
    SELECT a.id, arg_max(b.id, b.ts), 1 FROM commits a JOIN commits b ON b.branch = a.branch - 1 AND b.ts < a.ts WHERE a.kind = 'purchase' AND a.id % 10 = 0 GROUP BY 1
),
tips AS (SELECT branch, arg_max(id, ts) AS oid FROM commits GROUP BY 1),
refs AS (
    SELECT 'refs/heads/u' || branch AS name, oid FROM tips
    UNION ALL SELECT 'refs/tags/v' || id, id FROM commits WHERE kind = 'signup' AND id % 50 = 0
),
files AS (
    SELECT lang || '/' || source || '/' || doc_id AS path, sha1('blob ' || strlen(text) || chr(0) || text) AS oid, CAST(strlen(text) AS BIGINT) AS size, doc_id FROM documents
)
"""
#: With the closure of some commits: seeds (seed, id) must be defined before.
CLOSURE = ", reached AS (SELECT seed, id FROM seeds UNION SELECT r.seed, e.parent FROM reached r JOIN edges e ON e.child = r.id)\n"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LAID_OUT: dict[tuple[str, str], graph.Graph] = {}


def the_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The tables' commit graph, laid out once for all questions of a session; its tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAID_OUT:
        _LAID_OUT[key] = graph.Graph(model.commits(spark, sf_dir).select("id"), model.edges(spark, sf_dir))
    return _LAID_OUT[key]


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.commits(spark, sf_dir).groupBy("branch").agg(F.max_by("id", F.struct("ts", "id")).alias("oid"))


@query(MODEL + "SELECT name, oid FROM refs")
def list_refs(spark, sf_dir):
    return refs.list_refs(model.refs(spark, sf_dir))


@query(MODEL + "SELECT name, oid FROM refs WHERE starts_with(name, 'refs/tags/') OR starts_with(name, 'refs/heads/u1')")
def list_refs_prefix(spark, sf_dir):
    return refs.list_refs(model.refs(spark, sf_dir), ["refs/tags/", "refs/heads/u1"])


@query(MODEL + "SELECT name, r.oid, ts, kind FROM refs r JOIN commits c ON c.id = r.oid")
def ref_details(spark, sf_dir):
    return model.refs(spark, sf_dir).join(model.commits(spark, sf_dir), F.col("oid") == F.col("id")).select("name", "oid", "ts", "kind")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref_details(spark, sf_dir)


@query(MODEL + "SELECT name, oid FROM refs WHERE name NOT IN (SELECT 'refs/heads/u' || branch FROM tips WHERE branch % 3 = 0)")
def hidden_refs(spark, sf_dir):
    hidden = tips(spark, sf_dir).where("branch % 3 = 0").select(F.concat(F.lit("refs/heads/u"), "branch").alias("name"))
    return refs.visible(model.refs(spark, sf_dir), hidden)


#: Refs dealt to seven repositories, each with a HEAD, some hidden, some tags annotated; one HEAD is unborn, one hidden.
MANY = MODEL + """, many AS (SELECT oid % 7 AS repo, name, oid FROM refs), heads(repo, head) AS (SELECT repo, CASE repo WHEN 3 THEN 'refs/heads/none' ELSE (SELECT min(name) FROM many m WHERE m.repo = r.repo AND starts_with(name, 'refs/heads/')) END FROM (SELECT DISTINCT repo FROM many WHERE starts_with(name, 'refs/heads/')) r),
shown AS (SELECT * FROM many WHERE NOT (oid % 5 = 0) AND NOT (repo = 4 AND name = (SELECT head FROM heads WHERE repo = 4)))
"""


@query(MANY + """SELECT repo, name, oid, symref, CASE WHEN name LIKE 'refs/tags/%' AND oid % 100 = 0 THEN oid + 7 END AS peeled FROM (
    SELECT repo, name, oid, NULL AS symref FROM shown
    UNION ALL SELECT h.repo, 'HEAD', s.oid, h.head FROM heads h LEFT JOIN shown s ON s.repo = h.repo AND s.name = h.head WHERE s.oid IS NOT NULL OR NOT EXISTS (SELECT 1 FROM many m WHERE m.repo = h.repo AND m.name = h.head))""")
def ls_refs(spark, sf_dir):
    many = model.refs(spark, sf_dir).select((F.col("oid") % 7).alias("repo"), "name", "oid")
    heads = many.where("name like 'refs/heads/%'").groupBy("repo").agg(F.min("name").alias("head")).withColumn("head", F.when(F.col("repo") == 3, "refs/heads/none").otherwise(F.col("head")))
    hidden = many.where("oid % 5 = 0").select("repo", "name").unionByName(heads.where("repo = 4").select("repo", F.col("head").alias("name"))).distinct()
    peeled = many.where("name like 'refs/tags/%' and oid % 100 = 0").select("oid", (F.col("oid") + 7).alias("peeled")).distinct()
    return refs.advertise(many, heads, hidden, peeled)


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.regexp_replace("c_name", "#", "-").alias("repo"), (F.col("c_custkey") % 7 == 0).alias("deleted"), F.col("c_custkey").alias("epoch"))


@query("""WITH r AS (SELECT replace(c_name, '#', '-') AS repo, c_custkey % 7 = 0 AS deleted, c_custkey AS epoch FROM customer),
p AS (SELECT *, row_number() OVER (ORDER BY repo) AS place FROM r WHERE starts_with(repo, 'Customer') AND repo > 'Customer-000000050' QUALIFY place <= 101)
SELECT repo, deleted, epoch, (SELECT max(repo) FROM p WHERE place <= 100 AND (SELECT count(*) FROM p) > 100) AS next_token FROM p WHERE place <= 100 AND NOT deleted""")
def list_repositories_page(spark, sf_dir):
    return refs.page(repositories(spark, sf_dir), "repo", "Customer", "Customer-000000050", 0)


@query(MODEL + "SELECT path, oid, size FROM files")
def blob_ids(spark, sf_dir):
    return model.files(spark, sf_dir).select("path", "oid", "size")


@query(MODEL + "SELECT path, f.oid, size FROM files f WHERE oid IN (SELECT oid FROM files WHERE doc_id % 10 = 3)")
def object_lookup(spark, sf_dir):
    f = model.files(spark, sf_dir)
    wanted = f.where("doc_id % 10 = 3").select("oid").distinct()
    return f.join(wanted, "oid", "left_semi").select("path", "oid", "size")


@query(MODEL + "SELECT oid, min(doc_id) AS dense_id, arg_min(path, doc_id) AS path FROM files GROUP BY oid")
def dedup_oldest(spark, sf_dir):
    return maintain.oldest_copies(model.files(spark, sf_dir).select("oid", F.col("doc_id").alias("dense_id"), "path"))


@query(MODEL + """SELECT oid, min(doc_id) AS dense_id FROM files WHERE doc_id % 2 = 1 AND oid NOT IN (SELECT oid FROM files WHERE doc_id % 2 = 0) GROUP BY oid""")
def ingest_new_objects(spark, sf_dir):
    f = model.files(spark, sf_dir).select("oid", F.col("doc_id").alias("dense_id"))
    return maintain.new_objects(f.where("dense_id % 2 = 1"), f.where("dense_id % 2 = 0"))


@query("""SELECT doc_id, CAST(k AS INT) AS chunk, substr(text, CAST(k * 4096 + 1 AS BIGINT), 4096) AS part FROM documents, range(0, 100) AS r(k) WHERE k = 0 OR k * 4096 < length(text)""")
def object_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    last = F.greatest(F.lit(0), F.ceil(F.length("text") / 4096).cast("int") - 1)
    return d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select("doc_id", "chunk", F.substring("text", F.col("chunk") * 4096 + 1, F.lit(4096)).alias("part"))


COMMIT_TEXT = "'tree ' || sha1('t' || id) || chr(10) || coalesce('parent ' || sha1('c' || parent) || chr(10), '') || 'author U' || branch || ' <u' || branch || '@example.org> ' || (1700000000 + id) || ' ' || CASE WHEN id % 2 = 0 THEN '+0130' ELSE '-0700' END || chr(10) || 'committer U' || branch || ' <u> ' || chr(10) || chr(10) || kind || ' ' || id || chr(10) || chr(10) || 'Body of ' || id"


def commit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = model.commits(spark, sf_dir), model.edges(spark, sf_dir).where("ord = 0").select(F.col("child").alias("id"), "parent")
    return c.join(e, "id", "left").select("id", F.expr(COMMIT_TEXT.replace("sha1('t' || id)", "sha1(cast('t' || id as binary))").replace("sha1('c' || parent)", "sha1(cast('c' || parent as binary))")).alias("content"))


TEXTS = MODEL + f", texts AS (SELECT id, {COMMIT_TEXT} AS content FROM commits LEFT JOIN (SELECT child AS id, parent FROM edges WHERE ord = 0) USING (id))\n"


@query(TEXTS + "SELECT id, sha1('commit ' || strlen(content) || chr(0) || content) AS oid, content FROM texts")
def canonical_commit_bytes(spark, sf_dir):
    return commit_texts(spark, sf_dir).select("id", scalars.object_id("commit", F.col("content")).alias("oid"), "content")


@query(MODEL + """SELECT id, sha1('t' || id) AS tree, coalesce(sha1('c' || parent), '') AS parents, 'U' || branch AS name, 'u' || branch || '@example.org' AS email,
    1700000000 + id AS seconds, CASE WHEN id % 2 = 0 THEN 5400 ELSE -25200 END AS offset_seconds, 0 AS committed, kind || ' ' || id AS summary, 'Body of ' || id AS body
    FROM commits LEFT JOIN (SELECT child AS id, parent FROM edges WHERE ord = 0) USING (id)""")
def parse_commit(spark, sf_dir):
    f = commit_texts(spark, sf_dir).select("id", scalars.commit_fields(F.col("content")).alias("c"))
    return f.select("id", "c.tree", F.array_join("c.parents", ",").alias("parents"), "c.author.name", "c.author.email", "c.author.seconds", "c.author.offset_seconds", F.col("c.committer.seconds").alias("committed"), "c.summary", "c.body")


@query("""SELECT o_orderkey, m AS mode, CASE WHEN m = 16384 THEN 'tree' WHEN m = 57344 THEN NULL ELSE 'blob' END AS kind FROM
    (SELECT o_orderkey, [33188, 33261, 40960, 16384, 57344][CAST(o_orderkey % 5 AS INT) + 1] AS m FROM orders)""")
def mode_kinds(spark, sf_dir):
    mode = F.get(F.array(*map(F.lit, [33188, 33261, 40960, 16384, 57344])), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", mode.alias("mode")).withColumn("kind", scalars.mode_kind(F.col("mode")))


#: A piece of every event's name, so that each meets the rule's cases in many places.
PIECES = ["ok", "a..b", "x.lock", "sp ace", "v1@{0}", ".hid", "y/", "end.", "st*r", "é", "a.lock.b", "@", "b[", "c~1", "d^", "e:f", "back\\slash", "q?", "x.lock/y", "n//m"]
PIECES_SQL = "[" + ", ".join(f"'{p}'" for p in PIECES) + "]"


@query(f"""SELECT event_id, name, starts_with(name, 'refs/') AND len(parts) >= 3 AND NOT list_contains(parts, '') AND len(list_filter(parts, lambda p: starts_with(p, '.') OR ends_with(p, '.lock'))) = 0 AND NOT ends_with(name, '.')
    AND NOT contains(name, '..') AND NOT contains(name, '@{{') AND translate(name, ' ~^:?*[' || chr(92), '') = name AS ok
    FROM (SELECT event_id, name, string_split(name, '/') AS parts FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'refs/heads/' WHEN 1 THEN 'refs/' ELSE 'heads/' END || {PIECES_SQL}[CAST(event_id % 20 AS INT) + 1] || CASE WHEN event_id % 7 = 0 THEN '/' || event_type ELSE '' END AS name FROM events))""")
def refname_valid(spark, sf_dir):
    k = F.col("event_id")
    start = F.when(k % 3 == 0, "refs/heads/").when(k % 3 == 1, "refs/").otherwise("heads/")
    name = F.concat(start, F.get(F.array(*map(F.lit, PIECES)), (k % 20).cast("int")), F.when(k % 7 == 0, F.concat(F.lit("/"), "event_type")).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", name.alias("name")).withColumn("ok", scalars.ref_name_ok(F.col("name")))


#: Components, and whether a checkout may hold them.
COMPONENTS = {"file.txt": True, "": False, ".": False, "..": False, ".git": False, ".GIT": False, ".git:x": False, ".git::$INDEX_ALLOCATION": False, ".gi\u200ct": False, ".git . .": False, "git~1": False, "GIT~1 ": False, "git~2": True, ".gitx": True, ".git x": True, "a\\b": False, "...": True, ".gi\u200ct ": True, ".gitmodules": True}
COMPONENTS_SQL = ", ".join(f"('{name}', {ok})" for name, ok in COMPONENTS.items())


@query(f"""SELECT n_name || '/' || name || CASE WHEN n_nationkey % 2 = 0 THEN '/leaf' ELSE '' END AS path, ok FROM nation, (VALUES {COMPONENTS_SQL}) AS c(name, ok)""")
def path_valid(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.explode(F.array(*map(F.lit, COMPONENTS))).alias("name"))
    path = F.concat("n_name", F.lit("/"), "name", F.when(F.col("n_nationkey") % 2 == 0, "/leaf").otherwise(""))
    return n.select(path.alias("path")).withColumn("ok", scalars.path_ok(F.col("path")))


@query("""SELECT l_orderkey AS source, 'p' || l_partkey AS oid, 'part' AS kind, 'MISSING' AS fault FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)""")
def connectivity_missing(spark, sf_dir):
    ref = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("oid"), F.lit("part").alias("kind"))
    have = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("oid"), F.lit("part").alias("kind"))
    return maintain.missing(ref, have)


@query("""SELECT oid, count(DISTINCT kind) AS kinds FROM (SELECT l_partkey AS oid, CASE WHEN l_linenumber = 7 THEN 'tree' ELSE 'blob' END AS kind FROM lineitem) GROUP BY oid HAVING count(DISTINCT kind) > 1""")
def kind_conflicts(spark, sf_dir):
    return maintain.kind_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("oid"), F.when(F.col("l_linenumber") == 7, "tree").otherwise("blob").alias("kind")))


LEVELS = """SELECT r_name AS path, 'tree' AS kind, 'r' || r_regionkey AS oid, 1 AS depth FROM region
UNION ALL SELECT r_name || '/' || n_name, 'tree', 'n' || n_nationkey, 2 FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, 'blob', 'c' || c_custkey, 3 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"""


@query(LEVELS)
def list_tree(spark, sf_dir):
    return trees.list_tree(model.tree_entries(spark, sf_dir), "root")


@query(f"SELECT DISTINCT oid, kind FROM ({LEVELS}) WHERE starts_with(path, 'ASIA/') UNION SELECT 'r' || r_regionkey, 'tree' FROM region WHERE r_name = 'ASIA'")
def tree_closure(spark, sf_dir):
    e = model.tree_entries(spark, sf_dir)
    return trees.tree_closure(e, e.where("name = 'ASIA'").select("oid"))


SNAPSHOTS = MODEL + """, a AS (SELECT path, oid FROM files WHERE doc_id % 10 <> 0),
b AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha1('blob ' || (size + 1) || chr(0) || text || 'x') ELSE oid END AS oid FROM files JOIN documents USING (doc_id) WHERE doc_id % 10 <> 1)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = model.files(spark, sf_dir)
    changed = f.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("doc_id % 10 <> 1")
    oid = F.when(F.col("doc_id") % 7 == 0, scalars.blob_id(F.concat("text", F.lit("x")))).otherwise(F.col("oid"))
    return f.where("doc_id % 10 <> 0").select("path", "oid"), changed.select("path", oid.alias("oid"))


@query(SNAPSHOTS + """SELECT path, CASE WHEN a.oid IS NULL THEN 'added' WHEN b.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.oid AS old_oid, b.oid AS new_oid
    FROM a FULL JOIN b USING (path) WHERE a.oid IS DISTINCT FROM b.oid""")
def diff_commit(spark, sf_dir):
    return trees.diff(*snapshots(spark, sf_dir))


@query(SNAPSHOTS + "SELECT path, 'added' AS change, NULL::VARCHAR AS old_oid, oid AS new_oid FROM b")
def diff_root(spark, sf_dir):
    _, b = snapshots(spark, sf_dir)
    return trees.diff(b.limit(0), b)


@query(MODEL + """SELECT path || '/inner' AS path, 'added' AS change, NULL::VARCHAR AS old_oid, oid AS new_oid FROM files WHERE doc_id % 10 = 0
    UNION ALL SELECT path, 'deleted', oid, NULL FROM files WHERE doc_id % 10 = 0""")
def diff_file_dir(spark, sf_dir):
    f = model.files(spark, sf_dir)
    new = f.select(F.when(F.col("doc_id") % 10 == 0, F.concat("path", F.lit("/inner"))).otherwise(F.col("path")).alias("path"), "oid")
    return trees.diff(f, new)


@query(MODEL + """SELECT path, oid FROM files WHERE doc_id % 10 <> 0 AND doc_id % 11 <> 0 UNION ALL SELECT path, sha1('put' || doc_id) FROM files WHERE doc_id % 10 = 0 AND doc_id % 11 <> 0""")
def create_commit(spark, sf_dir):
    f = model.files(spark, sf_dir)
    edits = f.where("doc_id % 10 = 0 or doc_id % 11 = 0").select("path", F.when(F.col("doc_id") % 11 != 0, F.sha1(F.concat(F.lit("put"), "doc_id").cast("binary"))).alias("oid"))
    return trees.edit(f.select("path", "oid"), edits)


#: The id of a tree in SQL, from its bytes in hex.
TREE_ID = "sha1(unhex(hex('tree ' || length({0}) // 2) || '00' || {0}))"


@query(MODEL + f""", low AS (SELECT lang || '/' || source AS path, string_agg(hex('100644 ' || doc_id) || '00' || upper(oid), '' ORDER BY CAST(doc_id AS VARCHAR)) AS h, lang, source FROM files JOIN documents USING (doc_id) GROUP BY lang, source),
low_id AS (SELECT *, {TREE_ID.format('h')} AS oid FROM low),
mid AS (SELECT lang AS path, string_agg(hex('40000 ' || source) || '00' || upper(oid), '' ORDER BY source || '/') AS h FROM low_id GROUP BY lang),
mid_id AS (SELECT *, {TREE_ID.format('h')} AS oid FROM mid),
top AS (SELECT string_agg(hex('40000 ' || path) || '00' || upper(oid), '' ORDER BY path || '/') AS h FROM mid_id)
SELECT path, oid FROM low_id UNION ALL SELECT path, oid FROM mid_id UNION ALL SELECT '', {TREE_ID.format('h')} FROM top""")
def write_trees(spark, sf_dir):
    return trees.directories(model.files(spark, sf_dir).select("path", "oid"))


@query(MODEL + "SELECT id, row_number() OVER (PARTITION BY branch ORDER BY ts, id) - 1 AS depth FROM commits")
def first_parent_history(spark, sf_dir):
    return graph.history(model.commits(spark, sf_dir).select("id"), model.edges(spark, sf_dir))


@query(MODEL + """SELECT t.oid AS start, id, CAST(n - 1 AS INT) AS place, max(CASE WHEN n = 21 THEN id END) OVER (PARTITION BY branch) AS next_token
    FROM (SELECT branch, id, row_number() OVER (PARTITION BY branch ORDER BY ts DESC, id DESC) AS n FROM commits QUALIFY n <= 21) JOIN tips t USING (branch) QUALIFY n <= 20""")
def history_page(spark, sf_dir):
    return the_graph(spark, sf_dir).list_commits(tips(spark, sf_dir).select(F.col("oid").alias("start")), 20)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations")
def turn_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"))
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    e = c.select(F.col("id").alias("child"), before.alias("parent"), F.lit(0).alias("ord")).where("parent is not null")
    return graph.history(c.select("id"), e).join(c, "id").select("conv_id", "turn", "depth")


@query(MODEL + ", up AS (SELECT id, 1 AS g FROM commits UNION SELECT e.child, up.g + 1 FROM up JOIN edges e ON e.parent = up.id) SELECT id, CAST(max(g) AS BIGINT) AS generation FROM up GROUP BY id")
def commit_generation(spark, sf_dir):
    return the_graph(spark, sf_dir).generations()


PAIRS = ", pairs AS (SELECT t.oid AS d, c.id AS a FROM tips t JOIN commits c ON c.branch IN (t.branch, t.branch - 1))\n"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tips go to the branches, not each commit to two tips
    t = tips(spark, sf_dir).select(F.explode(F.array("branch", F.col("branch") - 1)).alias("branch"), F.col("oid").alias("d"))
    return model.commits(spark, sf_dir).select(F.col("id").alias("a"), "branch").join(t.hint("merge"), "branch").select("a", "d")


@query(MODEL + PAIRS + ", seeds AS (SELECT DISTINCT d AS seed, d AS id FROM pairs)" + CLOSURE + "SELECT a, d, r.id IS NOT NULL AS is_ancestor FROM (SELECT DISTINCT a, d FROM pairs) p LEFT JOIN reached r ON r.seed = p.d AND r.id = p.a")
def is_ancestor_pairs(spark, sf_dir):
    return the_graph(spark, sf_dir).is_ancestor(pairs(spark, sf_dir))


@query(MODEL + """, moves AS (SELECT 'refs/heads/u' || t.branch AS refname, t.branch, CASE WHEN t.branch % 5 = 0 THEN NULL WHEN t.branch % 13 = 0 THEN t.oid ELSE o.id END AS a, CASE WHEN t.branch % 7 = 0 THEN NULL ELSE t.oid END AS d
    FROM tips t JOIN (SELECT branch, min(id) AS id FROM commits GROUP BY 1) o ON o.branch = t.branch - t.branch % 2)
, seeds AS (SELECT DISTINCT d AS seed, d AS id FROM moves WHERE d IS NOT NULL)""" + CLOSURE + """, hops AS (SELECT *, CASE branch % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 15 ELSE 16 END AS n FROM moves)
SELECT refname, CASE WHEN n = 0 THEN a ELSE a + n * 1000000000::BIGINT END AS old, d AS new,
    a IS NOT NULL AND d IS NOT NULL AND (n > 15 OR NOT EXISTS (SELECT 1 FROM reached r WHERE r.seed = d AND r.id = a)) AS force FROM hops""")
def force_flags(spark, sf_dir):
    b, far = F.col("branch"), F.lit(1_000_000_000).cast("long")
    oldest = model.commits(spark, sf_dir).groupBy(F.col("branch").alias("b")).agg(F.min("id").alias("o"))
    hops = F.when(b % 4 == 0, 0).when(b % 4 == 1, 1).when(b % 4 == 2, 15).otherwise(16)
    old = F.when(b % 5 != 0, F.when(b % 13 == 0, F.col("oid")).otherwise(F.col("o")) + hops * far)
    u = tips(spark, sf_dir).join(oldest, b - b % 2 == F.col("b")).select(F.concat(F.lit("refs/heads/u"), "branch").alias("refname"), old.alias("old"), F.when(b % 7 != 0, F.col("oid")).alias("new"))
    # each commit has a chain of sixteen tags, one naming the next
    tags = model.commits(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.struct((F.col("id") + k * far).alias("tag"), (F.col("id") + (k - 1) * far).alias("target")))).alias("t")).select("t.*")
    return graph.force_flags(the_graph(spark, sf_dir), u, tags)


@query(MODEL + ", pairs AS (SELECT x.oid AS a, y.oid AS b FROM tips x JOIN tips y ON y.branch = x.branch + 1), seeds AS (SELECT DISTINCT oid AS seed, oid AS id FROM tips)" + CLOSURE + """
, common AS (SELECT p.a, p.b, r.id FROM pairs p JOIN reached r ON r.seed = p.a JOIN reached s ON s.seed = p.b AND s.id = r.id)
SELECT a, b, id AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN edges e ON e.child = d.id WHERE d.a = c.a AND d.b = c.b AND e.parent = c.id)""")
def merge_bases_pairs(spark, sf_dir):
    t = tips(spark, sf_dir)
    p = t.select((F.col("branch") + 1).alias("branch"), F.col("oid").alias("a")).join(t, "branch").select("a", F.col("oid").alias("b"))
    return the_graph(spark, sf_dir).merge_bases(p)


#: Odd branches are wanted, the client has the even ones.
WALK = MODEL + ", seeds AS (SELECT branch % 2 AS seed, oid AS id FROM tips)" + CLOSURE


@query(WALK + "SELECT id FROM reached WHERE seed = 1 EXCEPT SELECT id FROM reached WHERE seed = 0")
def rev_walk_wants_haves(spark, sf_dir):
    t = tips(spark, sf_dir)
    return the_graph(spark, sf_dir).between(t.where("branch % 2 = 1").select(F.col("oid").alias("id")), t.where("branch % 2 = 0").select(F.col("oid").alias("id")))


@query(MODEL + ", walk AS (SELECT oid AS id, 1 AS depth FROM tips UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.id WHERE w.depth < 4) SELECT id, min(depth) AS depth, min(depth) >= 4 AS shallow FROM walk GROUP BY id")
def deepen_n(spark, sf_dir):
    return graph.deepen(model.edges(spark, sf_dir), tips(spark, sf_dir).select(F.col("oid").alias("id")), 4)


@query(WALK + ", sent AS (SELECT id FROM reached WHERE seed = 1 EXCEPT SELECT id FROM reached WHERE seed = 0) SELECT DISTINCT f.oid FROM sent JOIN files f ON f.doc_id = sent.id")
def segment_objects(spark, sf_dir):
    return rev_walk_wants_haves(spark, sf_dir).join(model.files(spark, sf_dir), F.col("id") == F.col("doc_id")).select("oid").distinct()


@query(MODEL + "SELECT path, oid, size FROM files WHERE size < 1024 OR doc_id % 97 = 0")
def filter_blob_limit(spark, sf_dir):
    limit = scalars.size_argument("1k")
    return model.files(spark, sf_dir).where((F.col("size") < limit) | (F.col("doc_id") % 97 == 0)).select("path", "oid", "size")


UPDATES = MODEL + """, updates AS (SELECT branch // 10 AS command, branch AS ord, 'refs/heads/u' || branch AS refname,
    CASE WHEN branch % 4 = 0 THEN NULL WHEN branch % 4 = 1 AND branch % 3 = 0 THEN oid + 1 ELSE oid END AS old, oid + 5 AS new FROM tips)
, met AS (SELECT u.*, r.oid AS now, CASE WHEN u.old IS DISTINCT FROM r.oid THEN 'STALE_OLD_VALUE' END AS own FROM updates u LEFT JOIN refs r ON r.name = u.refname)
"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("branch")
    old = F.when(b % 4 == 0, F.lit(None)).when((b % 4 == 1) & (b % 3 == 0), F.col("oid") + 1).otherwise(F.col("oid"))
    return tips(spark, sf_dir).select(F.floor(b / 10).alias("command"), b.alias("ord"), F.concat(F.lit("refs/heads/u"), b).alias("refname"), old.alias("old"), (F.col("oid") + 5).alias("new"))


@query(UPDATES + "SELECT command, ord, refname, own AS reason FROM met")
def cas_update_refs(spark, sf_dir):
    return refs.evaluate(updates(spark, sf_dir), model.refs(spark, sf_dir), atomic=False)


@query(UPDATES + "SELECT command, ord, refname, coalesce(own, CASE WHEN bool_or(own IS NOT NULL) OVER (PARTITION BY command) THEN 'ATOMIC_FAILURE' END) AS reason FROM met")
def cas_atomic(spark, sf_dir):
    return refs.evaluate(updates(spark, sf_dir), model.refs(spark, sf_dir), atomic=True)


@query(MODEL + """, u AS (SELECT branch // 10 AS command, (branch // 10) % 2 = 1 AS atomic, branch AS ord,
    CASE WHEN branch % 9 = 0 THEN 'refs/heads/a..b' WHEN branch % 9 = 1 THEN 'refs/heads/same' WHEN branch % 9 = 2 THEN 'refs/one' WHEN branch % 10 IN (3, 6) THEN 'refs/heads/again' ELSE 'refs/heads/u' || branch END AS refname,
    CASE WHEN branch % 6 IN (0, 2) THEN NULL WHEN branch % 6 = 1 THEN -1 ELSE oid END AS new FROM tips),
own AS (SELECT u.*, CASE
    WHEN new IS NULL AND refname = 'refs/heads/a..b' THEN 'INVALID_NAME' WHEN new IS NULL AND refname = 'refs/heads/u6' THEN 'DELETES_HEAD'
    WHEN new IS NOT NULL AND refname IN ('refs/heads/a..b', 'refs/one') THEN 'INVALID_NAME' WHEN new IS NOT NULL AND c.id IS NULL THEN 'MISSING_OBJECT'
    WHEN new IS NOT NULL AND starts_with(refname, 'refs/heads/') AND c.id % 3 = 0 THEN 'NON_COMMIT' END AS first FROM u LEFT JOIN commits c ON c.id = u.new)
SELECT command, ord, refname, coalesce(first, CASE WHEN (SELECT count(*) FROM u o WHERE o.command = own.command AND o.refname = own.refname AND (own.atomic OR (o.new IS NULL) = (own.new IS NULL))) > 1 THEN 'REPEATED_REF' END) AS reason FROM own""")
def push_checks(spark, sf_dir):
    b = F.col("branch")
    command = F.floor(b / 10)
    name = F.when(b % 9 == 0, "refs/heads/a..b").when(b % 9 == 1, "refs/heads/same").when(b % 9 == 2, "refs/one").when((b % 10).isin(3, 6), "refs/heads/again").otherwise(F.concat(F.lit("refs/heads/u"), b))
    new = F.when((b % 6).isin(0, 2), F.lit(None)).when(b % 6 == 1, F.lit(-1)).otherwise(F.col("oid"))
    u = tips(spark, sf_dir).select(command.alias("command"), (command % 2 == 1).alias("atomic"), b.alias("ord"), name.alias("refname"), new.alias("new"))
    objects = model.commits(spark, sf_dir).select(F.col("id").alias("oid"), F.when(F.col("id") % 3 == 0, "tag").otherwise("commit").alias("kind"))
    return refs.prechecks(u, objects, "refs/heads/u6")


@query(MODEL + """, b AS (SELECT branch % 5 AS repo, CASE WHEN branch = 6 THEN 'refs/heads/main' WHEN branch = 7 THEN 'refs/heads/master' ELSE 'refs/heads/u' || branch END AS name FROM tips)
SELECT repo, CASE WHEN bool_or(name = 'refs/heads/u5') THEN 'refs/heads/u5' ELSE coalesce(max(CASE WHEN name = 'refs/heads/main' THEN name END), max(CASE WHEN name = 'refs/heads/master' THEN name END), min(name)) END AS head FROM b GROUP BY repo""")
def head_fixup(spark, sf_dir):
    b = F.col("branch")
    r = tips(spark, sf_dir).select((b % 5).alias("repo"), F.when(b == 6, "refs/heads/main").when(b == 7, "refs/heads/master").otherwise(F.concat(F.lit("refs/heads/u"), b)).alias("name"))
    return refs.head_fixup(r, r.select("repo", F.lit("refs/heads/u5").alias("head")).distinct())


THEIRS = ", theirs AS (SELECT name, CASE WHEN oid % 3 = 0 THEN oid + 1 ELSE oid END AS oid FROM refs WHERE oid % 7 <> 0)\n"


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.refs(spark, sf_dir).where("oid % 7 <> 0").select("name", F.when(F.col("oid") % 3 == 0, F.col("oid") + 1).otherwise(F.col("oid")).alias("oid"))


@query(MODEL + THEIRS + "SELECT name, r.oid AS old, t.oid AS new FROM refs r FULL JOIN theirs t USING (name) WHERE starts_with(name, 'refs/heads/') AND r.oid IS DISTINCT FROM t.oid")
def fetch_plan(spark, sf_dir):
    return refs.mirror_plan(model.refs(spark, sf_dir), theirs(spark, sf_dir), ["refs/heads/"])


@query(MODEL + THEIRS + """, specs AS (SELECT CASE WHEN oid % 11 = 0 THEN NULL WHEN oid % 13 = 0 THEN 'refs/heads/none' ELSE name END AS source, name AS destination FROM refs)
SELECT source, destination, t.oid AS old, r.oid AS new, CASE WHEN source IS NULL THEN CASE WHEN t.oid IS NULL THEN 'up_to_date' ELSE 'delete' END WHEN r.oid IS NULL THEN 'reject_not_held' WHEN r.oid = t.oid THEN 'up_to_date' ELSE 'send' END AS action
FROM specs s LEFT JOIN refs r ON r.name = s.source LEFT JOIN theirs t ON t.name = s.destination""")
def push_plan(spark, sf_dir):
    r = model.refs(spark, sf_dir)
    specs = r.select(F.when(F.col("oid") % 11 == 0, F.lit(None)).when(F.col("oid") % 13 == 0, F.lit("refs/heads/none")).otherwise(F.col("name")).alias("source"), F.col("name").alias("destination"))
    return refs.push_plan(specs, r, theirs(spark, sf_dir))


@query(MODEL + """, commands AS (SELECT branch // 10 AS push, branch AS ord, 'refs/heads/u' || branch AS refname FROM tips),
said AS (SELECT branch // 10 AS push, 'refs/heads/u' || branch AS refname, min(CASE WHEN id % 4 = 0 THEN id END) AS seq, count(*) AS n FROM commits WHERE branch <> 33 GROUP BY ALL)
SELECT c.push, ord, c.refname, CASE WHEN bool_or(n IS NULL) OVER (PARTITION BY c.push) THEN 'UNJUDGED' WHEN seq IS NOT NULL THEN 'REFUSED: r' || seq ELSE 'ALLOWED' END AS verdict FROM commands c LEFT JOIN said USING (push, refname)""")
def judgements(spark, sf_dir):
    b, name = F.col("branch"), F.concat(F.lit("refs/heads/u"), F.col("branch"))
    commands = tips(spark, sf_dir).select(F.floor(b / 10).alias("push"), b.alias("ord"), name.alias("refname"))
    said = model.commits(spark, sf_dir).where("branch <> 33").select(F.floor(b / 10).alias("push"), name.alias("refname"), (F.col("id") % 4 != 0).alias("allow"), F.concat(F.lit("r"), "id").alias("reason"), F.col("id").alias("seq"))
    return refs.judge(commands, said)


LAYERS = "(SELECT o_orderkey // 100 AS seq, o_custkey % 10 AS repo, count(*) AS objects FROM orders GROUP BY 1, 2)"


@query(f"SELECT repo, seq, objects, CAST(coalesce(sum(objects) OVER (PARTITION BY repo ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id FROM {LAYERS}")
def dense_ids(spark, sf_dir):
    layers = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("seq"), (F.col("o_custkey") % 10).alias("repo")).agg(F.count("*").alias("objects"))
    return maintain.dense_ids(layers)


@query("""SELECT l_orderkey * 10 + l_linenumber AS file, l_suppkey AS generation, l_partkey * 1000 AS unnamed_since FROM lineitem
    WHERE l_orderkey * 10 + l_linenumber NOT IN (SELECT o_orderkey * 10 + 1 FROM orders) AND l_suppkey < 48 AND 5000000 - l_partkey * 1000 > 21600""")
def sweep_candidates(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), F.col("l_suppkey").alias("generation"), (F.col("l_partkey") * 1000).alias("unnamed_since"))
    named = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("file"))
    return maintain.sweepable(listed, named, 5_000_000, 50, 21_600)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'ACCEPTED' WHEN o_custkey % 8 > 5 THEN 'AHEAD' WHEN o_custkey % 8 < 3 THEN 'STALE' ELSE 'ACCEPTED' END AS outcome FROM orders""")
def upload_window(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("generation"), F.lit(5).alias("current"), (F.col("o_orderkey") % 9 == 0).alias("inline"))
    return maintain.admit(u).select("o_orderkey", "outcome")


@query(MODEL + """, changes AS (SELECT 'b' || branch AS name, CASE WHEN kind = 'logout' OR id % 10 = 0 THEN NULL ELSE id END AS oid, row_number() OVER (PARTITION BY branch ORDER BY ts, id) AS version FROM commits)
SELECT name, oid, version FROM changes QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1 AND oid IS NOT NULL""")
def fold_changes(spark, sf_dir):
    version = F.row_number().over(Window.partitionBy("branch").orderBy("ts", "id")).cast("long")
    c = model.commits(spark, sf_dir)
    oid = F.when((F.col("kind") == "logout") | (F.col("id") % 10 == 0), F.lit(None)).otherwise(F.col("id"))
    return refs.fold(c.select(F.concat(F.lit("b"), "branch").alias("name"), oid.alias("oid"), version.alias("version")))


@query("SELECT repo, arg_min(node, md5(repo || '|' || node)) AS node FROM (SELECT replace(c_name, '#', '-') AS repo FROM customer), (VALUES ('n1'), ('n2'), ('n3')) AS v(node) GROUP BY repo")
def owner_choice(spark, sf_dir):
    return maintain.owners(repositories(spark, sf_dir), ["n1", "n2", "n3"])


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS largest, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS refused FROM orders GROUP BY 1")
def status_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"), F.count_if(F.col("o_orderstatus") == "F").alias("refused"))


@query(MODEL + "SELECT path, CAST((row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) - 1) // 100 AS INT) AS frame FROM files")
def change_frames(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy(F.substring_index("path", "/", 1)).orderBy("path")) - 1
    return model.files(spark, sf_dir).select("path", F.floor(place / 100).cast("int").alias("frame"))


@query(MODEL + """, log AS (SELECT 'r' || branch AS repo, id AS seq, CASE WHEN kind = 'purchase' THEN 'delete' ELSE 'create' END AS action, 'refs/heads/h' || id AS head FROM commits),
marked AS (SELECT *, action = 'create' AND coalesce(lag(action) OVER (PARTITION BY repo ORDER BY seq), 'delete') = 'delete' AS begins FROM log)
SELECT repo, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) AS BIGINT) AS epoch, arg_max(head, seq) FILTER (WHERE begins) AS head FROM marked GROUP BY repo HAVING arg_max(action, seq) = 'create'""")
def current_repositories(spark, sf_dir):
    c = model.commits(spark, sf_dir)
    log = c.select(F.concat(F.lit("r"), "branch").alias("repo"), F.col("id").alias("seq"), F.when(F.col("kind") == "purchase", "delete").otherwise("create").alias("action"), F.concat(F.lit("refs/heads/h"), "id").alias("head"))
    return lifecycle.current_repositories(log)


@query("""WITH RECURSIVE walk AS (SELECT doc_id AS oid, doc_id AS spot, 0 AS n FROM documents UNION ALL SELECT oid, spot - 1, n + 1 FROM walk WHERE spot % 90 <> 0 AND n < 100)
SELECT oid, CASE WHEN max(n) <= 64 THEN min(spot) END AS peeled FROM walk GROUP BY oid""")
def peel_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("oid"))
    return lifecycle.peel(d, d.where("oid % 90 <> 0").select(F.col("oid").alias("tag"), (F.col("oid") - 1).alias("target")))


@query(MODEL + "SELECT DISTINCT id AS tag, id AS target FROM commits WHERE kind = 'signup' AND id % 50 = 0 AND id IN (SELECT doc_id FROM files WHERE size > 500)")
def include_tags(spark, sf_dir):
    t = model.commits(spark, sf_dir).where("kind = 'signup' and id % 50 = 0").select(F.col("id").alias("tag"), F.col("id").alias("target"))
    return lifecycle.include_tags(t, model.files(spark, sf_dir).where("size > 500").select(F.col("doc_id").alias("oid")))


ODD = ["", "a/b", ".", "..", ".GIT", ".git . ", "git~1", ".gi\u200ct", ".git::$INDEX", "ok"]


@query("""SELECT n_regionkey AS tree, n_nationkey AS ord, CASE WHEN n_nationkey % 11 = 10 THEN 'NULL_OID' WHEN k = 0 THEN 'EMPTY_NAME' WHEN k = 1 THEN 'FULL_PATH' WHEN k = 2 THEN 'DOT' WHEN k = 3 THEN 'DOT_DOT' WHEN k < 9 THEN 'DOT_GIT' ELSE 'ZERO_PADDED_MODE' END AS fault
FROM (SELECT *, n_nationkey % 10 AS k FROM nation)""")
def tree_fsck(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ODD)), F.col("n_nationkey") % 10)
    oid = F.when(F.col("n_nationkey") % 11 == 10, F.lit("0" * 40)).otherwise(F.lit("1" * 40))
    e = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tree"), F.col("n_nationkey").alias("ord"), F.lit("040000").alias("mode"), name.alias("name"), oid.alias("oid"))
    return lifecycle.tree_faults(e)


@query("""SELECT l_orderkey AS commit, l_linenumber AS path, l_partkey % 3 AS oid FROM lineitem l WHERE NOT EXISTS
    (SELECT 1 FROM lineitem p WHERE (p.l_orderkey = l.l_orderkey - 1 OR p.l_orderkey = l.l_orderkey - 2) AND p.l_linenumber = l.l_linenumber AND p.l_partkey % 3 = l.l_partkey % 3)""")
def segment_members(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("path"), (F.col("l_partkey") % 3).alias("oid"))
    back = f.select(F.explode(F.array(F.col("commit") + 1, F.col("commit") + 2)).alias("commit"), F.col("commit").alias("parent"), "path", "oid")
    return lifecycle.brought(f, back)


@query()
def topological_order(spark, sf_dir):
    g = the_graph(spark, sf_dir).generations()
    return lifecycle.topological(g, model.commits(spark, sf_dir).select("id", F.col("id").alias("place")))
