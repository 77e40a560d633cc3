"""The library against DuckDB, hand-made histories and the cases of its rules."""

import pytest
from duck import assert_same
from pyspark.sql import functions as F

import __spark_entry__
from heddle import registry, registry_more  # noqa: F401
from heddle.functions import scalars
from heddle.operators import checks, graph, maintain, refs, trees
from heddle.plans.components import stars
from heddle.streaming import feed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def criss_cross(spark):
    # 1 - 2 - 4 - 6 and 1 - 3 - 5 - 7, where 4 and 5 each merge 2 and 3
    rows = [(2, 1, 0), (3, 1, 0), (4, 2, 0), (4, 3, 1), (5, 3, 0), (5, 2, 1), (6, 4, 0), (7, 5, 0)]
    edges = spark.createDataFrame(rows, "child long, parent long, ord int")
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 8), 9]], "id long")
    return graph.Graph(nodes, edges)


def test_merge_bases(spark, criss_cross):
    pairs = [(6, 7), (7, 6), (2, 3), (6, 6), (6, 1), (6, 9), (6, 100)]
    got = criss_cross.merge_bases(spark.createDataFrame(pairs, "a long, b long")).collect()
    found = {p: {r.base for r in got if (r.a, r.b) == p} for p in pairs}
    assert found == {(6, 7): {2, 3}, (7, 6): {2, 3}, (2, 3): {1}, (6, 6): {6}, (6, 1): {1}, (6, 9): set(), (6, 100): set()}


def test_ancestry_and_generations(spark, criss_cross):
    got = criss_cross.is_ancestor(spark.createDataFrame([(1, 7), (7, 1), (3, 6), (4, 7), (5, 5), (100, 7), (1, 100)], "a long, d long")).collect()
    assert {(r.a, r.d): r.is_ancestor for r in got} == {(1, 7): True, (7, 1): False, (3, 6): True, (4, 7): False, (5, 5): True, (100, 7): False, (1, 100): False}
    assert {r.id: r.generation for r in criss_cross.generations().collect()} == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4, 9: 1}


def test_layout_writes_each_commit_a_few_times(spark, monkeypatch):
    from heddle.plans import climb

    rows, kept = [], graph.materialize

    def counted(df, tag):
        out = kept(df, tag)
        rows.append(out.count())
        return out
    monkeypatch.setattr(graph, "materialize", counted)
    monkeypatch.setattr(climb, "materialize", counted)
    n = 4000
    edges = spark.range(1, n).selectExpr("id as child", "id - 1 as parent", "0 as ord")
    places = graph.Graph(spark.range(n), edges).places
    assert places.where("chain = 0 and pos = id").count() == n
    assert sum(rows) <= 4 * n


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_layout_of_scattered_edges(spark, monkeypatch, few):
    import random

    rng, n, reached, rows = random.Random(5), 250, {}, []
    name = rng.sample(range(10_000), n)
    for k in range(n):
        parents = list(dict.fromkeys(p for p in (k - rng.randrange(1, 4), rng.randrange(k) if k and rng.random() < 0.3 else -1) if p >= 0))
        rows += [(name[k], name[p], o) for o, p in enumerate(parents)]
        reached[name[k]] = {name[k]}.union(*(reached[name[p]] for p in parents))
    told = graph.told
    monkeypatch.setattr(graph, "told", lambda edges, split: told(edges, split, few))
    edges = spark.createDataFrame(rows + rows[:20], "child long, parent long, ord int").repartition(7)  # some edges are given twice
    g = graph.Graph(spark.createDataFrame([(k,) for k in name], "id long"), edges)
    assert g.places.count() == g.places.select("chain", "pos").distinct().count() == n
    found = g.ancestors(spark.createDataFrame([(k, k) for k in name[-20:]], "seed long, id long")).collect()
    assert len(found) == sum(len(reached[k]) for k in name[-20:])
    assert all(r.id in reached[r.seed] for r in found)


def test_pairs_broadcast_nothing(spark):
    assert "Broadcast" not in registry.pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_generations_across_blocks(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for k in range(200):
        parents = sorted({p for p in (k - 3, rng.randrange(k) if k and rng.random() < 0.3 else -1) if p >= 0}, reverse=True)
        rows += [(k, p, n) for n, p in enumerate(parents)]
        want[k] = 1 + max((want[p] for p in parents), default=0)
    g = graph.Graph(spark.range(200), spark.createDataFrame(rows, "child long, parent long, ord int"))
    for block in (1, 7, 1 << 16):
        assert {r.id: r.generation for r in g.generations(block).collect()} == want


def test_push_order(spark):
    from heddle.operators import lifecycle

    # 1 is the parent of 4 and 5, 2 of 5; 3 stands alone and 6 follows 4; pack order is that of places
    rows = [("p", 1, 0, None), ("p", 2, 1, []), ("p", 3, 2, [99]), ("p", 4, 3, [1]), ("p", 5, 4, [1, 2, 2]), ("p", 6, 5, [4]), ("q", 8, 0, [7]), ("q", 7, 1, None)]
    order = lambda rows: {p: [r.id for r in sorted(got, key=lambda r: r.nth) if r.push == p] for got in [lifecycle.push_order(spark.createDataFrame(rows, "push string, id long, place int, parents array<long>")).collect()] for p in ("p", "q")}
    assert order(rows) == {"p": [1, 4, 6, 2, 5, 3], "q": [7, 8]}
    with pytest.raises(Exception, match="cycle"):
        order([("p", 1, 0, [2]), ("p", 2, 1, [1])])


def test_peeling_broadcasts_nothing(spark, monkeypatch):
    from heddle.operators import lifecycle

    plans, kept = [], lifecycle.materialize
    monkeypatch.setattr(lifecycle, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, tag))
    # a chain of 40 tags whose links lie in other partitions, a ring, and a commit
    tags = spark.createDataFrame([(k, k - 1) for k in range(1, 41)] + [(50, 51), (51, 50)], "tag long, target long").repartition(12, "tag")
    starts = spark.createDataFrame([(k,) for k in (0, 1, 15, 16, 40, 50, 99)], "oid long")
    for most in (15, 40):
        found = lifecycle.peel(starts, tags, most)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert {r.oid: r.peeled for r in found.collect()} == {0: 0, 1: 0, 15: 0, 16: 0 if most > 15 else None, 40: 0 if most > 15 else None, 50: None, 99: 99}
    assert plans and not any("Broadcast" in p for p in plans)


def test_deepen(spark):
    edges = spark.createDataFrame([(k, k - 1, 0) for k in range(2, 12)], "child long, parent long, ord int")
    want = spark.createDataFrame([(11,)], "id long")
    assert [graph.deepen(edges, want, d).count() for d in (1, 3, 20)] == [1, 3, 11]
    assert graph.deepen(edges, want, 11).where("shallow").first().id == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3)]
    got = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 161)} | {k: 7 for k in range(8, 40)}


def test_identities(spark):
    rows = ["A U <a@b> 12 +0130", "A <a> 12", "A <x> <y> 5 -0700", "none", ""]
    got = spark.createDataFrame([(r,) for r in rows], "l string").select(scalars.identity(F.col("l")).alias("i")).collect()
    assert [(r.i.seconds, r.i.offset_seconds) for r in got] == [(12, 5400), (0, 0), (5, -25200), (0, 0), (0, 0)]


def test_sizes():
    assert [scalars.size_argument(x) for x in ("4", "1k", "0x10", "010", "2M")] == [4, 1024, 16, 8, 2 << 20]
    for bad in ("-1", "k", "1x", "99999999999g"):
        with pytest.raises(ValueError):
            scalars.size_argument(bad)


def test_edits(spark):
    base = spark.createDataFrame([("a/b", "1"), ("c", "2")], "path string, oid string")
    edit = lambda rows: {r.path: r.oid for r in trees.edit(base, spark.createDataFrame(rows, "path string, oid string")).collect()}
    assert edit([("c", None), ("gone", None), ("d/e", "3")]) == {"a/b": "1", "d/e": "3"}
    with pytest.raises(ValueError):
        edit([("c/x", "3")])
    with pytest.raises(ValueError):
        edit([("x", "3"), ("x", "4")])


def test_pages(spark):
    rows = spark.createDataFrame([(f"k{n:02d}", n == 1) for n in range(5)], "key string, deleted boolean")
    one = refs.page(rows, "key", "k", None, 2).collect()
    assert [(r.key, r.next_token) for r in one] == [("k00", "k01")]
    assert [r.next_token for r in refs.page(rows, "key", "k", "k03", 2).collect()] == [None]
    with pytest.raises(ValueError):
        refs.page(rows, "key", "k", "x", 2)


def test_runs():
    # What the compaction rule gives for these sizes.
    cases = {
        ((100, 1, 1, 1), 1): [],
        ((1000, 10, 10, 10, 10), 1): [(1, 5)],
        ((5, 1, 9, 2, 1, 1, 7, 3), 10): [(0, 8)],
        ((9,) * 10, 10): [(0, 4), (4, 8)],
        ((1,) * 100, 10): [(0, 40), (40, 80), (80, 100)],
        ((100, 1, 100, 100, 100, 10), 1): [(0, 4)],
        ((1000,) * 4 + (10,) * 4, 1): [(0, 4), (4, 8)],
    }
    assert {k: maintain.pick_runs(list(k[0]), 4, k[1]) for k in cases} == cases


def test_runs_of_any_sizes():
    import random

    rng = random.Random(1)
    for _ in range(500):
        sizes, factor, floor = [int(10 ** rng.uniform(0, 4)) for _ in range(rng.randint(0, 40))], rng.randint(2, 6), rng.choice([1, 10, 100])
        runs = maintain.pick_runs(sizes, factor, floor)
        assert all(b - a >= factor for a, b in runs) and all(b <= c for (_, b), (c, _) in zip(runs, runs[1:]))
        for a, b in runs:  # no longer than it must be, unless its bytes allow for it
            largest = max(floor, *sizes)
            assert b - a == factor or sum(sizes[a:b]) <= factor * largest
        merged = sizes
        for _ in range(60):  # merging ends, with fewer than `factor` layers in any class
            found = maintain.pick_runs(merged, factor, floor)
            if not found:
                break
            for a, b in reversed(found):
                merged = [*merged[:a], sum(merged[a:b]), *merged[b:]]
        assert not found and sum(merged) == sum(sizes)


def test_compaction_of_repositories(spark):
    rows = [(r, k, b) for r, sizes in (("a", [1] * 9), ("b", [5]), ("c", [100, 1, 1, 1, 1])) for k, b in enumerate(sizes)]
    got = maintain.compaction_runs(spark.createDataFrame(rows, "repo string, seq long, bytes long"), 4, 1).collect()
    assert {tuple(r) for r in got} == {(r, a, b - 1, b - a) for r, s in (("a", [1] * 9), ("b", [5]), ("c", [100, 1, 1, 1, 1])) for a, b in maintain.pick_runs(s, 4, 1)}


def test_prechecks_in_order(spark):
    updates = [(1, False, 1, "refs/heads/a", 7), (1, False, 2, "refs/heads/a", 7), (2, False, 1, "refs/heads/b", None), (2, False, 2, "refs/heads/b", 5), (3, True, 1, "refs/heads/b", None), (3, True, 2, "refs/heads/b", 5), (4, False, 1, "refs/one", None), (4, False, 2, "refs/one", 5), (5, False, 1, "refs/heads/main", None), (5, False, 2, "refs/heads/main", None), (6, False, 1, "refs/heads/t", 6), (6, False, 2, "refs/tags/t", 6)]
    df = spark.createDataFrame(updates, "command int, atomic boolean, ord int, refname string, new int")
    objects = spark.createDataFrame([(5, "commit"), (6, "tag")], "oid int, kind string")
    got = {(r.command, r.ord): r.reason for r in refs.prechecks(df, objects, "refs/heads/main").collect()}
    assert got == {
        (1, 1): "MISSING_OBJECT", (1, 2): "MISSING_OBJECT", (2, 1): None, (2, 2): None, (3, 1): "REPEATED_REF", (3, 2): "REPEATED_REF", (4, 1): None, (4, 2): "INVALID_NAME",
        (5, 1): "DELETES_HEAD", (5, 2): "DELETES_HEAD", (6, 1): "NON_COMMIT", (6, 2): None,
    }


def test_names_like_gitmodules(spark):
    cases = {".gitmodules": True, ".GITMODULES . ": True, ".gitmodules:x": True, ".gitmodu\u200cles": True, "gitmod~1": True, "gitmod~4": True, "gitmod~5": False, "gi7eba~1": True, "gi7e~123": True, "~1234567": True, "~0234567": False, "gi7eba~0": False, "gi7ebb~1": False, ".gitmodulesx": False, "a\\.gitmodules": True}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", scalars.like_dot_gitmodules(F.col("c")).alias("f")).collect()
    assert {r.c: r.f for r in got} == cases


def test_tree_entries_in_order(spark):
    from heddle.operators import lifecycle

    rows = [("t", 0, "100644", "b", "1"), ("t", 1, "100644", "a", "1"), ("t", 2, "120000", ".gitmodules", "1"), ("u", 0, "100644", "a", "1"), ("u", 1, "40000", "a", "2"), ("v", 0, "100644", "a.b", "1"), ("v", 1, "40000", "a", "1"), ("w", 0, "40000", "a", "1"), ("w", 1, "100644", "a.b", "1")]
    got = lifecycle.tree_faults(spark.createDataFrame(rows, "tree string, ord int, mode string, name string, oid string")).collect()
    assert {(r.tree, r.ord): r.fault for r in got} == {("t", 1): "OUT_OF_ORDER", ("t", 2): "GITMODULES_LINK", ("u", 0): "DUPLICATE", ("u", 1): "DUPLICATE", ("w", 1): "OUT_OF_ORDER"}


def test_pages_of_a_history(spark, criss_cross):
    page = lambda start, n: sorted((r.place, r.id, r.next_token) for r in criss_cross.list_commits(spark.createDataFrame([(start,)], "start long"), n).collect())
    assert page(7, 2) == [(0, 7, 3), (1, 5, 3)] and page(3, 2) == [(0, 3, None), (1, 1, None)] and page(6, 1) == [(0, 6, 4)]
    with pytest.raises(ValueError):
        page(100, 1)


def test_prefixes_past_counting():
    assert str(refs.with_prefix(F.col("n"), ["a"] * 65_536)) == str(F.lit(True)) == str(refs.with_prefix(F.col("n"), []))


def test_whole_listing_is_told_apart_from_a_cut_one(spark):
    rows = spark.createDataFrame([(b"b",), (b"a\xff",), (b"a",)], "path binary")
    assert [(r.path, r.truncated) for r in trees.in_path_order(rows, 2).collect()] == [("a", True), ("a\ufffd", True)]
    assert [r.truncated for r in trees.in_path_order(rows, 3).collect()] == [False] * 3


def test_ids_run_out(spark):
    rows = [("r", 1, 3), ("r", 2, 0), ("r", 3, 4), ("r", 4, 9), ("s", 1, 10)]
    got = maintain.dense_ids(spark.createDataFrame(rows, "repo string, seq int, objects long"), 10).collect()
    assert {(r.repo, r.seq): r.first_id for r in got} == {("r", 1): 0, ("r", 2): None, ("r", 3): 3, ("r", 4): None, ("s", 1): 0}


def test_stateful_fold(spark, tmp_path):
    batches = [[("r", "a", "1", 1), ("r", "b", "2", 3)], [("r", "a", None, 2), ("s", "x", "9", 1), ("r", "b", "2", 3)], [("s", "y", "8", 3)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, feed.CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = []
    stream = feed.folded(feed.follow(spark, f"{tmp_path}/in/*", 1)).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect()))
    stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    last = {r.repo: (r.version, r.refs, r.applied, r.waiting) for r in sorted(got, key=lambda r: (r.applied, r.waiting))}
    assert last == {"r": (3, 1, 3, 0), "s": (1, 1, 1, 1)}


def test_feed_from_a_state(spark):
    state = spark.createDataFrame([("r", "a", "1", 4)], feed.CHANGES)
    changes = spark.createDataFrame([("r", "a", "0", 3), ("r", "b", "2", 5), ("s", "x", "9", 1)], feed.CHANGES)
    got = sorted((r.part, r.repo, r.name) for r in feed.from_state(state, changes).collect())
    assert got == [(0, "r", "a"), (1, "r", "b"), (1, "s", "x")]


def test_post_receive_only_logs(spark, caplog):
    from heddle.operators import hooks

    rows = spark.createDataFrame([(1, 2, "b", None, "2", None), (1, 1, "a", None, "1", None), (2, 1, "c", None, "1", "STALE_OLD_VALUE")], "push int, ord int, refname string, old string, new string, reason string")
    told = []
    hooks.post_receive(lambda df: told.extend(df.collect()))(rows, 0)
    assert [(r.push, [c.refname for c in r.commands]) for r in told] == [(1, ["a", "b"])]
    hooks.post_receive(lambda df: 1 / 0)(rows, 1)
    assert "post-receive of batch 1 failed" in caplog.text


def test_command_line(spark, capsys):
    from heddle.__main__ import main

    assert main([SF, "repo", "list", "--prefix", "Customer-0000000", "--limit", "3"], spark) == 0
    assert capsys.readouterr().out.split("\n")[0].startswith("Customer-000000001\tFalse")
    assert main([SF, "repo", "get", "Customer-000000007"], spark) == 1 and main([SF, "repo", "get"], spark) == 2
    assert main([SF, "refs", "--prefix", "refs/tags/"], spark) == 0 and "refs/tags/" in capsys.readouterr().out
    assert main([SF, "diff", "--limit", "2"], spark) == 0 and len(capsys.readouterr().out.split()) > 2


def test_filters_of_objects(spark):
    with pytest.raises(ValueError):
        checks.filtered(spark.createDataFrame([("blob", 1, False)], "kind string, size long, wanted boolean"), "sparse:oid=x")


def test_feed(spark, tmp_path):
    rows = [("r", "a", "1", 1), ("r", "b", "2", 2), ("r", "a", "3", 3)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], feed.CHANGES).write.parquet(f"{tmp_path}/in/{k}")
    got = []
    feed.deliver(feed.follow(spark, f"{tmp_path}/in/*"), lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp").awaitTermination(60)
    assert {(r.name, r.oid) for r in feed.current(spark.createDataFrame(got, feed.CHANGES)).collect()} == {("a", "3"), ("b", "2")}


def test_topological_order(spark):
    from heddle.sources import model

    place = {r.id: k for k, r in enumerate(registry.topological_order(spark, SF).collect())}
    assert all(place[r.parent] < place[r.child] for r in model.edges(spark, SF).collect())


def test_object_faults(spark):
    person = "A <a@b> 5 +0000"
    good = f"tree {'a' * 40}\nparent {'b' * 40}\nauthor {person}\ncommitter {person}\n\nmessage"
    tag = f"object {'a' * 40}\ntype commit\ntag v1\ntagger {person}\n\nnotes"
    commits = {
        good: None, good.replace("parent b", "parent g"): "BAD_PARENT", good.replace(f"author {person}\n", f"author {person}\n" * 2): "MANY_AUTHORS",
        good.replace("5 +0000", "x +0000"): "BAD_DATE", good.replace("5 +0000", "5 0000"): "BAD_ZONE", good.replace("5 +", "0 +"): None, good.replace(" 5 ", f" {'9' * 30} "): "DATE_OVERFLOW",
        good.replace("A <a@b>", "A a@b>"): "BAD_NAME", good.replace("\n\nmessage", ""): "UNTERMINATED_HEADER", good + "\0": "NUL_IN_BODY", good.replace("A <a@b>", "A\0<a@b>"): "NUL_IN_HEADER",
    }
    tags = {tag: None, tag.replace("type commit", "type comit"): "BAD_TYPE", tag.replace("object", "objekt"): "NO_OBJECT", tag.replace("<a@b>", "<a@b"): "BAD_EMAIL", tag.replace("+0000\n", "+00\nmore x\n"): None, "object": "TOO_SHORT"}
    for cases, fault in ((commits, checks.commit_fault), (tags, checks.tag_fault)):
        got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", fault(F.col("c")).alias("f")).collect()
        assert {r.c: r.f for r in got} == cases


def test_trees_as_bytes(spark):
    rows = [("t", "100644", "a.b", "1" * 40), ("t", "40000", "a", "2" * 40), ("t", "100755", "a-", "3" * 40), ("u", "120000", "é", "4" * 40)]
    content = checks.tree_bytes(spark.createDataFrame(rows, "tree string, mode string, name string, oid string"))
    want = b"100755 a-\0" + b"\x33" * 20 + b"100644 a.b\0" + b"\x11" * 20 + b"40000 a\0" + b"\x22" * 20
    assert {r.tree: bytes(r.content) for r in content.collect()}["t"] == want
    back = checks.parse_trees(content).collect()
    assert [(r.mode, bytes(r.name).decode(), r.oid[0]) for r in sorted(back, key=lambda r: (r.tree, r.ord))] == [(0o100755, "a-", "3"), (0o100644, "a.b", "1"), (0o40000, "a", "2"), (0o120000, "é", "4")]
