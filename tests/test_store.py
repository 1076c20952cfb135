"""A graph in files: merges by key, untouched buckets stay as they are, lost merges are not seen."""

from pathlib import Path

import pytest

from docloom.operators import store as S


def node(i, label, item="a"):
    return ("g", "s", item, f"n{i}", "entity", label, None)


def edge(i, src, dst, weight=1.0, item="a"):
    return ("g", "s", item, f"e{i}", src, dst, "tied", weight, "{}")


@pytest.fixture
def graph(spark, tmp_path):
    return S.GraphStore(spark, str(tmp_path / "graph"))


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, S.NODE), spark.createDataFrame(edges, S.EDGE)


def content(graph):
    return sorted(map(str, graph.nodes().collect())), sorted(map(str, graph.edges().collect()))


def stamps(graph):
    return {str(p): p.stat().st_mtime_ns for p in Path(graph.path).rglob("*.parquet") if "/log/" not in str(p)}


def test_two_merges_equal_one(spark, graph, tmp_path):
    first = [node(i, f"old {i}") for i in range(60)], [edge(i, f"n{i}", f"n{i + 1}") for i in range(59)]
    second = [node(i, f"new {i}") for i in range(50, 70)], [edge(i, f"n{i}", f"n{i + 1}", 2.0) for i in range(55, 69)]
    assert graph.merge(*frames(spark, *first)) == 1 and graph.merge(*frames(spark, *second)) == 2
    once = S.GraphStore(spark, str(tmp_path / "once"))
    once.merge(*frames(spark, first[0][:50] + second[0], first[1][:55] + second[1]))
    assert content(graph) == content(once)
    assert graph.nodes().count() == 70 and graph.edges().where("weight = 2").count() == 14


def test_untouched_buckets_stay_and_a_repeated_merge_changes_no_row(spark, graph):
    graph.merge(*frames(spark, [node(i, "x") for i in range(400)], [edge(i, f"n{i}", "n0") for i in range(400)]))
    files, folders, rows = stamps(graph), graph.files("nodes"), content(graph)
    one = frames(spark, [node(7, "y")], [])
    graph.merge(*one)
    moved = {b for b, f in graph.files("nodes").items() if f != folders[b]}
    assert len(moved) == 1 and graph.files("edges") and {k: v for k, v in stamps(graph).items() if k in files} == files
    after = content(graph)
    assert after != rows and after[1] == rows[1]
    graph.merge(*one)
    assert content(graph) == after
    graph.sweep()
    assert content(graph) == after and len(stamps(graph)) < len(files) + 2


def test_a_lost_merge_is_not_seen_and_can_be_done_again(spark, graph, monkeypatch):
    graph.merge(*frames(spark, [node(1, "x"), node(2, "x")], [edge(1, "n1", "n2")]))
    before, real = content(graph), S.GraphStore._write

    def lost(self, kind, *args):
        done = real(self, kind, *args)
        if kind == "edges":
            raise RuntimeError("the driver is gone")
        return done

    new = frames(spark, [node(1, "y"), node(3, "y")], [edge(2, "n1", "n3")])
    with monkeypatch.context() as m:
        m.setattr(S.GraphStore, "_write", lost)
        with pytest.raises(RuntimeError):
            graph.merge(*new)
    assert content(graph) == before
    graph.merge(*new)
    graph.sweep()
    assert graph.nodes().count() == 3 and graph.edges().count() == 2 and graph.nodes().where("label = 'y'").count() == 2


def test_edges_need_both_ends_in_their_item(spark, graph):
    nodes = [node(1, "x"), node(2, "x"), node(1, "x", "b"), ("g", None, None, "n1", None, None, None), ("g", None, None, "n2", None, None, None)]
    edges = [edge(1, "n1", "n2"), edge(2, "n1", "n9"), edge(3, "n1", "n2", item="b"), ("g", None, None, "e4", "n2", "n1", "t", None, None), (*edge(5, "n1", "n2")[:3], None, "n1", "n2", "t", 1.0, None)]
    graph.merge(*frames(spark, nodes, edges))
    assert sorted(r.edge_id for r in graph.edges().collect()) == ["e1", "e4"]
    graph.merge(*frames(spark, [node(9, "late")], [edge(2, "n1", "n9")]))
    assert sorted(r.edge_id for r in graph.edges().collect()) == ["e1", "e2", "e4"]


def test_empty_merges_and_rows_that_repeat(spark, graph):
    assert graph.merge(*frames(spark, [], [])) == 0 and content(graph) == ([], [])
    graph.merge(*frames(spark, [node(1, "a"), node(1, "b"), node(1, "b")], []))
    assert [r.label for r in graph.nodes().collect()] == ["b"]
    graph.sweep()
    assert graph.nodes().count() == 1


def test_a_settled_step_leaves_tables_of_other_threads(spark):
    """What the step wrote on its way goes; what another thread writes meanwhile stays."""
    from concurrent.futures import ThreadPoolExecutor

    from docloom.operators.lineage import cut, settled

    own, others = [], []

    def step():
        own.append(cut(spark.range(3)))
        with ThreadPoolExecutor(1) as pool:
            others.append(pool.submit(cut, spark.range(5)).result())
        return own[0]

    assert settled(step).count() == 3 and others[0].count() == 5
    assert not Path(own[0].inputFiles()[0].removeprefix("file:")).exists()
