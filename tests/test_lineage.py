import math
import random

import pytest

from cuelake.operators import provenance as pv


def reach(edges):
    """{node: all nodes above it}, by walking."""
    up = {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)
    out = {}
    for node in up:
        seen, todo = set(), [node]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out[node] = seen
    return out


def graph(seed, n=40, circles=False):
    rng = random.Random(seed)
    edges = {(k, k - 1) for k in range(2, n) if rng.random() < 0.8}
    edges |= {(k, rng.randrange(1, k)) for k in range(2, n) if rng.random() < 0.4}
    if circles:
        edges |= {(rng.randrange(1, n), rng.randrange(1, n)) for _ in range(4)}
    return edges


@pytest.mark.parametrize("circles", [False, True])
def test_equals_walks(spark, circles):
    graphs = {p: graph(p, circles=circles) for p in range(6)}
    parents = spark.createDataFrame([(p, c, q) for p, es in graphs.items() for c, q in es], "project_id long, seq long, parent long")
    wanted = {p: sorted({c for c, _ in es})[::7] for p, es in graphs.items()}
    deliverables = spark.createDataFrame([(p, s) for p, ss in wanted.items() for s in ss], "project_id long, seq long")
    got = sorted(tuple(r) for r in pv.lineage(deliverables, parents).select("project_id", "seq", "source_seq").collect())
    assert got == sorted((p, s, a) for p, ss in wanted.items() for s in ss for a in reach(graphs[p])[s])
    closing = {(p, c, q) for p, es in graphs.items() for c, q in es if q >= c and (q == c or c in reach(es).get(q, ()))}
    assert {tuple(r) for r in pv.lineage_circles(parents).select("project_id", "seq", "parent").collect()} == closing


def test_rounds_are_logarithmic(spark):
    n = 3000
    parents = spark.range(2, n + 1).selectExpr("1L AS project_id", "id AS seq", "id - 1 AS parent")
    top = spark.createDataFrame([(1, n)], "project_id long, seq long")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or "/tmp")
    first = parents.selectExpr("project_id", "seq AS _at", "parent AS _to")
    assert len(pv._jumps(first, ["project_id"])) == math.ceil(math.log2(n - 1))
    assert pv.lineage(top, parents).count() == n - 1


def test_no_parents(spark):
    none = spark.createDataFrame([], "project_id long, seq long, parent long")
    top = spark.createDataFrame([(1, 2)], "project_id long, seq long")
    assert pv.lineage(top, none).count() == pv.lineage_circles(none).count() == 0


def chains(spark, n=400, projects=3):
    """Lines with a second parent at every fiftieth node."""
    rows = spark.range(2, n + 1).selectExpr("explode(sequence(1L, %dL)) AS project_id" % projects, "id AS seq")
    return rows.selectExpr("project_id", "seq", "explode(IF(seq %% 50 = 0, array(seq - 1, seq div 2), array(seq - 1))) AS parent".replace("%%", "%"))


def test_lines_are_followed_in_pieces(spark, monkeypatch):
    """every node of a line met every join; now a piece of a line without branches is one node."""
    seen = []
    whole = pv._reached
    monkeypatch.setattr(pv, "_reached", lambda d, p, keys: seen.append(p.count()) or whole(d, p, keys))
    top = spark.createDataFrame([(p, s) for p in (1, 2, 3) for s in (400, 333)], "project_id long, seq long")
    assert pv.lineage(top, chains(spark)).count() == 3 * (399 + 332)
    assert seen[0] < 3 * 40


def test_only_edges_in_spans_are_followed_for_circles(spark, monkeypatch):
    """all ancestors of every late edge were made; now only edges within spans of late ones are followed."""
    seen = []
    whole = pv.lineage
    monkeypatch.setattr(pv, "lineage", lambda d, p, *more: seen.append(p.count()) or whole(d, p, *more))
    late = spark.createDataFrame([(1, 130, 137), (1, 135, 139), (2, 2, 2), (3, 1, 3)], "project_id long, seq long, parent long")
    got = {tuple(r) for r in pv.lineage_circles(chains(spark).unionByName(late)).collect()}
    assert got == {tuple(r) for r in late.collect()}
    assert seen[0] < 40


@pytest.mark.parametrize(("segment", "seed", "circles"), [(5, 11, False), (7, 12, True)])
def test_blocks_and_short_pieces_give_the_same(spark, monkeypatch, segment, seed, circles):
    monkeypatch.setattr(pv, "SEGMENT", segment)
    es = graph(seed, n=60, circles=circles)
    parents = spark.createDataFrame([(1, c, q) for c, q in es] * 2, "project_id long, seq long, parent long")
    wanted = sorted({c for c, _ in es})[::9]
    top = spark.createDataFrame([(1, s) for s in wanted] * 2, "project_id long, seq long")
    got = sorted(tuple(r) for r in pv.lineage(top, parents, rows_per_block=7).select("seq", "source_seq").collect())
    assert got == sorted((s, a) for s in wanted for a in reach(es)[s])
    closing = {(c, q) for c, q in es if q >= c and (q == c or c in reach(es).get(q, ()))}
    assert {tuple(r) for r in pv.lineage_circles(parents, rows_per_block=7).select("seq", "parent").collect()} == closing
