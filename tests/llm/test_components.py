"""Connected components: few rounds, and a driver that keeps nothing of the rounds before."""

import random

import pytest

from scanloom.llm import components as C


def roots_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


@pytest.fixture
def tables(monkeypatch):
    """Of each table that components writes, how often the driver was cleared since the one before."""
    made = []
    monkeypatch.setattr(C, "written", lambda df, name, f=C.written: made.append(0) or f(df, name))

    def forget(spark, f=C.forget_finished):
        made[-1] += 1
        f(spark)

    monkeypatch.setattr(C, "forget_finished", forget)
    return made


def found(spark, edges):
    rows = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_stars_need_no_round(spark, tables):
    edges = [(5, 1), (1, 7), (7, 1), (9, 3), (4, 4), (None, 2), (2, None)]
    assert found(spark, edges) == {1: 1, 5: 1, 7: 1, 3: 3, 9: 3}
    assert tables == [1]
    assert found(spark, []) == {} and len(tables) == 2


def test_rounds_leave_nothing_with_the_driver(spark, tables):
    pick = random.Random(3)
    edges = [(k, k + 1) for k in range(20)] + [(pick.randrange(30, 90), pick.randrange(30, 90)) for _ in range(50)] + [(200, k) for k in range(100, 130)]
    assert found(spark, edges) == roots_of(edges)
    assert len(tables) > 2 and tables == [1] * len(tables)


def test_what_no_star_is(spark):
    star = lambda *edges: C._stars(spark.createDataFrame(list(edges), "u long, v long"))
    assert star() and star((2, 1), (3, 1), (5, 4))
    assert not star((3, 2), (2, 1)) and not star((3, 1), (3, 2)) and not star((9, 8), (3, 2), (2, 1))
