"""Joins and components where one key holds most rows."""

from cloudframe.operators import graph, joins
from cloudframe.operators.graph import connected_components


def test_join_one_gives_what_a_join_gives(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_HEAVY", 10)
    many = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)] + [(None, 1), (99, 1)], "k long, v long")
    one = spark.createDataFrame([(k, f"n{k}") for k in range(41)] + [(None, "x")], "k long, name string")
    got = joins.join_one(many, one, "k", 540)
    assert got.columns == ["k", "v", "name"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k").collect()))
    assert joins.join_one(many.limit(0), one, "k", 540).count() == 0


def test_components_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_HEAVY", 10)
    edges = [(5000, i) for i in range(1, 2000)] + [(7000, 7000 + i) for i in range(1, 900)] + [(7000 + i, 9000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 1 if n <= 5000 else 7000 for e in edges for n in e}


def test_a_round_of_components_does_not_repeat_its_plan(spark, monkeypatch, capsys):
    monkeypatch.setattr(joins, "LEAST_HEAVY", 10)
    plans, write = [], graph.write_table

    def kept(df, name, **options):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df, name, **options)

    monkeypatch.setattr(graph, "write_table", kept)
    edges = [(5000, i) for i in range(1, 200)] + [(i, i + 1) for i in range(6000, 6040)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 1 if n <= 5000 else 6000 for e in edges for n in e}
    assert len(plans) > 3
    assert max(p.count("HashAggregate(") for p in plans) <= 2
    assert max(p.count("Scan ") for p in plans) <= 8
