import numpy as np

from chronoreel.llm import common

from .helpers import components


def links():
    rng = np.random.default_rng(5)
    name = [int(x) for x in rng.permutation(np.arange(-2_000, 2_000)) * 3_000_000_000_000_001]
    chain = [(name[i], name[i + 1]) for i in range(700)]
    stars = [(name[1000 + i % 3], name[1100 + i]) for i in range(300)]
    some = [(name[2000 + a], name[2000 + b]) for a, b in rng.integers(0, 1500, (1000, 2)).tolist()]
    return [*chain, *stars, *some, *some[:50], *[(b, a) for a, b in chain[:50]], (name[1], name[1]), (None, name[0]), (name[3999], None), (None, None)]


def wanted(rows):
    rows = [(a, b) for a, b in rows if a is not None and b is not None and a != b]
    return components(sorted({x for r in rows for x in r}), rows)


def work(spark, group, f):
    """What ``f`` returns, and how many tasks it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out, told = f(), sc.statusTracker()
        stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_few_links_take_few_tasks(spark):
    """The rounds of joins gave each partition a task seven times a round: 35,110 of the 50,371 tasks of the pipeline's near-dedup on check_h."""
    rows = links()
    df = spark.createDataFrame(rows, "a long, b long").repartition(8)
    got, tasks = work(spark, "few-links", lambda: common.components(df).collect())
    assert len(got) == len(wanted(rows)) and {r.node: r.root for r in got} == wanted(rows)
    assert 0 < tasks < 100


def test_rounds_and_one_task_agree(spark, monkeypatch):
    rows = links()
    df = spark.createDataFrame(rows, "a long, b long")
    for few in (len(rows), 10, 0):  # at 10 the count decides
        monkeypatch.setattr(common, "FEW", few)
        got = common.components(df).collect()
        assert len(got) == len(wanted(rows)) and {r.node: r.root for r in got} == wanted(rows), few


def test_no_links_and_names_that_are_no_integers(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
    got = common.components(spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")).collect()
    assert {r.node: r.root for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
