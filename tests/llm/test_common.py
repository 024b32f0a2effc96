import numpy as np
import pytest

from quartzite.llm.common import components


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components_equal_union_find(spark, shape):
    rng = np.random.default_rng(4)
    edges = {"random": rng.integers(0, 300, (220, 2)).tolist(), "path": [[i, i + 1] for i in rng.permutation(60).tolist()], "star": [[500, i] for i in range(80)] + [[3, 900]], "empty": []}[shape] + [[7, 7], [None, 5]] * (shape != "empty")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_the_drivers_heap_is_collected_during_a_long_job(spark, monkeypatch):
    import time

    from quartzite.llm import common

    def slow(batches):
        for b in batches:
            time.sleep(2)
            yield b

    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    monkeypatch.setattr(common, "COLLECT_S", 0.5, raising=False)
    before = collections()
    assert common.materialize(spark.range(3, numPartitions=1).mapInArrow(slow, "id long"), "slow").count() == 3
    assert collections() >= before + 2
