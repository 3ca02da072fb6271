"""The rounds of the components keep each step: no plan holds the steps before it many times over, in the driver's memory."""

from weftwork.llm import simhash
from weftwork.llm.common import stored


def test_plans_of_the_rounds_stay_small(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 3000)]
    scans = []

    def keep(df, what):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return stored(df, what)

    got = {r.vertex: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long"), keep).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 3000)}
    assert len(scans) > 4 and max(scans) <= 12
