"""Streams that are read from an episode's files are read once, by tasks."""

from episodica.plans import reviews


def test_stamps_are_read_once(spark):
    """What both queries of stamps share: no list of files in the driver, and no reader of files in the plan that follows."""
    stamps = reviews._stamped(spark, "/root/testdata/sf0.001")[3]
    plan = stamps._jdf.queryExecution().executedPlan().toString()
    assert stamps.inputFiles() == [] and "FileScan" not in plan and "MapInArrow" not in plan
    assert stamps.count() == stamps.select("ep", "place").distinct().count() > 0
