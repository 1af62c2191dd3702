from grainmill.llm import repeats, scratch


def test_bitmaps_of_few_values_are_small(spark):
    few = spark.range(100).withColumnRenamed("id", "doc")
    for cells in (scratch.bitmap(few, "doc"), repeats.cells_of(few, "doc")):
        assert cells.nbytes <= 1 << 13
    rows, cells = spark.range(2000), scratch.bitmap(few, "doc")
    found, rest = ({r.id for r in scratch.passed(rows, "id", cells, p).collect()} for p in (True, False))
    assert found >= set(range(100)) and len(found) < 200 and found | rest == set(range(2000)) and not found & rest
