"""op9_warc reads every payload, but sends none through the join of the reading."""

from lexigrain.llm import queries


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def names(plan):
    return [plan.output().apply(i).name() for i in range(plan.output().size())]


def test_no_payload_in_the_join(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "u", "b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = queries.op9_warc(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    joined = [names(p.children().apply(i)) for p in nodes(plan) if p.nodeName() == "Join" for i in range(2)]
    assert len(joined) == 2 and not any("payload" in x for x in joined)
    assert any("payload" in names(p) for p in nodes(plan) if p.children().size() == 0)
