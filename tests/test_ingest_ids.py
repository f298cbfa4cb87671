from wirebook.plans import catalog


def test_ids_are_not_joined_by_the_driver(spark, sf_dir):
    """both sides grow with the events, so neither is broadcast, however small it is taken to be."""
    found = catalog.QUERIES["ingest_ids"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert found.columns == ["event_id", "trace_id", "span_id"]
