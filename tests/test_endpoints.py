"""Endpoints, shapes and names on small frames."""

from pyspark.sql import functions as F

from wirebook.operators.endpoints import NOT_JSON, endpoint_fields, endpoint_schemas, path_templates

DDL = "method string, url string, request_body binary, response_body binary, host string, path string, n int"


def make(spark, *rows):
    return spark.createDataFrame([(*row, "own", "own", 7) for row in rows], DDL)


def test_templates(spark):
    urls = [f"http://A.example/users/{k}/orders" for k in range(4)] + ["http://a.example/users/9", "/users/1?x=/y", "http://a.example", None, "http://b.example/users/1/orders#top"]
    found = {(r.host, r.path): r.template for r in path_templates(make(spark, *[("GET", u, None, None) for u in urls + urls]), most=3).collect()}
    assert found == {
        **{("a.example", f"/users/{k}/orders"): "/users/{}/orders" for k in range(4)},
        ("a.example", "/users/9"): "/users/9", ("", "/users/1"): "/users/1", ("a.example", ""): "/", ("b.example", "/users/1/orders"): "/users/1/orders",
    }


def test_shapes(spark):
    bodies = [b'{"a": 1, "b": {"c": [1, 2.5]}}', b'{"b": {"c": []}, "a": 2}', b'{"a": "x"}', b"[1]", b"", None, b"plain", b'\xff{"a": 1}', b'{"a": 1, "a": 2}']
    rows = [("POST", f"http://h/items/{k}", body, None) for k, body in enumerate(bodies * 3)]
    got = endpoint_schemas(make(spark, *rows), most=5).where("body = 'request'").collect()
    assert {(r.method, r.host, r.template) for r in got} == {("POST", "h", "/items/{}")}
    assert sum(r.n for r in got) == 27 and sum(r.n for r in got if r.body_schema is None) == 6 and sum(r.n for r in got if r.body_schema == NOT_JSON) == 9
    assert sum(r.n for r in got if r.body_schema == "OBJECT<a: STRING>") == 3 and sum(r.n for r in got if (r.body_schema or "").startswith("ARRAY")) == 3
    fields = {r.field: (r.n, r.required) for r in endpoint_fields(make(spark, *rows), most=5).collect()}
    assert fields == {"a": (9, True), "b": (6, False)}


def test_a_busy_endpoint_is_counted_before_the_shuffle(spark):
    """Bodies are in no exchange: only shapes and counts are."""
    frame = spark.range(5000).select(
        F.lit("GET").alias("method"), F.concat(F.lit("http://h/x/"), F.col("id") % 40).alias("url"),
        F.lit(None).cast("binary").alias("request_body"), F.concat(F.lit('{"id": '), "id", F.lit("}")).cast("binary").alias("response_body"))
    got = endpoint_schemas(frame).collect()
    assert {(r.template, r.body, r.body_schema, r.n) for r in got} == {("/x/{}", "request", None, 5000), ("/x/{}", "response", "OBJECT<id: BIGINT>", 5000)}


def test_no_traces(spark):
    assert endpoint_schemas(make(spark)).count() == 0 == endpoint_fields(make(spark)).count()
