"""Values used again, against a plain search over all pairs."""

import json
import random

from wirebook.operators.values import json_leaves, value_links

DDL = "trace_id string, span_id string, url string, request_body binary, response_body binary, ts_ns bigint, duration_ns bigint, place string, value string"


def told(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_leaves():
    body = {"a": [1, {"b/c": "x~"}], "n": None, "t": True, "f": 2.50, "": ""}
    assert sorted(json_leaves(json.dumps(body).encode())) == [("/", ""), ("/a/0", "1"), ("/a/1/b~1c", "x~"), ("/f", "2.5")]
    for broken in (b"", b"{", b"\xff", b"[" * 100_000):
        assert not list(json_leaves(broken))


def test_random_messages(spark):
    """Few values, one of them in most messages; times and ids collide."""
    draw = random.Random(5)
    rows = []
    for k in range(250):
        value = lambda: draw.choice(["hot", "hot", "hot", "v1", "v2", "77"])
        url = f"http://h/items/{value()}" + draw.choice(["", f"?id={value()}&x", "?q=a%20b"])
        body = json.dumps({"ref": value(), "deep": [{"id": value()}, 77, "a b"]}).encode()
        rows.append((f"t{draw.randrange(3)}", f"{draw.getrandbits(64):016x}", url, draw.choice([None, body]), draw.choice([b"", body, b"no"]), draw.randrange(80), draw.choice([None, 0, 5, 30]), "p", "v"))
    rows += [("t0", None, "http://h/hot", None, None, 99, 1, "p", "v"), (None, "0" * 16, "http://h/hot", None, None, 99, 1, "p", "v"), ("t0", "0" * 16, None, None, None, None, 1, "p", "v")]

    outputs, inputs = [], []
    for trace, span, url, request, response, start, duration, *_ in rows:
        if None in (trace, span, start):
            continue
        inputs += [(trace, span, start, f"body{p}", v) for p, v in json_leaves(request or b"")]
        outputs += [(trace, span, start + (duration or 0), f"body{p}", v) for p, v in json_leaves(response or b"")]
        path, _, query = url[len("http://h/") :].partition("?")
        inputs += [(trace, span, start, f"path/{n}", s) for n, s in enumerate(path.split("/"))]
        inputs += [(trace, span, start, f"query/{p.split('=')[0]}", p.partition("=")[2].replace("%20", " ")) for p in query.split("&")]
    want = []
    for trace, span, at, place, value in inputs:
        before = [(o[2], o[1]) for o in outputs if o[0] == trace and o[4] == value and o[2] < at]
        if value and before:
            end, source = max(before)
            want.append((trace, span, place, value, source, min(o[3] for o in outputs if (o[1], o[4], o[2]) == (source, value, end))))
    assert len(want) > 200
    assert told(value_links(spark.createDataFrame(rows, DDL), partitions=7)) == sorted(want, key=str)
    longer = [w for w in want if len(w[3]) >= 3]
    assert told(value_links(spark.createDataFrame(rows, DDL), shortest=3)) == sorted(longer, key=str)


def test_no_messages(spark):
    assert value_links(spark.createDataFrame([], DDL)).count() == 0
