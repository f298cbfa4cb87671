"""Endpoints and the shapes of their bodies, found from traces.

A path becomes a template by putting ``{}`` for every segment that takes many
values at its place. Bodies are reduced to the shape of their JSON, then to
counts by exact path, before anything is shuffled or joined, so neither a busy
endpoint nor a large body crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.session import durable

#: A segment that takes more values than this at one place of a host's paths of one length is a parameter.
MOST_VALUES = 20
NOT_JSON = "not JSON"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
ENDPOINT = ["method", "host", "template", "body"]


def host_of(url: Column) -> Column:
    """The host in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(url, _ABSOLUTE, 1))


def path_of(url: Column) -> Column:
    """The path without query and fragment."""
    return F.when(url.rlike(_ABSOLUTE), F.regexp_extract(url, _ABSOLUTE, 2)).otherwise(F.regexp_extract(url, r"^[^?#]*", 0))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def path_templates(traces: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """``host, path, template`` for every host and path among ``traces``.

    Values are counted exactly, for each host, number of segments and place.
    Rows without a URL have no path and are passed over.
    """
    seen = traces.where(F.col("url").isNotNull()).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    paths = durable(seen.withColumns({"segments": _segments(F.col("path")), "size": F.size(_segments(F.col("path")))}), "paths")
    values = paths.select("host", "size", F.posexplode("segments").alias("place", "value")).distinct()
    many = values.groupBy("host", "size", "place").count().where(F.col("count") > most)
    parameters = many.groupBy("host", "size").agg(F.collect_list("place").alias("places"))
    told = F.transform("segments", lambda s, at: F.when(F.array_contains("places", at), "{}").otherwise(s))
    template = F.concat(F.lit("/"), F.array_join(told, "/"))
    return paths.join(parameters, ["host", "size"], "left").select("host", "path", template.alias("template"))


def _shapes(traces: DataFrame, most: int) -> DataFrame:
    """Counts by endpoint, exact path, side, shape and names."""
    text = F.col("content").cast("string")
    readable = F.when(F.is_valid_utf8(text), text)
    shape = F.schema_of_variant(F.try_parse_json(readable))
    sides = F.inline(F.array(*[F.struct(F.lit(side).alias("body"), F.col(f"{side}_body").alias("content")) for side in ("request", "response")]))
    bodies = traces.where(F.col("url").isNotNull()).select("method", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), sides)
    told = bodies.select(
        "method", "host", "path", "body",
        F.when(F.octet_length("content") > 0, F.coalesce(shape, F.lit(NOT_JSON))).alias("body_schema"),
        F.when(shape.startswith("OBJECT"), F.array_sort(F.json_object_keys(readable))).alias("names"),
    )
    counted = durable(told.groupBy("method", "host", "path", "body", "body_schema", "names").agg(F.count(F.lit(1)).alias("n")), "shapes")
    return counted.join(path_templates(traces, most), ["host", "path"])


def endpoint_schemas(traces: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """``method, host, template, body, body_schema, n``: how many bodies of each shape an endpoint has.

    ``body`` is request or response; ``body_schema`` names the types of a whole
    JSON body at every depth, is null for bodies that are absent or empty, and
    ``not JSON`` for others, among them such with a name twice in one object.
    """
    return _shapes(traces, most).groupBy(*ENDPOINT, "body_schema").agg(F.sum("n").alias("n"))


def endpoint_fields(traces: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """``method, host, template, body, field, n, required``: outermost names of an endpoint's JSON objects.

    ``n`` objects have the name; it is ``required`` where all of them do.
    """
    shapes = durable(_shapes(traces, most).where(F.col("names").isNotNull()), "objects")
    objects = shapes.groupBy(*ENDPOINT).agg(F.sum("n").alias("objects"))
    fields = shapes.select(*ENDPOINT, "n", F.explode("names").alias("field")).groupBy(*ENDPOINT, "field").agg(F.sum("n").alias("n"))
    same = [fields[c].eqNullSafe(objects[c]) for c in ENDPOINT]
    return fields.join(objects, same).select(*[fields[c] for c in ENDPOINT], "field", "n", (F.col("n") == F.col("objects")).alias("required"))
