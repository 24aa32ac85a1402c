"""Live traffic: which requests are looked at, which answers are accepted and why others are not.

Everything is an expression over one row, so it says the same of a batch and of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import coerce, urls

# Hosts, operations in lower case by what they are for, and names of nodes that an answer may hold.
HOSTS = ["x.com", "twitter.com"]
CREATE = ["createtweet", "createnotetweet"]
DELETE = ["deletetweet"]
TIMELINE = ["useroriginalstimeline"]
REPLIES = ["userrepliestimeline"]
DETAIL = ["tweetresultbyrestid"]
CONNECTIONS = ["following", "followers"]
PROFILE = ["userbyscreenname", "userbyrestid"]
CREATED_NODES = ["create_tweet", "notetweet_create", "create_note_tweet", "CreateTweet"]


def selected(rows: DataFrame, replies: bool = False, connections: bool = False, url: str = "url", method: str = "method", status: str = "status") -> DataFrame:
    """rows with query_id, operation, kind, list and owner_id of the requests that are looked at, answered by 2xx.

    kind is create, delete, timeline, replies, detail, connections or profile. Writes must be POST,
    reads GET; replies and connections only if asked for. list and owner_id (out of the request's
    variables, null if it does not say) are given for connections. Other hosts, addresses without
    a query id and an operation, and null statuses go.
    """
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    at = F.array_position(parts, "graphql")
    name = lambda n: F.when(at > 0, F.get(parts, (at + n - 1).cast("int")))
    operation, verb = F.lower(name(2)), F.upper(F.col(method))
    reads = F.when(operation.isin(TIMELINE), "timeline").when(operation.isin(DETAIL), "detail").when(operation.isin(PROFILE), "profile")
    if replies:
        reads = reads.when(operation.isin(REPLIES), "replies")
    if connections:
        reads = reads.when(operation.isin(CONNECTIONS), "connections")
    writes = F.when(operation.isin(CREATE), "create").when(operation.isin(DELETE), "delete")
    web = F.lower(F.try_parse_url(F.col(url), F.lit("PROTOCOL"))).isin("http", "https") & urls.on_hosts(F.col(url), HOSTS)
    kind = F.when(web, F.when(verb == "GET", reads).when(verb == "POST", writes))
    variables = F.try_url_decode(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit("variables")))
    owner = coerce.record_id(F.get_json_object(variables, "$.userId"))
    listed = F.col("kind") == "connections"
    return rows.where((F.col(status) >= 200) & (F.col(status) < 300)).withColumns({"query_id": name(1), "operation": name(2), "kind": kind}).where("kind is not null").withColumns(
        {"list": F.when(listed, F.lower("operation")), "owner_id": F.when(listed, owner)}
    )


def _object(text: Column) -> Column:
    return F.when(text.startswith("{"), text)


def candidates(body: Column) -> Column:
    """The nodes of an answer that may be the post it made, as JSON texts in order of preference; what is no object goes."""
    at = lambda of, path: _object(F.get_json_object(of, path))
    data = at(body, "$.data")
    created = F.coalesce(*[at(data, f"$.{n}") for n in CREATED_NODES])
    primary = at(created, "$.tweet_results.result")
    return F.array_compact(F.array(
        primary, at(primary, "$.tweet_results.result"), at(primary, "$.tweet"), at(primary, "$.result"), at(created, "$.tweet_result.result"),
        at(data, "$.tweet_results.result"), at(data, "$.tweet_result.result"), at(created, "$.result"), created,
    ))


def node_id(node: Column) -> Column:
    return coerce.record_id(F.coalesce(F.get_json_object(node, "$.rest_id"), F.get_json_object(node, "$.legacy.id_str")))


def _said(errors: Column) -> Column:
    """What a node of errors says; null if it is none (absent, null or empty)."""
    listed = F.from_json(F.when(errors.startswith("["), errors), "array<string>")
    first = F.get(listed, F.lit(0))
    message = F.coalesce(F.nullif(F.get_json_object(first, "$.message"), F.lit("")), F.lit("no message"))
    code = F.get_json_object(first, "$.code").try_cast("bigint")
    entry = F.when(_object(first).isNull(), "present (non-object entry)").otherwise(F.substring(F.concat(
        message, F.coalesce(F.concat(F.lit(" [code "), code.cast("string"), F.lit("]")), F.lit("")),
        F.when(F.size(listed) > 1, F.concat(F.lit(" (+"), (F.size(listed) - 1).cast("string"), F.lit(" more)"))).otherwise(""),
    ), 1, 200))
    return F.when(F.size(listed) > 0, entry).when(errors.startswith("{") & (F.json_object_keys(errors).isNotNull()) & (F.size(F.json_object_keys(errors)) > 0), "present (unstructured)")


def refusal(body: Column) -> Column:
    """Why the answer to a write is not taken as a post; null if it is.

    Errors count even beside a sound result, of which the reason then speaks. Without errors there
    must be data with a candidate.
    """
    data = _object(F.get_json_object(body, "$.data"))
    created = F.coalesce(*[_object(F.get_json_object(data, f"$.{n}")) for n in CREATED_NODES])
    told = F.coalesce(_said(F.get_json_object(body, "$.errors")), _said(F.get_json_object(created, "$.errors")))
    found = candidates(body)
    beside = F.when(F.exists(found, lambda n: node_id(n).isNotNull()), "; NOTE a valid tweet result was also present").otherwise("")
    keys = F.array_join(F.slice(F.json_object_keys(data), 1, 12), ",")
    return (
        F.when(F.coalesce(~F.trim(body).startswith("{"), F.lit(True)) | F.try_parse_json(body).isNull(), "response body is not an object")
        .when(told.isNotNull(), F.concat(F.lit("graphql errors: "), told, beside)).when(data.isNull(), "no data node")
        .when(F.size(found) == 0, F.concat(F.lit("no tweet result candidate (data keys: "), F.when(keys == "", "(empty object)").otherwise(keys), F.lit(")")))
    )


def answered(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows of selected() that are writes of posts, with refusal and post_id: the id of the first candidate that has one."""
    ids = F.filter(F.transform(candidates(F.col(body)), node_id), lambda i: i.isNotNull())
    made = rows.where("kind = 'create'").withColumn("refusal", refusal(F.col(body)))
    return made.withColumn("post_id", F.when(F.col("refusal").isNull(), F.get(ids, F.lit(0))))
