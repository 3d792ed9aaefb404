import json
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import documents as doc
from lodestar.functions import scalar
from lodestar.functions.patterns import glob_to_regex
from lodestar.operators import analysis, catalog, keyed, lineage, relations
from lodestar.plans.evaluate import Engine
from lodestar.sources import connectors, external, files, sinks
from lodestar.streaming import events, ingest


# -- documents
@pytest.mark.parametrize(
    "before, ops, after",
    [
        ({"a": [1, 2]}, [{"op": "add", "path": "/a/-", "value": 3}], {"a": [1, 2, 3]}),
        ({"a": {"b~/c": 1}}, [{"op": "remove", "path": "/a/b~0~1c"}], {"a": {}}),
        ({"a": 1}, [{"op": "copy", "from": "/a", "path": "/b"}, {"op": "test", "path": "/b", "value": 1.0}], {"a": 1, "b": 1}),
        ({}, [{"op": "create", "path": "/x/y/z", "value": 1}], {"x": {"y": {"z": 1}}}),
        ({"a": [1, 2, 3]}, [{"op": "move", "from": "/a/0", "path": "/a/2"}], {"a": [2, 3, 1]}),
        ({"a": 1}, [{"op": "replace", "path": "", "value": [0]}], [0]),
    ],
)
def test_patch(before, ops, after):
    assert doc.patch(before, ops) == after


@pytest.mark.parametrize("ops", [[{"op": "remove", "path": "/x"}], [{"op": "replace", "path": "/x", "value": 1}], [{"op": "add", "path": "/x/y", "value": 1}], [{"op": "test", "path": "/a", "value": 2}], [{"op": "add", "path": "/l/5", "value": 2}], [{"op": "what", "path": "/a"}], [{"op": "add", "path": "a", "value": 2}]])
def test_bad_patches_change_nothing(ops):
    before = {"a": 1, "l": [0]}
    with pytest.raises(doc.PointerError):
        doc.patch(before, [{"op": "add", "path": "/new", "value": 1}, *ops])
    assert before == {"a": 1, "l": [0]}


def test_diff_and_merge():
    a, b = {"x": 1, "y": [1, 2, 3], "z": {"q": 1}}, {"y": [1, 5], "z": {"q": 1, "r": None}, "w": 0}
    assert doc.patch(a, list(doc.diff(a, b))) == b
    assert doc.merge({"a": {"b": 1}}, {"a": {"c": 2}}) == ({"a": {"b": 1, "c": 2}}, True)
    assert doc.merge({"a": 1}, {"a": 2})[1] is False
    assert doc.merge_right({"a": {"b": 1, "c": 1}}, {"a": {"b": 2}}) == {"a": {"b": 2, "c": 1}} and doc.merge_left({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3}


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]}}', '{"a":{"c":3}}'), ("bad", "{}"), (None, "{}")], "x string, y string")
    rows = df.select(doc.pointer_get(F.col("x"), "/a/b/1").alias("p"), doc.json_merge(F.col("x"), F.col("y")).alias("m"), doc.json_patch(F.col("x"), [{"op": "remove", "path": "/a/b/0"}]).alias("q"), doc.json_diff(F.col("x"), F.col("y")).alias("d")).collect()
    assert rows[0].p == "2" and rows[0].m == '{"a":{"b":[1,2],"c":3}}' and rows[0].q == '{"a":{"b":[2]}}' and len(json.loads(rows[0].d)) == 2
    assert rows[1].m is None and rows[2].q is None


# -- scalar functions
def test_scalar_functions(spark):
    one = spark.range(1)
    a = F.array(*[F.lit(i) for i in (1, 2, 3)])
    v = lambda c: one.select(c.alias("v")).first().v
    assert [v(scalar.array_slice(a, *x)) for x in ((-5, 2), (2, 1), (1, 99))] == [[1, 2], [], [2, 3]]
    assert v(scalar.numbers_range(F.lit(3), F.lit(1))) == [3, 2, 1] and v(scalar.numbers_range_step(F.lit(1), F.lit(8), 3)) == [1, 4, 7]
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert v(scalar.object_union(m, F.create_map(F.lit("b"), F.lit(None).cast("int")))) == {"a": 1, "b": None}
    assert v(scalar.semver_compare(F.lit("1.2.10"), F.lit("1.2.9"))) == 1 and v(scalar.semver_compare(F.lit("1.0.0-rc1"), F.lit("1.0.0"))) == -1
    assert v(scalar.units_parse_bytes(F.lit("10Ki"))) == 10240 and v(scalar.units_parse_bytes(F.lit("2MB"))) == 2_000_000
    assert v(scalar.cidr_contains("10.0.0.0/8", F.lit("10.9.8.7"))) and not v(scalar.cidr_contains("10.0.0.0/8", F.lit("11.0.0.1")))
    assert v(scalar.type_name(scalar.parse_json(F.lit("[1]")))) == "array" and v(scalar.parse_json(F.lit("{x")).isNull())
    with pytest.raises(ValueError):
        scalar.numbers_range_step(F.lit(1), F.lit(2), 0)


@pytest.mark.parametrize("pattern, delimiters, yes, no", [("*.com", ["."], "a.com", "a.b.com"), ("**.com", ["."], "a.b.com", "a.org"), ("{a,b}?", None, "bz", "cz"), ("[!a]x", None, "bx", "ax"), ("*", [], "ab", "a.b"), ("a+b", None, "a+b", "aab")])
def test_globs(spark, pattern, delimiters, yes, no):
    import re

    assert re.fullmatch(glob_to_regex(pattern, delimiters), yes) and not re.fullmatch(glob_to_regex(pattern, delimiters), no)
    assert spark.createDataFrame([(yes,), (no,)], "s string").filter(scalar.glob_match(pattern, delimiters, "s")).count() == 1


# -- keyed tables, catalog, analysis
def test_keyed(spark):
    prev = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    feed = spark.createDataFrame([(1, 1, "x", False), (1, 2, "y", False), (2, 3, None, True), (3, 4, "n", None)], "id int, seq int, v string, gone boolean")
    assert sorted(map(tuple, keyed.apply_changes(prev, feed, ["id"], ["seq"], F.col("gone")).collect())) == [(1, "y"), (3, "n")]
    diff = keyed.diff_tables(prev, prev.filter("id = 1").unionByName(spark.createDataFrame([(9, None)], "id int, v string")), ["id"])
    assert sorted((r.id, r.change) for r in diff.collect()) == [(2, "removed"), (9, "added")]
    assert keyed.set_conflicts(feed, ["id"], "v").first().values == ["x", "y"]


def test_catalog(spark):
    c = catalog.Catalog()
    seen = []
    c.on_change(lambda p, f: seen.append(p))
    c.mount("data.a.b", spark.range(3), owner="conn")
    with pytest.raises(catalog.CatalogError):
        c.mount("a", spark.range(1))
    with pytest.raises(catalog.CatalogError):
        c.mount("a.b", spark.range(1))
    with pytest.raises(catalog.CatalogError):
        c.bulk([("create", "x", spark.range(1)), ("delete", "nope")])
    assert c.paths() == ["a.b"]
    got = c.bulk([("create", "x", spark.range(5))], ["x", "y"])
    assert got["reads"][0]["result"].count() == 5 and "error" in got["reads"][1] and seen == ["a.b", "x"]
    assert c.read("a.b", [2], ["id"]).count() == 1
    now = [0.0]
    memo = catalog.Memo(10, clock=lambda: now[0])
    assert [memo.get({"q": 1}, lambda: now[0]) for _ in range(2)] == [0.0, 0.0] and memo.hits == 1
    now[0] = 11
    assert memo.get({"q": 1}, lambda: now[0]) == 11


def test_batch_and_impact(spark):
    e = Engine(["package b\np[x] := y if { some i, x in input.x; y := input.y[i] }"])
    got = analysis.batch_query(e, "data.b.p", {"ok": {"x": [1, 1, 3], "y": [1, 1, 1]}, "bad": {"y": [1, 2, 1]}}, {"x": [1, 1, 3]})
    assert got["status"] == 207 and "error" in got["responses"]["bad"] and got["responses"]["ok"]["result"] == {"1": 1, "3": 1}
    assert analysis.batch_query(e, "data.b.p", {})["status"] == 200
    df = spark.createDataFrame([(1, None), (2, 5), (3, 20)], "id int, x int")
    rows = analysis.impact(df, lambda d: F.col("x") > 1, lambda d: F.col("x") > 10)
    assert [r.id for r in rows.collect()] == [2]
    assert analysis.sampled(spark.range(10_000), 0.25, "id").count() == pytest.approx(2500, rel=0.1)
    with pytest.raises(AssertionError):
        analysis.fail_if_any(rows)


def test_relations(spark):
    rows = [("doc", "viewer", None, "team", "member"), ("team", "member", "ann", None, None), ("team", "member", None, "org", "member"), ("org", "member", "bob", None, None), ("org", "member", None, "team", "member")]
    tuples = spark.createDataFrame(rows, "object string, relation string, user string, userset_object string, userset_relation string")
    viewers = lambda d: sorted(r.user for r in relations.expand(tuples, d).filter("object = 'doc'").collect())
    assert viewers(1) == ["ann"] and viewers(2) == ["ann", "bob"] == viewers(None)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "parent int, child int")
    assert sorted(r.node for r in relations.reachable(edges, spark.createDataFrame([(1,)], "id int")).collect()) == [1, 2, 3]
    owners, parents = spark.createDataFrame([("root", "o")], "object string, user string"), spark.createDataFrame([("f1", "root"), ("f2", "f1")], "object string, parent string")
    assert {r.object for r in relations.inherit(owners, parents, 1).collect()} == {"root", "f1"}


# -- external stores
def test_sql_send(spark):
    spark.range(3).createOrReplaceTempView("numbers_view")
    request = {"driver": "spark", "query": "SELECT id FROM numbers_view WHERE id >= ?", "args": [1]}
    assert external.sql_send(spark, request) == {"rows": [[1], [2]]}
    assert external.sql_send(spark, {**request, "row_object": True, "cache": True}) == {"rows": [{"id": 1}, {"id": 2}]}
    assert "error" in external.sql_send(spark, {"driver": "spark", "query": "SELECT nope", "raise_error": False})
    with pytest.raises(external.RequestError):
        external.sql_send(spark, {**request, "what": 1})


def test_sql_args():
    put = external.with_args
    assert put("SELECT '?', \"$1\" -- ? $2\nFROM t /* $1 */ WHERE a = $2 AND b = $1 AND c = $1", [1, "o'k"], "postgres") == "SELECT '?', \"$1\" -- ? $2\nFROM t /* $1 */ WHERE a = E'o\\'k' AND b = 1 AND c = 1"
    assert put("a = ? OR b = ?", ["\\' OR 1=1 -- ", None], "mysql") == "a = '\\\\\\' OR 1=1 -- ' OR b = NULL"
    assert put("a = ? OR b = ?", [True, "x'y"], "sqlserver") == "a = 1 OR b = N'x''y'"
    for query, args in (("a = ?", [1, 2]), ("a = ? AND b = ?", [1]), ("a = $3", [1])):
        with pytest.raises(external.RequestError):
            put(query, args, "postgres")


def test_results_for_the_driver_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(external, "MAX_ROWS", 2)
    spark.range(3).createOrReplaceTempView("three")
    with pytest.raises(external.RequestError):
        external.sql_send(spark, {"driver": "spark", "query": "SELECT id FROM three"})


def test_document_stores(spark):
    df = spark.createDataFrame([("x", 1, "s1"), ("x", 2, "s2"), ("y", 3, None)], "p string, s int, v string")
    assert external.dynamodb_get(df, {"key": {"p": {"S": "x"}, "s": {"N": "2"}}}) == {"row": {"p": "x", "s": 2, "v": "s2"}}
    query = {"key_condition_expression": "#p = :p AND s > :s", "expression_attribute_names": {"#p": "p"}, "expression_attribute_values": {":p": {"S": "x"}, ":s": {"N": "0"}}, "scan_index_forward": False, "limit": 1}
    assert external.dynamodb_query(df, query, "s")["rows"] == [{"p": "x", "s": 2, "v": "s2"}]
    assert external.dynamodb_query(df, {**query, "limit": 5, "select": "COUNT"}, "s") == {"count": 2}
    assert external.mongodb_find(df, {"filter": {"$nor": [{"p": "x"}]}})["results"] == [{"p": "y", "s": 3, "v": None}]
    assert external.mongodb_find_one(df, {"filter": {"v": {"$exists": False}}, "options": {"projection": {"s": 1}}}) == {"results": {"s": 3}}
    with pytest.raises(external.RequestError):
        external.mongodb_find(df, {"filter": {"p": {"$where": "x"}}})
    assert external.vault_send(lambda mount, path: {"k": mount + path}, {"kv2_get": {"mount_path": "m", "path": "p"}}) == {"data": {"k": "mp"}}
    assert external.neo4j_query(lambda q, p: df.limit(1).select("p"), {"query": "MATCH"})["results"] == [{"p": "x"}]


def test_redis(spark):
    row = spark.range(1).select(F.lit("hello").alias("s"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("l"), F.create_map(F.lit("f"), F.lit("v")).alias("h"), F.array(F.lit("c"), F.lit("d")).alias("t"))
    store = {k: F.col(k) for k in "slht"}
    ask = lambda c, *a: external.redis_query(store, row, {"command": c, "args": list(a)})["results"]
    assert (ask("get", "s"), ask("strlen", "s"), ask("getrange", "s", 1, 3)) == ("hello", 5, "ell")
    assert [ask("getrange", "s", a, b) for a, b in ((-3, -1), (0, -2), (2, 99), (-99, 1), (3, 1), (9, 9))] == ["llo", "hell", "llo", "he", "", ""]
    assert (ask("lindex", "l", -1), ask("lrange", "l", 1, -1), ask("lpos", "l", "c"), ask("llen", "l")) == ("c", ["b", "c"], 2, 3)
    assert (ask("hget", "h", "f"), ask("hexists", "h", "q"), ask("hmget", "h", "f", "q")) == ("v", False, ["v", None])
    assert (ask("sinter", "l", "t"), ask("sunion", "l", "t"), ask("sdiff", "l", "t"), ask("smismember", "t", "c", "z")) == (["c"], ["a", "b", "c", "d"], ["a", "b"], [True, False])
    with pytest.raises(external.RequestError):
        ask("set", "s")


# -- files, connectors, sinks
def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"x": 1}')
    (tmp_path / "d" / "b.xml").write_text('<r k="v"><i>1</i><i>2</i></r>')
    (tmp_path / "d" / "c.txt").write_text("no")
    (tmp_path / "d" / "bad.json").write_text("{")
    df = files.read_documents(spark, str(tmp_path / "d"))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in df.collect()}
    assert json.loads(rows["a.json"].document) == {"x": 1} and json.loads(rows["b.xml"].document) == {"r": {"-k": "v", "i": ["1", "2"]}}
    assert rows["bad.json"].document is None and rows["bad.json"].error and "c.txt" not in rows
    assert files.document_tree([("p/a.json", 1), ("p/q/b.json", 2)], "p") == {"a.json": 1, "q": {"b.json": 2}}
    before = df.select("path", "sha256").cache()
    before.count()
    (tmp_path / "d" / "a.json").write_text('{"x": 2}')
    assert [r.change for r in files.changed_files(files.read_documents(spark, str(tmp_path / "d")), before).collect()] == ["changed"]


def test_connectors(spark):
    answers = iter([(200, {"ETag": "1"}, '{"a": 1}'), (304, {}, ""), (500, {}, "")])
    asked = []
    c = connectors.Connector("web", "data.web", connectors.http(lambda h: asked.append(h) or next(answers)), interval="5m")
    cat = catalog.Catalog()
    frame = lambda s, d: s.createDataFrame([(json.dumps(d),)], "doc string")
    assert c.mount(spark, cat, frame) and not c.mount(spark, cat, frame) and asked[1] == {"If-None-Match": "1"}
    assert not c.refresh() and c.status == "ERROR" and c.state == {"a": 1} and c.seconds == 300
    assert connectors.interval_seconds("10ms") == 1.0 and connectors.interval_seconds(None) == 30
    assert connectors.mongodb_documents([{"_id": "a", "v": 1}, {"_id": 5, "v": 2}, {"v": 3}]) == {"a": {"v": 1}, "5": {"v": 2}}
    assert connectors.ldap_documents([("cn=x,dc=a,dc=b", {"mail": ["m"]})]) == [{"dn": {"_raw": "cn=x,dc=a,dc=b", "cn": ["x"], "dc": ["a", "b"]}, "mail": ["m"]}]
    assert connectors.git_ref({"refs/heads/main": "1", "refs/heads/x": "2"}, branch="x") == "2"
    poll = connectors.objects(lambda: ["a.json", "b/c.json", "z.bin"], lambda k: '{"k":"%s"}' % k)
    assert poll() == {"a.json": {"k": "a.json"}, "b": {"c.json": {"k": "b/c.json"}}} and poll() is None


class _Numbers:
    def __init__(self, options):
        self.n = int(options["n"])

    def slices(self):
        return 2

    def rows(self, i):
        return ((x,) for x in range(i, self.n, 2))


def numbers_client(options):
    return _Numbers(options)


def test_client_source(spark):
    spark.dataSource.register(connectors.ClientSource)
    df = spark.read.format("client").option("client", "tests.test_engine:numbers_client").option("schema", "x int").option("n", "5").load()
    assert sorted(r.x for r in df.collect()) == [0, 1, 2, 3, 4]


class _Queue:
    def read(self, after, most):
        ids = range(after, min(after + most, 5))
        return [(str(i), "k", "t", "p", i, json.dumps({"n": i})) for i in ids], max(after, min(after + most, 5))


def queue_client(options):
    return _Queue()


def test_message_stream(spark, tmp_path):
    spark.dataSource.register(connectors.MessageSource)
    stream = spark.readStream.format("messages").option("client", "tests.test_engine:queue_client").option("batch", "3").load()
    q = stream.writeStream.format("memory").queryName("messages_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(100):
        if spark.sql("SELECT * FROM messages_out").count() == 5:
            break
        time.sleep(0.2)
    q.stop()
    assert sorted(r.value for r in spark.sql("SELECT value FROM messages_out").collect()) == [f'{{"n": {i}}}' for i in range(5)]


def test_time_limit(spark):
    assert lineage.limited(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(TimeoutError):
        lineage.limited(spark, 1, lambda: spark.range(10**12).selectExpr("sum(sqrt(id))").collect())
    with pytest.raises(ZeroDivisionError):
        lineage.limited(spark, 60, lambda: 1 / 0)


def test_sinks():
    lines = ["a" * n for n in (3, 3, 10, 1)]
    assert [len(b) for b in sinks.batches(lines, count=2)] == [2, 2] and [len(b) for b in sinks.batches(lines, size=7)] == [2, 1, 1]
    assert sinks.body(["1", "2"], "array") == b"[1,2]" and sinks.body(["1"], "lines") == b"1\n"
    calls = []

    def flaky(d):
        calls.append(d)
        if len(calls) < 3:
            raise OSError

    sinks.with_retry(flaky, sleep=lambda s: None)(b"x")
    assert len(calls) == 3


# -- streams
def _feed(spark, tmp_path, schema):
    (tmp_path / "in").mkdir(exist_ok=True)
    return spark.readStream.schema(schema).json(str(tmp_path / "in"))


def _put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def test_keyed_ingest(spark, tmp_path):
    schema = "id int, seq int, v string, type string"
    state = ingest.StateTable(spark, str(tmp_path / "state"), "id int, v string")
    transform = ingest.change_feed_transform(["id"], ["seq"], F.col("type") == "delete")
    for name, rows in (("1", [{"id": 1, "seq": 1, "v": "a"}, {"id": 1, "seq": 2, "v": "b"}, {"id": 2, "seq": 3, "v": "c"}]), ("2", [{"id": 2, "seq": 4, "type": "delete"}, {"id": 3, "seq": 5, "v": "d"}])):
        _put(tmp_path, name, rows)
        ingest.keyed_ingest(_feed(spark, tmp_path, schema), state, transform, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, state.current().collect())) == [(1, "b"), (3, "d")]
    with pytest.raises(RuntimeError):
        ingest.keyed_ingest(_feed(spark, tmp_path, schema), state, transform, str(tmp_path / "cp"), ready=lambda: False)


def test_per_key_state(spark, tmp_path):
    _put(tmp_path, "1", [{"k": "a"}, {"k": "b"}, {"k": "a"}])
    counted = ingest.per_key_ingest(_feed(spark, tmp_path, "k string"), "k", lambda pdf, old: ((old[0] if old else 0) + len(pdf),), "n long", "k string, n long")
    q = counted.writeStream.format("memory").queryName("per_key").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM per_key").collect())) == [("a", 2), ("b", 1)]


EVENT = {"input": {"user": "u", "list": [1, 2]}, "result": {"ok": True}, "other": 1}


@pytest.mark.parametrize(
    "mask, changed",
    [
        ("/input/user", {"input": {"list": [1, 2]}, "erased": ["/input/user"]}),
        ("/result", {"result": None, "erased": ["/result"]}),
        ("/input/none", {}),
        ("/input/list/9", {}),
        ({"op": "upsert", "path": "/input/list/1", "value": 0}, {"input": {"user": "u", "list": [1, 0]}, "masked": ["/input/list/1"]}),
        ({"op": "upsert", "path": "/input/new", "value": {"a": 1}}, {"input": {"user": "u", "list": [1, 2], "new": {"a": 1}}, "masked": ["/input/new"]}),
        ({"op": "upsert", "path": "/nd_builtin_cache", "value": 1}, {}),
    ],
)
def test_event_masks(mask, changed):
    want = {k: v for k, v in (EVENT | changed).items() if v is not None}
    assert events.mask_event(EVENT, [mask]) == want


def test_bad_masks():
    for m in ({"op": "hash", "path": "/input/a"}, "/labels/id", ""):
        with pytest.raises(events.MaskRuleError):
            events.mask_event(EVENT, [m])


def test_event_pipeline(spark, tmp_path):
    schema = "decision_id string, timestamp timestamp, input struct<user:string,secret:string>, result boolean"
    rows = [{"decision_id": str(i), "timestamp": "2024-05-01T00:00:00Z", "input": {"user": "u", "secret": "s"}, "result": i % 2 == 0} for i in range(4)]
    _put(tmp_path, "1", rows)
    got = []
    sink = sinks.fan_out([(sinks.file_sink(str(tmp_path / "out")), None), (lambda df, i: got.extend(df.collect()), sinks.splunk_envelope())])
    masks = ["/input/secret", {"op": "upsert", "path": "/input/user", "value": "*"}]
    events.deliver(_feed(spark, tmp_path, schema), sink, str(tmp_path / "cp"), drop=~F.col("result"), masks=masks).awaitTermination()
    assert sorted(r.event.decision_id for r in got) == ["0", "2"]
    assert got[0].event.input.asDict() == {"user": "*"} and got[0].event.erased == ["/input/secret"]
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    text = spark.createDataFrame([(json.dumps(EVENT),), ("bad",)], "e string").select(events.mask_json(F.col("e"), ["/input/user"]).alias("m")).collect()
    assert "user" not in json.loads(text[0].m)["input"] and text[1].m is None
