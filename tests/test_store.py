"""JSON store folders, sinks, service, command line, streams."""

import io
import json

import pytest
from pyspark.sql import functions as F

from mangrove import cli
from mangrove.errors import FormatError, MarkdownIntegrityError, MarkdownMissingError, ValidationError
from mangrove.service import Service
from mangrove.sources import json_store, sinks
from mangrove.streaming.watch import json_stream, stream_query, windowed_counts


@pytest.fixture
def root(tmp_path):
    for i, status in enumerate(("open", "closed", "open"), 1):
        sinks.put(str(tmp_path), "task", str(i), {"type": "task", "id": str(i), "status": status, "n": i})
    sinks.put(str(tmp_path), "note", "1", {"type": "note", "id": "1", "status": "open"})
    (tmp_path / "_meta").mkdir()
    (tmp_path / "_meta" / "x.json").write_text("{")
    return str(tmp_path)


def test_read(spark, root):
    assert json_store.list_types(root) == ["note", "task"] and json_store.list_ids(root, "task") == ["1", "2", "3"]
    found = json_store.catalog(spark, root).query({"filter": {"status": "open"}}, ordered=True)
    assert [(r.type, r.id) for r in found.collect()] == [("note", "1"), ("task", "1"), ("task", "3")]
    assert json_store.read_documents(spark, root + "/none").count() == 0


def test_remote_root(spark, root):
    remote = f"file://{root}"
    assert json_store.list_types(remote) == ["note", "task"] and json_store.list_ids(remote, "task") == ["1", "2", "3"]
    assert json_store.catalog(spark, remote).query({"filter": {"status": "open"}}).count() == 3 and json_store.list_files(remote + "/none") == []


def test_malformed(spark, root, tmp_path):
    (tmp_path / "task" / "9.json").write_text("{oops")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error
        json_store.collection(spark, root, "task").df.collect()
    assert json_store.collection(spark, root, "task", malformed="drop").count() == 3
    kept = json_store.read_documents(spark, root, ["task"], malformed="keep")
    assert [r.id for r in kept.where("error IS NOT NULL").collect()] == ["9"]
    (tmp_path / "task" / "9.json").write_text('{"type":"task","id":"8"}')
    with pytest.raises(Exception):  # noqa: B017
        json_store.collection(spark, root, "task").df.collect()


def test_put_and_remove(root, tmp_path):
    doc = {"type": "task", "id": "1", "status": "open", "n": 1}
    assert not sinks.put(root, "task", "1", doc) and sinks.put(root, "task", "1", {**doc, "n": 2})
    assert (tmp_path / "task" / "1.json").read_text() == '{\n  "id": "1",\n  "n": 2,\n  "status": "open",\n  "type": "task"\n}\n'
    assert sinks.remove(root, "task", "1") and not sinks.remove(root, "task", "1")
    for type_, id_, bad in (("task", "1", {"type": "x", "id": "1"}), ("task", "../x", doc), ("task", "1", [])):
        with pytest.raises(ValidationError):
            sinks.put(root, type_, id_, bad)
    assert not list(tmp_path.rglob(".*.json*"))


def test_format(spark, root, tmp_path):
    (tmp_path / "task" / "1.json").write_text('{"type":"task","id":"1"}')
    assert sinks.format_store(spark, root, dry_run=True)["count"] == 1 and sinks.format_store(spark, root)["count"] == 1
    assert sinks.format_store(spark, root) == {"count": 0, "errors": []}
    (tmp_path / "task" / "2.json").write_text("{")
    assert len(sinks.format_store(spark, root, "task")["errors"]) == 1
    with pytest.raises(FormatError):
        sinks.format_store(spark, root, fail_fast=True)


def test_markdown(spark, root, tmp_path):
    sinks.put_with_markdown(root, "city", "rome", {"type": "city", "id": "rome"}, {"body": "# Rome", "more": "x"}, integrity=True)
    assert json_store.read_markdown(spark, root, "city", "rome") == {"body": "# Rome", "more": "x"}
    sinks.write_markdown(root, "city", "rome", "body", "# Roma")
    assert json_store.read_markdown(spark, root, "city", "rome", "body") == {"body": "# Roma"} and json_store.list_ids(root, "city") == []
    (tmp_path / "city" / "rome" / "body.md").write_text("changed")
    with pytest.raises(MarkdownIntegrityError):
        json_store.read_markdown(spark, root, "city", "rome")
    (tmp_path / "city" / "rome" / "body.md").unlink()
    with pytest.raises(MarkdownMissingError):
        json_store.read_markdown(spark, root, "city", "rome")


def test_export_and_table(spark, root, tmp_path):
    docs = json_store.read_documents(spark, root)
    out = str(tmp_path / "_out")
    assert sinks.export_documents(docs, out) == 4 and json_store.list_types(out) == ["note", "task"]
    sinks.write_table(docs, out + "/t")
    sinks.write_table(docs.where("type = 'note'").withColumn("id", F.lit("new")), out + "/t")
    rows = spark.read.parquet(out + "/t")
    assert sorted((r.type, r.id) for r in rows.collect()) == [("note", "new"), ("task", "1"), ("task", "2"), ("task", "3")]


def test_service(spark, root):
    service = Service(spark, root, seconds=dict.fromkeys(("query", "ensure_index", "put_doc", "get_doc"), 60))
    call = lambda tool, **a: service.call(tool, a)
    value = lambda r: r["content"][1]["json"]
    assert value(call("get_doc", type="task", id="1"))["doc"]["status"] == "open" and value(call("get_doc", type="task", id="9")) == {"doc": None}
    assert value(call("list_ids", type="task")) == {"ids": ["1", "2", "3"], "count": 3}
    assert [d["id"] for d in value(call("query", type="task", filter={"status": "open"}, sort={"n": -1}))["results"]] == ["3", "1"]
    assert value(call("put_doc", type="task", id="4", doc={"type": "task", "id": "4"})) == {"ok": True} and value(call("rm_doc", type="task", id="4")) == {"ok": True}
    assert value(call("ensure_index", type="task", field="status")) == {"ok": True}
    for bad in (("query", {"filter": {}, "limit": 1001}), ("query", {"filter": {}, "projection": {"a": 2}}), ("query", {"filter": {"a": {"$x": 1}}}), ("get_doc", {"type": "T", "id": "1"}), ("nope", {}), ("put_doc", {"type": "task", "id": "1", "doc": {"type": "task", "id": "1", "x": "y" * (1 << 20)}})):
        assert service.call(*bad)["isError"], bad
    assert Service(spark, root, read_only=True).call("rm_doc", {"type": "task", "id": "1"})["isError"] and Service(spark, root, enabled=False).names() == []
    assert service.metrics.calls["get_doc", "ok"] == 2 and service.metrics.percentile("get_doc", 0.95) > 0
    slow = Service(spark, root, seconds={"list_ids": 0.0})
    slow.tools["list_ids"] = lambda a: __import__("time").sleep(1) or ("", {})
    assert "TIMEOUT" in slow.call("list_ids", {"type": "task"})["content"][0]["text"]


def test_cli(spark, root, capsys, monkeypatch):
    def run(*argv, stdin=None):
        if stdin is not None:
            monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
        code = cli.main(["--root", root, *argv])
        return code, capsys.readouterr().out

    assert run("put", "user", "a", "--data", '{"name":"A"}') == (0, "Stored user/a\n")
    assert run("get", "user", "a", "--raw")[1] == '{"id":"a","name":"A","type":"user"}\n'
    assert run("get", "user", "zz")[0] == 2 and run("get", "user", "../x")[0] == 1 and run("nonsense")[0] == 1
    assert run("put", "user", "b", stdin='{"name":"B"}')[0] == 0 and run("put", "user", "b", stdin="")[0] == 1
    assert run("ls", "user", "--json")[1] == '["a", "b"]\n' and run("ls", "user", "--limit", "0")[1] == ""
    assert [d["id"] for d in json.loads(run("query", "--type", "task", "--limit", "1", "--data", '{"filter":{"status":"open"}}')[1])] == ["1"]
    assert run("query", "--data", '{"filter":{}}', "--limit", "0")[0] == 1 and run("query", "--data", "[]")[0] == 1
    assert run("format", "--all", "--check")[0] == 0 and run("format")[0] == 1
    assert json.loads(run("stats", "--json", "--type", "task")[1])["count"] == 3 and "By Type:" in run("stats", "--detailed")[1]
    assert json.loads(run("reindex", "task", "status", "--json")[1])["total_indexes"] == 1
    assert run("rm", "user", "a", stdin="")[0] == 1 and run("rm", "user", "a", "--force")[0] == 0
    schema = json.dumps({"$id": "schema/user@1", "required": ["age"]})
    assert run("schema", "add", "--data", schema)[0] == 0 and run("schema", "list", "--json")[1] == '["schema/user@1"]\n'
    run("put", "user", "c", "--data", '{"schemaRef":"schema/user@1"}')
    code, out = run("schema", "validate", "--json", "--type", "user")
    assert code == 1 and json.loads(out) == {"total": 2, "valid": 0, "warnings": 1, "errors": 1}
    monkeypatch.setenv("MANGROVE_ENABLE_STATS", "0")
    assert run("stats")[0] == 3


def test_streams(spark, root, tmp_path):
    from mangrove.operators.collections import Collection

    found = stream_query(Collection("task", json_stream(spark, f"{root}/task")), {"status": "open"}, {"id": 1, "n": 1})
    q = found.writeStream.format("memory").queryName("open_tasks").option("checkpointLocation", str(tmp_path / "_c1")).start()
    try:
        q.processAllAvailable()
        sinks.put(root, "task", "7", {"type": "task", "id": "7", "status": "open", "n": 7})
        q.processAllAvailable()
        assert sorted(r.id for r in spark.sql("SELECT id FROM open_tasks").collect()) == ["1", "3", "7"]
    finally:
        q.stop()
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*")
    q = windowed_counts(events, "ts", "1 day", ["event_type"], "1 hour").writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "_c2")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    finally:
        q.stop()
