import random

import pytest

from loomdex.cli import Session, add_arguments, choices
from loomdex.operators import lsm, mutate
from loomdex.operators.ids import with_ids
from loomdex.operators.skew import skew_join
from loomdex.sources.store import IndexStore, StoreError
from loomdex.streaming.ingest import apply_batch, ingest


def _docs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, external_id string, title string, content string")


def _live(store):
    return {r["external_id"]: (r["doc_id"], r["content"]) for r in store.documents().collect()}


def test_add_remove_reopen(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/s", "english")
    store.add(_docs(spark, ("a", None, "cats"), ("b", "t", "cats dogs"), ("a", "", "birds"), (None, None, None)), ["at"])
    assert _live(store) == {"b": (2, "cats dogs"), "a": (3, "birds"), "": (4, "")}
    store.remove(_docs(spark, ("b", "", ""), ("zz", "", "")))
    again = IndexStore(spark, f"file://{tmp_path}/s")
    assert again.manifest.language == "english" and sorted(_live(again)) == ["", "a"]
    before = store.index()
    again.add(_docs(spark, ("a", "", "fish")), ["at"])
    assert _live(again)["a"] == (5, "fish")
    assert [r["doc_id"] for r in before.ids("birds").collect()] == [3]
    assert again.index().ids("birds OR cats").count() == 0 and again.index().ids("NOT cats").count() == 2
    with pytest.raises(StoreError):
        store.remove(_docs(spark, ("a", "", "")))  # its version has been published by the other writer
    again.compact()
    again.vacuum()
    assert _live(IndexStore(spark, f"file://{tmp_path}/s"))["a"] == (5, "fish")
    assert again.stats().first()["segments"] == 1
    with pytest.raises(StoreError):
        IndexStore(spark, f"file://{tmp_path}/s", "russian")


def test_history_is_like_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    store, live, next_id = IndexStore(spark, f"file://{tmp_path}/h", level_bytes=1), {}, 1
    for _ in range(4):
        rows = [(rng.choice("abcdef"), "", rng.choice(["cat", "dog", "cat dog"])) for _ in range(rng.randint(1, 5))]
        store.add(_docs(spark, *rows), ["at"])
        for name, _, text in rows:
            live[name] = (next_id, text)
            next_id += 1
        gone = rng.choice("abcdef")
        store.remove(_docs(spark, (gone, "", "")))
        live.pop(gone, None)
    assert _live(store) == live
    assert sorted(r["doc_id"] for r in store.index().ids("cat AND NOT dog").collect()) == sorted(i for i, t in live.values() if t == "cat")
    assert len(store.manifest.segments) < 4  # compaction took place


def _log(spark, *rows):
    return spark.createDataFrame(list(rows), "step long, op string, external_id string, title string, content string")


def test_stream(spark, tmp_path):
    log = _log(spark, (1, "add", "a", "", "cats"), (2, "add", "b", "", "dogs"), (3, "remove", "a", None, None), (4, "flush", None, None, None))
    log.write.parquet(f"{tmp_path}/in")
    store = IndexStore(spark, f"file://{tmp_path}/s")
    ingest(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c").awaitTermination(120)
    assert _live(store) == {"b": (2, "dogs")} and store.manifest.version == 2 and store.manifest.next_doc_id == 3


def test_late_commands_are_as_in_the_replay(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice(["add", "add", "remove"]), rng.choice("abcd"), "", f"text {i}") for i in range(1, 25)]
    late = rows[:]
    rng.shuffle(late)
    store = IndexStore(spark, f"file://{tmp_path}/s")
    for at in range(0, len(late), 8):
        apply_batch(store, _log(spark, *late[at : at + 8]))
    version = store.manifest.version
    apply_batch(store, _log(spark, *late[16:]))  # run again after a failure
    assert store.manifest.version == version
    want = {r["external_id"]: r["content"] for r in mutate.replay(_log(spark, *rows).selectExpr("*", "timestamp'2024-01-01' as arrived_at")).collect()}
    assert {k: v for k, (_, v) in _live(store).items()} == want
    store.compact()
    apply_batch(store, _log(spark, (0, "add", "a", "", "too late"), (99, "add", "z", None, None)))
    assert {k: v for k, (_, v) in _live(store).items()} == {**want, "z": ""}


def test_remove_tells_what_was_there(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/r")
    store.add(_docs(spark, ("a", "", "cats"), ("b", "", "cats")), ["at"])
    told = {r["external_id"]: r["existed"] for r in store.remove(_docs(spark, ("a", "", ""), ("a", "", ""), ("zz", "", ""))).collect()}
    assert told == {"a": True, "zz": False} and sorted(_live(store)) == ["b"]
    index = store.index()
    assert [r["doc_id"] for r in index.ids("cats").collect()] == [2]
    after, told = index.without(_docs(spark, ("b", "", ""), ("q", "", "")))
    assert {r["external_id"]: r["existed"] for r in told.collect()} == {"b": True, "q": False}
    for plan in ("flags", "relational", "scan"):
        assert after.ids("cats", plan).count() == 0 and after.ids("NOT dogs", plan).count() == 0
    assert [r["doc_id"] for r in index.ids("cats").collect()] == [2]


def test_only_negations_read_the_documents(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/p")
    store.add(_docs(spark, ("a", "", "cats"), ("b", "", "dogs")), ["at"])
    store.add(_docs(spark, ("a", "", "birds")), ["at"])
    plan = lambda q: store.index().ids(q)._jdf.queryExecution().optimizedPlan().toString()
    reads = lambda q: plan(q).count("Relation [doc_id") + plan(q).count("external_id")
    assert "external_id" not in plan("cats AND NOT dogs") and plan("cats").count("Relation") == 2 and plan("NOT cats").count("Relation") > 2 and reads("cats") >= 1
    physical = store.index().ids("cats")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,cat)" in physical


def test_two_writers(spark, tmp_path):
    one, two = IndexStore(spark, f"file://{tmp_path}/w"), IndexStore(spark, f"file://{tmp_path}/w")
    one.add(_docs(spark, ("a", "", "cats")), ["at"])
    with pytest.raises(StoreError, match="another writer"):
        two.add(_docs(spark, ("b", "", "dogs")), ["at"])
    assert sorted(_live(IndexStore(spark, f"file://{tmp_path}/w"))) == ["a"]
    assert not [n for n in one.files.names("manifest") if n.endswith(".tmp")]


def test_command_line(spark, tmp_path):
    s = Session(spark, IndexStore(spark, f"file://{tmp_path}/c"))
    run = lambda line: None if (out := s.run(line)) is None else list(out)
    assert run("add doc1 My Title | some cats") == ["Added document 'doc1' (internal ID: 1)"]
    assert run("q cat") == ["Found 1 document(s):", "  [1] My Title", "      some cats"] and run("q dog") == ["No documents found"]
    assert run("search cat dog") == ["Search error: unexpected token at position 1: dog"]
    assert run("search") == ["Usage: search <query>"] and run("  ") == [] and run("exit") is None
    assert run("ls") == ["Documents in index: 1", "  [1] My Title: some cats"]
    assert run("rm nothing") == ["No document 'nothing'"] and run("rm doc1") == ["Removed document 'doc1'"] and run("ls") == ["No documents in index"]
    assert run("bogus")[0].startswith("Unknown command") and run("help")[0] == "Commands:"
    assert run("flush")[0].startswith("Nothing to flush") and run("demo")[0].startswith("Loaded") and run("compact") == ["Index compacted"]
    assert "  document_count: 10" in run("stats") and run("q (cat OR dog) AND NOT summer")[0] == "Found 4 document(s):"
    assert add_arguments("x") is None and add_arguments("x y") == ("x", "", "y") and add_arguments(" x y") == ("", "", "x y")
    quiet = lambda *_: None
    assert choices(iter(["2", "", "English"]), quiet) == ("index_data", "english") and choices(iter(["", ""]), quiet) == (None, None) and choices(iter([]), quiet) == (None, None)


def test_newest(spark):
    rows = [(1, 1, "k", "old", False), (2, 2, "k", "new", False), (3, 1, "k", "late", False), (4, 1, "t", "x", False), (5, 2, "t", None, True), (6, 1, "n", None, None), (7, 1, None, "x", False)]
    seg = spark.createDataFrame([(*r, "extra") for r in rows], "row_id long, segment_seq long, kv_key string, kv_value string, tombstone boolean, r string")
    assert {r["kv_key"]: r["kv_value"] for r in lsm.newest(seg).collect()} == {"k": "new", "n": None}
    assert lsm.point_get(seg, "t").count() == 0 and lsm.range_scan(seg, "k", "n").count() == 1 and lsm.range_scan(seg, "k", None).count() == 2
    assert lsm.newest(seg.where("false")).count() == 0
    assert lsm.over_budget({0: 11, 1: 40, 2: 161}, 10, 4) == [0, 2]


def test_replay(spark):
    rows = [(1, "add", "a", "t", "c", "2024-01-01"), (1, "add", "a", "t", "c", "2024-01-05"), (2, "add", "b", None, None, "2024-01-01"), (3, "remove", "a", None, None, "2024-01-01"), (4, "flush", None, None, None, "2024-01-01"), (5, "add", "b", "x", "y", "2024-01-01"), (6, "remove", "zz", None, None, None), (None, "add", "q", "", "", None)]
    log = spark.createDataFrame(rows, "step long, op string, external_id string, title string, content string, at string").withColumn("arrived_at", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("at"))
    assert [tuple(r) for r in mutate.replay(log).collect()] == [(3, "b", "x", "y")]
    assert mutate.replay(log.where("false")).count() == 0


def test_ids_and_skewed_join(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) as k", "5000 - id as o")
    ids = {r["id"]: r["doc_id"] for r in with_ids(rows, ["o"]).collect()}
    assert all(ids[i] == 5000 - i for i in range(5000))
    assert with_ids(rows.where("false"), ["o"]).count() == 0
    right = rows.groupBy("k").count()
    from pyspark.sql import functions as F

    got = skew_join(rows.select("id", "k"), right, ["k"], "count", 5000, F.col("id"))
    assert got.count() == 5000 and got.where("k = 'hot'").select("count").distinct().collect()[0][0] == 1667
    assert skew_join(rows.where("false").select("id", "k"), right, ["k"], "count", 0, F.col("id")).count() == 0
