"""The archive's runs, its index, the sources by element and by member, and generation that goes on."""

from __future__ import annotations

import glob
import json
import os
import random
import zipfile
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatlake.operators import export, normalize, reports, search, store
from chatlake.plans import catalog
from chatlake.plans.adapters import archive
from chatlake.sources import arrays, exports, runs
from chatlake.streaming.ingest import ingest_stream
from conftest import SF
from test_library import FLAT, GOOD, _files


def _chat(k, n=2, word="bank"):
    return FLAT | {"name": f"Chat {k}", "chat_messages": [{"sender": "human", "text": f"{word} number {k} turn {i}"} for i in range(n)]}


def _found(spark, root, query="bank", anew=False):
    """Hits of the archive's index; anew: that one made of the archive's tables gives the same."""
    c, m = store.read(spark, root, "conversations"), store.read(spark, root, "messages")
    hits = search.search_batch(catalog._ask(spark, {"q": query}), search.load(spark, root), c, m, 100, with_excerpts=False)
    rows = [(r["message_id"], round(r["score"], 9)) for r in hits.orderBy("rank").collect()]
    if anew:
        whole = search.search_batch(catalog._ask(spark, {"q": query}), search.build(c, m), c, m, 100, with_excerpts=False)
        assert rows == [(r["message_id"], round(r["score"], 9)) for r in whole.orderBy("rank").collect()]
    return rows


def test_imports_keep_the_index_and_few_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs.compact, "__defaults__", (2,))
    root = str(tmp_path / "archive")
    for k in range(4):
        assert tuple(store.ingest(spark, root, _files(spark, {f"f{k}": _chat(k)})).first()) == (1, 1, 2, 0)
    assert len(runs.current(spark, root).runs) == 1  # of 4
    assert len(_found(spark, root)) == 8 and store.read(spark, root, "messages").count() == 8
    longer = _chat(3, 4)
    assert tuple(store.ingest(spark, root, _files(spark, {"again": longer, "bad": "{"})).first()) == (1, 0, 2, 1)
    assert len(_found(spark, root, "turn-3", anew=True)) == 1 and len(_found(spark, root)) == 10
    before = len(glob.glob(f"{root}/tables/*/*"))
    assert runs.vacuum(spark, root, hours=0) == 0  # older versions still name them
    monkeypatch.setattr(runs, "KEPT", 1)
    store.ingest(spark, root, _files(spark, {"one more": _chat(9)}))
    assert runs.vacuum(spark, root, hours=0) > 0 and len(glob.glob(f"{root}/tables/*/*")) < before
    assert len(_found(spark, root, anew=True)) == 12


def test_a_broken_import_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "archive")
    store.ingest(spark, root, _files(spark, {"a": _chat(1), "x": "{"}))
    seen = _found(spark, root)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(search, "add_to", fail)  # after conversations, messages and bad files were written
        with pytest.raises(OSError, match="lost"):
            store.ingest(spark, root, _files(spark, {"b": _chat(2), "y": "{"}))
    assert _found(spark, root) == seen and [store.read(spark, root, t).count() for t in ("conversations", "messages", "bad_files")] == [1, 2, 1]
    assert tuple(store.ingest(spark, root, _files(spark, {"b": _chat(2), "y": "{"})).first()) == (1, 1, 2, 1)
    assert [store.read(spark, root, t).count() for t in ("conversations", "messages", "bad_files")] == [2, 4, 2]


def test_an_import_that_was_overtaken_is_merged_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "archive")
    store.ingest(spark, root, _files(spark, {"a": _chat(0)}))
    real, overtaken = runs.commit, []

    def slow(*args, **more):
        if not overtaken:
            overtaken.append(True)
            store.ingest(spark, root, _files(spark, {"b": _chat(1), "c": _chat(2)}))
        return real(*args, **more)

    monkeypatch.setattr(runs, "commit", slow)
    assert tuple(store.ingest(spark, root, _files(spark, {"b": _chat(1), "d": _chat(3)})).first()) == (2, 1, 2, 0)
    assert store.read(spark, root, "conversations").count() == 4 and len(_found(spark, root)) == 8
    base = runs.current(spark, root)
    real(spark, root, base, [])
    with pytest.raises(runs.Conflict):
        real(spark, root, base, [])


def test_a_half_written_version_is_not_there(spark, tmp_path):
    root = str(tmp_path / "archive")
    store.ingest(spark, root, _files(spark, {"a": _chat(0)}))
    now = runs.current(spark, root)
    (tmp_path / "archive" / "versions" / f"{now.number + 1:010d}.json").write_text("{")
    assert runs.current(spark, root) == now
    with pytest.raises(runs.Conflict):  # its writer may still be at it
        runs.commit(spark, root, now, [])
    os.utime(tmp_path / "archive" / "versions" / f"{now.number + 1:010d}.json", (1, 1))
    assert runs.commit(spark, root, now, []).number == now.number + 2


def test_a_batch_of_a_stream_counts_once(spark, tmp_path):
    root, folder = str(tmp_path / "archive"), tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(_chat(1)))
    (folder / "bad.json").write_text("{")
    ingest_stream(spark, str(folder), root, str(tmp_path / "cp")).awaitTermination()
    counts = [store.read(spark, root, t).count() for t in ("messages", "bad_files")]
    os.remove(max(glob.glob(f"{tmp_path}/cp/commits/*")))  # as if the query had died before it noted the batch
    for x in glob.glob(f"{tmp_path}/cp/commits/.*crc"):
        os.remove(x)
    ingest_stream(spark, str(folder), root, str(tmp_path / "cp")).awaitTermination()
    assert [store.read(spark, root, t).count() for t in ("messages", "bad_files")] == counts == [2, 1]
    assert len(_found(spark, root)) == 2


def _scanned(df):
    """Rows that the scans of a plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_few_keys_read_few_rows(spark, tmp_path):
    ids = spark.range(400_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("id"))
    run = runs.Run(spark, str(tmp_path), {"t": runs.Table("id string", ("id",))})
    run.write("t", ids, runs.SMALL + 1)
    rows = runs.read(spark, str(tmp_path), "t", run.tables["t"], runs.Version(1, (run.entry(),)))
    keys = ids.limit(3)
    with runs.setting(spark, "spark.sql.parquet.pushdown.inFilterThreshold", store.LOOKUP_KEYS):
        held = store.known(keys, rows, "id", 3)
        assert held.count() == 3
        again = store.known(keys, rows, "id", 3)
        again.write.format("noop").mode("overwrite").save()
        plan = again._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id" in plan
    assert spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "10"
    with runs.setting(spark, "spark.sql.parquet.pushdown.inFilterThreshold", store.LOOKUP_KEYS):
        again.collect()
        assert 0 < _scanned(again) < 100_000  # of 400,000: pages of 20,000 rows
    assert [store.known(keys, rows, "id", n).count() for n in (store.LOOKUP_KEYS + 1, store.BROADCAST_KEYS + 1)] == [3, 3]


def test_one_pruned_scan_of_postings(spark):
    index, c, m = catalog._indexed(spark, SF)
    one = search.rank(catalog._ask(spark, {"q": "the"}), index, 20)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term)" in plan and "EqualTo(term,the)" in plan
    two = search.rank(catalog._ask(spark, {"q": "that was"}), index, 20)
    assert two._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_bounds_skip_postings_and_change_no_rank(spark, tmp_path):
    c, m = archive(spark, SF)
    root = str(tmp_path / "index")
    search.save(c, m, root)
    index = search.load(spark, root)
    asked = catalog._ask(spark, {w: w for w in ("the", "of", "and", "was", "zzz", "THE")})
    for limit in (1, 5, 40):
        best, every = (search.rank(asked, index, n).collect() for n in (limit, None))
        for q in {r["query_id"] for r in every}:
            scores = [sorted((round(r["score"], 9), r["message_id"]) for r in some if r["query_id"] == q) for some in (best, every)]
            reach = scores[1][min(limit, len(scores[1])) - 1][0]
            assert [x for x in scores[0] if x[0] <= reach] == [x for x in scores[1] if x[0] <= reach]
    one = catalog._ask(spark, {"q": "the"})
    assert search.rank(one, index, 1).count() < search.rank(one, index).count()


def test_postings_of_odd_messages(spark):
    rows = [("m1", "c", "The the title", "THE end. the"), ("m2", "c", None, None), ("m3", "c", "", "x " * 5), ("m4", "c", "a b", "c d")]
    got = {(r["message_id"], r["term"]): (r["positions"], r["dl"]) for r in search.postings_of(spark.createDataFrame(rows, "id string, conversation_id string, title string, content string")).collect()}
    assert got[("m1", "the")] == ([0, 1, 4, 6], 6) and got[("m1", "title")] == ([2], 6) and got[("m1", "end")] == ([5], 6)
    assert got[("m3", "x")] == ([0 + 1, 2, 3, 4, 5], 5) and {k for k, _ in got} == {"m1", "m3", "m4"}
    assert got[("m4", "b")][0][0] + 1 != got[("m4", "c")][0][0]  # no phrase goes from the title to the content


def _random_json(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return rng.choice(["a\\", '"q"', "[{", "}]", ",", 'é\\\\"', "x" * rng.randint(0, 9), 1, None, True, '\\\\\\"'])
    if kind < 0.7:
        return [_random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {str(rng.random())[:4] + rng.choice(['"', "]", "\\"]): _random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_arrays_by_element_of_ranges_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "STEP", 7)
    rng, wanted = random.Random(5), {}
    for k in range(12):
        value = [_random_json(rng) for _ in range(rng.randint(0, 6))]
        (tmp_path / f"{k}.json").write_text(rng.choice(["", " ", "\n" * 30]) + json.dumps(value, ensure_ascii=k % 2 == 0, indent=rng.choice([None, 1])) + rng.choice(["", "\n "]))
        wanted[f"{k}.json"] = value
    bad = {"b1": "[1,2", "b2": "[1] x", "b3": '["a', "b4": "[1][2]", "b5": "[1}", "b6": "[1]]"}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "one.json").write_text('{"a": [1, 2]}')
    for size in (3, 64):
        elements, rejected = exports.read_large(spark, str(tmp_path), at_least=1, size=size)
        got = {}
        for r in sorted(elements.collect(), key=lambda r: (r["source_path"], r["position"])):
            got.setdefault(r["source_path"].rpartition("/")[2], []).append(json.loads(r["value"]))
        assert got == {k: v for k, v in wanted.items() if v} | {"one.json": [{"a": [1, 2]}]}
        assert {r["source_path"].rpartition("/")[2][:-5] for r in rejected.collect()} == set(bad)


def test_large_files_by_element_give_what_whole_ones_give(spark, tmp_path):
    cycle = [{"title": "Cycle", "create_time": 1.0, "mapping": {"a": {"parent": None, "children": ["b"], "message": None}, "b": {"parent": "a", "children": ["a"], "message": None}}}]
    values = {"a": GOOD, "b": FLAT, "c": "{", "d": [], "e": [FLAT, 3], "f": "3", "g": cycle, "h": [FLAT | {"created_at": None}, FLAT], "i": "[" + json.dumps(FLAT) + ",]", "j": [_chat(k) for k in range(30)], "k": GOOD[0]}
    for name, value in values.items():
        (tmp_path / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))
    found = []
    for large in (exports.LARGE, 1):
        files, rejected = exports.read_exports(spark, str(tmp_path), large=large)
        good, bad = normalize.normalize(files, lambda rows, name, large=large: runs.written(rows, f"{tmp_path}/kept-{large}/{name}"))
        plain = sorted((r["source_path"].rpartition("/")[2], r["id"], str(r["messages"])) for r in good.collect())
        found.append((plain, {r["source_path"].rpartition("/")[2]: r["reason"] for r in bad.unionByName(rejected).collect()}))
    assert found[0] == found[1] and len(found[0][0]) == 32 and set(found[0][1]) == {"c.json", "e.json", "f.json", "g.json", "h.json", "i.json", "k.json"}


def test_zip_members_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "BIG 1%20.ZIP", "w") as z:
        for k in range(40):
            z.writestr(f"x/{k}.json", json.dumps(_chat(k)))
    with zipfile.ZipFile(tmp_path / "damaged.zip", "w") as z:
        z.writestr("a.json", "[]" * 500)
        z.writestr("b.json", json.dumps(FLAT))
    data = bytearray((tmp_path / "damaged.zip").read_bytes())
    data[60] ^= 255  # in the first member's bytes
    (tmp_path / "damaged.zip").write_bytes(data)
    (tmp_path / "none.zip").write_text("no zip")
    files, rejected = exports.read_exports(spark, *(str(tmp_path / x) for x in ("BIG 1%20.ZIP", "damaged.zip", "none.zip")))
    assert Counter(r["reason"] for r in rejected.collect()) == {"Invalid zip archive": 2}
    assert {r["source_path"].rpartition("!/")[2] for r in files.collect()} == {f"x/{k}.json" for k in range(40)}
    folders = iter([str(tmp_path / "listed"), str(tmp_path / "members")])
    monkeypatch.setattr(runs, "scratch", lambda _: next(folders))
    assert exports.read_zips(spark, str(tmp_path / "BIG 1%20.ZIP")).count() == 40
    assert len(glob.glob(f"{tmp_path}/members/part-*.parquet")) > 1  # written by several tasks


def test_paths_are_what_they_are(spark, tmp_path):
    (tmp_path / "exports-2024.06").mkdir()
    (tmp_path / "exports-2024.06" / "a.json").write_text(json.dumps(FLAT))
    (tmp_path / "B.JSON").write_text(json.dumps([_chat(1)]))
    files, _ = exports.read_exports(spark, str(tmp_path / "exports-2024.06"), str(tmp_path / "B.JSON"))
    assert sorted(r["source_path"].rpartition("/")[2] for r in files.collect()) == ["B.JSON", "a.json"]
    assert exports.read_exports(spark, str(tmp_path / "exp*"))[0].count() == 1
    with pytest.raises(ValueError, match="does not exist"):
        exports.read_exports(spark, str(tmp_path / "gone"))


def _selected(spark, c, sizes):
    ids = [r[0] for r in c.select("id").orderBy("id").limit(sum(sizes)).collect()]
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows.append((k, ids[at : at + n]))
        at += n
    return reports.selections(spark.createDataFrame(rows, "report_id int, selected_conversation_ids array<string>"))


def test_generation_goes_on_where_it_stopped(spark, tmp_path):
    c, m = archive(spark, SF, korean=True)
    chosen = _selected(spark, c, [4, 4, 4])
    calls, broken = str(tmp_path / "calls"), str(tmp_path / "broken")
    os.mkdir(calls)
    open(broken, "w").close()

    def stub(rows: pd.DataFrame) -> pd.Series:
        import os
        import uuid

        if os.path.exists(broken) and len(os.listdir(calls)) >= 2:
            raise OSError("no more")
        for _ in range(len(rows)):
            open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return "## Overview\n\n" + rows["prompt"].str.len().astype(str)

    ask = lambda: reports.generate(prompts, stub, 1, str(tmp_path / "outputs"), per_call=1)
    rows = reports.inputs(chosen, c, m)
    prompts = reports.chunk_prompts(reports.pack_chunks(reports.documents(rows), 1), reports.languages(rows))
    n = prompts.count()
    assert n > 3
    with pytest.raises(Exception, match="no more"):
        ask()
    assert len(os.listdir(calls)) == 2
    os.remove(broken)
    assert ask().count() == n and len(os.listdir(calls)) == n  # the rest alone
    assert ask().count() == n and len(os.listdir(calls)) == n
    twice = prompts.unionByName(prompts.withColumn("report_id", F.lit(99).cast("int")))
    assert reports.generate(twice, stub, None, str(tmp_path / "outputs")).count() == 2 * n and len(os.listdir(calls)) == n


def test_two_runs_of_one_selection_are_two_reports(spark, tmp_path):
    c, m = archive(spark, SF)
    chosen, root = _selected(spark, c, [2]), str(tmp_path / "archive")
    for k, text in enumerate(("one", "two")):
        made = reports.build_reports(chosen, c, m, lambda rows, text=text: pd.Series([text] * len(rows)), str(tmp_path / f"w{k}"), created_at="2024-01-01", titles=spark.createDataFrame([(0, "Weekly")], "report_id int, title string"))
        assert store.save_reports(made, root).count() == 1
        assert store.save_reports(made, root).count() == 0
    saved = store.read(spark, root, "insight_reports")
    assert saved.count() == 2 and {r["title"] for r in saved.collect()} == {"Weekly"}
    export.write_files(export.report_files(saved), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["Weekly-2.md", "Weekly.md"]
    assert reports.build_reports(chosen, c, m, lambda rows: pd.Series(["x"] * len(rows)), str(tmp_path / "w3")).first()["created_at"][:2] == "20"
    with pytest.raises(ValueError, match="At least one"):
        reports.build_reports(_selected(spark, c, [1, 0]), c, m, None, str(tmp_path / "w4"))


def test_names_that_meet_are_numbered(spark, monkeypatch):
    rows = [("a.md", t) for t in "xyz"] + [("a-2.md", "own"), ("b", None), ("b", None), ("c.tar.gz", "1"), (None, "no")]
    docs = spark.createDataFrame(rows, "file_name string, markdown string")
    for named in (100_000, 1):
        monkeypatch.setattr(export, "NAMED", named)
        got = [tuple(r) for r in export.numbered(docs).collect()]
        names = [n for n, _ in got]
        assert len(got) == 7 and len(set(names)) == 7 and {"a.md", "a-3.md", "b", "b-2", "c.tar.gz"} < set(names) and ("a-2.md", "own") in got
        assert Counter(t for _, t in got) == Counter(t for n, t in rows if n)
