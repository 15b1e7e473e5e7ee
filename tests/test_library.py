from __future__ import annotations

import hashlib
import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatlake.functions import text as T
from chatlake.operators import export, normalize, reports, search, store
from chatlake.plans import catalog
from chatlake.plans.adapters import archive
from chatlake.sources import exports
from chatlake.streaming.ingest import ingest_stream
from conftest import SF
from oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_text_helpers(spark):
    md = T.compact_markdown(F.col("x"))
    assert _one(spark, md, x="left **open here --- ## next part") == "left open here · next part"
    assert _one(spark, md, x="both **ends** here and `code") == "both **ends** here and code"
    assert _one(spark, md, x="a **[hit]** marked") == "a **\\[hit\\]** marked"
    assert [tuple(r) for r in _one(spark, T.citations(F.col("x")), x="As [k:9.b#m12] and [z#0] say, [no] more.")] == [("k:9.b", 12), ("z", 0)]
    assert _one(spark, T.link_citations(F.col("x")), x="As [k:9.b#m12] and [z#0] say, [no].") == "As [k:9.b #12](#source:k%3A9.b:12) and [z #0](#source:z:0) say, [no]."
    assert _one(spark, T.safe_file_name(F.col("x")), x="What? <a|b>.. c") == "What- -a-b-.. c"
    assert _one(spark, T.highlight_terms(F.col("x")), x="서울 go \"river bank\" go! cafe\u0301") == ["river bank", "caf\u00e9", "서울", "go"]
    assert _one(spark, T.mark_terms(F.col("x"), F.array(F.lit("go"), F.lit("서울"))), x="서울 GO on") == "<mark>서울</mark> <mark>GO</mark> on"
    assert _one(spark, T.mark_terms(F.col("x"), F.array(F.lit("a\\E(b"), F.lit("\\Q"))), x="x a\\E(b \\Q") == "x <mark>a\\E(b</mark> <mark>\\Q</mark>"
    assert [_one(spark, T.safe_link(F.col("x")), x=u) for u in ("vbscript:q", "//other.org/x", "http://a.b/c", "#part", "/there", "mailto:a@b")] == ["", "", "http://a.b/c", "#part", "/there", "mailto:a@b"]
    odd = "a\u00a0b\x01c\u200bd\u2028e\U000e0001f\x7f g's"
    assert _one(spark, T.quoted(F.col("x")), x=odd) == repr(odd)
    assert _one(spark, T.slug(F.col("x")), x="  Héllo, Wörld_x -- y ") == "héllo-wörld-x-y"
    assert _one(spark, T.quoted(F.col("x")), x="it's") == '"it\'s"' and _one(spark, T.quoted(F.col("x")), x="a\nb'\"") == repr("a\nb'\"")


def _tree(title, branches, **more):
    return {"title": title, "create_time": 1707570900.5, "mapping": branches} | more


def _node(parent, children, text=None, role="user", parts=None):
    return {"parent": parent, "children": children, "message": None if text is None and parts is None else {"author": {"role": role}, "content": {"parts": parts or [text]}, "create_time": 1707570900.0}}


GOOD = [
    _tree("Branches", {"zz": _node(None, ["a", "b"]), "a": _node("zz", [], "lost"), "b": _node("zz", ["c"], parts=["one", {"text": "two"}, {"x": 1}, 3, None, ""]), "c": _node("b", ["gone"], "three", "assistant")}),
    _tree("Blank", {"r": _node(None, [], "  \n")}),
    {"title": "Empty", "mapping": {}},
]
FLAT = {"name": "Flat", "created_at": "2026-02-10T09:15:00Z", "chat_messages": [{"sender": "human", "text": "hi", "created_at": "t1"}, {"sender": "assistant", "content": [{"type": "text", "text": "x"}, "y"], "timestamp": "t2"}, {"sender": "bot", "text": "no"}]}


def _files(spark, values):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in values.items()], "source_path string, value string")


def test_layouts_and_quarantine(spark):
    cycle = [_tree("Cycle", {"a": _node(None, ["b"], "x"), "b": _node("a", ["a"], "y")})]
    values = {"a": GOOD, "b": FLAT, "c": "{", "d": [], "e": [_tree(None, {"r": _node(None, [], "x")})], "f": "3", "g": cycle, "h": [FLAT | {"created_at": None}]}
    conversations, rejected = normalize.normalize(_files(spark, values))
    got = {r["title"]: [tuple(m) for m in r["messages"]] for r in conversations.collect()}
    assert got == {
        "Branches": [("user", "one\ntwo\n", "2024-02-10T13:15:00+00:00"), ("assistant", "three", "2024-02-10T13:15:00+00:00")],
        "Flat": [("user", "hi", "t1"), ("assistant", "x\ny", "t2")],
    }
    assert conversations.where("title = 'Branches'").first()["created_at"] == "2024-02-10T13:15:00.500000+00:00"
    assert {r[0]: r[1] for r in rejected.collect()} == {"c": "not valid JSON", "e": "title is no string", "f": "unknown layout", "g": "cycle in mapping", "h": "created_at is no string"}


def test_walk_of_odd_trees(spark):
    two_roots = [_tree("Two roots", {"x": _node("gone", [], "no"), "a": _node("", ["b"], "first"), "b": _node("a", ["c", "d"], "x"), "c": _node("b", [], "lost"), "d": _node("b", [], "last"), "r": _node(None, [], "second root")})]
    rootless = [_tree("Rootless", {"a": _node("b", ["b"], "x"), "b": _node("a", ["a"], "y")})]
    deep = [_tree("Deep", {f"n{k}": _node(f"n{k - 1}" if k else None, [f"n{k + 1}"] if k < 2999 else [], f"t{k}") for k in range(3000)})]
    got = {r["title"]: [m["content"] for m in r["messages"]] for r in normalize.normalize(_files(spark, {"a": two_roots, "b": rootless, "c": deep}))[0].collect()}
    assert got == {"Two roots": ["first", "x", "last"], "Deep": [f"t{k}" for k in range(3000)]}


def test_sources_store_and_stream(spark, tmp_path):
    folder = tmp_path / "in put+1" / "nested"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps(GOOD))
    (tmp_path / "in put+1" / "b.json").write_text(json.dumps(FLAT))
    (folder / "note.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("x/a.json", json.dumps(GOOD))
        z.writestr("x/p.png", b"0")
        z.writestr("x/B.JSON", json.dumps(FLAT))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../escape.json", "[]")
    files, rejected = exports.read_exports(spark, str(tmp_path / "in put+1"), str(tmp_path / "good.zip"), str(tmp_path / "bad.zip"))
    assert sorted(r[0].rpartition("/in put+1/")[2] for r in files.where("source_path not like '%zip%'").collect()) == ["b.json", "nested/a.json"]
    assert [r["reason"] for r in rejected.collect()] == ["Unsafe zip entry"]
    with pytest.raises(ValueError, match="Unsupported"):
        exports.read_exports(spark, str(folder / "note.txt"))
    with pytest.raises(ValueError, match="does not exist"):
        exports.read_exports(spark, str(tmp_path / "x.txt"))
    root = str(tmp_path / "archive")
    first, again = store.ingest(spark, root, files, rejected).first(), store.ingest(spark, root, files).first()
    assert tuple(first) == (3, 2, 4, 1) and tuple(again) == (3, 0, 0, 0)
    assert [r["reason"] for r in store.read(spark, root, "bad_files").collect()] == ["Unsafe zip entry"]
    flat = exports.read_folder(spark, str(tmp_path / "in put+1"), recursive=False)
    assert [r[0].rpartition("/")[2] for r in flat.collect()] == ["b.json"]
    one = exports.read_exports(spark, str(tmp_path / "in put+1" / "b.json"))[0]
    assert [json.loads(r["value"]) for r in one.collect()] == [FLAT]
    keys = exports.read_zips(spark, str(tmp_path / "good.zip")).select("archive_key").distinct().collect()
    assert [r[0] for r in keys] == [hashlib.sha256((tmp_path / "good.zip").read_bytes()).hexdigest()[:12]]
    longer = json.loads(json.dumps(FLAT))
    longer["chat_messages"].append({"sender": "human", "text": "more"})
    assert tuple(store.ingest(spark, root, _files(spark, {"z": longer})).first())[:3] == (1, 0, 1)
    assert store.read(spark, root, "messages").count() == 5 and store.read(spark, root, "insight_reports").count() == 0
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in put+1"), str(tmp_path / "streamed"), str(tmp_path / "cp")).awaitTermination()
    assert store.read(spark, str(tmp_path / "streamed"), "messages").count() == 4


def test_search_equals_fts5(spark):
    c, m = archive(spark, SF)
    table = m.join(c.select(F.col("id").alias("conversation_id"), "title"), "conversation_id").select("id", "title", "content").collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, content)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(r) for r in table])
    index = catalog._indexed(spark, SF)[0]
    asked = {"a": "the", "b": "that was", "c": "of-the", "d": "\"of the\" and --", "e": "zzz"}
    got = search.search_batch(catalog._ask(spark, asked), index, c, m, 1000).collect()
    for name, query in asked.items():
        match = " ".join(f'"{p}"' for p in query.replace('"', " ").split())
        want = db.execute("SELECT id, bm25(t), snippet(t, 2, '[', ']', '...', 24) FROM t WHERE t MATCH ?", (match,)).fetchall()
        mine = {r["message_id"]: r for r in got if r["query_id"] == name}
        assert set(mine) == {w[0] for w in want}
        for i, score, shown in want:
            assert mine[i]["score"] == pytest.approx(score, abs=1e-12)
            assert mine[i]["excerpt"] == " ".join(shown.split())


def _next_fit(sizes, most):
    slots, filled, out = [], 0, []
    for k, n in enumerate(sizes):
        if slots and filled + n > most:
            out.append(slots)
            slots, filled = [], 0
        if n > most:
            out.append([k])
            continue
        slots.append(k)
        filled += n
    return out + [slots] * bool(slots)


def test_packing(spark):
    sizes = [4000, 4000, 4000, 9999, 3000, 3000, 10_000, 1]
    docs = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(sizes)], "report_id int, ord int, document string")
    got = [len(r["text"]) for r in reports.pack_chunks(docs, 1).orderBy("chunk").collect()]
    assert got == [sum(sizes[k] for k in g) + 2 * (len(g) - 1) for g in _next_fit(sizes, 10_000)]
    big = "\n\n".join(["a" * 6000, "b" * 5000, "c" * 25_000, "d" * 10])
    rows = spark.createDataFrame([(1, 0, "s"), (1, 1, big), (1, 2, "t")], "report_id int, ord int, document string")
    assert [r["text"][:1] + str(len(r["text"])) for r in reports.pack_chunks(rows, 1).orderBy("chunk").collect()] == ["s1", "a6000", "b5000", "c10000", "c10000", "c5000", "d10", "t1"]


def test_slots_equal_a_loop(spark):
    rng = random.Random(3)
    sizes = {r: [rng.choice([0, 1, 50, 99, 100, 101, 250, rng.randint(0, 120)]) for _ in range(n)] for r, n in ((1, 0), (2, 1), (3, 400), (4, 3000))}
    rows = spark.createDataFrame([(r, k, n) for r, ns in sizes.items() for k, n in enumerate(ns)], "report_id int, ord int, n int").repartition(5)
    got = {(x["report_id"], x["ord"]): x["slot"] for x in reports.slots_of(rows, 100).collect()}
    for r, ns in sizes.items():
        groups, slot, at = _next_fit(ns, 100), 0, {}
        for g in groups:
            at |= dict.fromkeys(g, slot)
            slot += max(1, -(-ns[g[0]] // 100)) if len(g) == 1 else 1
        assert [got[r, k] for k in range(len(ns))] == [at[k] for k in range(len(ns))]
    many = spark.range(1_000_000).select(F.lit(1).alias("report_id"), F.col("id").cast("int").alias("ord"), F.lit(30).alias("n"))
    assert reports.slots_of(many, 100).agg(F.max("slot")).first()[0] == 333_333


def test_sections_and_json(spark):
    out = spark.createDataFrame([("## Overview\n\nx ", "en"), ("x", "ko")], "m string, l string").select(reports.ensure_sections(F.col("m"), F.col("l")).alias("r"), reports.parsed_json(F.lit('```json\n{"a": 1}\n```')).cast("string").alias("j")).collect()
    assert out[0]["r"].startswith("## Overview\n\nx\n\n## Key concepts\n\n_Not provided._\n") and out[0]["r"].count("## ") == 7
    assert out[1]["r"].count("_제공되지 않음._") == 7 and out[0]["j"] == '{"a":1}'
    c, m = archive(spark, SF)
    with pytest.raises(ValueError, match="Conversation not found"):
        reports.build_reports(spark.createDataFrame([(1, 0, "missing")], "report_id int, ord int, conversation_id string"), c, m, None, "/nowhere")


def test_outline(spark):
    md = "# First part\n## 둘째 부분\n### First   *part* #\n##### Too deep\n## !!\ntext\n## cafe\u0301"
    got = reports.outline(spark.createDataFrame([("r", "T", md), ("s", "Bare", "x")], "id string, title string, markdown string")).orderBy("report_id", "line").collect()
    assert [(r["heading_id"], r["level"]) for r in got] == [("first-part", 1), ("둘째-부분", 2), ("first-part-2", 3), ("section", 2), ("caf\u00e9", 2), ("report-top", 1)]


def test_reports_are_saved_and_written(spark, tmp_path):
    rows = [("r1", "A/b", ["c2", "c1"], "p", "m", "# One\n", "2024-01-02"), ("r2", "A/b ", ["c1"], "p", "m", None, "2024-01-03")]
    made = spark.createDataFrame(rows, store.SCHEMAS["insight_reports"])
    root = str(tmp_path / "archive")
    assert [store.save_reports(made.where("id = 'r1'"), root).count(), store.save_reports(made, root).count(), store.save_reports(made.limit(0), root).count()] == [1, 1, 0]
    assert [r["id"] for r in store.latest(store.read(spark, root, "insight_reports")).collect()] == ["r2", "r1"]
    assert tuple(store.report(spark, root, "r1").first()) == rows[0] and store.report(spark, root, "zz").count() == 0
    assert "markdown" not in reports.summaries(made).columns
    export.write_files(export.report_files(made.withColumn("title", F.concat("id", F.lit(": x")))), str(tmp_path / "out"))
    assert {x.name: x.read_text() for x in (tmp_path / "out").iterdir()} == {"r1- x.md": "# One\n", "r2- x.md": ""}
    c, m = archive(spark, SF)
    export.write_files(export.conversation_markdown(c, m), str(tmp_path / "md"))
    assert {x.name: x.read_text() for x in (tmp_path / "md").iterdir()} == {r["file_name"]: r["markdown"] for r in export.conversation_markdown(c, m).collect()}


def test_saved_index_takes_each_message_once(spark, tmp_path):
    c = spark.createDataFrame([("c", "chatgpt", "One\\two title", "2024")], "id string, source string, title string, created_at string")
    m = spark.createDataFrame([(f"c:{k}", "c", k, "user", t, None) for k, t in enumerate(["river bank", "bank", "other"])], "id string, conversation_id string, message_index int, role string, content string, timestamp string")
    asked = catalog._ask(spark, {"q": "bank"})
    root = str(tmp_path / "index")
    search.save(c, m.where("message_index < 2"), root)
    first = search.search_batch(asked, search.load(spark, root), c, m).select("message_id", "score").collect()
    for _ in range(2):
        search.save(c, m.where("message_index < 2").unionByName(m.where("message_index < 2")), root, "append")
    assert search.search_batch(asked, search.load(spark, root), c, m).select("message_id", "score").collect() == first and len(first) == 2
    search.save(c, m, root, "append")
    whole = search.search_batch(asked, search.build(c, m), c, m).select("message_id", "score").collect()
    assert search.search_batch(asked, search.load(spark, root), c, m, title="e\\tw").select("message_id", "score").collect() == whole
    groups = search.search_conversations(asked, search.load(spark, root), c, m)
    assert [len(r["excerpts"]) for r in search.shown_excerpts(groups, 1).collect()] == [1]
    long = "word " * 30 + "hit " * 50_000
    assert search.best_window(long, [["hit"]]).count("[hit]") > 0


def test_outline_has_every_heading(spark):
    made = catalog._reports(spark, SF)[2].select("title", "markdown").collect()
    want = {(int(r["title"].split()[-1]), k, x.removeprefix("## ")) for r in made for k, x in enumerate(r["markdown"].split("\n")) if x.startswith("## ")}
    got = {(r["report_id"], r["line"], r["text"]) for r in catalog.queries()["report_outline"](spark, SF).collect()}
    assert got == want and max(sum(r == i for r, _, _ in got) for i in {r for r, _, _ in got}) == 8


def test_every_message_has_its_window(spark):
    m = archive(spark, SF)[1].select("id", "conversation_id", "message_index").collect()
    want = {(y["id"], x["conversation_id"], x["message_index"]) for x in m for y in m if x["conversation_id"] == y["conversation_id"] and abs(x["message_index"] - y["message_index"]) <= 2}
    got = [(r["id"], r["id"].split(":")[0], r["target_index"]) for r in catalog.queries()["context_window"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_ingest_reads_system_messages_from_json_files(spark):
    files, root = catalog._export_files(spark, SF)
    names = [r["source_path"] for r in files.select("source_path").collect()]
    assert names and len(set(names)) == len(names) and all(n.endswith(".json") and n.split("/")[-2] in "ab" for n in names)
    assert any('"sender":"system"' in r["value"] for r in files.where("source_path like 'b/%'").collect())
    c, m = archive(spark, SF)
    want = m.where("role = 'system'").join(c.where("source = 'chatgpt'").select(F.col("id").alias("conversation_id")), "conversation_id").count()
    got = catalog.queries()["ingest_messages"](spark, SF).where("role = 'system'")
    assert got.count() == want > 0
