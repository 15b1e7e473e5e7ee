"""What the reviewer's third round found: each of these failed before."""

from __future__ import annotations

import json
import os

from conftest import SF
from oracle import same
from pyspark.sql import functions as F

from chatlake.operators import normalize, reports, search, store
from chatlake.plans import catalog
from chatlake.sources import runs


def with_conversations(tmp_path, rows) -> str:
    """The given tables with another conversations table."""
    for name in os.listdir(SF):
        if name != "conversations.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    # DuckDB reads one file under the table's name.
    os.rename(tmp_path / "conversations.parquet", tmp_path / "made")
    os.rename(next((tmp_path / "made").glob("*.parquet")), tmp_path / "conversations.parquet")
    return str(tmp_path)


def test_merge_prompts_keep_a_chunk_without_citations(spark, tmp_path):
    text = "first part\n\n" + "x" * 9_990
    rows = spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", "short"), (5, 0, "user", "a\n\n" * 10), (5, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    folder = with_conversations(tmp_path, rows.coalesce(1))
    assert catalog.queries()["prompts"](spark, folder).where(F.col("n_chunks") > 1).count() > 2
    same(spark, folder, catalog.queries()["merge_prompts"], catalog.oracle_sql()["merge_prompts"])


def test_files_of_an_import_are_bounded_by_their_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PART_CHARS", 5_000, raising=False)
    one = [{"name": f"c{k}", "created_at": "2024", "chat_messages": [{"sender": "human", "text": f"w{k} " * 250}]} for k in range(60)]
    files = spark.createDataFrame([("b.json", json.dumps(one))], "source_path string, value string")
    root = f"file://{tmp_path}/archive"
    assert store.ingest(spark, root, files).first()["inserted_messages"] == 60
    base = runs.current(spark, root)
    sizes = store.runs.read(spark, root, "messages", store.TABLES["messages"], base).groupBy(F.input_file_name()).agg(F.sum(F.length("content")).alias("n")).collect()
    assert len(sizes) >= 10 and max(r["n"] for r in sizes) < 3 * 5_000
    assert runs.read(spark, root, "postings", store.TABLES["postings"], base).count() == 120


def test_python_gets_few_prompts_at_a_time(spark, tmp_path):
    rows = spark.range(2_000).select(F.lit("s").alias("system"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit(9).alias("max_tokens"))

    def batch_rows(some):
        import inspect

        caller = inspect.currentframe().f_back
        return some["prompt"] + " " + str(len(caller.f_locals["batch"]))

    made = reports.generate(rows.coalesce(1), batch_rows, store=f"file://{tmp_path}/outputs", parallel=1).collect()
    assert len(made) == 2_000 and {r["output"].split(" ")[0] for r in made} == {f"p{k}" for k in range(2_000)}
    assert max(int(r["output"].split(" ")[1]) for r in made) <= 100


def test_documents_trim_a_text_once(spark):
    rows = spark.createDataFrame([(1, 0, "c", "s", "t", "", 0, "user", " a\n\n\n\nb ", None)], "report_id long, ord int, conversation_id string, source string, title string, created_at string, message_index int, role string, content string, timestamp string")
    docs = reports.documents(rows)
    assert "]\na\n\nb\n</message>" in docs.first()["document"]
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("\\s+\\z") == 1


def test_postings_leave_python_in_the_order_of_their_files(spark, monkeypatch):
    rows = [(f"c{k}:0", f"c{k}", "a title", " ".join(f"w{j % 7}" for j in range(k + 1)) + " Été the the ΟΔΟΣ İx") for k in range(40)] + [("e:0", "e", None, " -- "), ("n:0", "n", None, None), ("t:0", "t", "only", "")]
    titled = spark.createDataFrame(rows, "id string, conversation_id string, title string, content string").coalesce(1)
    whole = search.postings_of(titled).collect()
    assert [(r["bucket"], r["term"].encode(), -r["level"]) for r in whole] == sorted((r["bucket"], r["term"].encode(), -r["level"]) for r in whole)
    for r in whole:
        _, _, title, content = next(x for x in rows if x[0] == r["message_id"])
        a, b = (spark_tokens(x) for x in (title, content))
        assert r["positions"] == [p for p, w in enumerate([*a, None, *b]) if w == r["term"]] and r["dl"] == len(a) + len(b)
    texts = spark.createDataFrame([(x[0], x[1], " ".join(spark_tokens(x[2])), " ".join(spark_tokens(x[3]))) for x in rows], "message_id string, conversation_id string, t0 string, t1 string").toArrow()
    monkeypatch.setattr(search, "SHARE_BYTES", 50)
    shares = [r for b in search._grouped(iter(texts.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert sorted((r["term"], r["message_id"], r["positions"]) for r in shares) == sorted((r["term"], r["message_id"], r["positions"]) for r in whole)


def spark_tokens(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", (text or "").lower().replace("é", "e"))


def test_blocks_are_summed_once(spark, tmp_path):
    rows = spark.range(30).select(F.concat("id", F.lit(":0")).alias("id"), F.col("id").cast("string").alias("conversation_id"), F.concat(F.lit("of w"), "id").alias("content"))
    c = rows.select(F.col("conversation_id").alias("id"), F.lit("t").alias("title"))
    blocks = search.blocks_of(search.build(c, rows).postings)
    plan = search.TABLES["blocks"].deal(blocks, 10_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    root = f"file://{tmp_path}/index"
    search.save(c, rows, root)
    index = search.load(spark, root)
    assert sorted(map(tuple, index.blocks.drop("run").collect())) == sorted(map(tuple, search.blocks_of(index.postings).collect()))


def test_second_pass_gives_a_phrase_once_for_several_parts(spark, monkeypatch):
    from chatlake.llm import collocations

    seen, counts = [], collocations.phrase_counts

    def counting(texts, *rest):
        seen.append(texts.rdd.getNumPartitions())
        return counts(texts, *rest)

    monkeypatch.setattr(collocations, "phrase_counts", counting)
    texts = spark.range(640).select(F.lit("en").alias("lang"), F.lit("a b c. a b").alias("text")).repartition(64)
    found = {r["phrase"]: r["n"] for r in collocations.frequent_phrases(texts).collect()}
    assert found == {"": 3200, "a": 1280, "b": 1280, "c": 640, "a b": 1280, "b c": 640, "a b c": 640}
    assert seen == [16]


def test_files_of_an_import_are_read_once(spark, tmp_path):
    flat = [{"name": f"c{k}", "created_at": "2024", "chat_messages": [{"sender": "human", "text": f"w{k}"}]} for k in range(3)]
    tree = [{"title": "t", "create_time": 1, "mapping": {"r": {"parent": None, "children": ["a"], "message": None}, "a": {"parent": "r", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}}}}]
    os.makedirs(tmp_path / "in")
    for name, text in (("a", json.dumps(tree)), ("b", json.dumps(flat)), ("one", json.dumps(flat[0] | {"name": "alone"})), ("none", "[]"), ("x", "{"), ("y", '{"z": 1}'), ("odd", json.dumps([flat[0] | {"name": "lost"}, 5]))):
        (tmp_path / "in" / f"{name}.json").write_text(text)
    files = spark.read.option("wholetext", True).text(f"file://{tmp_path}/in").select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("source_path"), "value")
    scans = []

    def keep(rows, name):
        scans.append(rows._jdf.queryExecution().executedPlan().toString().count("FileScan text"))
        return runs.written(rows, f"file://{tmp_path}/kept/{name}")

    good, bad = normalize.normalize(files, keep)
    scans.append(bad._jdf.queryExecution().executedPlan().toString().count("FileScan text"))
    assert sum(scans) == 1
    for c, b in ((good, bad), normalize.normalize(files)):
        assert sorted((r["source_path"], r["position"], r["title"]) for r in c.collect()) == [("a.json", 0, "t"), *[("b.json", k, f"c{k}") for k in range(3)], ("one.json", 0, "alone")]
        assert sorted(map(tuple, b.collect())) == [("odd.json", "list element is no object"), ("x.json", "not valid JSON"), ("y.json", "unknown layout")]


def test_texts_of_an_import_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PART_CHARS", 80_000)
    one = [{"name": f"c{k}", "created_at": "2024", "chat_messages": [{"sender": "human", "text": f"w{k} " * 500}]} for k in range(60)]
    root = f"file://{tmp_path}/archive"
    store.ingest(spark, root, spark.createDataFrame([("b.json", json.dumps(one))], "source_path string, value string"))
    assert store.read(spark, root, "messages").select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism == 4
