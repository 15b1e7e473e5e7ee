"""Reports: selections of conversations become packed chunks of text, prompts, and, by two rounds of a caller's generator, Markdown. [INS, AGG-5, AGG-7, AGG-8, WIN-6, WIN-7]

Many reports run as one job. A selection is a row (report_id, ord, conversation_id).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import text as T
from chatlake.sources import runs

#: The sections of a report, in English and Korean, and what stands in a section that is missing.
SECTIONS = {
    "en": ["Overview", "Key concepts", "Connections between conversations", "Agreements, contradictions, and patterns", "New or surprising insights", "Suggested follow-up questions", "Source references"],
    "ko": ["개요", "핵심 개념", "대화 간 연결", "합의점·모순·패턴", "새롭거나 놀라운 인사이트", "후속 질문 제안", "출처 참조"],
}
FALLBACK = {"en": "_Not provided._", "ko": "_제공되지 않음._"}
#: A message over MAX_MESSAGE characters keeps this many at its start and end, around the mark.
MAX_MESSAGE, HEAD, TAIL = 12_000, 8_000, 4_000
OMITTED = "\n\n[...middle of long message omitted for a faster focused synthesis...]\n\n"
MIN_CHUNK, PARTIAL_TOKENS, REPORT_TOKENS = 10_000, 1800, 3200
#: Prompts that Python gets at a time, some calls' worth.
PROMPT_ROWS = 64
#: What prompts say around sections and sources.
ROLE = "You write a report on a user's archived conversations, in "
LANGUAGES = {"en": "English", "ko": "Korean"}
RULES = "\nCite every claim as [conversation_id#mIndex], only with references that the sources carry. Compare the conversations with each other, say where they agree, differ or leave gaps, and mark what is your own inference. Keep it short and easy to scan.\n"
ASK_WHOLE = {"en": "Write the report from these conversations, with a source for each claim.\n\n", "ko": "다음 대화로 근거를 밝힌 보고서를 쓰세요.\n\n"}
ASK_PART = {"en": "Note its findings with their source references unchanged.\n\n", "ko": "출처 표기를 그대로 두고 발견한 내용을 적으세요.\n\n"}
ASK_MERGE = {"en": "The notes below come from parts of the same sources. Make one report of them; each reference stays as it is.\n\n", "ko": "아래 메모는 같은 자료를 나누어 적은 것입니다. 출처를 그대로 두고 보고서 하나로 쓰세요.\n\n"}
#: What stands between two notes of a merge prompt.
BETWEEN = "\n\n=====\n\n"
#: Fixed value: what a heading is.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def selections(reports: DataFrame, ids_col: str = "selected_conversation_ids") -> DataFrame:
    """Rows (report_id, ord, conversation_id): each id once, where it first stands; a report without any has one row of nulls, which build_reports() refuses. [SET-1, INS-1]"""
    return reports.select("report_id", F.posexplode_outer(F.array_distinct(ids_col)).alias("ord", "conversation_id"))


def missing(selected: DataFrame, conversations: DataFrame) -> DataFrame:
    """Selected ids that the archive does not have, by report. [JOI-6]"""
    lost = selected.where("conversation_id is not null").join(conversations.select(F.col("id").alias("conversation_id")).hint("merge"), "conversation_id", "left_anti")
    return lost.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "conversation_id"))), lambda r: r["conversation_id"]).alias("missing"))


def inputs(selected: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows (report_id, ord, conversation fields, message fields or null): the selection with ordered messages. [JOI-4, INS-1]"""
    held = selected.join(conversations.select(F.col("id").alias("conversation_id"), "source", "title", "created_at").hint("merge"), "conversation_id")
    return held.join(messages.select("conversation_id", "message_index", "role", "content", "timestamp").hint("merge"), "conversation_id", "left")


def languages(rows: DataFrame) -> DataFrame:
    """(report_id, hangul, latin, language) of inputs(): a vote of letters, each title counted once. [AGG-5]"""

    def letters(pattern: str) -> Column:
        first = F.coalesce(F.col("message_index"), F.lit(0)) == F.col("_first")
        return F.coalesce(F.sum(F.coalesce(F.regexp_count("content", F.lit(pattern)), F.lit(0)) + F.when(first, F.regexp_count("title", F.lit(pattern))).otherwise(0)), F.lit(0))

    # The first message of a conversation in a selection carries its title's letters.
    first = F.min(F.coalesce(F.col("message_index"), F.lit(0))).over(Window.partitionBy("report_id", "ord"))
    votes = rows.withColumn("_first", first).groupBy("report_id").agg(letters("[가-힣]").alias("hangul"), letters("[A-Za-z]").alias("latin"))
    return votes.withColumn("language", F.when((F.col("hangul") > 0) & (F.col("hangul") >= F.col("latin") * 0.35), "ko").otherwise("en"))


def compact_message(content: Column) -> Column:
    """A message without outer white space and without runs of blank lines; the middle of a long one is left out. [INS-2]"""
    return _shortened(_trimmed(content))


def _trimmed(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?U)^\s+|\s+\z", ""), "\n{3,}", "\n\n")


def _shortened(text: Column) -> Column:
    return F.when(F.length(text) > MAX_MESSAGE, F.concat(F.substring(text, 1, HEAD), F.lit(OMITTED), F.substring(text, -TAIL, TAIL))).otherwise(text)


def documents(rows: DataFrame) -> DataFrame:
    """(report_id, ord, conversation_id, document): each conversation as one tagged text, a source line for each message. [INS-3, AGG-8]"""
    stamp = F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit(' timestamp="'), F.col("timestamp"), F.lit('"'))).otherwise("")
    index = F.col("message_index").cast("string")
    block = F.concat(
        F.lit('<message index="'), index, F.lit('" role="'), F.col("role"), F.lit('"'), stamp, F.lit(">\nSource reference: ["), F.col("conversation_id"), F.lit("#m"), index, F.lit("]\n"), _shortened(F.col("_text")), F.lit("\n</message>\n\n")
    )
    # A column of its own: what an aggregate collects would work the patterns out anew for each use of the text.
    blocks = rows.withColumn("_text", _trimmed(F.col("content"))).groupBy("report_id", "ord", "conversation_id", "source", "title", "created_at").agg(F.array_sort(F.collect_list(F.when(F.col("message_index").isNotNull(), F.struct("message_index", block.alias("b"))))).alias("bs"))
    head = F.concat(F.lit('<conversation id="'), F.col("conversation_id"), F.lit('" source="'), F.col("source"), F.lit('">\nTitle: '), F.col("title"), F.lit("\nCreated: "), F.col("created_at"), F.lit("\n\n"))
    return blocks.select("report_id", "ord", "conversation_id", F.concat(head, F.array_join(F.transform("bs", lambda b: b["b"]), ""), F.lit("</conversation>")).alias("document"))


class NextFit:
    """Packs sizes in order: a slot takes items while they fit. An item over `most` has a slot, or as many as it takes, alone. [WIN-7]"""

    def __init__(self, most: int, extra: int = 0):
        self.most, self.extra, self.slot, self.filled, self.is_open = most, extra, 0, 0, False

    def place(self, n: int) -> int:
        """The slot of the next item, the first of its slots if it takes several."""
        if n > self.most:
            at = self.slot + self.is_open
            self.slot, self.filled, self.is_open = at - (-n // self.most), 0, False
            return at
        if self.is_open and self.filled + n + self.extra > self.most:
            self.slot, self.filled = self.slot + 1, 0
        self.filled, self.is_open = self.filled + n + self.extra, True
        return self.slot


def next_fit(sizes: Column, most: int, extra: int = 0) -> Column:
    """The slots of an array of sizes, such as those of one document's parts. Each step depends on the one before, and a fold in columns would copy what it has so far at each."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([list(map(NextFit(most, extra).place, row.tolist())) for row in rows])

    return run(sizes)


def slots_of(sized: DataFrame, most: int) -> DataFrame:
    """Rows (report_id, ord, slot) of rows (report_id, ord, n): each report's sizes packed in order. A report streams through a task that holds one slot's state, however many documents it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        report, fit = None, None
        for batch in batches:
            slots = []
            for one, n in zip(batch["report_id"].tolist(), batch["n"].tolist(), strict=True):
                if fit is None or one != report:
                    report, fit = one, NextFit(most)
                slots.append(fit.place(n))
            yield batch[["report_id", "ord"]].assign(slot=slots)

    kinds = dict(sized.dtypes)
    in_order = sized.select("report_id", "ord", "n").repartition("report_id").sortWithinPartitions("report_id", "ord")
    return in_order.mapInPandas(run, f"report_id {kinds['report_id']}, ord {kinds['ord']}, slot long")


def pack_chunks(docs: DataFrame, max_chars: int = 80_000) -> DataFrame:
    """(report_id, chunk, n_chunks, text) of documents(): chunks of whole documents in order; one that is too long is split at blank lines, or cut. [INS-4, INS-5]

    A task holds a chunk or a document; chunks are numbered without their texts.
    """
    most = max(MIN_CHUNK, max_chars)
    spark = docs.sparkSession
    docs = runs.written(docs.select("report_id", "ord", "document"), runs.scratch(spark))
    placed = docs.join(slots_of(docs.select("report_id", "ord", F.length("document").alias("n")), most).hint("merge"), ["report_id", "ord"])
    small = placed.where(F.length("document") <= most).select("report_id", "slot", F.lit(0).alias("piece"), "ord", F.lit(0).alias("at"), F.col("document").alias("part"))
    blocks = placed.where(F.length("document") > most).withColumn("bs", F.split("document", "\n\n"))
    inner = F.arrays_zip(F.col("bs").alias("b"), next_fit(F.transform("bs", F.length), most, 2).alias("piece"))
    each = blocks.select("report_id", "slot", "ord", F.posexplode(inner).alias("at", "x")).select("report_id", "slot", "ord", "at", "x.b", "x.piece")
    pieces = F.when(F.length("b") > most, F.transform(F.sequence(F.lit(0), F.ceil(F.length("b") / most).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("b"), i * most + 1, F.lit(most)).alias("t"))))
    cut = each.withColumn("c", F.coalesce(pieces, F.array(F.struct(F.lit(0).alias("i"), F.col("b").alias("t"))))).select("report_id", "slot", "ord", "at", "piece", F.explode("c").alias("c"))
    large = cut.select("report_id", "slot", (F.col("piece") + F.col("c.i")).alias("piece"), "ord", "at", F.col("c.t").alias("part"))
    key = ["report_id", "slot", "piece"]
    parts = small.unionByName(large).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "at", "part"))).alias("p"))
    joined = runs.written(parts.select(*key, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text")), runs.scratch(spark))
    w = Window.partitionBy("report_id")
    numbers = joined.select(*key, F.row_number().over(w.orderBy("slot", "piece")).alias("chunk"), F.count(F.lit(1)).over(w).alias("n_chunks"))
    return joined.join(numbers.hint("merge"), key).select("report_id", "chunk", "n_chunks", "text")


def _by_language(language: Column, en: str, ko: str) -> Column:
    return F.when(language == "ko", F.lit(ko)).otherwise(F.lit(en))


def system_prompt(language: Column) -> Column:
    """What the generator is told about the report's form. [INS-6]"""
    lists = {k: "\n".join(f"## {s}" for s in v) for k, v in SECTIONS.items()}
    return F.concat(F.lit(ROLE), _by_language(language, **LANGUAGES), F.lit(". Its H2 sections are exactly:\n"), _by_language(language, **lists), F.lit(RULES))


def chunk_prompts(chunks: DataFrame, langs: DataFrame) -> DataFrame:
    """(report_id, chunk, n_chunks, language, system, prompt, max_tokens): a final prompt for a report of one chunk, else one for each chunk. [INS-6, INS-7]"""
    lang = F.col("language")
    rows = chunks.join(langs.select("report_id", "language").hint("merge"), "report_id")
    whole = F.concat(_by_language(lang, **ASK_WHOLE), F.col("text"), F.lit("\n"))
    part = F.concat(
        F.lit("Source group "), F.col("chunk").cast("string"), F.lit(" of "), F.col("n_chunks").cast("string"), F.lit(". "),
        _by_language(lang, **ASK_PART), F.col("text"), F.lit("\n"),
    )
    return rows.select("report_id", "chunk", "n_chunks", "language", system_prompt(lang).alias("system"), F.when(F.col("n_chunks") == 1, whole).otherwise(part).alias("prompt"), F.when(F.col("n_chunks") == 1, REPORT_TOKENS).otherwise(PARTIAL_TOKENS).alias("max_tokens"))


def generate(prompts: DataFrame, generate_fn: Callable[[pd.DataFrame], pd.Series], parallel: int | None = None, store: str | None = None, per_call: int = 16) -> DataFrame:
    """prompts with output: generate_fn(rows with system, prompt, max_tokens) gives a text for each row. parallel bounds how many tasks call at once. [UDF-2]

    With store, a folder that all executors reach, each call's outputs are written there under the digests of their prompts as soon as they are given, and what
    is there is not asked again: a run that failed goes on where it stopped, and equal prompts are asked once. A call gets at most per_call prompts.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", output string"
    if store is None:
        rows = prompts if parallel is None else prompts.repartition(parallel)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(output=generate_fn(batch))

        return rows.mapInPandas(run, schema)
    spark = prompts.sparkSession
    digest = F.sha2(F.concat_ws("\0", "system", "prompt", F.col("max_tokens").cast("string")), 256)
    keyed = runs.written(prompts.withColumn("_digest", digest), runs.scratch(spark))
    todo = keyed.join(_outputs(spark, store).select("_digest").hint("merge"), "_digest", "left_anti").dropDuplicates(["_digest"])
    dealt = todo.repartition(*([parallel] if parallel else []), "_digest").sortWithinPartitions("_digest")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pyarrow.fs.FileSystem.from_uri(store if "://" in store else f"file://{store}")
        files.create_dir(base, recursive=True)
        for batch in batches:
            for at in range(0, len(batch), per_call):
                some = batch.iloc[at : at + per_call].reset_index(drop=True)
                made = pa.table({"_digest": pa.array(some["_digest"], pa.string()), "output": pa.array(list(generate_fn(some.drop(columns="_digest"))), pa.string())})
                part = f"{base}/.{uuid.uuid4().hex}"
                pq.write_table(made, part, filesystem=files)
                files.move(part, f"{base}/{some['_digest'][0]}-{len(some)}.parquet")
                yield pd.DataFrame({"n": [len(some)]})

    # A batch is as many bytes in Python several times over, and prompts are long.
    with runs.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", PROMPT_ROWS // per_call * per_call or per_call):
        dealt.mapInPandas(ask, "n long").agg(F.sum("n")).collect()
    # Written: two scans of one folder count as the same in a plan, though it has grown between them.
    return runs.written(keyed.join(_outputs(spark, store).hint("merge"), "_digest").select(*prompts.columns, "output"), runs.scratch(spark))


def _outputs(spark: SparkSession, store: str) -> DataFrame:
    """Rows (_digest, output) of what was generated, each prompt once."""
    schema = "_digest string, output string"
    if runs.kind(spark, store) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store).groupBy("_digest").agg(F.min("output").alias("output"))


def merge_prompts(partials: DataFrame) -> DataFrame:
    """One prompt for each report of several chunks, of its partial findings in order. [INS-6, INS-7]"""
    gathered = partials.groupBy("report_id", "language", "system").agg(F.array_sort(F.collect_list(F.struct("chunk", "output"))).alias("o"))
    joined = F.array_join(F.transform("o", lambda x: x["output"]), BETWEEN)
    lead = _by_language(F.col("language"), **ASK_MERGE)
    return gathered.select("report_id", F.lit(0).alias("chunk"), F.size("o").alias("n_chunks"), "language", "system", F.concat(lead, joined, F.lit("\n")).alias("prompt"), F.lit(REPORT_TOKENS).alias("max_tokens"))


def ensure_sections(markdown: Column, language: Column) -> Column:
    """The report with a heading and a fallback line for each section that it lacks. [INS-8]"""
    text = F.regexp_replace(markdown, r"(?U)^\s+|\s+\z", "")

    def fill(code: str) -> Column:
        names = F.array(*[F.lit(s) for s in SECTIONS[code]])
        lost = F.filter(names, lambda s: ~F.contains(text, F.concat(F.lit("## "), s)))
        added = F.array_join(F.transform(lost, lambda s: F.concat(F.lit("\n## "), s, F.lit(f"\n\n{FALLBACK[code]}"))), "\n")
        return F.when(F.size(lost) == 0, F.concat(text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n"), added, F.lit("\n")))

    return F.when(language == "ko", fill("ko")).otherwise(fill("en"))


def build_reports(
    selected: DataFrame, conversations: DataFrame, messages: DataFrame, generate_fn: Callable[[pd.DataFrame], pd.Series], work_dir: str, max_chars: int = 80_000, parallel: int | None = None, provider: str = "", model: str = "", created_at: str | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Reports of all selections, as insight_reports rows: map over chunks, then merge. [INS-1..8, SNK-5, AGG-7]

    What the generator gave is kept in work_dir by the digests of prompts, so calling again with the same work_dir after a failure asks only for the rest. An id is made
    of what went in and of what came out. created_at is by default the present time; titles, rows (report_id, title), names reports, others are "Report" and their number.
    An empty selection, and selected ids that do not exist, raise ValueError.
    """
    if not selected.where("conversation_id is null").isEmpty():
        raise ValueError("At least one conversation must be selected.")
    lost = missing(selected, conversations)
    if names := lost.limit(5).collect():
        raise ValueError(f"Conversation not found: {names[0]['missing']}")
    created_at = created_at or datetime.now(UTC).isoformat()
    rows = inputs(selected, conversations, messages)
    prompts = chunk_prompts(pack_chunks(documents(rows), max_chars), languages(rows))
    done = generate(prompts, generate_fn, parallel, f"{work_dir}/outputs")
    merged = generate(merge_prompts(done.where("n_chunks > 1")), generate_fn, parallel, f"{work_dir}/outputs")
    texts = done.where("n_chunks = 1").select("report_id", "language", "output").unionByName(merged.select("report_id", "language", "output"))
    ids = selected.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "conversation_id"))), lambda r: r["conversation_id"]).alias("selected_conversation_ids"))
    body = texts.withColumn("markdown", ensure_sections(F.col("output"), F.col("language"))).join(ids.hint("merge"), "report_id")
    numbered = F.concat(F.lit("Report "), F.col("report_id").cast("string"))
    named = body.withColumn("title", numbered) if titles is None else body.join(titles.select("report_id", "title").hint("merge"), "report_id", "left").withColumn("title", F.coalesce("title", numbered))
    made_of = F.concat_ws("\0", F.to_json("selected_conversation_ids"), F.lit(provider), F.lit(model), F.lit(created_at), "title", F.sha2("markdown", 256))
    return named.select(F.substring(F.sha2(made_of, 256), 1, 32).alias("id"), "title", "selected_conversation_ids", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "markdown", F.lit(created_at).alias("created_at"))


def summaries(reports: DataFrame) -> DataFrame:
    """Reports without their text, as a list of them shows. [PRJ-2]"""
    return reports.drop("markdown")


def measures(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(report_id, source_count, chunk_count, source_chars, context_chars, calls) [AGG-7]"""
    sources = rows.groupBy("report_id").agg(F.countDistinct("ord").alias("source_count"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("source_chars"))
    packed = chunks.groupBy("report_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("text")).alias("context_chars"))
    return sources.join(packed.hint("merge"), "report_id").withColumn("calls", F.when(F.col("chunk_count") == 1, F.lit(1).cast("long")).otherwise(F.col("chunk_count") + 1))


def parsed_json(output: Column) -> Column:
    """A generator's output as JSON: code fences are taken off; null if it is none. [UDF-3]"""
    bare = F.regexp_replace(F.regexp_replace(F.trim(output), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.try_parse_json(bare)


def outline(reports: DataFrame, deepest: int = 3) -> DataFrame:
    """(report_id, line, level, text, heading_id) of the headings of reports (id, title, markdown); a report without any gives one row of its title. [INS-11, WIN-6]"""
    lines = reports.select(F.col("id").alias("report_id"), F.posexplode(F.split("markdown", "\r?\n")).alias("line", "raw"))
    mark = HEADING
    found = lines.where(F.col("raw").rlike(mark)).select("report_id", "line", F.length(F.regexp_extract("raw", mark, 1)).alias("level"), T.strip_inline_markdown(F.regexp_extract("raw", mark, 2)).alias("text")).where("text <> ''")
    named = found.withColumn("slug", T.heading_slug(F.col("text")))
    k = F.row_number().over(Window.partitionBy("report_id", "slug").orderBy("line"))
    ids = named.withColumn("heading_id", F.when(k == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), k.cast("string")))).where(F.col("level") <= deepest)
    shown = ids.select("report_id", "line", "level", "text", "heading_id")
    bare = reports.select(F.col("id").alias("report_id"), F.lit(0).alias("line"), F.lit(1).alias("level"), F.col("title").alias("text"), F.lit("report-top").alias("heading_id"))
    return shown.unionByName(bare.join(shown.select("report_id").distinct().hint("merge"), "report_id", "left_anti"))
