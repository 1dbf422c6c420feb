"""The deterministic parts of question answering: intent, keywords, retrieval, citations, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.names import base_name, handed_out, texts_holding
from codestrata.operators.store import newest_contents
from codestrata.operators.vectors import nearest
from codestrata.session import Stage

# Intent patterns in the order they are tried.
INTENTS = (
    (r"重构.*需要.*修改|需要同步修改", "impact"),
    (r"如果.*(改|修|重构|变更).*影响|变更影响|影响范围", "impact"),
    (r"(影响|重构|改动|修改|更改|改).*(影响|波及|涉及|同步|需要)", "impact"),
    (r"(谁|哪些|什么|哪里).*(调用|使用|引用|用到)", "callers"),
    (r"被.*(调用|使用|引用|用到)", "callers"),
    (r"调用.*了.*哪些|调用了什么|调用链|调用关系(?!.*多少条)", "callees"),
    (r"里面.*(调用|使用).*什么|方法.*调用|函数.*调用", "callees"),
    (r"搜索|查找|找到|找出|有没有.*(函数|方法|相关)", "search"),
    (r"(函数|方法|接口).*(详情|介绍|干什么|作用|干嘛的|做什么)", "detail"),
    (r"详细介绍|详细说说|详细信息", "detail"),
    (r"文件.*(结构|函数|类|内容|什么)", "structure"),
    (r"\\.\w+.*(有|里).*(什么|哪些)|(有|里).*(什么|哪些).*\.\w+", "structure"),
    (r"\.\w+.*(里|中|里面).*(干嘛|干什么|作用|做|什么|哪些)", "structure"),
    (r"\.\w+.*(干嘛|干什么|作用|做啥)", "detail"),
    (r"里(面|头|边).*(什么|哪些)", "structure"),
    (r"总共有|有多少|总共有多少|几个|多少条|多少.*函数|多少.*类", "stats"),
    (r"统计|概览|总览|规模|多大", "stats"),
    (r"调用关系.*多少条|多少条.*调用", "stats"),
)
# Patterns of citations, call-shaped words, unresolved and truncated answers.
CITATION = r"\[([^\[\]]*[A-Za-z][^\[\]]*)\]"
# Patterns of quoted, named, other and capitalised identifiers in a question.
QUOTED = '["「」]([^"「」]+)["「」]'
NAMED = r"(?:函数|方法|接口)\s*[:：]?\s*([a-zA-Z_][a-zA-Z0-9_.]*)"
IDENTIFIER = "([a-zA-Z_][a-zA-Z0-9_.]+)"
CAPITALISED = "([A-Z][a-zA-Z0-9_]{2,})"
CALL_WORD = r"\b([a-zA-Z_][a-zA-Z0-9_]{1,})\s*\("
UNRESOLVED = "无法确定|未找到|没有找到|信息不足|数据不足|不完整"
TRUNCATED = "__truncated__|已省略|截断"
SPECULATIVE = "推测"

MAX_FILES, MAX_CONTEXT = 6, 40_000


def intent(question: Column) -> Column:
    """The intent of the first pattern that is found, else ``unknown``; null for a null question."""
    out = F.when(question.isNull(), F.lit(None).cast("string"))
    for pattern, name in INTENTS:
        out = out.when(question.rlike(pattern), name)
    return out.otherwise("unknown")


def keywords(question: Column) -> Column:
    """Candidate identifiers, distinct, the longest first and equal lengths in order of appearance."""
    quoted, words, classes = (F.regexp_extract_all(question, F.lit(p), 1) for p in (QUOTED, IDENTIFIER, CAPITALISED))
    named = F.regexp_extract(question, NAMED, 1)
    every = F.array_distinct(F.filter(F.concat(quoted, F.array(named), words, classes), lambda w: w != ""))
    ranked = F.transform(every, lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("at"), w.alias("word")))
    return F.transform(F.array_sort(ranked), lambda s: s["word"])


def raw_keyword(question: Column) -> Column:
    """The identifier a question is about: quoted, else named, else the longest with a dot, else the longest; null if there is none."""
    quoted = F.get(F.regexp_extract_all(question, F.lit(QUOTED), 1), 0)
    named = F.nullif(F.regexp_extract(question, NAMED, 1), F.lit(""))
    words = F.regexp_extract_all(question, F.lit(IDENTIFIER), 1)
    ranked = F.transform(words, lambda w, i: F.struct((~F.contains(w, F.lit("."))).alias("plain"), (-F.length(w)).alias("size"), i.alias("at"), w.alias("word")))
    return F.coalesce(quoted, named, F.get(F.array_sort(ranked), 0)["word"])


def questions(items: DataFrame) -> DataFrame:
    """item_id, detected intent, whether it is the expected one, and the keywords joined by spaces."""
    found = intent(F.col("question"))
    return items.select("item_id", found.alias("detected"), (found == F.col("expected_type")).alias("intent_correct"),
                        F.array_join(keywords(F.col("question")), " ").alias("words"))


def question_functions(items: DataFrame, functions: DataFrame) -> DataFrame:
    """item_id and the qualified name found for its longest keyword that any function's name contains.

    Of the functions that match, the first by path, line and id counts. The
    keywords are few, so they are made distinct before they meet the names.
    """
    asked = items.select("item_id", F.posexplode(keywords(F.col("question"))).alias("at", "word"))
    words = asked.select(F.lower("word").alias("low")).distinct()
    named = functions.where("qualified_name is not null").groupBy(F.lower("qualified_name").alias("q")).agg(
        F.min(F.struct("path", "start_line", "func_id", "qualified_name")).alias("best"))
    hit = texts_holding(named, "q", handed_out(words, "low"), "low").groupBy("low").agg(F.min("best").alias("best"))
    return (
        asked.join(hit, F.lower("word") == F.col("low"))
        .groupBy("item_id").agg(F.min(F.struct("at", F.col("best.qualified_name").alias("name"))).alias("m"))
        .select("item_id", F.col("m.name").alias("qualified_name"))
    )


def occurrences(text: Column, word: str) -> Column:
    """How often a literal word stands in a text, without overlaps, whatever the case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / len(word)).cast("int")


def naive_retrieval(contents: DataFrame, word: str, n: int = MAX_FILES) -> DataFrame:
    """The n files that hold a word most often, ties by file_id."""
    hits = contents.where("content is not null").select("file_id", occurrences(F.col("content"), word).alias("hits"), F.length("content").alias("size"))
    return hits.where("hits > 0").orderBy(F.desc("hits"), "file_id").limit(n)


def context_budget(retrieved: DataFrame, budget: int = MAX_CONTEXT) -> DataFrame:
    """Characters taken of each retrieved file in rank order; the file that crosses the budget is cut, later ones drop out."""
    order = Window.orderBy(F.desc("hits"), "file_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    return retrieved.withColumn("before", before).where(F.col("before") < budget).select(
        "file_id", "size", F.least(F.col("size"), F.lit(budget) - F.col("before")).alias("taken")
    )


def question_retrieval(items: DataFrame, files: DataFrame, contents: DataFrame, stage: Stage, n: int = MAX_FILES) -> DataFrame:
    """item_id, rank, file_id, tier, hits, path, size and blank: the n files read for each question.

    Of the files with content those count whose base name contains the
    keyword's (tier 1), else those whose text does in any case, by hits (2),
    else all by bytes (3), as for a question without keyword; ties by file_id.
    The keywords are few, so they are made distinct before they meet the texts.
    """
    known = files.where("file_id is not null and path is not null").groupBy("file_id").agg(F.min("path").alias("path"))
    texts = stage.keep(newest_contents(contents).join(known, "file_id").select(
        "file_id", "path", "content", F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").alias("size"),
        F.octet_length("content").alias("bytes"), (~F.col("content").rlike(r"\S")).alias("blank")))
    asked = stage.keep(items.select("item_id", raw_keyword(F.col("question")).alias("word")))
    words = asked.select("word").distinct()
    shown = ["file_id", "path", "size", "blank"]

    def best(rows: DataFrame, tier: int, order: list) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("word").orderBy(*order, "file_id"))
        return stage.keep(rows.withColumn("rank", at).where(F.col("rank") <= n).select("word", "rank", F.lit(tier).alias("tier"), "hits", *shown))

    based = F.broadcast(words.withColumn("base", F.element_at(F.split("word", "/"), -1)).where("base <> ''"))
    named = best(texts.drop("content").join(based, F.contains("name", F.col("base"))).withColumn("hits", F.lit(0)), 1, [])
    rest = F.broadcast(words.where("word is not null").join(named, "word", "left_anti").withColumn("low", F.lower("word")))
    count = (F.length("text") - F.length(F.replace("text", F.col("low"), F.lit("")))) / F.length("low")
    held = texts.select(*shown, F.lower("content").alias("text")).join(rest, F.contains("text", F.col("low")))
    held = best(held.select("word", *shown, count.cast("int").alias("hits")), 2, [F.desc("hits")])
    found = named.unionByName(held)
    small = texts.orderBy("bytes", "file_id").limit(n).select(*shown, "bytes", F.lit(0).alias("hits"))
    found = found.unionByName(best(words.join(found, "word", "left_anti").crossJoin(small), 3, ["bytes"]))
    return asked.alias("a").join(found.alias("f"), F.col("a.word").eqNullSafe(F.col("f.word"))).select(
        "item_id", "rank", "file_id", "tier", "hits", "path", "size", "blank")


def question_budget(retrieved: DataFrame, budget: int = MAX_CONTEXT) -> DataFrame:
    """item_id, rank, file_id, block and taken: characters of each file's block, with its head line, that fit a question's budget."""
    order = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    block = F.length(F.concat(F.lit("===== FILE: "), "path", F.lit(" =====\n"))) + F.col("size")
    blocks = retrieved.where("not blank").withColumn("block", block).withColumn("before", F.coalesce(F.sum("block").over(order), F.lit(0)))
    return blocks.where(F.col("before") < budget).select(
        "item_id", "rank", "file_id", "block", F.least(F.col("block"), F.lit(budget) - F.col("before")).alias("taken"))


def call_words(contents: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file: distinct words called, and how many of them are names of functions."""
    words = contents.where("content is not null").select(
        "file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL_WORD), 1))).alias("word"))
    known = functions.select(F.col("name").alias("word")).where("word is not null").distinct().withColumn("known", F.lit(1))
    return words.join(known, "word", "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("words"), F.count("known").alias("known"))


def claims(answers: DataFrame) -> DataFrame:
    """item_id, claim_no, statement, citations (array) and speculative, one row per non-blank line of an answer."""
    lines = answers.select("item_id", F.posexplode(F.split("answer", "\n")).alias("claim_no", "line")).withColumn("statement", F.trim("line"))
    return lines.where("statement <> ''").select(
        "item_id", "claim_no", "statement", F.regexp_extract_all("statement", F.lit(CITATION), 1).alias("citations"),
        F.contains("statement", F.lit(SPECULATIVE)).alias("speculative"))


def valid_paths(*columns: DataFrame) -> DataFrame:
    """path, distinct: the strings of one-column frames that hold ``.py``, ``/`` or a backslash."""
    every = columns[0].toDF("path")
    for c in columns[1:]:
        every = every.union(c.toDF("path"))
    return every.where(F.contains("path", F.lit(".py")) | F.contains("path", F.lit("/")) | F.contains("path", F.lit("\\"))).distinct()


def cited_files(stated: DataFrame) -> DataFrame:
    """item_id, claim_no and file of each citation: what stands before its first ``:``."""
    return stated.select("item_id", "claim_no", F.explode("citations").alias("c")).withColumn("file", F.trim(F.element_at(F.split("c", ":"), 1)))


def citation_gate(answers: DataFrame, paths: DataFrame) -> DataFrame:
    """item_id, verified, caught, confidence and passed: whether the cited files exist.

    A citation's file is valid if it stands in a known path, as the whole, the
    base name or any other part of it. A claim with any bad citation is caught,
    claims without citations count for neither side. The cited files are few
    and kept, so the runs of the paths need not be shuffled to meet them.
    """
    cited = cited_files(claims(answers).where("not speculative")).select("item_id", "claim_no", "file")
    cited = Stage(answers.sparkSession, "citations").keep(cited)
    asked = cited.select("file").distinct()
    known = texts_holding(paths.select("path").distinct(), "path", handed_out(asked, "file"), "file").select("file").distinct().withColumn("valid", F.lit(1))
    judged = cited.join(known, "file", "left").groupBy("item_id", "claim_no").agg(F.count_if(F.col("valid").isNull()).alias("bad"))
    sums = judged.groupBy("item_id").agg(F.count_if(F.col("bad") == 0).alias("verified"), F.count_if(F.col("bad") > 0).alias("caught"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero(F.col("verified")) + zero(F.col("caught"))
    confidence = F.when(total > 0, zero(F.col("verified")) / total).otherwise(F.lit(1.0))
    return answers.select("item_id").distinct().join(sums, "item_id", "left").select(
        "item_id", zero(F.col("verified")).alias("verified"), zero(F.col("caught")).alias("caught"),
        F.round(confidence, 6).alias("confidence"), (confidence >= 0.5).alias("passed"))


def scores(items: DataFrame, answers: DataFrame, gate: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, category and score: the mean of intent, keywords, count, confidence and plain statement.

    ``counts`` has item_id and result_count; a missing count is 0 and a missing
    min_count is always met. Without keywords that part is met.
    """
    low = F.lower("answer")
    has = F.when(F.coalesce(F.size("keywords"), F.lit(-1)) <= 0, True).otherwise(F.forall("keywords", lambda k: F.contains(low, F.lower(k))))
    met = items.join(answers, "item_id", "left").join(gate, "item_id", "left").join(counts, "item_id", "left")
    right = F.coalesce(intent(F.col("question")) == F.col("expected_type"), F.lit(False))
    enough = F.col("min_count").isNull() | (F.coalesce("result_count", F.lit(0)) >= F.col("min_count"))
    honest = F.when(F.contains(F.coalesce("answer", F.lit("")), F.lit(SPECULATIVE)), 0.5).otherwise(1.0)
    part = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = (part(right) + part(has) + part(enough) + F.coalesce("confidence", F.lit(1.0)) + honest) / 5
    return met.select("item_id", "category", F.round(score, 6).alias("score"))


def mentioned(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """item_id and result_count: distinct call-shaped words of an answer among the item's ``vocabulary`` (item_id, word)."""
    said = answers.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CALL_WORD), 1))).alias("word"))
    counts = said.join(vocabulary.distinct(), ["item_id", "word"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("result_count"))
    return answers.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("result_count", F.lit(0)).alias("result_count"))


def baseline_confidence(answers: DataFrame, read: DataFrame) -> DataFrame:
    """item_id, verified, bad and confidence: a claim with citations is verified if any of them is one of the files ``read`` (item_id, path).

    Few files are read for an item, so the paths are compared per item.
    """
    cited = cited_files(claims(answers).where("not speculative")).where("file <> ''")
    inside = F.contains(F.col("path"), F.col("file")) | (base_name(F.col("path")) == F.col("file"))
    good = cited.join(read.select("item_id", "path").distinct(), "item_id").where(inside).select("item_id", "claim_no").distinct().withColumn("good", F.lit(1))
    sums = claims(answers).where("not speculative and size(citations) > 0").select("item_id", "claim_no").join(good, ["item_id", "claim_no"], "left").groupBy(
        "item_id").agg(F.count("good").alias("verified"), (F.count(F.lit(1)) - F.count("good")).alias("bad"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    confidence = F.coalesce(F.col("verified") / (F.col("verified") + F.col("bad")), F.lit(1.0))
    return answers.select("item_id").distinct().join(sums, "item_id", "left").select("item_id", zero("verified"), zero("bad"), F.round(confidence, 6).alias("confidence"))


def is_empty(results: Column, detail: Column) -> Column:
    """Whether a look-up gave neither results (a count) nor a detail."""
    return (F.coalesce(results, F.lit(0)) == 0) & detail.isNull()


def fallback_results(items: DataFrame, vectors: DataFrame, stored: DataFrame, n: int = 3) -> DataFrame:
    """item_id, vec_id and rank: the n stored vectors nearest to each question whose intent is unknown or search.

    ``vectors`` has the questions' own (item_id, embedding). An empty store
    gives no row, so the look-up's result stays.
    """
    asked = items.where(intent(F.col("question")).isin("unknown", "search")).select("item_id")
    own = vectors.join(asked, "item_id").select(F.col("item_id").alias("vec_id"), "embedding")
    return nearest(own, stored, n).select(F.col("query_id").alias("item_id"), "vec_id", "rank")


def json_parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, object and array: what stands between the first and last brace and bracket of a text, null if there is none.

    What does not parse as JSON is null too.
    """
    def part(pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
        # the parser stops at the first value's end; inside an object, text after it is an error
        return F.when(F.try_parse_json(F.concat(F.lit('{"x":'), found, F.lit("}"))).isNotNull(), found)

    return texts.select(key, part(r"(?s)\{.*\}").alias("object"), part(r"(?s)\[.*\]").alias("array"))


def report(scored: DataFrame) -> DataFrame:
    """Per category: questions, passed (score of at least 0.7) and mean score."""
    return scored.groupBy("category").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("score") >= 0.7).alias("passed"),
                                          F.round(F.avg("score"), 6).alias("mean_score"))


def reflect_verdict(answers: DataFrame) -> DataFrame:
    """item_id and why an answer needs another round: tool_error, truncated, unresolved, no_citation or none.

    A column ``tool_error`` (boolean) says that a step failed; without it none did.
    """
    failed = F.coalesce(F.col("tool_error"), F.lit(False)) if "tool_error" in answers.columns else F.lit(False)
    verdict = (
        F.when(failed, "tool_error").when(F.col("answer").rlike(TRUNCATED), "truncated").when(F.col("answer").rlike(UNRESOLVED), "unresolved")
        .when(~F.col("answer").rlike(CITATION) & (F.size(keywords(F.col("question"))) > 0), "no_citation").otherwise("none")
    )
    return answers.select("item_id", verdict.alias("verdict"))


def shortened_lists(rows: DataFrame, group: str, order: list[str], keep: int = 20) -> DataFrame:
    """group, kept and omitted: lengths of lists cut to ``keep`` items in the given order."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(group, F.least("n", F.lit(keep)).alias("kept"), F.greatest(F.col("n") - keep, F.lit(0)).alias("omitted"))


def kept_items(rows: DataFrame, group: str, order: list[str], keep: int = 20) -> DataFrame:
    """The first ``keep`` rows of each group with their position ``at`` and how many of the group are ``omitted``."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    counts = rows.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("omitted"))
    first = rows.select(group, *order).withColumn("at", at).where(F.col("at") <= keep)
    return first.join(counts, group).select(group, *order, "at", "omitted")


def result_summary(kept: DataFrame, group: str, item: Column, longest: int = 8_000) -> DataFrame:
    """group, summary (compact JSON of its kept items and how many are omitted, cut to ``longest`` characters) and its whole length.

    ``kept`` are the rows of ``kept_items``, so a group is never longer than its list.
    """
    lists = kept.select(group, "omitted", F.struct("at", item.alias("item")).alias("x")).groupBy(group, "omitted").agg(F.array_sort(F.collect_list("x")).alias("items"))
    text = F.to_json(F.struct(F.col(group), F.transform("items", lambda x: x["item"]).alias("items"), F.col("omitted")))
    return lists.select(group, F.substring(text, 1, longest).alias("summary"), F.length(text).alias("chars"))
