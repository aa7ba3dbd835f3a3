"""Evaluation as one plan: dataset and split, retrieval, prompts, responses, answers, scores and metrics.

The condition is a column, not a loop: all conditions of a run go through one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.calculator import run_program_udf
from quern.functions.prompts import prompt
from quern.operators import allocation, metrics, retrieval
from quern.sources.store import missing_only, with_citations
from quern.tables import stored

#: Conditions of a run, which are settings.
CONDITIONS = 1000


def dataset(questions: DataFrame, citations: DataFrame, part: str = "full", families: list[str] | None = None, limit: int | None = None, dev_target: int = 5) -> DataFrame:
    """Questions with their citations: a split, or named families instead, and the first `limit` by number."""
    rows = with_citations(questions, citations)
    if families:
        known = {r[0] for r in rows.filter(F.col("family").isin(families)).select("family").distinct().collect()}
        if set(families) - known:
            raise ValueError(f"unknown families: {sorted(set(families) - known)}")
        rows = rows.filter(F.col("family").isin(families))
    elif part not in ("full", "all"):
        keyed = rows.withColumns({"pos": F.col("no"), "category": F.col("tax_category")})
        rows = allocation.split(keyed, dev_target, part).drop("pos", "category")
    return rows.orderBy("no").limit(limit) if limit and limit > 0 else rows


def passages(questions: DataFrame, corpus: DataFrame, k: int, metadata: DataFrame | None = None) -> DataFrame:
    """(no, passages): the best k passages of each question by BM25, time-aware where metadata is given."""
    q = questions.select(F.col("no").alias("query_id"), F.col("question").alias("query"), "case_year")
    scores = retrieval.boosted(retrieval.bm25(corpus, q), corpus, q, metadata)
    best = retrieval.top(scores, k)
    if metadata is not None:
        best = retrieval.injected(best, q, retrieval.parameter_passages(corpus, metadata), k)
    own = F.array_sort(F.collect_list(F.struct("rank", "title", "text", "source_id", "chunk_id")))
    return best.join(corpus, "chunk_id").groupBy(F.col("query_id").alias("no")).agg(own.alias("passages"))


def prompts(questions: DataFrame, conditions: list[str], found: DataFrame) -> DataFrame:
    """(no, condition, key, prompt, ...) for each question and condition; key is a hash of the prompt and condition."""
    rows = questions.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).join(found, "no", "left")
    own = prompt(*map(F.col, ("condition", "country", "case_year", "question", "citations", "passages")))
    return rows.withColumn("prompt", own).withColumn("key", F.sha2(F.concat_ws("\x1f", "condition", "prompt"), 256))


def responses(asked: DataFrame, done: DataFrame | None, responder: Callable, parallel: int = 8) -> DataFrame:
    """(key, raw_response): valid earlier ones and, for keys without one, what the responder gives."""
    todo = asked.select("key", "prompt").dropDuplicates(["key"])
    if done is None:
        return todo.repartition(parallel).mapInPandas(responder, "key string, prompt string, raw_response string").select("key", "raw_response")
    new = missing_only(todo, done, "key").repartition(parallel).mapInPandas(responder, "key string, prompt string, raw_response string")
    return done.filter("raw_response is not null and not startswith(raw_response, '[EVALUATION ERROR')").select("key", "raw_response").unionByName(new.select("key", "raw_response"))


def answered(asked: DataFrame, given: DataFrame) -> DataFrame:
    """asked with pred_value, pred_unit and answer_state: of the last program if it was read and has a result, else of the text.

    answer_state: program, text, 'program not read' (outside of the grammar, or without a result; the answer is then that of
    the text outside of all programs, which may be none), or none without a response.
    """
    fence = r"(?i)```(?:python)?\s*([\s\S]*?)```"
    rows = asked.join(given, "key", "left")
    block = F.when(F.col("raw_response").contains("```"), F.try_element_at(F.regexp_extract_all("raw_response", F.lit(fence), F.lit(1)), F.lit(-1)))
    rows = rows.withColumn("program_value", run_program_udf(block))
    ran, unread = F.col("program_value").isNotNull(), block.isNotNull() & F.col("program_value").isNull()
    rest = F.trim(F.regexp_replace("raw_response", fence, "\n"))
    plain = text.answer(F.when(unread, F.nullif(rest, F.lit(""))).otherwise(F.col("raw_response")))
    state = F.when(ran, "program").when(unread, "program not read").when(F.col("raw_response").isNotNull(), "text").otherwise("none")
    value = F.when(ran, text.answer(F.col("program_value"))["value"]).otherwise(plain["value"])
    return rows.withColumns({"pred_value": value, "pred_unit": F.when(~ran, plain["unit"]), "answer_state": state}).drop("program_value")


def unread_share(answers: DataFrame) -> DataFrame:
    """(condition, responses, not_read): the share of responses whose program was not read."""
    return answers.groupBy("condition").agg(F.count("raw_response").alias("responses"), F.round(F.avg((F.col("answer_state") == "program not read").cast("double")), 6).alias("not_read"))


def summary(records: DataFrame) -> DataFrame:
    """Metrics by condition."""
    gold = F.coalesce("answer_value", F.lit(text.INSUFFICIENT))
    return metrics.overall(metrics.scored(records.withColumn("gold_answer", gold)), "condition")


def bootstrap(rows: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(low, high): 95 % interval of solvable accuracy by resampling whole families with Poisson(1) weights.

    Weights are hashes of family and round, so families are summed once and reruns agree.
    """
    each = rows.groupBy("family").agg(F.count_if("solvable").alias("n"), F.count_if(F.col("solvable") & F.col("exact")).alias("k"))
    drawn = each.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.shiftrightunsigned(F.xxhash64("family", "round", F.lit(seed)), 11) / F.lit(float(1 << 53))
    limits = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    weight = sum(((u >= c).cast("int") for c in limits), F.lit(0))
    means = drawn.withColumn("w", weight).groupBy("round").agg((F.sum(F.col("w") * F.col("k")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def paired(records: DataFrame, base: str) -> DataFrame:
    """(condition, both, neither, gained, lost, only_here, only_base): each other condition's exact answers beside those of a base condition, by question.

    gained: exact here and not in the base; lost: the other way; a question that one of the two lacks counts in only_here or only_base.
    A question is counted once a condition: right if any of its records is.
    """
    each = metrics.scored(records.withColumn("gold_answer", F.coalesce("answer_value", F.lit(text.INSUFFICIENT))))
    each = each.groupBy("condition", "no").agg(F.max(F.coalesce("exact", F.lit(False))).alias("ok"))
    others = [r[0] for r in each.select("condition").filter(F.col("condition") != base).distinct().limit(CONDITIONS + 1).collect()]
    if len(others) > CONDITIONS:
        raise ValueError(f"more than {CONDITIONS} conditions")
    own = each.filter(F.col("condition") == base).select("no", F.col("ok").alias("base_ok"), F.explode(F.array(*map(F.lit, others)).cast("array<string>")).alias("condition"))
    rows = own.join(each.filter(F.col("condition") != base), ["condition", "no"], "full_outer")
    n = lambda c, name: F.count_if(c).alias(name)
    ok, was = F.col("ok"), F.col("base_ok")
    return rows.groupBy("condition").agg(n(ok & was, "both"), n(~ok & ~was, "neither"), n(ok & ~was, "gained"), n(~ok & was, "lost"), n(was.isNull(), "only_here"), n(ok.isNull(), "only_base"))


def write_run(records: DataFrame, folder: str, run: dict[str, str], base: str | None = None) -> None:
    """records, summary and comparison of a run below a folder: records by (condition, question number), read back in that order by file.

    run (country, split, model and the like) stands in each row of summary and comparison; a comparison needs a base condition.
    """
    given, records = {k: F.lit(v) for k, v in run.items()}, stored(records, "records")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.repartitionByRange(n, "condition", "no").sortWithinPartitions("condition", "no")
    dealt.write.mode("overwrite").partitionBy("condition").json(f"{folder}/records")
    summary(records).withColumns(given).write.mode("overwrite").json(f"{folder}/summary")
    if base is not None:
        paired(records, base).withColumns(given | {"base": F.lit(base)}).write.mode("overwrite").json(f"{folder}/comparison")
