"""Queries of the operators in this subpackage, with SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasm.llm import bpe, pack, quantiles, residue, runs, skeleton, spans
from rasm.session import checkpoint, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _report(spark: SparkSession, d: str) -> DataFrame:
    return spans.report(spans.records(table(spark, d, "chunk_results"), table(spark, d, "ayah_entries")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("rec_key")


def p1_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record stands elsewhere."""
    return _report(spark, d).select("rec_key", "spans", "covered", "length", F.round(F.col("covered") / F.col("length"), 6).alias("share"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """The results kept per day, as a written table."""
    return checkpoint(quantiles.daily(table(spark, d, "eval_rows"), "eval_id", "reciter", "evaluated_at", ["raw_wer", "corrected_cer"], "ingested_at"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per reciter and metric over all days."""
    return quantiles.summarize(_daily(spark, d), ["group", "metric"]).withColumnRenamed("group", "reciter")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Per month of evaluation, all reciters together, from the same daily summaries."""
    return quantiles.summarize(_daily(spark, d).withColumn("month", F.trunc("day", "month")), ["month", "metric"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return skeleton.found(t("chunk_results"), t("eval_rows"), t("labeled_examples"), t("ayah_entries"), t("corpus_source"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all four columns that share a skeleton with another text."""
    cols = [("chunk_results", "raw_asr"), ("eval_rows", "ref"), ("labeled_examples", "predicted_word"), ("ayah_entries", "text")]
    one, *rest = [table(spark, d, t).select(F.col(c).alias("text")) for t, c in cols]
    for r in rest:
        one = one.unionByName(r)
    return skeleton.groups(one, "text").where("variants > 1")


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "chunk_results"), "session_id", "chunk_index", "matched_ayah", "start_time_s", "end_time_s", "received_at", least)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _runs(spark, d, 2).select(c("entity").alias("session_id"), c("first_index").cast("int").alias("first_chunk_index"), c("last_index").cast("int").alias("last_chunk_index"))


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _runs(spark, d, 1).select(c("entity").alias("session_id"), c("event").cast("int").alias("matched_ayah"), c("first_index").cast("int").alias("first_chunk_index"), c("last_index").cast("int").alias("last_chunk_index"), c("n").alias("chunks"), c("from_s"), c("to_s"))


def p5_text_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more chunks of a session with nearly the same text: the same letters, whatever else stands between them."""
    c = F.col
    letters = F.regexp_replace(F.coalesce("corrected_text", F.lit("")), r"[^\p{L}]", "")
    event = F.when(letters != "", F.xxhash64(letters))
    r = runs.collapse_runs(table(spark, d, "chunk_results"), "session_id", "chunk_index", event, "start_time_s", "end_time_s", "received_at", 2)
    return r.select(c("entity").alias("session_id"), c("first_index").cast("int").alias("first_chunk_index"), c("last_index").cast("int").alias("last_chunk_index"), c("n").alias("chunks"), c("from_s"), c("to_s"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_texts(spark, d), "text")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(bpe.count_tokens(_texts(spark, d), "text"), "doc_id", "n_tokens", 2048)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents").select("doc_id", "text", "paper_key"), "doc_id", "text", "paper_key")


QUERIES = {f.__name__: f for f in (p1_found, p1_shared, p2_percentiles, p2_by_month, p3_found, p3_groups, p5_found, p5_runs, p5_text_runs, p6_ids, p7_pack, p8_found)}

_RUNS = """
with once as (select session_id, chunk_index, arg_min(matched_ayah, received_at) as m, arg_min(start_time_s, received_at) as s, arg_min(end_time_s, received_at) as e
              from chunk_results group by all),
kept as (select * from once where m is not null),
numbered as (select *, row_number() over (partition by session_id order by s nulls first, chunk_index) as r,
                       row_number() over (partition by session_id, m order by s nulls first, chunk_index) as q from kept)
select session_id, {columns} from numbered group by session_id, m, r - q"""
_ENDS = "cast(arg_min(chunk_index, r) as int) as first_chunk_index, cast(arg_max(chunk_index, r) as int) as last_chunk_index"

_WINDOWS = """
with chunk as (select session_id, chunk_index, arg_min_null(corrected_text, received_at) as t from chunk_results group by all),
rec as (select 'chunk:' || session_id || ':' || chunk_index as rec_key, 0 as role, t from chunk where length(t) >= 60
        union all select 'ayah:' || surah || ':' || ayah, 1, text from ayah_entries where length(text) >= 60),
win as (select rec_key, role, length(t) as n, i, substr(t, i, 60) as w from (select *, unnest(range(1, length(t) - 58)) as i from rec)),
node as (select w, count(distinct rec_key) filter (where role = 0) as c, count(distinct rec_key) filter (where role = 1) as v from win group by w),
hit as (select win.* from win join node using (w) where (role = 0 and (c >= 2 or v >= 1)) or (role = 1 and v >= 2))
"""

_LETTERS = _RUNS.replace("arg_min(matched_ayah, received_at)", "nullif(regexp_replace(coalesce(arg_min_null(corrected_text, received_at), ''), '[^\\p{{L}}]', '', 'g'), '')")

SQL = {
    "p1_found": _WINDOWS + "select distinct rec_key from hit",
    "p1_shared": _WINDOWS + """,
step as (select *, lag(i) over (partition by rec_key order by i) as before from hit)
select rec_key, cast(sum(case when before is null or i > before + 60 then 1 else 0 end) as int) as spans,
       cast(sum(case when before is null then 60 else least(60, i - before) end) as int) as covered, cast(max(n) as int) as length,
       round(cast(sum(case when before is null then 60 else least(60, i - before) end) as double) / max(n), 6) as share
from step group by rec_key""",
    "p5_found": _RUNS.format(columns=_ENDS) + " having count(*) > 1",
    "p5_text_runs": _LETTERS.format(columns=f"{_ENDS}, count(*) as chunks, arg_min_null(s, r) as from_s, arg_max_null(e, r) as to_s") + " having count(*) > 1",
    "p5_runs": _RUNS.format(columns=f"cast(m as int) as matched_ayah, {_ENDS}, count(*) as chunks, arg_min_null(s, r) as from_s, arg_max_null(e, r) as to_s"),
}
