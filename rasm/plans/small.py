"""Queries of small columns, reports and joins, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasm.functions import columns as col
from rasm.functions import metrics as m
from rasm.functions import text as tx
from rasm.operators import evaluate, guard, pipeline, report, retrieve, sessions, windows
from rasm.plans import folds
from rasm.plans import sql as S
from rasm.plans.queries import _BM25, _QUERIES, _SKEL, SQL, _hyp, _once, _queries, _ref, query
from rasm.session import broadcast_if_small, spread, table

SQL |= folds.SQL
c = F.col
_KEY = ["session_id", "chunk_index"]
_SUR = "cast(split_part(r.id, ':', 1) as int)"
_WRONG = "x.status in ('major', 'missing') and x.reference is not null"


@query("""select session_id, try_cast(trim(split_part(choice, ' - ', 1)) as int) as surah, case when starts_with(engine, 'Combined') then 'combined' else 'standard' end as engine
from (select distinct session_id, coalesce(surah || ' - name', 'Auto') as choice, case asr_engine when 'combined' then 'Combined (two)' else 'Standard' end as engine from sessions)""")
def session_choices(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").select("session_id", F.coalesce(F.concat("surah", F.lit(" - name")), F.lit("Auto")).alias("choice"), F.when(c("asr_engine") == "combined", "Combined (two)").otherwise("Standard").alias("engine")).distinct()
    return s.select("session_id", col.chapter_of_choice(c("choice")).alias("surah"), col.engine_of_choice(c("engine")).alias("engine"))


@query("select distinct session_id, try_cast(split_part(session_id, '_', 2) as bigint) as id_seconds, cast(floor(epoch(started_at)) as bigint) as started from sessions")
def session_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").select("session_id", col.id_seconds(c("session_id")).alias("id_seconds"), F.unix_timestamp(c("started_at").cast("timestamp")).alias("started")).distinct()


@query(f"""with {S.ONCE}, k as (select session_id, chunk_index, {_SUR} as s, r.ayah as a from once)
select session_id, chunk_index, case when s <> 0 and a <> 0 then s || ':' || a end as id, case when s <> 0 and a <> 0 then s end as key_surah from k""")
def verse_ids(spark: SparkSession, d: str) -> DataFrame:
    k = _once(spark, d, "matched_surah_ayah_id", "matched_ayah").withColumn("s", F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int"))
    return k.select(*_KEY, col.verse_id(c("s"), c("matched_ayah")).alias("id"), col.verse_key(c("s"), c("matched_ayah"))["surah"].alias("key_surah"))


_BARE = "array_to_string(case when t[1:4] = ['بسم', 'الله', 'الرحمن', 'الرحيم'] then t[5:] else t end, ' ')"


@query(f"""with {S.ONCE}, t as (select session_id, chunk_index, r.raw as raw, {S.tokens(S.normalize('r.raw'))} as t from once)
select session_id, chunk_index, coalesce(raw, '') <> '' and {_BARE} = '' as skipped, {_BARE} as analysed from t""")
def invocation_skips(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "raw_asr").withColumn("analysed", guard.strip_invocations(c("raw_asr"), "exact"))
    return t.select(*_KEY, col.only_invocations(c("raw_asr"), c("analysed")).alias("skipped"), "analysed")


@query(f"""with {S.ONCE}, p as (select session_id, chunk_index, r.conf as conf, r.ayah as a, max(r.ayah) over (partition by session_id order by chunk_index rows unbounded preceding) as reached from once)
select session_id, chunk_index, a as matched_ayah from p where (conf is null or conf >= 0.30) and a = reached""")
def reliable_matches(spark: SparkSession, d: str) -> DataFrame:
    p = _once(spark, d, "confidence", "matched_ayah").withColumn("at", evaluate.running_max(c("matched_ayah"), "session_id", order=["chunk_index"]))
    return p.where(col.reliable(c("confidence"), c("matched_ayah"), c("at"))).select(*_KEY, "matched_ayah")


@query(f"""with {S.ONCE}, p as (select session_id, chunk_index, {_SUR} as surah, r.ayah as a, r.conf as conf,
  count(*) filter (where len({S.tokens(S.normalize('r.cor'))}) >= 2) over (partition by session_id order by chunk_index rows between 7 preceding and current row) as heard from once)
select session_id, chunk_index, surah, round(least(0.95, conf * 1.2), 6) as score from p where a <> 1 and conf >= 0.70 and heard >= 2 and surah is not null""")
def guard_votes(spark: SparkSession, d: str) -> DataFrame:
    """The votes that sure matches give for their chapters."""
    w = Window.partitionBy("session_id").orderBy("chunk_index").rowsBetween(-7, 0)
    p = _once(spark, d, "matched_surah_ayah_id", "matched_ayah", "confidence", "corrected_text").withColumn("surah", F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int"))
    p = p.withColumn("heard", F.sum((F.size(tx.tokens(tx.normalize(c("corrected_text")))) >= 2).cast("int")).over(w))
    return p.where(col.votes(c("matched_ayah"), c("confidence"), c("heard")) & c("surah").isNotNull()).select(*_KEY, "surah", F.round(col.vote_score(c("confidence")), 6).alias("score"))


@query(f"""with {S.ONCE}, v as (select session_id, r.lock.top_surah as surah, r.lock.top_score as score, r.lock.margin as margin from once where r.lock.top_surah is not null and r.lock.top_score >= 0.20)
select session_id, surah, count(*) as n, round(sum(score), 6) as score, round(sum(coalesce(margin, 0)), 6) as margin from v group by 1, 2""")
def vote_summary(spark: SparkSession, d: str) -> DataFrame:
    """Votes of a session for each chapter, of candidates that are admitted."""
    lock = c("surah_lock_state")
    v = _once(spark, d, "surah_lock_state").select("session_id", lock["top_surah"].alias("surah"), lock["top_score"].alias("score"), lock["margin"].alias("margin")).where("surah is not null and score >= 0.20")
    return v.groupBy("session_id", "surah").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.round(F.sum(F.coalesce("margin", F.lit(0.0))), 6).alias("margin"))


@query(f"""with {S.ONCE}, l as (select session_id, arg_max(r.lock.locked_surah, chunk_index) as s from once where r.lock.lock_state = 'ACTIVE' and r.lock.locked_surah is not null group by session_id),
v as (select session_id, {_SUR} as surah, count(*) as n, min(chunk_index) as f from once where r.id is not null group by 1, 2),
m as (select session_id, surah from v qualify row_number() over (partition by session_id order by n desc, f) = 1)
select coalesce(m.session_id, l.session_id) as session_id, coalesce(l.s, m.surah) as surah from m full join l on m.session_id = l.session_id""")
def detected_surah(spark: SparkSession, d: str) -> DataFrame:
    """The chapter of a session: the one locked last, else the one most chunks match."""
    t = _once(spark, d, "matched_surah_ayah_id", "surah_lock_state")
    return evaluate.detected(t, "session_id", "chunk_index", F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int"), c("surah_lock_state.lock_state"), c("surah_lock_state.locked_surah"))


_STAT = lambda s: f"sum(len(list_filter(w, lambda x: x.status = '{s}')))"


@query(f"""with {S.ONCE.replace('raw := raw_asr', 'words := word_errors, raw := raw_asr')}, w as (select session_id, coalesce(r.words, []) as w from once),
s as (select session_id, cast(sum(len(w)) as bigint) as total_words, {', '.join(f'cast({_STAT(x)} as bigint) as {x}' for x in ('correct', 'minor', 'major', 'uncertain'))} from w group by 1)
select *, round(case when total_words > 0 then correct * 100.0 / total_words else 0.0 end, 4) as accuracy from s""")
def display_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.display_stats(_once(spark, d, "word_errors"), "session_id", "word_errors")


@query(f"""with {S.ONCE} select session_id, count(*) as errors, string_agg(chunk_index || ':' || coalesce(cast(r.ayah as varchar), '-'), ' ' order by chunk_index) as history from once where r.ver = 'error' group by session_id""")
def error_history(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a session with an error, in order, with their verses."""
    t = _once(spark, d, "verdict", "matched_ayah").where("verdict = 'error'").select("session_id", "chunk_index", F.concat_ws(":", "chunk_index", F.coalesce(c("matched_ayah").cast("string"), F.lit("-"))).alias("x"))
    return t.groupBy("session_id").agg(F.count("*").alias("errors"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "x"))), lambda y: y["x"]), " ").alias("history"))


_VERDICTS = f"""cl as (select example_id, true_word_label as tw, true_harakaat_label as th, is_last_word as last, {_SKEL('predicted_word')} = {_SKEL('reference_word')} as same,
  regexp_extract_all(predicted_word, {S.q(f'([^{tx.VOWELS}])([{tx.VOWELS}]*)')}, 2) as pm, regexp_extract_all(reference_word, {S.q(f'([^{tx.VOWELS}])([{tx.VOWELS}]*)')}, 2) as rm
  from labeled_examples where predicted_word is not null and reference_word is not null),
sh as (select *, list_transform(pm, lambda x: regexp_replace(x, {S.q('[^' + evaluate.SHORT + ']')}, '', 'g')) as ps, list_transform(rm, lambda x: regexp_replace(x, {S.q('[^' + evaluate.SHORT + ']')}, '', 'g')) as rs from cl),
pos as (select *, list_filter(range(1, len(rs) + 1 - case when last then 1 else 0 end), lambda i: ps[i] <> '' and rs[i] <> '') as places from sh),
wv as (select example_id, tw, th, case when same then 'correct' else 'incorrect' end as word, case when not same or len(pm) <> len(rm) or len(places) = 0 then 'not_applicable' when len(list_filter(places, lambda i: ps[i] <> rs[i])) > 0 then 'incorrect' else 'correct' end as vowels from pos)"""


@query(f"with {_VERDICTS} select example_id, word, vowels from wv")
def word_verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labeled_examples").where("predicted_word is not null and reference_word is not null")
    word, vowels = evaluate.word_verdict(c("predicted_word"), c("reference_word"), c("is_last_word"))
    return e.select("example_id", word.alias("word"), vowels.alias("vowels"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labeled_examples").where("predicted_word is not null and reference_word is not null")
    word, vowels = evaluate.word_verdict(c("predicted_word"), c("reference_word"), c("is_last_word"))
    return e.select(c("true_word_label").alias("tw"), c("true_harakaat_label").alias("th"), word.alias("word"), vowels.alias("vowels"))


@query(f"""with {_VERDICTS}, p as (select th as t, vowels as q from wv where th is not null), l as (select distinct t as label from p union select distinct q from p), n as (select count(*) as n, count(*) filter (where t = q) as ok from p),
k as (select label, count(*) filter (where t = label and q = label) as tp, count(*) filter (where q = label) as pr, count(*) filter (where t = label) as su from l, p group by label),
r as (select *, case when pr = 0 then 0.0 else tp / cast(pr as double) end as p, case when su = 0 then 0.0 else tp / cast(su as double) end as q from k),
f as (select *, case when p + q = 0 then 0.0 else 2 * p * q / (p + q) end as f from r)
select label, tp, su as support, round(p, 8) as precision, round(q, 8) as recall, round(f, 8) as f1, round((select ok / cast(n as double) from n), 8) as accuracy, round((select avg(f) from f), 8) as macro_f1 from f""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return report.class_report(evaluate.confusion(_judged(spark, d), "th", "vowels"))


@query(f"""with {_VERDICTS}, p as (select 'word' as rule, tw = 'correct' as t, word = 'correct' as q from wv where tw is not null union all select 'vowels', th = 'correct', vowels = 'correct' from wv where th is not null),
k as (select coalesce(rule, 'pooled') as rule, count(*) as n, count(*) filter (where t and q) as tp, count(*) filter (where q and not t) as fp, count(*) filter (where t and not q) as fn, count(*) filter (where not t and not q) as tn from p group by grouping sets ((rule), ())),
r as (select *, case when tp + fp = 0 then 0.0 else tp / cast(tp + fp as double) end as p, case when tp + fn = 0 then 0.0 else tp / cast(tp + fn as double) end as q from k)
select rule, n, tp, fp, fn, tn, round((tp + tn) / cast(n as double), 4) as accuracy, round(p, 4) as precision, round(q, 4) as recall, round(case when p + q = 0 then 0.0 else 2 * p * q / (p + q) end, 4) as f1 from r""")
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    each = j.select(F.inline(F.array(F.struct(F.lit("word").alias("rule"), (c("tw") == "correct").alias("true"), (c("word") == "correct").alias("pred")), F.struct(F.lit("vowels").alias("rule"), (c("th") == "correct").alias("true"), (c("vowels") == "correct").alias("pred")))))
    return report.rule_report(each.where(c("true").isNotNull()), "rule", "true", "pred")


_UNI = "uni as (select w, count(*) / cast(sum(count(*)) over () as double) as p from (select unnest(tokens) as w from ref) group by w)"


@query(f"""with {S.REF}, {_UNI}, e as (select surah, ayah, unnest(tokens) as w from ref)
select surah, ayah, round(greatest(0.0, least(1.0, (avg(log10(p)) + 5) / 3)), 6) as score from e join uni using (w) group by surah, ayah""")
def lm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of each verse by a language model of single words."""
    e = _ref(spark, d).select("surah", "ayah", F.explode("tokens").alias("w"))
    counts = e.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    p = counts.crossJoin(F.broadcast(total)).select("w", (c("n") / c("total")).alias("p"))  # one row
    return e.join(broadcast_if_small(p), "w").groupBy("surah", "ayah").agg(F.round(col.lm_score(F.avg(F.log10("p"))), 6).alias("score"))


_MARKS = S.q("[" + col.SESSION_MARKS + "]+")
_COLL = lambda x: f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
_NOMARK = f"regexp_replace(coalesce(corrected_text, ''), {_MARKS}, '', 'g')"


@query(f"""select distinct session_id, chunk_index, {_COLL(_NOMARK)} as bare, {_COLL(f"regexp_replace({_NOMARK}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g')")} as fragment,
{S.normalize(_NOMARK)} as line from chunk_results""")
def session_text_forms(spark: SparkSession, d: str) -> DataFrame:
    t = c("corrected_text")
    return table(spark, d, "chunk_results").select(*_KEY, col.without_marks(t).alias("bare"), col.fragment_text(t).alias("fragment"), col.lm_line(F.concat(F.lit("1|2|"), F.coalesce(t, F.lit("")))).alias("line")).distinct()


_REST = "substr(predicted_word, 3)"


@query(f"""select example_id, replace(predicted_word, {S.q(chr(0x670))}, '') as no_dagger, regexp_replace(regexp_replace(predicted_word, {S.q('^[' + tx.VOWELS + ']+')}, ''), {S.q('[' + tx.VOWELS + ']+$')}, '') as no_last,
case when starts_with(predicted_word, {S.q(col.WASL)}) then case when starts_with(reference_word, {S.q(col.STEM)}) then {S.q(col.WASL_STEM)} || regexp_replace({_REST}, {S.q('^ه[' + tx.VOWELS + ']*')}, '') else 'ا' || {_REST} end else predicted_word end as repaired
from (select example_id, case when example_id % 5 = 0 then {S.q(col.WASL)} || predicted_word else predicted_word end as predicted_word, case when example_id % 10 = 0 then {S.q(col.STEM)} || reference_word else reference_word end as reference_word from labeled_examples)
where predicted_word is not null and reference_word is not null""")
def word_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Marks stripped, and connecting alefs put right in words of which a fifth is given one."""
    e = table(spark, d, "labeled_examples")
    p = F.when(c("example_id") % 5 == 0, F.concat(F.lit(col.WASL), "predicted_word")).otherwise(c("predicted_word"))
    r = F.when(c("example_id") % 10 == 0, F.concat(F.lit(col.STEM), "reference_word")).otherwise(c("reference_word"))
    e = e.select("example_id", p.alias("p"), r.alias("r")).where("p is not null and r is not null")
    return e.select("example_id", col.without_dagger(c("p")).alias("no_dagger"), col.without_last_marks(c("p")).alias("no_last"), col.repair_wasl(c("p"), c("r")).alias("repaired"))


_SMARTS = lambda w: f"translate(regexp_replace(regexp_replace({w}, {S.q('[' + tx.SIGNS + ']')}, '', 'g'), {S.q('[' + tx.VOWELS + ']')}, '', 'g'), {S.q(tx.FOLD_FROM[:2])}, {S.q(tx.FOLD_TO[:2])})"


@query(f"""with v as (select distinct {_SMARTS('w')} as s from (select unnest(string_split({_COLL("coalesce(text, '')")}, ' ')) as w from ayah_entries)),
e as (select example_id, predicted_word as p, reference_word as r, {_SMARTS('predicted_word')} in (select s from v) as pk, {_SMARTS('reference_word')} in (select s from v) as rk from labeled_examples where predicted_word is not null and reference_word is not null)
select example_id, case when rk and not pk then regexp_replace(r, {S.q('[' + tx.VOWELS + ']')}, '', 'g') else p end as word, case when rk and not pk then 'second' else 'first' end as source from e""")
def word_backbone(spark: SparkSession, d: str) -> DataFrame:
    """Of two engines' words the first, but the second where only that is a word of the corpus."""
    known = _ref(spark, d).select(F.explode(F.split(tx.display(c("raw_text")), " ")).alias("w")).select(tx.smart_word(c("w")).alias("s")).distinct()
    e = table(spark, d, "labeled_examples").where("predicted_word is not null and reference_word is not null")
    e = e.select("example_id", "predicted_word", "reference_word", tx.smart_word(c("predicted_word")).alias("ps"), tx.smart_word(c("reference_word")).alias("rs"))
    for side in ("p", "r"):
        words = broadcast_if_small(known.select(c("s").alias(f"{side}s"), F.lit(True).alias(f"{side}k")))
        e = e.join(words, f"{side}s", "left")
    word, source = col.backbone(c("predicted_word"), c("reference_word"), F.coalesce("pk", F.lit(False)), F.coalesce("rk", F.lit(False)))
    return e.select("example_id", word.alias("word"), source.alias("source"))


@query(f"""with {S.ONCE.replace('raw := raw_asr', 'words := word_errors, raw := raw_asr')}, w as (select session_id, chunk_index, {_SUR} as surah, r.ayah as ayah, list_filter(coalesce(r.words, []), lambda x: {_WRONG}) as w from once),
p as (select session_id, chunk_index, surah, ayah, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w)
select session_id, chunk_index, cast(i as int) as i, trim(x.reference) as text, surah, ayah, x.ref_index as first, x.ref_index as last from p where trim(x.reference) <> ''""")
def pending_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The corrections that are due after a chunk."""
    t = _once(spark, d, "word_errors", "matched_surah_ayah_id", "matched_ayah")
    w = F.filter(F.coalesce("word_errors", F.array()), lambda x: x["status"].isin("major", "missing") & x["reference"].isNotNull())
    spans = F.transform(w, lambda x: F.struct(F.lit(None).cast("string").alias("text"), x["ref_index"].alias("first"), x["ref_index"].alias("last")))
    due = col.pending_corrections(F.transform(w, lambda x: x["reference"]), spans, F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int"), c("matched_ayah"))
    return t.select(*_KEY, F.posexplode(due).alias("i", "x")).select(*_KEY, (c("i") + 1).alias("i"), "x.*")


@query(f"""with {S.REF}, s as (select surah, ayah, list_transform(range(0, len(tokens)), lambda i: [i, i * 400, i * 400 + 350]) as s from ref)
select surah, ayah, list_min(list_transform(list_filter(s, lambda x: x[1] between 1 and 4), lambda x: x[-2])) as start_ms, list_max(list_transform(list_filter(s, lambda x: x[1] between 1 and 4), lambda x: x[-1])) as end_ms from s""")
def segment_times(spark: SparkSession, d: str) -> DataFrame:
    """Time of the words 1 to 3 of each verse, in segments that count from 0 or 1."""
    i = F.sequence(F.lit(0), F.size("tokens") - 1)
    seg = F.when(F.size("tokens") > 0, F.transform(i, lambda x: F.array(x, x * 400, x * 400 + 350))).otherwise(F.array().cast("array<array<int>>"))
    r = windows.segment_range(seg, F.lit(1), F.lit(3))
    return _ref(spark, d).select("surah", "ayah", r["start_ms"].cast("long").alias("start_ms"), r["end_ms"].cast("long").alias("end_ms"))


@query("""with a as (select eval_id, min(regexp_extract(audio_path, '([^/]+)\\.[^./]*$', 1)) as stem from eval_rows where audio_path is not null group by eval_id), l as (select distinct lpad(cast(surah as varchar), 3, '0') || lpad(cast(ayah as varchar), 3, '0') as stem, surah, ayah from labeled_examples where surah is not null and ayah is not null)
select l.surah, l.ayah, count(*) as files from a join l on a.stem = l.stem group by 1, 2""")
def labels_with_audio(spark: SparkSession, d: str) -> DataFrame:
    """How many audio files there are of each verse that has labels."""
    files = table(spark, d, "eval_rows").where("audio_path is not null").groupBy("eval_id").agg(F.min(report.stem(c("audio_path"))).alias("stem"))
    labels = table(spark, d, "labeled_examples").where("surah is not null and ayah is not null").select("surah", "ayah").distinct()
    labels = labels.select(F.concat(F.lpad(c("surah").cast("string"), 3, "0"), F.lpad(c("ayah").cast("string"), 3, "0")).alias("stem"), "surah", "ayah")
    return report.with_audio(labels, files, "stem").groupBy("surah", "ayah").agg(F.count("*").alias("files"))


@query(f"""with {S.ONCE}, {S.REF}, {_QUERIES}, {_BM25}, sur as (select q, surah, max(score) as score from top group by q, surah)
select q, surah, score, cast(row_number() over (partition by q order by score desc, surah) as int) as rank from sur qualify rank <= 5""")
def topk_chapters(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_chapters(retrieve.bm25(_queries(spark, d), "q", _ref(spark, d)), "q", 5)


@query(f"""with {S.ONCE}, p as (select session_id, chunk_index, r.s as s, r.ver as v from once)
select session_id, chunk_index from p where s is null or not exists (select 1 from p e where e.session_id = p.session_id and e.v = 'error' and e.chunk_index <> p.chunk_index and abs(e.s - p.s) < 0.05)""")
def not_stale(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that no other chunk with an error starts within 0.05 s of."""
    p = _once(spark, d, "start_time_s", "verdict").select(*_KEY, c("start_time_s").alias("s"), "verdict")
    return sessions.without_stale(p, p.where("verdict = 'error'"), "session_id", "chunk_index", "s", 0.05).select(*_KEY)


@query("""with s as (select session_id, min(start_sample) as a, max(end_sample) as z, max(end_sample) + 1600 as n from chunk_results where start_sample < end_sample group by session_id)
select session_id, greatest(0, a - 3200) as "start", least(n, z + 3200) as "end" from s""")
def trimmed_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a session's audio after silence in front and behind is cut, but for 0.2 s."""
    s = table(spark, d, "chunk_results").where("start_sample < end_sample").groupBy("session_id").agg(F.min("start_sample").alias("a"), F.max("end_sample").alias("z"))
    start, end = col.trim_bounds(c("a"), c("z"), c("z") + 1600, 3200)
    return s.select("session_id", start.alias("start"), end.alias("end"))


@query(f"""with {S.ONCE}, {S.REF}, {S.HYP}, p as (select session_id, chunk_index, surah, expected as matched, lag(expected) over (partition by session_id order by chunk_index) + 1 as due from hyp),
j as (select p.*, ref.norm_text as due_text from p left join ref on p.surah = ref.surah and p.due = ref.ayah)
select session_id, chunk_index, case when due_text is not null and (matched < due or matched >= due + 2) then due else matched end as matched, coalesce(due_text is not null and matched >= due + 2, false) as wrong,
case when due_text is not null and (matched < due or matched >= due + 2) then due_text end as text from j""")
def forced_positions(spark: SparkSession, d: str) -> DataFrame:
    """Matches behind the verse that is due, or two and more ahead of it, are put there; a jump ahead is an error."""
    due = F.lag("expected").over(Window.partitionBy("session_id").orderBy("chunk_index")) + 1
    p = _hyp(spark, d).select(*_KEY, "surah", c("expected").alias("matched"), due.alias("due"))
    return guard.forced(p, _ref(spark, d)).select(*_KEY, "matched", "wrong", "text")


@query(f"""with {S.ONCE}, k as (select session_id, chunk_index, {_SUR} as s, r.* from once)
select session_id, chunk_index, coalesce(raw, '') as raw_asr, coalesce(cor, '') as corrected_text, coalesce(cor, '') as display_text, ayah as matched_ayah, case when s <> 0 and ayah <> 0 then s end as matched_surah, cer, wer, cast(null as double) as coverage, coalesce(ver, 'unknown') as verdict from k""")
def api_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of the interface in the shape of the guard's."""
    t = _once(spark, d, "raw_asr", "corrected_text", "matched_ayah", "matched_surah_ayah_id", "cer", "wer", "verdict")
    r = guard.from_api(t.withColumn("surah", F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int")), "surah")
    return r.select(*_KEY, "raw_asr", "corrected_text", "display_text", "matched_ayah", c("matched_key.surah").alias("matched_surah"), "cer", "wer", "coverage", "verdict")


_EV = "ev as (select eval_id, min_by(struct_pack(surah := surah, reciter := reciter, cer := corrected_cer, wer := corrected_wer, ver := verdict), ingested_at) as r from eval_rows group by eval_id), e as (select eval_id, r.* from ev where r.cer is not null and not isnan(r.cer) and r.wer is not null and not isnan(r.wer))"


_RATE = lambda x: f"cast(round({x} * 10000) as bigint) // 10000 || '.' || lpad(cast(cast(round({x} * 10000) as bigint) % 10000 as varchar), 4, '0')"


@query(f"""with {_EV}, w as (select row_number() over (order by wer desc, eval_id) as i, eval_id, wer from e qualify i <= 20)
select 'total' as section, 'all' as name, count(*) || ' ' || {_RATE('avg(wer)')} || ' ' || {_RATE('avg(cer)')} as line from e
union all select 'verdict', coalesce(ver, '-'), cast(count(*) as varchar) from e group by 2
union all select 'surah', coalesce(cast(surah as varchar), '-'), count(*) || ' ' || {_RATE('avg(wer)')} from e group by 2
union all select 'worst', cast(i as varchar), eval_id || ' ' || {_RATE('wer')} from w""")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.latest(table(spark, d, "eval_rows"), ["eval_id"], "ingested_at", ["surah", "corrected_cer", "corrected_wer", "verdict"])
    return report.eval_report(e.where("corrected_cer is not null and not isnan(corrected_cer) and corrected_wer is not null and not isnan(corrected_wer)"))


@query(f"""with {S.ONCE}, d as (select session_id, chunk_index, {S.normalize('r.raw')} as a, {S.normalize('r.cor')} as b, r.ver as ver from once)
select session_id, chunk_index, a = b as same_text, case when length(b) = 0 then 1.0 else round({S.edits('a', 'b')} / cast(length(b) as double), 6) end as cer, coalesce(ver, '') = case when a = b then 'ok' else 'error' end as same_verdict from d""")
def dual_flags(spark: SparkSession, d: str) -> DataFrame:
    """Two models' texts of each chunk side by side."""
    t = _once(spark, d, "raw_asr", "corrected_text", "verdict").select(*_KEY, tx.normalize(c("raw_asr")).alias("a"), tx.normalize(c("corrected_text")).alias("b"), "verdict")
    one = F.when(c("a") == c("b"), "ok").otherwise("error")
    return t.select(*_KEY, (c("a") == c("b")).alias("same_text"), F.round(m.cer(c("a"), c("b")), 6).alias("cer"), (F.coalesce("verdict", F.lit("")) == one).alias("same_verdict"))


@query()
def dual_report(spark: SparkSession, d: str) -> DataFrame:
    """The guard's results of two recognizers' texts, and whether they agree."""
    t = _once(spark, d, "raw_asr", "corrected_text", "matched_ayah", "matched_surah_ayah_id")
    t = t.select(*_KEY, F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int").alias("surah"), c("matched_ayah").alias("expected"), c("raw_asr").alias("first"), c("corrected_text").alias("second"))
    return guard.dual(t, _ref(spark, d), _KEY)


@query()
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    """Display class of each labelled word."""
    e = spread(table(spark, d, "labeled_examples").select("example_id", "predicted_word", "reference_word"), "example_id")
    like = retrieve.likeness(tx.normalize(c("predicted_word")), tx.normalize(c("reference_word"))) / 100
    return e.select("example_id", col.word_class(c("predicted_word"), c("reference_word"), F.lit(None).cast("double"), like).alias("class"))


@query()
def closest_verses(spark: SparkSession, d: str) -> DataFrame:
    """The three verses of the band (5 back, 10 ahead) with the best ratio to each text."""
    return retrieve.closest(_hyp(spark, d), _ref(spark, d), _KEY, 3)


@query()
def legacy_errors(spark: SparkSession, d: str) -> DataFrame:
    """Missing, extra and substituted words of each chunk against its verse."""
    from rasm.operators import align
    from rasm.plans.queries import _pairs

    return _pairs(spark, d).select(*_KEY, F.inline(align.word_errors(c("a"), c("ref"))))


def _session_words(spark: SparkSession, d: str) -> DataFrame:
    text = _once(spark, d, "raw_asr").where("raw_asr <> ''").groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "raw_asr"))), lambda x: x["raw_asr"]), " ").alias("text"))
    norm = tx.normalize(c("text"))
    return text.select(c("session_id").alias("q"), norm.alias("norm"), tx.tokens(norm).alias("words"))


@query()
def session_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Each session as a whole: its text through the path search, regrouped by verse."""
    q = _session_words(spark, d)
    return retrieve.aligned(retrieve.viterbi(q, "q", _ref(spark, d), online=True), q, "q")


@query("""with n as (select session_id, max(end_sample) as n from chunk_results where end_sample > 0 group by session_id),
w as (select session_id, n, unnest(range(0, n, 368000)) as s from n where n > 480000)
select session_id, 0 as "start", n as "end" from n where n <= 480000
union all select session_id, s, least(s + 400000, n) from w where s = 0 or s - 368000 + 400000 < n""")
def redecode_windows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "chunk_results").where("end_sample > 0").groupBy("session_id").agg(F.max("end_sample").alias("n"))
    return n.select("session_id", F.inline(pipeline.redecode(c("n"))))


@query(f"""with {S.ONCE}, p as (select session_id, chunk_index, r.ayah as m, r.ver as v, lag(r.ayah) over w as cur, lag(r.ver) over w as before from once window w as (partition by session_id order by chunk_index)),
f as (select *, coalesce(before = 'error', false) and cur is not null and m is distinct from cur as strict from p)
select session_id, chunk_index, case when strict then cur else m end as matched_ayah, case when strict then 'error' else v end as verdict from f""")
def strict_matches(spark: SparkSession, d: str) -> DataFrame:
    """After a chunk with an error only its verse counts."""
    w = Window.partitionBy("session_id").orderBy("chunk_index")
    t = _once(spark, d, "matched_ayah", "verdict").withColumns({"cur": F.lag("matched_ayah").over(w), "fsm": F.when(F.lag("verdict").over(w) == "error", "VERIFYING").otherwise("LISTENING")})
    return pipeline.strict(t, "fsm", "cur", "matched_ayah", "verdict").select(*_KEY, "matched_ayah", "verdict")


@query()
def chunk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk from its text to verdict, lock and correction."""
    t = _once(spark, d, "raw_asr", "corrected_text", "duration_s", "matched_ayah")
    t = t.select(*_KEY, c("duration_s").alias("seconds"), F.lit(0.1).alias("level"), c("raw_asr").alias("raw"), c("corrected_text").alias("second"), c("matched_ayah").alias("reached"))
    starts = table(spark, d, "sessions").groupBy("session_id").agg(F.min(F.struct("started_at", "surah", "start_ayah")).alias("s")).select("session_id", "s.surah", "s.start_ayah")
    return pipeline.chunks(t, starts, table(spark, d, "ayah_entries"))


@query()
def upload_results(spark: SparkSession, d: str) -> DataFrame:
    """Each different text of the evaluation as an upload of its own."""
    e = table(spark, d, "eval_rows").where("raw is not null").groupBy("eval_id").agg(F.min(F.struct("ingested_at", "surah", "ayah", "raw")).alias("r"))
    return pipeline.upload(e.select("eval_id", "r.surah", c("r.ayah").alias("expected"), "r.raw"), "eval_id", _ref(spark, d))


@query()
def progress_results(spark: SparkSession, d: str) -> DataFrame:
    """What the pointer of each session came to, or that too much was of low confidence."""
    return sessions.progressed(_once(spark, d, "matched_ayah", "verdict", "cer", "wer", "coverage", "confidence", "confidence_level"))


SQL["progress_results"] = folds.RESULTS


@query()
def healed_words(spark: SparkSession, d: str) -> DataFrame:
    """Status of each word of the verses of a session after all its chunks."""
    ref = _ref(spark, d).select(F.concat_ws(":", "surah", "ayah").alias("id"), c("tokens").alias("ref"))
    t = _once(spark, d, "corrected_text", "matched_surah_ayah_id", "harakaat_errors").join(broadcast_if_small(ref), c("matched_surah_ayah_id") == c("id"))
    marks = F.transform(F.coalesce("harakaat_errors", F.array()), lambda x: tx.normalize(x["predicted"]))
    t = t.select(F.concat_ws("|", "session_id", "id").alias("verse"), "chunk_index", tx.tokens(tx.normalize(c("corrected_text"))).alias("said"), "ref", marks.alias("marks"))
    done = sessions.healed(t, "verse", "chunk_index", "said", "ref", "marks")
    return done.select(F.substring_index("verse", "|", 1).alias("session_id"), F.substring_index("verse", "|", -1).alias("id"), F.posexplode("statuses").alias("at", "status")).where("status is not null")
