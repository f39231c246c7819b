"""Queries of the core, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasm.functions import metrics as m
from rasm.functions import text as tx
from rasm.operators import align, corpus, evaluate, guard, match, retrieve, sessions, windows
from rasm.operators.intervals import periods_and_gaps
from rasm.plans import sql as S
from rasm.session import bounded, broadcast_if_small, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ref(spark: SparkSession, d: str) -> DataFrame:
    return corpus.reference(table(spark, d, "ayah_entries"))


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return evaluate.latest(table(spark, d, "chunk_results"), ["session_id", "chunk_index"], "received_at", list(columns))


def _hyp(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "raw_asr", "matched_ayah", "matched_surah_ayah_id").where("matched_ayah is not null and matched_surah_ayah_id is not null")
    surah = F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int")
    return rows.select("session_id", "chunk_index", surah.alias("surah"), c("matched_ayah").alias("expected"), tx.normalize(c("raw_asr")).alias("norm"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    q = _once(spark, d, "raw_asr").select(F.concat_ws(":", "session_id", "chunk_index").alias("q"), tx.normalize(c("raw_asr")).alias("norm"))
    return q.select("q", "norm", tx.tokens(c("norm")).alias("words"))


_QUERIES = f"qry as (select *, {S.tokens('norm')} as words from (select session_id || ':' || chunk_index as q, {S.normalize('r.raw')} as norm from once))"
_KEY = ["session_id", "chunk_index"]


# Problem 4


@query("""
with c as (select distinct session_id, start_sample as s, end_sample as e from chunk_results where start_sample < end_sample),
p as (select *, max(e) over (partition by session_id order by s, e rows between unbounded preceding and 1 preceding) as m from c),
g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by session_id order by s, e rows unbounded preceding) as i from p),
q as (select session_id, i, min(s) as s, max(e) as e from g group by session_id, i),
l as (select *, lead(s) over (partition by session_id order by s) as n from q)
select session_id, 'period' as kind, s as from_sample, e as to_sample from q
union all select session_id, 'gap', e, n from l where n > e""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "chunk_results"), "session_id", "start_sample", "end_sample")


# Text


@query(f"select surah, ayah, {S.normalize('text')} as norm, len({S.tokens(S.normalize('text'))}) as n from ayah_entries")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    norm = tx.normalize(c("text"))
    return table(spark, d, "ayah_entries").select("surah", "ayah", norm.alias("norm"), F.size(tx.tokens(norm)).alias("n"))


_FOLD = f"translate(regexp_replace(coalesce(text, ''), {S.q('[' + tx.EVAL_MARKS + ']+')}, '', 'g'), {S.q(tx.FOLD_FROM)}, {S.q(tx.FOLD_TO)})"


@query(f"select ayah_key, trim(regexp_replace(regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) as folded from corpus_source")
def normalize_eval(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_source").select("ayah_key", tx.normalize_for_eval(c("text")).alias("folded"))


_SKEL = lambda x: f"translate(regexp_replace({x}, {S.q('[' + tx.VOWELS + ']')}, '', 'g'), {S.q(tx.FOLD_FROM)}, {S.q(tx.FOLD_TO)})"
_SMART = f"translate(regexp_replace(regexp_replace(predicted_word, {S.q('[' + tx.SIGNS + ']')}, '', 'g'), {S.q('[' + tx.VOWELS + ']')}, '', 'g'), {S.q(tx.FOLD_FROM[:2])}, {S.q(tx.FOLD_TO[:2])})"


@query(f"select example_id, {_SKEL('predicted_word')} as skeleton, {_SMART} as smart, translate({S.normalize('predicted_word')}, {S.q(tx.FOLD_FROM)}, {S.q(tx.FOLD_TO)}) as folded from labeled_examples")
def word_forms(spark: SparkSession, d: str) -> DataFrame:
    w = c("predicted_word")
    return table(spark, d, "labeled_examples").select("example_id", tx.skeleton(w).alias("skeleton"), tx.smart_word(w).alias("smart"), tx.fold_invocation(w).alias("folded"))


@query(f"select session_id, chunk_index, trim(regexp_replace(coalesce(corrected_text, ''), '[\\s\\p{{Z}}]+', ' ', 'g')) as shown, case when length(raw_asr) > 40 then substr(raw_asr, 1, 40) || '...' else raw_asr end as preview, ((start_sample * 100 + 8000) // 16000) / 100.0 as start_s from chunk_results")
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_results").select(*_KEY, tx.display(c("corrected_text")).alias("shown"), tx.preview(c("raw_asr")).alias("preview"), F.round(c("start_sample") / 16000.0, 2).alias("start_s"))


_T = S.tokens(S.normalize("corrected_text"))


@query(f"""
with t as (select session_id, chunk_index, {_T} as t from chunk_results),
k as (select *, list_filter(range(1, len(t) + 1), lambda i: i = 1 or t[i] <> t[i - 1]) as keep from t)
select session_id, chunk_index, array_to_string(list_transform(keep, lambda i: t[i]), ' ') as once,
       coalesce(list_max(list_transform(range(1, len(keep) + 1), lambda j: coalesce(keep[j + 1], len(t) + 1) - keep[j])), 0) as longest
from k""")
def dedup_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chunk_results").select(*_KEY, tx.tokens(tx.normalize(c("corrected_text"))).alias("t"))
    return t.select(*_KEY, F.array_join(tx.collapse_repeats(c("t")), " ").alias("once"), tx.longest_run(c("t")).cast("long").alias("longest"))


@query(f"""
with t as (select session_id, chunk_index, {_T} as t from chunk_results),
k as (select *, list_filter(range(1, greatest(2, len(t) + 1)), lambda k: len(t) > 0 and len(t) % k = 0 and len(list_filter(range(0, len(t)), lambda i: t[i + 1] <> t[i % k + 1])) = 0) as ks from t)
select session_id, chunk_index, case when len(t) = 0 then '' else array_to_string(t[1:ks[1]], ' ') end as tiled from k""")
def exact_tile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_results").select(*_KEY, F.array_join(tx.tile(tx.tokens(tx.normalize(c("corrected_text")))), " ").alias("tiled"))


def _fix_sql() -> str:
    x = "array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: i = 1 or t[i] <> t[i - 1]), lambda i: t[i]), ' ')"
    for a, b in tx.PHRASE_FIXES:
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    cases = " ".join(f"when {S.q(a)} then {S.q(b)}" for a, b in tx.TOKEN_FIXES.items())
    return f"with t as (select session_id, chunk_index, {S.tokens(S.normalize('raw_asr'))} as t from chunk_results), f as (select session_id, chunk_index, {x} as f from t) select session_id, chunk_index, array_to_string(list_transform(string_split(f, ' '), lambda w: case w {cases} else w end), ' ') as fixed from f"


@query(_fix_sql())
def rule_corrected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_results").select(*_KEY, tx.fix_rules(c("raw_asr")).alias("fixed"))


# Corpus


@query(f"""
select distinct try_cast(split_part(ayah_key, '_', 1) as int) as surah, try_cast(array_to_string(string_split(ayah_key, '_')[2:], '_') as int) as ayah, text
from corpus_source where try_cast(split_part(ayah_key, '_', 1) as int) is not null and try_cast(array_to_string(string_split(ayah_key, '_')[2:], '_') as int) is not null and {S.normalize('text')} <> ''""")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return corpus.from_export(table(spark, d, "corpus_source"))


@query(f"with {S.REF} select surah, ayah, global_idx, norm_text from ref")
def reference_order(spark: SparkSession, d: str) -> DataFrame:
    return _ref(spark, d).select("surah", "ayah", "global_idx", "norm_text")


@query(f"with {S.REF}, w as (select distinct surah, unnest(tokens) as word from ref) select surah, count(*) as words, array_to_string(list_sort(list(word)), ' ') as vocabulary from w group by surah")
def vocab_by_surah(spark: SparkSession, d: str) -> DataFrame:
    v = corpus.vocabulary(_ref(spark, d))
    return v.groupBy("surah").agg(F.count("*").alias("words"), F.array_join(F.sort_array(F.collect_list("word")), " ").alias("vocabulary"))


_STATS = "stats as (select term, count(*) as df, ln(((select count(*) from ref) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from (select unnest(list_distinct(tokens)) as term from ref) group by term)"


@query(f"with {S.REF}, {_STATS} select term, df, round(idf, 6) as idf from stats")
def term_stats_idf(spark: SparkSession, d: str) -> DataFrame:
    return corpus.term_stats(_ref(spark, d)).withColumn("idf", F.round("idf", 6))


_GRAMS = lambda t, n: f"case when len({t}) = 0 then cast([] as varchar[]) when len({t}) < {n} then [array_to_string({t}, ' ')] else list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string(({t})[i:i + {n - 1}], ' ')) end"
_INDEX = f"idx as (select global_idx, 2 as n, unnest({_GRAMS('tokens', 2)}) as gram from ref union all select global_idx, 3, unnest({_GRAMS('tokens', 3)}) from ref)"


@query(f"with {S.REF}, {_INDEX} select n, gram, count(*) as places, count(distinct global_idx) as verses from idx group by n, gram")
def ngram_index(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ngram_index(_ref(spark, d)).groupBy("n", "gram").agg(F.count("*").alias("places"), F.countDistinct("global_idx").alias("verses"))


@query(f"""
with {S.REF}, p as (select list_concat(['<s>'], tokens, ['</s>']) as p from ref),
g as (select n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) as gram from p, (select unnest([1, 2, 3, 4, 5]) as n)),
k as (select n, gram, count(*) as cnt from g group by n, gram)
select cast(n as int) as n, gram, cnt, round(cnt / cast(sum(cnt) over (partition by n) as double), 10) as share from k""")
def ngram_share(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ngram_counts(_ref(spark, d), c("tokens"), 5).withColumn("share", F.round("share", 10))


@query(f"""
with {S.REF}, p as (select list_concat(['<s>'], tokens, ['</s>']) as p from ref),
g as (select n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) as gram from p, (select unnest([1, 2, 3, 4, 5]) as n)),
k as (select n, gram, count(*) as cnt from g group by n, gram), s as (select *, cnt / cast(sum(cnt) over (partition by n) as double) as share from k)
select cast(n as int) as n, gram, printf('%.6f', log10(share)) || chr(9) || gram || case when n < 5 then chr(9) || '0.000000' else '' end as line from s""")
def arpa_lines(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.arpa_lines(evaluate.ngram_counts(_ref(spark, d), c("tokens"), 5))


@query(f"""
with {S.REF}, e as (select surah, ayah, tokens, unnest(range(1, len(tokens) + 1)) as depth from ref)
select cast(depth as int) as depth, array_to_string(tokens[1:depth], ' ') as prefix, max(depth = len(tokens)) as is_end, count(*) as verses from e group by 1, 2""")
def prefix_tree(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prefixes(_ref(spark, d))


@query(f"with {S.REF} select surah, ayah, coalesce(string_agg(norm_text, ' ') over (partition by surah order by ayah rows between 2 preceding and 1 preceding), '') as prompt from ref")
def initial_prompts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prompts(_ref(spark, d))


_SPANS = """isl as (select *, ayah - row_number() over (partition by surah order by ayah) as island from ref),
spans as (select a.surah, a.ayah as "start", b.ayah as "end", string_agg(x.norm_text, ' ' order by x.ayah) as text from isl a join isl b on a.surah = b.surah and a.island = b.island and b.ayah between a.ayah and a.ayah + {last}
          join isl x on x.surah = a.surah and x.island = a.island and x.ayah between a.ayah and b.ayah group by 1, 2, 3)"""


@query(f'with {S.REF}, {_SPANS.format(last=11)} select surah, "start", "end", text from spans')
def sequence_spans(spark: SparkSession, d: str) -> DataFrame:
    return corpus.spans(_ref(spark, d), 12)


# Scores


@query(f"""
with {S.ONCE}, p as (select session_id, chunk_index, {S.normalize('r.raw')} as h, {S.normalize('r.cor')} as r from once)
select session_id, chunk_index, round({S.cer('h', 'r')}, 6) as cer from p""")
def cer_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = spread(_once(spark, d, "raw_asr", "corrected_text"), *_KEY)
    return p.select(*_KEY, F.round(m.cer(tx.normalize(c("raw_asr")), tx.normalize(c("corrected_text"))), 6).alias("cer"))


_PAIR = f"p as (select session_id, chunk_index, {S.tokens(S.normalize('r.raw'))} as h, {S.tokens(S.normalize('r.cor'))} as r from once)"


@query(f"with {S.ONCE}, {_PAIR} select session_id, chunk_index, round({S.wer('h', 'r')}, 6) as wer from p")
def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _once(spark, d, "raw_asr", "corrected_text").select(*_KEY, tx.tokens(tx.normalize(c("raw_asr"))).alias("h"), tx.tokens(tx.normalize(c("corrected_text"))).alias("r"))
    return spread(p, *_KEY).select(*_KEY, F.round(m.wer(c("h"), c("r")), 6).alias("wer"))


@query(f"with {S.ONCE}, {_PAIR} select session_id, chunk_index, round({S.coverage('h', 'r')}, 6) as coverage from p")
def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _once(spark, d, "raw_asr", "corrected_text").select(*_KEY, tx.tokens(tx.normalize(c("raw_asr"))).alias("h"), tx.tokens(tx.normalize(c("corrected_text"))).alias("r"))
    return spread(p, *_KEY).select(*_KEY, F.round(m.coverage(c("h"), c("r")), 6).alias("coverage"))


_VOTE = lambda start, first="": f"""hit as (select h.*, r.* exclude (surah) from hyp h join cand r on h.surah = r.surah and r.{start} between greatest(1, h.expected - 1) and h.expected + 3),
both_ as (select * from hit union all select h.*, r.* exclude (surah) from hyp h join cand r on h.surah = r.surah where not exists (select 1 from hit t where t.session_id = h.session_id and t.chunk_index = h.chunk_index) {first}),
tok as (select *, {S.tokens('norm')} as ht, {S.tokens('norm_text')} as rt from both_),
met as (select *, {S.cer('norm', 'norm_text')} as cer, {S.wer('ht', 'rt')} as wer, {S.coverage('ht', 'rt')} as cov from tok)"""  # noqa: E731
_ONE = f"""with {S.ONCE}, {S.REF}, {S.HYP}, cand as (select surah, ayah, norm_text from ref), {_VOTE('ayah')},
sc as (select *, {S.clamp('0.65 * (1 - cer) + 0.35 * cov')} as conf, {S.clamp('0.5 * (1 - cer) + 0.3 * (1 - wer) + 0.2 * cov')} as ali from met),
best as (select * from sc qualify row_number() over (partition by session_id, chunk_index order by cer, cov desc, conf desc, ayah) = 1)"""


@query(f"{_ONE} select session_id, chunk_index, ayah, round(cer, 6) as cer, round(wer, 6) as wer, round(cov, 6) as coverage, round(conf, 6) as confidence, round(ali, 6) as alignment from best")
def band_match_best(spark: SparkSession, d: str) -> DataFrame:
    best = match.verses(_hyp(spark, d), _ref(spark, d), _KEY, known=True)
    return best.select(*_KEY, "ayah", *[F.round(x, 6).alias(x) for x in ("cer", "wer", "coverage", "confidence", "alignment")])


@query(f"""with {S.ONCE}, {S.REF}, {S.HYP}, {_SPANS.format(last=11)}, cand as (select surah, "start", "end", text as norm_text, dense_rank() over (partition by surah order by "start") as place from spans), {_VOTE('"start"', 'and r.place <= 12')},
sc as (select *, {S.clamp('0.45 * (1 - cer) + 0.20 * (1 - wer) + 0.30 * cov + least(0.08, 0.01 * ("end" - "start" + 1))')} as conf, {S.clamp('0.40 * (1 - cer) + 0.30 * (1 - wer) + 0.30 * cov')} as ali from met)
select session_id, chunk_index, "start", "end", round(cer, 6) as cer, round(wer, 6) as wer, round(cov, 6) as coverage, round(conf, 6) as confidence, round(ali, 6) as alignment
from sc qualify row_number() over (partition by session_id, chunk_index order by cer, cov desc, conf desc, "start", "end") = 1""")
def sequence_match_best(spark: SparkSession, d: str) -> DataFrame:
    best = match.sequences(_hyp(spark, d), corpus.spans(_ref(spark, d), 12), _KEY)
    return best.select(*_KEY, "start", "end", *[F.round(x, 6).alias(x) for x in ("cer", "wer", "coverage", "confidence", "alignment")])


def _level_sql(conf: str, n: str) -> str:
    return f"case when {conf} >= ({S.threshold(n, 'high')}) then 'high' when {conf} >= ({S.threshold(n, 'medium')}) then 'medium' else 'low' end"


@query(f"""with {S.ONCE}, w as (select session_id, chunk_index, r.conf as conf, len({S.tokens(S.normalize('r.raw'))}) as n from once),
l as (select session_id, chunk_index, {_level_sql('conf', 'n')} as level from w)
select *, case level when 'high' then 'ok' when 'medium' then 'minor' else 'error' end as verdict,
       case level when 'high' then 0.44 when 'medium' then 0.33 end as most_word_cer from l""")
def adaptive_verdict(spark: SparkSession, d: str) -> DataFrame:
    w = _once(spark, d, "raw_asr", "confidence").select(*_KEY, m.level(c("confidence"), F.size(tx.tokens(tx.normalize(c("raw_asr"))))).alias("level"))
    return w.select("*", m.verdict(c("level")).alias("verdict"), F.when(c("level") == "high", 0.44).when(c("level") == "medium", 0.33).alias("most_word_cer"))


_WCER = S.cer("h[i]", "r[i]")


@query(f"""with {S.ONCE}, {_PAIR} select session_id, chunk_index, array_to_string(list_transform(range(1, len(h) + 1), lambda i:
  case when r[i] is not null and ({_WCER}) <= 0.38 and (left(h[i], 1) = left(r[i], 1) or right(h[i], 1) = right(r[i], 1)) then r[i] else h[i] end), ' ') as fixed from p""")
def constrained_correction(spark: SparkSession, d: str) -> DataFrame:
    p = _once(spark, d, "raw_asr", "corrected_text")
    words = m.constrained_words(tx.tokens(tx.normalize(c("raw_asr"))), tx.tokens(tx.normalize(c("corrected_text"))), F.lit(0.38))
    return p.select(*_KEY, F.array_join(words, " ").alias("fixed"))


@query(f"""with {S.ONCE}, {S.REF}, {S.HYP} select session_id, chunk_index, hyp.surah, expected, norm_text as expected_text from hyp left join ref on hyp.surah = ref.surah and hyp.expected = ref.ayah""")
def lookup_expected(spark: SparkSession, d: str) -> DataFrame:
    ref = _ref(spark, d).select("surah", c("ayah").alias("expected"), c("norm_text").alias("expected_text"))
    return _hyp(spark, d).drop("norm").join(broadcast_if_small(ref), ["surah", "expected"], "left").select(*_KEY, "surah", "expected", "expected_text")


@query(f"""with {S.ONCE}, {S.REF}, p as (select session_id, chunk_index, {S.tokens(S.normalize('r.raw'))} as t, o.tokens as ref from once join ref o on r.id = o.surah || ':' || o.ayah)
select session_id, chunk_index, array_to_string(case when len(t) > 0 and length(t[-1]) <= 4 and not list_contains(ref, t[-1])
  and len(list_filter(ref, lambda x: starts_with(x, t[-1]) and length(x) > length(t[-1]))) > 0 then t[1:len(t) - 1] else t end, ' ') as kept from p""")
def drop_partial_tail(spark: SparkSession, d: str) -> DataFrame:
    ref = _ref(spark, d).select(F.concat_ws(":", "surah", "ayah").alias("id"), c("tokens").alias("ref"))
    p = _once(spark, d, "raw_asr", "matched_surah_ayah_id").join(broadcast_if_small(ref), c("matched_surah_ayah_id") == c("id"))
    return p.select(*_KEY, F.array_join(tx.drop_partial_tail(tx.tokens(tx.normalize(c("raw_asr"))), c("ref")), " ").alias("kept"))


# Retrieval

_BM25 = f"""{_STATS}, post as (select surah, ayah, global_idx, len(tokens) as dl, unnest(tokens) as term from ref),
pw as (select p.surah, p.ayah, p.global_idx, p.term, any_value(s.idf) * count(*) * 2.5 / (count(*) + 1.5 * (0.25 + 0.75 * any_value(p.dl) / (select avg(len(tokens)) from ref))) as w from post p join stats s on p.term = s.term group by 1, 2, 3, 4),
qt as (select q, term, count(*) as k from (select q, unnest(words) as term from qry) group by q, term),
bm as (select q, surah, ayah, global_idx, round(sum(k * w), 6) as score from qt join pw on qt.term = pw.term group by 1, 2, 3, 4),
top as (select *, row_number() over (partition by q order by score desc, global_idx) as rank from bm qualify rank <= 30)"""


@query(f"with {S.ONCE}, {S.REF}, {_QUERIES}, {_BM25} select q, surah, ayah, score, cast(rank as int) as rank from top")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(_queries(spark, d), "q", _ref(spark, d)).select("q", "surah", "ayah", "score", "rank")


@query(f"""with {S.ONCE}, {S.REF}, {_QUERIES}, {_BM25}, sur as (select q, surah, max(score) as score from top group by q, surah),
r as (select *, row_number() over (partition by q order by score desc, surah) as k, lead(score) over (partition by q order by score desc, surah) as second from sur)
select q, surah, score, round(score - coalesce(second, 0), 6) as margin from r where k = 1""")
def surah_margin(spark: SparkSession, d: str) -> DataFrame:
    top = retrieve.bm25(_queries(spark, d), "q", _ref(spark, d))
    two = top.groupBy("q", "surah").agg(F.max("score").alias("score")).groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-c("score")).alias("m"), "surah"))), 1, 2).alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return two.select("q", first["surah"].alias("surah"), (-first["m"]).alias("score"), F.round(-first["m"] + F.coalesce(second["m"], F.lit(0.0)), 6).alias("margin"))


@query(f"""with {S.ONCE}, {S.REF}, {_QUERIES}, {_INDEX},
qg as (select q, 2 as n, unnest(list_distinct({_GRAMS('words', 2)})) as gram from qry union all select q, 3, unnest(list_distinct({_GRAMS('words', 3)})) from qry),
h as (select q, global_idx, cast(sum(idx.n) as bigint) as hits from qg join idx on qg.n = idx.n and qg.gram = idx.gram group by 1, 2)
select q, global_idx, hits, cast(row_number() over (partition by q order by hits desc, global_idx) as int) as rank from h qualify rank <= 30""")
def ngram_candidates_top30(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.ngram_candidates(_queries(spark, d), "q", corpus.ngram_index(_ref(spark, d)))


@query(f"""with {S.ONCE}, {_PAIR}, g as (select session_id, chunk_index, list_distinct(list_concat({_GRAMS('h', 2)}, {_GRAMS('h', 3)})) as a, list_concat({_GRAMS('r', 2)}, {_GRAMS('r', 3)}) as b from p)
select session_id, chunk_index, round(case when len(a) = 0 then 0.0 else len(list_intersect(a, b)) / cast(len(a) as double) end, 6) as overlap from g""")
def overlap_coefficient(spark: SparkSession, d: str) -> DataFrame:
    p = _once(spark, d, "raw_asr", "corrected_text").select(*_KEY, tx.tokens(tx.normalize(c("raw_asr"))).alias("h"), tx.tokens(tx.normalize(c("corrected_text"))).alias("r"))
    g = lambda t: F.concat(tx.ngrams(c(t), 2), tx.ngrams(c(t), 3))
    return p.select(*_KEY, F.round(m.overlap_coefficient(g("h"), g("r")), 6).alias("overlap"))


@query()
def fuzzy_rerank(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.rerank(_queries(spark, d), "q", _ref(spark, d))


@query()
def viterbi_path(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.viterbi(_queries(spark, d), "q", _ref(spark, d), online=True)


# Sessions


@query(f"""with {S.ONCE}, t as (select session_id, chunk_index, r.cor as t from once where len({S.tokens(S.normalize('r.cor'))}) >= 2)
select session_id, chunk_index, string_agg(t, '  ') over (partition by session_id order by chunk_index rows between 7 preceding and current row) as buffer from t""")
def rolling_buffer_8(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "corrected_text").where(F.size(tx.tokens(tx.normalize(c("corrected_text")))) >= 2)
    return windows.rolling(t, "session_id", ["chunk_index"], "corrected_text").select(*_KEY, "buffer")


@query(f"with {S.ONCE} select session_id, chunk_index, max(r.ayah) over (partition by session_id order by chunk_index rows unbounded preceding) as reached from once")
def monotone_progress(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "matched_ayah").select(*_KEY, evaluate.running_max(c("matched_ayah"), "session_id", order=["chunk_index"]).alias("reached"))


@query(f"with {S.ONCE} select session_id, arg_max(r.lock.locked_surah, chunk_index) as locked_surah from once where r.lock.lock_state = 'ACTIVE' and r.lock.locked_surah is not null group by session_id")
def last_lock(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "surah_lock_state").where("surah_lock_state.lock_state = 'ACTIVE' and surah_lock_state.locked_surah is not null")
    return t.groupBy("session_id").agg(F.max_by("surah_lock_state.locked_surah", "chunk_index").alias("locked_surah"))


@query(f"""with {S.ONCE}, v as (select session_id, cast(split_part(r.id, ':', 1) as int) as surah, count(*) as n, min(chunk_index) as f from once where r.id is not null group by 1, 2)
select session_id, surah, n from v qualify row_number() over (partition by session_id order by n desc, f) = 1""")
def majority_surah(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "matched_surah_ayah_id").withColumn("surah", F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int"))
    return evaluate.vote(t, "session_id", "surah", "chunk_index")


@query(f"""with {S.ONCE} select session_id, count(*) as chunks, count(*) filter (where r.ver = 'ok') as ok, count(*) filter (where r.ver = 'error') as errors,
round(count(*) filter (where r.ver = 'ok') * 100.0 / greatest(1, count(*) filter (where r.ver in ('ok', 'error'))), 1) as accuracy,
round(avg(r.cer), 12) as mean_cer, round(avg(case when r.lev = 'low' then 1.0 else 0.0 end), 6) as low_share from once group by session_id""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "verdict", "cer", "confidence_level")
    ok, err = F.count_if(c("verdict") == "ok"), F.count_if(c("verdict") == "error")
    low = F.avg(F.when(c("confidence_level") == "low", 1.0).otherwise(0.0))
    return t.groupBy("session_id").agg(F.count("*").alias("chunks"), ok.alias("ok"), err.alias("errors"), F.round(ok * 100.0 / F.greatest(F.lit(1), ok + err), 1).alias("accuracy"), F.round(F.avg("cer"), 12).alias("mean_cer"), F.round(low, 6).alias("low_share"))


@query(f"with {S.ONCE} select session_id, string_agg(r.cor, ' ' order by chunk_index) as text from once where r.cor <> '' group by session_id")
def session_text(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "corrected_text").where("corrected_text <> ''")
    return t.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "corrected_text"))), lambda x: x["corrected_text"]), " ").alias("text"))


@query("""with l as (select session_id, max(end_sample) as n from chunk_results where end_sample > 0 group by session_id), s as (select session_id, n, unnest(range(0, n, 56000)) as a from l)
select session_id, a as "start", least(a + 80000, n) as "end" from s where (a = 0 or a - 56000 + 80000 < n) and least(a + 80000, n) - a >= 16000""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "chunk_results").where("end_sample > 0").groupBy("session_id").agg(F.max("end_sample").alias("n"))
    return n.select("session_id", F.inline(windows.hopping(c("n"), 80_000, 56_000, 16_000)))


@query("""with g as (select *, case when ts - lag(ts) over w >= interval 3 hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts range unbounded preceding) as i from g)
select user_id, min(ts) as session_start, max(ts) + interval 3 hour as session_end, count(*) as n from s group by user_id, i""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.silences(table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")), "user_id", "ts", "3 hours")


def blip_fold(spark: SparkSession, d: str) -> DataFrame:
    return windows.fold_blips(_once(spark, d, "start_time_s", "end_time_s").where("start_time_s < end_time_s"), "session_id", "start_time_s", "end_time_s", 4.0)


QUERIES["blip_fold"] = blip_fold


@query(f"""with {S.ONCE} select session_id, to_json(list(struct_pack(chunk_index := chunk_index, verdict := r.ver) order by chunk_index)) as chunks from once group by session_id""")
def session_json(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "verdict")
    js = F.to_json(F.sort_array(F.collect_list(F.struct("chunk_index", "verdict"))), {"ignoreNullFields": "false"})
    return t.groupBy("session_id").agg(js.alias("chunks"))


# Evaluation


@query("select true_word_label as true_label, true_harakaat_label as pred_label, count(*) as n from labeled_examples where true_word_label is not null and true_harakaat_label is not null group by 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(table(spark, d, "labeled_examples"), "true_word_label", "true_harakaat_label")


_WORD = f"w as (select true_word_label as true_label, case when {_SKEL('predicted_word')} = {_SKEL('reference_word')} then 'correct' else 'incorrect' end as pred_label from labeled_examples where true_word_label is not null and predicted_word is not null and reference_word is not null)"


@query(f"""with {_WORD}, l as (select distinct true_label as label from w union select distinct pred_label from w),
k as (select label, count(*) filter (where true_label = label and pred_label = label) as tp, count(*) filter (where true_label <> label and pred_label = label) as fp, count(*) filter (where true_label = label and pred_label <> label) as fn from l, w group by label),
r as (select *, case when tp + fp = 0 then 0.0 else tp / cast(tp + fp as double) end as p, case when tp + fn = 0 then 0.0 else tp / cast(tp + fn as double) end as q from k)
select label, tp, fp, fn, round(p, 8) as precision, round(q, 8) as recall, round(case when p + q = 0 then 0.0 else 2 * p * q / (p + q) end, 8) as f1 from r""")
def prf_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labeled_examples").where("true_word_label is not null and predicted_word is not null and reference_word is not null")
    word, _ = evaluate.word_verdict(c("predicted_word"), c("reference_word"), c("is_last_word"))
    out = evaluate.label_metrics(evaluate.confusion(e.withColumn("pred", word), "true_word_label", "pred"))
    return out.select("label", "tp", "fp", "fn", *[F.round(x, 8).alias(x) for x in ("precision", "recall", "f1")])


@query("""with e as (select surah, true_word_label as word, true_harakaat_label as vowels from labeled_examples),
u as (select surah, 'word' as rule, word = 'correct' as ok from e where word is not null union all select surah, 'vowels', vowels = 'correct' from e where vowels is not null)
select coalesce(rule, 'pooled') as rule, count(*) as n, round(avg(case when ok then 1.0 else 0.0 end), 8) as accuracy from u group by grouping sets ((rule), ())""")
def pooled_rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labeled_examples").select(c("true_word_label").alias("word"), c("true_harakaat_label").alias("vowels"))
    u = e.unpivot([], ["word", "vowels"], "rule", "label").where("label is not null")
    return u.rollup("rule").agg(F.count("*").alias("n"), F.round(F.avg((c("label") == "correct").cast("double")), 8).alias("accuracy")).withColumn("rule", F.coalesce("rule", F.lit("pooled")))


_OK = "raw_wer is not null and not isnan(raw_wer) and corrected_wer is not null and not isnan(corrected_wer)"
_EVALS = f"ev as (select eval_id, min_by(struct_pack(reciter := reciter, raw_wer := raw_wer, corrected_wer := corrected_wer, gain := improvement_wer, surah := surah, ayah := ayah, ref := ref, raw := raw), ingested_at) as r from eval_rows group by eval_id)"


def _evals(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return evaluate.latest(table(spark, d, "eval_rows"), ["eval_id"], "ingested_at", list(columns))


@query(f"with {_EVALS} select count(*) as n, round(avg(r.raw_wer), 8) as raw_wer, round(avg(r.corrected_wer), 8) as corrected_wer, round(avg(r.raw_wer - r.corrected_wer), 8) as gain from ev where {_OK.replace('raw_wer', 'r.raw_wer').replace('corrected_wer', 'r.corrected_wer')}")
def eval_means(spark: SparkSession, d: str) -> DataFrame:
    e = _evals(spark, d, "raw_wer", "corrected_wer").where(_OK)
    return e.agg(F.count("*").alias("n"), *[F.round(F.avg(x), 8).alias(x) for x in ("raw_wer", "corrected_wer")], F.round(F.avg(c("raw_wer") - c("corrected_wer")), 8).alias("gain"))


@query(f"with {_EVALS} select r.reciter as reciter, count(*) as n, round(avg(r.raw_wer), 8) as raw_wer, round(avg(r.corrected_wer), 8) as corrected_wer from ev where {_OK.replace('raw_wer', 'r.raw_wer').replace('corrected_wer', 'r.corrected_wer')} group by 1")
def eval_by_reciter(spark: SparkSession, d: str) -> DataFrame:
    e = _evals(spark, d, "reciter", "raw_wer", "corrected_wer").where(_OK)
    return e.groupBy("reciter").agg(F.count("*").alias("n"), *[F.round(F.avg(x), 8).alias(x) for x in ("raw_wer", "corrected_wer")])


@query(f"with {_EVALS} select eval_id, r.reciter as reciter, r.corrected_wer as corrected_wer from ev where r.corrected_wer is not null and not isnan(r.corrected_wer) order by corrected_wer desc, eval_id limit 20")
def eval_worst20(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.worst(_evals(spark, d, "reciter", "corrected_wer"), "corrected_wer", 20, ["eval_id"])


_MICRO = f"p as (select {S.normalize('r.raw')} as h, {S.normalize('r.ref')} as f from ev where r.ref is not null), t as (select *, {S.tokens('h')} as ht, {S.tokens('f')} as ft from p)"


@query(f"""with {_EVALS}, {_MICRO}, s as (select sum({S.token_edits('ht', 'ft')}) as we, sum(len(ft)) as w, sum({S.edits('h', 'f')}) as ce, sum(length(f)) as k from t)
select cast(we as bigint) as word_edits, cast(w as bigint) as words, cast(ce as bigint) as char_edits, cast(k as bigint) as chars, round(we / cast(w as double), 8) as wer, round(ce / cast(k as double), 8) as cer from s""")
def micro_wer(spark: SparkSession, d: str) -> DataFrame:
    p = _evals(spark, d, "raw", "ref").where("ref is not null").select(tx.normalize(c("raw")).alias("h"), tx.normalize(c("ref")).alias("f"))
    return evaluate.micro_rates(spread(p), "h", "f")


@query("select reader, bitrate_kbps from readers where not contains(lower(coalesce(special_notes, '')), 'incomplete') and reader is not null")
def reader_filter(spark: SparkSession, d: str) -> DataFrame:
    notes = F.lower(F.coalesce("special_notes", F.lit("")))
    return table(spark, d, "readers").where(~F.contains(notes, F.lit("incomplete")) & c("reader").isNotNull()).select("reader", "bitrate_kbps")


@query(f"with {_EVALS} select eval_id, r.reciter as reciter from ev where r.reciter in (select reader from readers)")
def known_readers(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "readers").select(c("reader").alias("reciter"))
    return _evals(spark, d, "reciter").join(broadcast_if_small(known), "reciter", "left_semi").select("eval_id", "reciter")


# Marks

_CL = lambda w, g: f"regexp_extract_all({w}, {S.q(f'([^{tx.VOWELS}])([{tx.VOWELS}]*)')}, {g})"


@query(f"""select example_id, len({_CL('reference_word', 1)}) as bases, array_to_string({_CL('reference_word', 1)}, '') as skeleton,
case when len({_CL('predicted_word', 1)}) <> len({_CL('reference_word', 1)}) then '' else array_to_string(list_filter(range(0, len({_CL('reference_word', 1)})), lambda i: ({_CL('predicted_word', 2)})[i + 1] <> ({_CL('reference_word', 2)})[i + 1]), ',') end as differing
from labeled_examples where predicted_word is not null and reference_word is not null""")
def diacritic_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labeled_examples").where("predicted_word is not null and reference_word is not null")
    bases, _ = tx.clusters(c("reference_word"))
    return e.select("example_id", F.size(bases).cast("long").alias("bases"), F.array_join(bases, "").alias("skeleton"), F.array_join(tx.differing_marks(c("predicted_word"), c("reference_word")).cast("array<string>"), ",").alias("differing"))


@query("""select session_id, chunk_index, array_to_string(list_transform(list_filter(harakaat_errors, lambda x: x.status = 'harakaat_error'), lambda x: x.predicted || '>' || x.reference), ' ') as errors,
len(list_filter(word_errors, lambda x: x.status not in ('correct', 'minor'))) > 0 as wrong from chunk_results where harakaat_errors is not null or word_errors is not null""")
def error_projection(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chunk_results").where("harakaat_errors is not null or word_errors is not null")
    errors = F.transform(F.filter("harakaat_errors", lambda x: x["status"] == "harakaat_error"), lambda x: F.concat(x["predicted"], F.lit(">"), x["reference"]))
    wrong = F.size(F.filter("word_errors", lambda x: ~x["status"].isin("correct", "minor"))) > 0
    return t.select(*_KEY, F.array_join(errors, " ").alias("errors"), F.when(c("word_errors").isNotNull(), wrong).alias("wrong"))


# Signals


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: cast(v as double) * cast(v as double))) / len(embedding)), 6) as rms, round(list_max(list_transform(embedding, lambda v: abs(v))), 6) as peak, len(embedding) as n from embeddings")
def signal_levels(spark: SparkSession, d: str) -> DataFrame:
    x = c("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(windows.rms(x), 6).alias("rms"), F.round(windows.peak(x).cast("float"), 6).alias("peak"), F.size(x).cast("long").alias("n"))


@query("select vec_id, len(embedding) as before, 200 as after, round(list_sum(list_transform(embedding[1:200], lambda v: cast(v as double))), 5) as total from embeddings")
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    p = windows.pad(c("embedding"), 200)
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("before"), F.size(p).alias("after"), F.round(F.aggregate(p, F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query("""with e as (select vec_id, i, round(list_sum(list_transform(embedding[i + 1:i + 8], lambda v: cast(v as double) * cast(v as double))), 9) as e from (select vec_id, embedding, unnest(range(10, 41)) as i from embeddings))
select vec_id, cast(arg_min(i, (e, i)) as int) as cut from e group by vec_id""")
def quietest_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", windows.quietest(c("embedding"), 8, 10, 40).alias("cut"))


@query("select session_id, chunk_index, case when duration_s < 1.5 or confidence < 0.005 then 'skipped' when duration_s is null or confidence is null then 'decode' else 'decode' end as gate from chunk_results")
def energy_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_results").select(*_KEY, windows.gate(c("duration_s"), c("confidence")).alias("gate"))


# Relational layer


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02 00:00:00'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    o, k, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(k, c("o_custkey") == c("c_custkey")).join(n, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Alignment and sessions (kernels in Python: no SQL)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ref = _ref(spark, d).select(F.concat_ws(":", "surah", "ayah").alias("id"), c("norm_text").alias("ref"), c("raw_text").alias("ref_raw"), c("tokens").alias("ref_words"))
    rows = _once(spark, d, "raw_asr", "corrected_text", "matched_surah_ayah_id", "confidence")
    joined = rows.join(broadcast_if_small(ref), c("matched_surah_ayah_id") == c("id"))
    return spread(joined.withColumns({"a": tx.normalize(c("raw_asr")), "b": tx.normalize(c("corrected_text"))}), *_KEY)


@query()
def word_annotations(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("words", align.spoken(align.annotations(c("a"), c("ref"), c("confidence"))))
    return p.select(*_KEY, align.minor_fixes(c("words")).alias("fixed"), F.inline("words"))


@query()
def best_of_two(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(*_KEY, F.inline(align.best_annotations(c("a"), c("b"), c("ref"))))


@query()
def wrong_word_spans(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("w", align.spoken(align.annotations(c("a"), c("ref"), F.lit(None))))
    return p.select(*_KEY, F.inline(align.wrong_words(F.transform("w", lambda x: x["status"]), F.transform("w", lambda x: x["word"]))))


@query()
def diacritic_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "labeled_examples")
    v = align.vowel_check(c("predicted_word"), c("reference_word"), c("surah"), c("ayah"))
    return spread(e, "example_id").select("example_id", v.alias("v")).select("example_id", "v.skipped", "v.reason", "v.harakaat", "v.makhraj")


def _skeletons(spark: SparkSession, d: str) -> set[str]:
    """Skeletons of the fixed corpus's words: as many as it has, some thousands."""
    return {r["s"] for r in bounded(corpus.skeletons(_ref(spark, d)))}


@query()
def merge_engines(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("against", F.when(c("confidence") >= 0.4, c("ref")))
    return align.merged(p, "a", "b", "against", _KEY, _skeletons(spark, d))


@query()
def boundary_recovery(spark: SparkSession, d: str) -> DataFrame:
    words = {r["word"] for r in bounded(corpus.vocabulary(_ref(spark, d)).select("word").distinct())}  # of the fixed corpus
    return spread(_once(spark, d, "raw_asr"), *_KEY).select(*_KEY, align.split_known(tx.normalize(c("raw_asr")), words).alias("text"))


@query()
def merged_transcript(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "corrected_text").select(*_KEY, c("corrected_text").alias("text"), tx.normalize(c("corrected_text")).alias("norm"))
    return sessions.transcripts(t)


@query()
def fragment_carry(spark: SparkSession, d: str) -> DataFrame:
    return sessions.fragments(_pairs(spark, d).select(*_KEY, c("a").alias("text"), c("ref_words").alias("ref")))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    lock = c("surah_lock_state")
    return _once(spark, d, "surah_lock_state").select(*_KEY, lock["top_surah"].alias("surah"), lock["top_score"].alias("score"), lock["margin"].alias("margin"))


@query()
def lock_fsm(spark: SparkSession, d: str) -> DataFrame:
    return sessions.locks(_votes(spark, d))


@query()
def correction_fsm(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.transform(F.filter(F.coalesce("word_errors", F.array()), lambda x: ~x["status"].isin("correct", "minor")), lambda x: x["word"])
    vowels = F.transform(F.filter(F.coalesce("harakaat_errors", F.array()), lambda x: x["status"] == "harakaat_error"), lambda x: F.coalesce(x["reference"], x["predicted"]))
    return sessions.corrections(_once(spark, d, "verdict", "confidence", "word_errors", "harakaat_errors").select(*_KEY, "verdict", "confidence", wrong.alias("wrong"), vowels.alias("vowels")))


@query()
def progressive_pointer(spark: SparkSession, d: str) -> DataFrame:
    return sessions.progress(_once(spark, d, "matched_ayah", "verdict", "cer", "coverage", "confidence"))


@query(f"""with {S.ONCE.replace('raw := raw_asr', 'words := word_errors, raw := raw_asr')}, w as (select session_id, chunk_index, r.id as id, unnest(r.words) as x from once where r.id is not null),
s as (select session_id, id, x.ref_index as ref_index, x.status as status, chunk_index, x.hyp_index as h from w where x.status is not null)
select session_id, id, ref_index, case when bool_or(status = 'correct') then 'correct' else arg_max(status, (chunk_index, h, status)) end as status from s group by 1, 2, 3""")
def word_status(spark: SparkSession, d: str) -> DataFrame:
    w = _once(spark, d, "matched_surah_ayah_id", "word_errors").where("matched_surah_ayah_id is not null")
    w = w.select("session_id", c("matched_surah_ayah_id").alias("id"), "chunk_index", F.explode("word_errors").alias("x")).select("session_id", "id", c("x.ref_index").alias("ref_index"), c("x.status").alias("status"), F.struct("chunk_index", "x.hyp_index", "x.status").alias("seq"))
    return sessions.word_statuses(w, ["session_id", "id"], "ref_index", "status", "seq")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "raw_asr", "matched_ayah", "matched_surah_ayah_id")
    surah = F.get(F.split("matched_surah_ayah_id", ":"), F.lit(0)).cast("int")
    return rows.select(*_KEY, surah.alias("surah"), c("matched_ayah").alias("expected"), c("raw_asr").alias("raw"))


@query()
def guard_preserve(spark: SparkSession, d: str) -> DataFrame:
    return guard.guard(_raw(spark, d), _ref(spark, d), corpus.spans(_ref(spark, d), 12), _KEY)


@query()
def guard_replace(spark: SparkSession, d: str) -> DataFrame:
    return guard.guard(_raw(spark, d), _ref(spark, d), None, _KEY, "aggressive", preserve=False, auto=True)


@query()
def invocation_strip(spark: SparkSession, d: str) -> DataFrame:
    ways = ("fuzzy", "wide", "words", "exact")
    return spread(_once(spark, d, "raw_asr"), *_KEY).select(*_KEY, *[guard.strip_invocations(c("raw_asr"), w).alias(w) for w in ways])


@query()
def synthetic_labels(spark: SparkSession, d: str) -> DataFrame:
    return guard.corrupted(table(spark, d, "ayah_entries"))


@query()
def chunk_messages(spark: SparkSession, d: str) -> DataFrame:
    return guard.messages(table(spark, d, "chunk_results"))


@query(f"with {S.ONCE}, {S.HYP} select session_id, chunk_index, greatest(lag(expected) over w + 1, expected) as at, coalesce(expected - (lag(expected) over w + 1) >= 2, false) as skipped from hyp window w as (partition by session_id order by chunk_index)")
def position_policy(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("expected").over(Window.partitionBy("session_id").orderBy("chunk_index")) + 1
    return guard.position(_hyp(spark, d).withColumn("due", before), "due", "expected").select(*_KEY, "at", "skipped")
