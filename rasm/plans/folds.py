"""SQL of the session folds: recursion over a session's rows in order."""

from __future__ import annotations

from rasm.plans import sql as S

_ONCE = S.ONCE.replace("raw := raw_asr", "words := word_errors, marks := harakaat_errors, cov := coverage, raw := raw_asr")


def fold(rows: str, first: str, step: str, out: str) -> str:
    """rows: `n` as (session_id, i, ..) with i from 1. first, step: the columns of the state, of `n` alone and of `n` and the state `f`."""
    return f"with recursive {rows}, f as (select n.session_id, n.chunk_index, n.i, {first} from n where i = 1 union all select n.session_id, n.chunk_index, n.i, {step} from f join n on n.session_id = f.session_id and n.i = f.i + 1) select session_id, chunk_index, {out} from f"


_I = "row_number() over (partition by session_id order by chunk_index) as i"

_MOVE = lambda p: f"case when a is not null and good then case when sure then greatest({p}, a + 1) else least(greatest({p}, a + 1), {p} + 2) end else {p} end"
POINTER = fold(
    f"{_ONCE}, n as (select session_id, chunk_index, {_I}, r.ayah as a, coalesce(r.conf, 0) >= 0.92 as sure, coalesce(r.ver in ('ok', 'minor'), false) or coalesce(r.cer <= 1.10 and r.cov >= 0.20, false) as good from once)",
    f"{_MOVE('1')} as pointer", f"{_MOVE('f.pointer')}", "cast(pointer as int) as pointer",
)

RESULTS = f"""{POINTER.split(' select session_id, chunk_index, cast(pointer')[0]}, p as (select session_id, arg_max(pointer, chunk_index) as pointer from f group by session_id),
m as (select session_id, avg(r.cer) as cer, avg(r.wer) as wer, avg(r.conf) as conf, avg(case when r.lev = 'low' then 1.0 else 0.0 end) as low from once group by session_id)
select session_id, cast(case when low < 0.60 then pointer - 1 end as int) as matched_ayah, case when low < 0.60 then round(cer, 8) end as cer, case when low < 0.60 then round(wer, 8) end as wer, case when low < 0.60 then round(conf, 8) end as confidence,
round(low, 6) as low_share, case when low < 0.60 then 'progressive' else 'fallback_fullpass_rule_only' end as verdict from m join p using (session_id)"""

_WORDS = lambda s: S.tokens(f"trim({s} || ' ' || n.t)").replace("string_split(trim", "string_split(trim")
_CUT = lambda w: f"len({w}) > 0 and not list_contains(n.ref, ({w})[-1]) and len(list_filter(n.ref, lambda x: starts_with(x, ({w})[-1]) and length(x) > length(({w})[-1]))) > 0"
_FR = lambda s: f"case when {_CUT(_WORDS(s))} then ({_WORDS(s)})[-1] else '' end"
_CA = lambda s: f"array_to_string(case when {_CUT(_WORDS(s))} then ({_WORDS(s)})[1:len({_WORDS(s)}) - 1] else {_WORDS(s)} end, ' ')"
FRAGMENTS = fold(
    f"{S.ONCE}, {S.REF}, n as (select session_id, chunk_index, {_I}, {S.normalize('r.raw')} as t, o.tokens as ref from once join ref o on r.id = o.surah || ':' || o.ayah)",
    f"{_CA(S.q(''))} as carried, {_FR(S.q(''))} as fragment", f"{_CA('f.fragment')}, {_FR('f.fragment')}", "carried, fragment",
)

_NEW = lambda h: f"case when n.weak then {h} else list_append({h}, struct_pack(s := n.surah, sc := n.score, m := n.margin))[-4:] end"
_OWN = "list_filter(h, lambda x: x.s = h[j].s)"
_FIRST = f"list_filter(range(1, len(h) + 1), lambda j: len({_OWN}) >= 2 and list_sum(list_transform({_OWN}, lambda x: x.sc)) / len({_OWN}) >= 0.28 and list_sum(list_transform({_OWN}, lambda x: x.m)) / len({_OWN}) >= 0.08)"
_EMPTY = "cast([] as struct(s int, sc double, m double)[])"
LOCKS = f"""with recursive {S.ONCE}, n as (select session_id, chunk_index, {_I}, surah, score, margin, surah is null or score is null or score < 0.20 as weak
  from (select session_id, chunk_index, r.lock.top_surah as surah, r.lock.top_score as score, coalesce(r.lock.margin, 0.0) as margin from once)),
f as (select session_id, chunk_index, i, h, cast(null as int) as locked, 0 as missed from (select n.*, {_NEW(_EMPTY)} as h from n where i = 1)
 union all select session_id, chunk_index, i, case when was is not null and miss >= 3 then {_EMPTY} else h end,
  case when was is not null then case when miss >= 3 then null else was end else (h[({_FIRST})[1]]).s end, case when was is not null and miss < 3 then miss else 0 end
 from (select n.session_id, n.chunk_index, n.i, {_NEW('f.h')} as h, f.locked as was, case when n.weak or n.surah <> f.locked then f.missed + 1 else 0 end as miss from f join n on n.session_id = f.session_id and n.i = f.i + 1))
select session_id, chunk_index, case when locked is not null then 'ACTIVE' else 'INACTIVE' end as state, locked from f"""

_BAD = "[]::varchar[]"
CORRECTIONS = f"""with recursive {_ONCE}, n as (select session_id, chunk_index, {_I}, coalesce(r.ver, '') as v, coalesce(r.conf, 1.0) >= 0.3 as sure,
  list_transform(list_filter(coalesce(r.words, []), lambda x: x.status not in ('correct', 'minor')), lambda x: x.word) as wrong,
  list_transform(list_filter(coalesce(r.marks, []), lambda x: x.status = 'harakaat_error'), lambda x: coalesce(x.reference, x.predicted)) as vowels from once),
f as (select session_id, chunk_index, i, a as action, case when a = 'pause' then 'CORRECTING' else 'LISTENING' end as fsm, case when a = 'pause' and v <> 'error' then 'vowels' else 'word' end as kind, 0 as attempts, case when a = 'pause' then case when v <> 'error' then vowels else wrong end else {_BAD} end as words
  from (select n.*, case when v in ('ok', 'minor') and len(vowels) > 0 then 'pause' when v = 'error' and sure then 'pause' when v in ('minor', 'error') then 'warn' else 'continue' end as a from n where i = 1)
 union all select session_id, chunk_index, i, a, case when a in ('pause', 'retry') then 'CORRECTING' when a = 'verified' or was = 'LISTENING' then 'LISTENING' else 'VERIFYING' end,
  case when a = 'pause' then case when v <> 'error' then 'vowels' else 'word' end when a = 'verified' then 'word' else kind end, case when a = 'retry' then attempts + 1 when a in ('pause', 'verified') then 0 else attempts end,
  case when a = 'pause' then case when v <> 'error' then vowels else wrong end when a = 'verified' then {_BAD} when was <> 'LISTENING' and sure and kind = 'vowels' then left_ else words end
 from (select *, case when was = 'LISTENING' then case when v in ('ok', 'minor') and len(vowels) > 0 then 'pause' when v = 'error' and sure then 'pause' when v in ('minor', 'error') then 'warn' else 'continue' end
    when not sure then 'continue' when kind = 'vowels' then case when len(left_) > 0 then 'retry' else 'verified' end when v in ('ok', 'minor') then 'verified' else 'retry' end as a
  from (select n.*, case when f.fsm = 'CORRECTING' then 'VERIFYING' else f.fsm end as was, f.kind, f.attempts, f.words, list_filter(f.words, lambda x: list_contains(n.vowels, x)) as left_ from f join n on n.session_id = f.session_id and n.i = f.i + 1)))
select session_id, chunk_index, action, fsm, kind, attempts from f"""

BLIPS = f"""with recursive {S.ONCE}, t as (select session_id, r.s as s, r.e as e from once where r.s < r.e), n as (select *, row_number() over (partition by session_id order by s, e) as i, count(*) over (partition by session_id) as last from t),
f as (select session_id, i, last, s as a, e as z, e - s >= 4.0 as closed from n where i = 1
 union all select session_id, i, last, a, z, z - a >= 4.0 from (select n.session_id, n.i, n.last, case when f.closed then n.s else f.a end as a, case when f.closed then n.e else greatest(f.z, n.e) end as z from f join n on n.session_id = f.session_id and n.i = f.i + 1))
select session_id, a as from_s, z as to_s from f where closed or i = last"""

SQL = {"progressive_pointer": POINTER, "progress_results": RESULTS, "fragment_carry": FRAGMENTS, "lock_fsm": LOCKS, "correction_fsm": CORRECTIONS, "blip_fold": BLIPS}
