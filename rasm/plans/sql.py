"""Pieces of SQL that say the same as the column functions."""

from rasm.functions import text as tx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), {q('[' + tx.MARKS + tx.TATWEEL + ']')}, '', 'g'), {q('[^' + tx.ALLOWED + ' ]+')}, ' ', 'g'), ' +', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"case when {x} = '' then cast([] as varchar[]) else string_split({x}, ' ') end"


_LETTERS = [*range(0x621, 0x63B), *range(0x641, 0x64B), 0x6A9, 0x6CC, *range(0x660, 0x66A), *range(0x6F0, 0x6FA), 0x60C, 0x61B, 0x61C, 0x61F]
_ASCII = "".join(chr(i) for i in range(33, 127) if chr(i) not in "A'")[: len(_LETTERS)]
_FROM = "".join(map(chr, _LETTERS))


def ascii_letters(x: str) -> str:
    """One ASCII character for each letter of a normalized text: the distance there counts bytes."""
    return f"translate({x}, {q(_FROM)}, {q(_ASCII)})"


def edits(a: str, b: str) -> str:
    return f"levenshtein({ascii_letters(a)}, {ascii_letters(b)})"


def cer(h: str, r: str) -> str:
    return f"case when length({r}) = 0 then 1.0 else {edits(h, r)} / cast(length({r}) as double) end"


def token_edits(h: str, r: str) -> str:
    """h, r: arrays. Words become ASCII characters by their place among the words of h, of which there may be 94; words that h has not
    are one character, as they equal none of it."""
    code = lambda t: f"array_to_string(list_transform({t}, lambda w: chr(cast(32 + coalesce(list_position(list_distinct({h}), w), 0) as int))), '')"
    return f"levenshtein({code(h)}, {code(r)})"


def wer(h: str, r: str) -> str:
    return f"case when len({r}) = 0 then 1.0 else {token_edits(h, r)} / cast(len({r}) as double) end"


def coverage(h: str, r: str) -> str:
    shared = f"list_sum(list_transform(list_distinct({r}), lambda w: least(len(list_filter({h}, lambda x: x = w)), len(list_filter({r}, lambda y: y = w)))))"
    return f"case when len({r}) = 0 or len({h}) = 0 then 0.0 else {shared} / cast(len({r}) as double) end"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def threshold(n: str, level: str) -> str:
    a, b, c, d = {"high": (0.40, 0.60, 0.72, 0.82), "medium": (0.25, 0.40, 0.55, 0.65)}[level]
    return f"case when {n} <= 3 then {a} when {n} <= 6 then {b} when {n} <= 10 then {c} else {d} end"


#: Deliveries of a chunk once, the earliest.
ONCE = "once as (select session_id, chunk_index, min_by(struct_pack(raw := raw_asr, cor := corrected_text, ayah := matched_ayah, id := matched_surah_ayah_id, conf := confidence, lev := confidence_level, ver := verdict, s := start_time_s, e := end_time_s, lock := surah_lock_state, cer := cer, wer := wer), received_at) as r from chunk_results group by all)"
REF = f"ref as (select *, {tokens('norm_text')} as tokens from (select surah, ayah, row_number() over (order by surah, ayah) - 1 as global_idx, text, {normalize('text')} as norm_text from ayah_entries))"
HYP = f"""hyp as (select session_id, chunk_index, cast(split_part(r.id, ':', 1) as int) as surah, r.ayah as expected, {normalize('r.raw')} as norm from once where r.ayah is not null and r.id is not null)"""
