"""Small column functions of sessions, matches and displays. Null stays null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasm.functions import metrics as m
from rasm.functions import text as tx

# Marks and signs that the words of a session and of a language model's text are without.
SESSION_MARKS = tx.span("0610-061A 064B-065F 0670 0640 06D6-06ED 00AB 00BB 200E-200F 202A-202E FEFF")


def verse_id(surah: Column, ayah: Column) -> Column:
    """`surah:ayah`; null where either is null or 0."""
    return F.when((surah != 0) & (ayah != 0), F.concat_ws(":", surah, ayah))


def verse_key(surah: Column, ayah: Column) -> Column:
    """The struct (surah, ayah); null where either is null or 0."""
    return F.when((surah != 0) & (ayah != 0), F.struct(surah.cast("int").alias("surah"), ayah.cast("int").alias("ayah")))


def chapter_of_choice(choice: Column) -> Column:
    """The number in front of " - " of a choice like "2 - name"; null of nothing, of one that begins with Auto and of what is no number."""
    number = F.trim(F.get(F.split(choice, " - "), F.lit(0))).try_cast("int")
    return F.when(F.startswith(choice, F.lit("Auto")), None).otherwise(number)


def engine_of_choice(choice: Column) -> Column:
    return F.when(F.startswith(choice, F.lit("Combined")), "combined").otherwise("standard")


def word_class(said: Column, reference: Column, confidence: Column, like: Column) -> Column:
    """correct if the normalized words are equal, else uncertain under a confidence of 0.30, minor from a likeness of 0.70, else major."""
    same = tx.normalize(said) == tx.normalize(reference)
    return F.when(same, "correct").when(F.coalesce(confidence < 0.30, F.lit(False)), "uncertain").when(like >= 0.70, "minor").otherwise("major")


def only_invocations(raw: Column, analysed: Column) -> Column:
    """Whether a text is no more than the invocations: something was said, and nothing is left to look at."""
    return (F.coalesce(raw, F.lit("")) != "") & (F.coalesce(analysed, F.lit("")) == "")


def reliable(confidence: Column, matched: Column, current: Column) -> Column:
    """Whether a match is shown: of the current verse, with a confidence that is not known or 0.30 and more."""
    return F.coalesce((confidence.isNull() | (confidence >= 0.30)) & (matched == current), F.lit(False))


def votes(ayah: Column, confidence: Column, heard: Column) -> Column:
    """Whether a match may vote for its chapter: not of a first verse, sure, and with two texts heard or more."""
    return F.coalesce((ayah != 1) & (confidence >= 0.70) & (heard >= 2), F.lit(False))


def vote_score(confidence: Column) -> Column:
    return F.least(F.lit(0.95), confidence * 1.2)


def silent(peak: Column, least: float = 0.001) -> Column:
    """Whether a peak is silence; 0.01 is the bound of a level too faint to work with."""
    return peak < least


def lm_score(mean_log10: Column) -> Column:
    """A mean log10 probability a word as a score: -2 and more is 1, -5 and less is 0."""
    return m.clamp((mean_log10 + 5) / 3)


def emission(overlap: Column, like: Column, lm: Column | None = None) -> Column:
    """Score of a window against a verse: overlap and likeness, with a language model half of it; 0 without overlap."""
    score = 0.6 * overlap + 0.4 * like if lm is None else 0.5 * lm + 0.3 * overlap + 0.2 * like
    return F.when(overlap == 0, F.lit(0.0)).otherwise(score)


def without_marks(c: Column) -> Column:
    """Single spaces, no marks; punctuation stays. Null gives ''."""
    return tx.collapse(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SESSION_MARKS}]+", ""))


def fragment_text(c: Column) -> Column:
    """As without_marks, and without punctuation."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SESSION_MARKS}]+", "")
    return tx.collapse(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s\p{Z}]", ""))


def lm_line(line: Column) -> Column:
    """The third field of a|b|text without marks, normalized; '' where there is none."""
    return tx.normalize(F.regexp_replace(F.coalesce(F.get(F.split(line, r"\|", 3), F.lit(2)), F.lit("")), f"[{SESSION_MARKS}]+", ""))


def without_dagger(c: Column) -> Column:
    return F.translate(c, chr(0x670), "")


def without_last_marks(c: Column) -> Column:
    """A word without the marks after its last letter, and before its first."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{tx.VOWELS}]+", ""), f"[{tx.VOWELS}]+$", "")


# The prefix that a connecting alef is heard as, and the stem it is put right for.
WASL, STEM, WASL_STEM = "اِ", "اهد", "اهْ"


def repair_wasl(voweled: Column, word: Column) -> Column:
    """A voweled word that begins with alef and kasra: alef alone, or of the words that begin with the stem its own prefix, with the heh
    that follows taken in."""
    rest = F.substring(voweled, 3, 1 << 20)
    stem = F.concat(F.lit(WASL_STEM), F.regexp_replace(rest, f"^ه[{tx.VOWELS}]*", ""))
    return F.when(F.startswith(voweled, F.lit(WASL)), F.when(F.startswith(word, F.lit(STEM)), stem).otherwise(F.concat(F.lit("ا"), rest))).otherwise(voweled)


def backbone(first: Column, second: Column, first_known: Column, second_known: Column) -> tuple[Column, Column]:
    """(word, source): the first engine's word, but the second's without vowels where only that is a word of the corpus."""
    take = F.coalesce(second_known & ~F.coalesce(first_known, F.lit(False)), F.lit(False))
    return F.when(take, F.regexp_replace(second, f"[{tx.VOWELS}]", "")).otherwise(first), F.when(take, "second").otherwise("first")


def pending_corrections(words: Column, spans: Column, surah: Column, ayah: Column) -> Column:
    """Array of (text, surah, ayah, first, last): wrong words and their spans (text, first, last) side by side, the longer list whole;
    the span's text counts before the word; without a text there is no entry."""

    def entry(x: Column) -> Column:
        span = x["s"]
        text = F.trim(F.coalesce(F.nullif(span["text"], F.lit("")), x["w"], F.lit("")))
        return F.struct(text.alias("text"), surah.alias("surah"), ayah.alias("ayah"), span["first"].alias("first"), span["last"].alias("last"))

    both = F.arrays_zip(F.coalesce(words, F.array().cast("array<string>")).alias("w"), F.coalesce(spans, F.array().cast("array<struct<text: string, first: int, last: int>>")).alias("s"))
    return F.filter(F.transform(both, entry), lambda x: x["text"] != "")


def trim_bounds(first: Column, last: Column, n: Column, pad: int) -> tuple[Column, Column]:
    """(start, end) of the samples kept around the first and last speech, with a pad on either side; all of them where none was heard."""
    return F.coalesce(F.greatest(F.lit(0), first - pad), F.lit(0)), F.coalesce(F.least(n, last + pad), n)


def id_seconds(session_id: Column) -> Column:
    """The seconds since 1970 that a session's name holds."""
    return F.nullif(F.regexp_extract(session_id, r"^sess_(\d+)", 1), F.lit("")).try_cast("long")
