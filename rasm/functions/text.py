"""Text functions as native column expressions. Null stays null unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(spec: str) -> str:
    """The inside of a character class from code points and ranges in hexadecimal."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in spec.split())


# Marks that normalization deletes.
MARKS = span("0610-061A 064B-065F 0670 06D6-06DC 06DF-06E4 06E7-06E8 06EA-06ED")
TATWEEL = "ـ"
# What normalization keeps besides the space. The Latin A is part of the guard's list; the strict list is without it.
ALLOWED = span("0600-06FF 0041 0660-0669 06F0-06F9")
ALLOWED_STRICT = span("0600-06FF 0660-0669 06F0-06F9")
# Vowel marks that a skeleton is without.
VOWELS = span("064B-0652 0670")
# Marks, quotes and signs that the evaluation's normalization deletes.
EVAL_MARKS = span("0610-061A 064B-065F 0670 0640 06D6-06ED 00AB 00BB 200E-200F 202A-202E FEFF")
# Letters that sound alike and what they are folded to.
FOLD_FROM, FOLD_TO = "أإآٱىة", "اااايه"
# The wasla alef and combining signs (madda, hamza above and below) that the merge deletes before anything else.
SIGNS = "ٱ" + span("0653 0654 0655")
# Phrases and words that recognition gets wrong, with what they stand for.
PHRASE_FIXES = [
    ("الرحيلحمد", "الرحيم الحمد"), ("الدي ن", "الدين"), ("العالم ن", "العالمين"), ("إياكنعبد", "إياك نعبد"), ("أن عمت", "أنعمت"), ("الر حيم", "الرحيم"), ("الر حين", "الرحيم"), ("الرح يم", "الرحيم"),
    ("الرحم ن", "الرحمن"), ("الرح من", "الرحمن"), ("المست قيم", "المستقيم"), ("المستق يم", "المستقيم"), ("المس تقيم", "المستقيم"), ("الض الين", "الضالين"), ("الضال ين", "الضالين"), ("العال مين", "العالمين"),
    ("نست عين", "نستعين"), ("المحت كين", "المستقيم"), ("صرا ط", "صراط"), ("سرا ط", "صراط"), ("يو م", "يوم"),
]
TOKEN_FIXES = {"الرحي": "الرحيم", "الرحين": "الرحيم", "المستقي": "المستقيم", "صاط": "صراط", "هدنا": "اهدنا", "نستعي": "نستعين"}
# Further replacements of the aggressive mode, in this order.
AGGRESSIVE_FIXES = [("إهدنا", "اهدنا"), ("الضالن", "الضالين"), ("الالمين", "العالمين")]
BASMALA = ("بسم", "الله", "الرحمن", "الرحيم")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def normalize(c: Column, strict: bool = False) -> Column:
    """Without marks and tatweel; what is not allowed becomes a space; single spaces. Null gives ''."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{MARKS}{TATWEEL}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, f"[^{ALLOWED_STRICT if strict else ALLOWED} ]+", " "), " +", " "))


def normalize_for_eval(c: Column) -> Column:
    """Folds letters that sound alike and drops punctuation; null gives ''."""
    folded = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{EVAL_MARKS}]+", ""), FOLD_FROM, FOLD_TO)
    return collapse(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s\p{Z}]", ""))


def skeleton(c: Column) -> Column:
    """A word without vowel marks, alike letters folded; as long as the word without its marks."""
    return F.translate(F.regexp_replace(c, f"[{VOWELS}]", ""), FOLD_FROM, FOLD_TO)


def smart_word(c: Column) -> Column:
    """The merge's form: wasla and madda signs go first, so a wasla alef is deleted, not folded; then vowels; hamza alefs fold."""
    return F.translate(F.regexp_replace(F.regexp_replace(c, f"[{SIGNS}]", ""), f"[{VOWELS}]", ""), FOLD_FROM[:2], FOLD_TO[:2])


def fold_invocation(c: Column) -> Column:
    return F.translate(normalize(c), FOLD_FROM, FOLD_TO)


def display(c: Column) -> Column:
    """Single spaces; null gives ''."""
    return collapse(F.coalesce(c, F.lit("")))


def preview(c: Column, n: int = 40) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of a text with single spaces; [] of an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def words(c: Column) -> Column:
    """tokens() of a text with single spaces only, which names c once."""
    return F.array_remove(F.split(c, " "), "")


def collapse_repeats(t: Column) -> Column:
    """Words without those equal to the one before. No lambda names t, which would be computed again for each word."""
    before = F.concat(F.array(F.lit(None).cast("string")), t)
    return F.filter(F.zip_with(t, before, lambda x, y: F.when(y.isNull() | (x != y), x)), lambda x: x.isNotNull())


def tile(t: Column) -> Column:
    """The shortest block that, repeated, gives all words."""

    def block(w: Column) -> Column:
        n = F.size(w)
        fits = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda k: (n % k == 0) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i) == F.get(w, i % k)))
        return F.when(n <= 1, w).otherwise(F.slice(w, 1, F.get(fits, F.lit(0))))

    return let(t, block)


def ngrams(t: Column, n: int) -> Column:
    """Word n-grams; a shorter text once as a whole."""
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(grams)


def fix_rules(c: Column, mode: str = "balanced") -> Column:
    """Normalized text with repeated words dropped; but in safe mode known phrases and then known words put right, and in aggressive
    mode three more phrases."""
    text = F.array_join(let(words(normalize(c)), collapse_repeats), " ")
    if mode == "safe":
        return text
    put = lambda x, fixes: reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), fixes, x)
    known = F.create_map(*[F.lit(x) for p in TOKEN_FIXES.items() for x in p])
    text = F.array_join(F.transform(words(put(text, PHRASE_FIXES)), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    return put(text, AGGRESSIVE_FIXES) if mode == "aggressive" else text


def has_basmala(t: Column) -> Column:
    return F.coalesce(F.slice(t, 1, 4) == F.array(*map(F.lit, BASMALA)), F.lit(False))


def without_basmala(t: Column, surah: Column, ayah: Column) -> Column:
    """Words without a leading basmala, where it is no verse of its own: in another chapter than the first, at verse 1 or unknown."""
    return F.when(F.coalesce((surah != 1) & (ayah.isNull() | (ayah == 1)), F.lit(False)) & has_basmala(t), F.slice(t, 5, F.greatest(F.lit(1), F.size(t)))).otherwise(t)


def longest_run(t: Column) -> Column:
    """Length of the longest run of equal words, 0 of none."""
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["w"].eqNullSafe(x), a["n"] + 1).otherwise(1)
        return F.struct(x.alias("w"), n.alias("n"), F.greatest(a["m"], n).alias("m"))

    return F.aggregate(t, start, step, lambda a: a["m"])


def clusters(c: Column) -> tuple[Column, Column]:
    """(base characters, marks after each); marks before the first base are dropped."""
    pattern = f"([^{VOWELS}])([{VOWELS}]*)"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))


def differing_marks(predicted: Column, reference: Column) -> Column:
    """Positions (from 0) of the clusters whose marks differ; [] if the numbers of clusters differ."""
    (pb, pm), (rb, rm) = clusters(predicted), clusters(reference)
    at = F.filter(F.sequence(F.lit(0), F.size(pb) - 1), lambda i: F.get(pm, i) != F.get(rm, i))
    return F.when((F.size(pb) != F.size(rb)) | (F.size(pb) == 0), F.array().cast("array<int>")).otherwise(at)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it: an expression in a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_partial_tail(t: Column, ref: Column) -> Column:
    """Words without a last one of up to 4 letters that is no reference word but begins one."""

    def cut(x: Column) -> Column:
        last = x["last"]
        begins = F.exists(x["ref"], lambda r: F.startswith(r, last) & (F.length(r) > F.length(last))) & ~F.array_contains(x["ref"], last) & (F.length(last) <= 4)
        return F.when(F.coalesce(begins, F.lit(False)), F.slice(x["t"], 1, F.size(x["t"]) - 1)).otherwise(x["t"])

    return let(t, lambda w: let(F.struct(w.alias("t"), ref.alias("ref"), F.try_element_at(w, F.lit(-1)).alias("last")), cut))
