"""Alignment of recognized words with reference words: annotations, vowel checks, merging of two recognizers.

The kernels run in Arrow-batched Python over pairs that are already bounded (a chunk and a verse or span)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from rasm import kernels as k
from rasm.functions import text as tx

WORD = "array<struct<word: string, reference: string, status: string, similarity: double, hyp_index: int, ref_index: int>>"
VOWEL = re.compile(f"[{tx.VOWELS}]")
DAGGER = chr(0x670)


def _each(f: Callable, kind: str) -> Callable[..., Column]:
    """f over rows as an Arrow-batched UDF; a row with a null argument gives null. What f gives becomes an Arrow array at once."""
    from pyspark.sql.pandas.types import to_arrow_type

    target = to_arrow_type(_parse_datatype_string(kind))

    def run(cols: tuple) -> pa.Array:
        return pa.array([None if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in cols))], target)

    # a UDF of a fixed number of arguments each: the kind of UDF is read off its signature
    def one(a: pa.Array) -> pa.Array:
        return run((a,))

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run((a, b))

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run((a, b, c))

    return F.arrow_udf((one, two, three)[len(signature(f).parameters) - 1], kind)


def annotations(hyp: Column, ref: Column, confidence: Column) -> Column:
    """Word annotations of two texts with single spaces, by a shortest edit script; null of a null text."""
    f = _each(lambda h, r, c: k.annotate(h.split(), r.split(), None if c != c else c), WORD)
    return f(hyp, ref, F.coalesce(confidence.cast("double"), F.lit(float("nan"))))


def best_annotations(first: Column, second: Column, ref: Column) -> Column:
    """For each reference word the better of two recognizers' annotations, the first of equals."""
    return _each(lambda a, b, r: k.best_of(k.annotate(a.split(), r.split(), None), k.annotate(b.split(), r.split(), None)), WORD)(first, second, ref)


def wrong_words(statuses: Column, words: Column) -> Column:
    """Phrases of wrong words with their places."""
    f = lambda s, w: [{"phrase": p, "first": a, "last": z} for p, a, z in k.wrong_phrases(list(s), list(w))]
    return _each(f, "array<struct<phrase: string, first: int, last: int>>")(statuses, words)


def word_errors(hyp: Column, ref: Column) -> Column:
    """What differs between two texts by matching runs: (kind, expected, got) with a word missing or extra, or a phrase substituted."""

    def run(h: str, r: str) -> list[dict]:
        a, b = r.split(), h.split()
        out = []
        for tag, i1, i2, j1, j2 in k.blocks(a, b):
            if tag == "delete":
                out += [{"kind": "missing", "expected": w, "got": None} for w in a[i1:i2]]
            elif tag == "insert":
                out += [{"kind": "extra", "expected": None, "got": w} for w in b[j1:j2]]
            elif tag == "replace":
                out.append({"kind": "substitution", "expected": " ".join(a[i1:i2]), "got": " ".join(b[j1:j2])})
        return out

    return _each(run, "array<struct<kind: string, expected: string, got: string>>")(hyp, ref)


def teachable(words: Column) -> Column:
    """Phrases of reference words to be taught, with their places."""
    f = lambda w: [{"text": t, "first": a, "last": z} for t, a, z in k.teachable(w)]
    return _each(f, "array<struct<text: string, first: int, last: int>>")(words)


def minor_fixes(words: Column) -> Column:
    """The text with minor slips put right: the reference's word where the status is minor, else the word itself."""
    kept = F.filter(words, lambda x: x["word"].isNotNull())
    return F.array_join(F.transform(kept, lambda x: F.when(x["status"] == "minor", x["reference"]).otherwise(x["word"])), " ")


def spoken(words: Column) -> Column:
    """Annotations without those at the end that are only missing."""
    last = F.array_max(F.filter(F.transform(words, lambda x, i: F.when(x["status"] != "missing", i + 1)), lambda i: i.isNotNull()))
    return F.slice(words, 1, F.coalesce(last, F.lit(0)))


def _skeleton(word: str) -> str:
    return VOWEL.sub("", word).translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO))


def check_vowels(predicted: str, reference: str, first_of_all: bool = False) -> dict:
    """Status of each word by its vowel marks: ok, harakaat_error, makhraj_error (another skeleton), missing, extra.

    Nothing is checked against verse 1:1, an empty reference or one without marks. A bare word is ok. A dagger alef of the
    reference, and the marks at the end of the last word, do not count."""
    if first_of_all or not reference:
        return {"skipped": True, "reason": "no_reference", "words": [], "harakaat": 0, "makhraj": 0}
    if not VOWEL.search(reference):
        return {"skipped": True, "reason": "reference_not_diacritized", "words": [], "harakaat": 0, "makhraj": 0}
    pred, ref = predicted.split(), reference.split()
    out = []
    for tag, i1, i2, j1, j2 in k.blocks([_skeleton(w) for w in ref], [_skeleton(w) for w in pred]):
        for n in range(max(i2 - i1, j2 - j1)):
            i, j = i1 + n if i1 + n < i2 else None, j1 + n if j1 + n < j2 else None
            r, p = ref[i] if i is not None else None, pred[j] if j is not None else None
            if tag == "equal":
                a, b = r.replace(DAGGER, ""), p
                if i == len(ref) - 1:
                    a, b = re.sub(f"{VOWEL.pattern}+$", "", a), re.sub(f"{VOWEL.pattern}+$", "", b)
                out.append((j, p, r, "ok" if a == b or not VOWEL.search(p) else "harakaat_error"))
            elif p is None:
                if tag == "delete":
                    out.append((-1, "", r, "missing"))
            else:
                out.append((j, p, r if tag == "replace" else None, "makhraj_error" if tag == "replace" else "extra"))
    words = [{"index": a, "predicted": b, "reference": c, "status": d} for a, b, c, d in out]
    return {"skipped": False, "reason": None, "words": words, "harakaat": sum(w["status"] == "harakaat_error" for w in words), "makhraj": sum(w["status"] == "makhraj_error" for w in words)}


CHECK = "struct<skipped: boolean, reason: string, words: array<struct<index: int, predicted: string, reference: string, status: string>>, harakaat: int, makhraj: int>"


def vowel_check(predicted: Column, reference: Column, surah: Column, ayah: Column) -> Column:
    f = _each(lambda p, r, one: check_vowels(p, r, bool(one)), CHECK)
    return f(F.coalesce(predicted, F.lit("")), F.coalesce(reference, F.lit("")), F.coalesce((surah == 1) & (ayah == 1), F.lit(False)))


def smart(word: str) -> str:
    return VOWEL.sub("", re.sub(f"[{tx.SIGNS}]", "", word)).translate(str.maketrans(tx.FOLD_FROM[:2], tx.FOLD_TO[:2]))


def inject_vowels(word: str, donor: str) -> str:
    """word with the donor's marks at the same letters; where the lengths differ, the donor if it has marks, else word."""
    bare, base = (VOWEL.sub("", re.sub(f"[{tx.SIGNS}]", "", w)) for w in (word, donor))
    if len(bare) != len(base):
        return donor if VOWEL.search(donor) else word
    marks: list[str] = []
    for ch in donor:
        if VOWEL.match(ch):
            if marks:
                marks[-1] += ch
        else:
            marks.append("")
    return "".join(ch + (marks[i] if i < len(marks) else "") for i, ch in enumerate(bare))


def merge_engines(first: str, second: str, reference: str | None, known: Callable[[str], bool]) -> tuple[str, str]:
    """(words, words with vowels) from two recognizers; the second's words carry vowels.

    Without a reference the first's word stands unless only the second's is known. With one, at each of its places the word of
    the engine that has it right, else what was said; places that neither fills are left out."""
    a, b = first.split(), second.split()
    sa, sb = [smart(w) for w in a], [smart(w) for w in b]
    close = lambda x, y: len(x) == len(y) and (x == y if len(x) < 3 else k.levenshtein(x, y) <= (1 if len(x) <= 6 else 2))
    words, donors = [], []
    if reference:
        ref = reference.split()
        sr = [smart(w) for w in ref]
        places = []
        for s in (sa, sb):
            at: dict[int, int] = {}
            for tag, i1, i2, j1, j2 in k.blocks(sr, s, autojunk=False):
                if tag in ("equal", "replace"):
                    at |= {i: j for i, j in zip(range(i1, i2), range(j1, j2))}
            places.append(at)
        for i in range(len(ref)):
            x, y = places[0].get(i), places[1].get(i)
            if x is not None and (sa[x] == sr[i] or y is None or sb[y] != sr[i]):
                words.append(a[x])
                donors.append(b[y] if y is not None and close(sa[x], sb[y]) else None)
            elif y is not None:
                words.append(b[y])
                donors.append(b[y])
    else:
        give: dict[int, tuple[str, str | None]] = {}
        for tag, i1, i2, j1, j2 in k.blocks(sa, sb):
            for i, j in zip(range(i1, i2), range(j1, j2)):
                if tag == "equal":
                    give[i] = (a[i], b[j])
                elif tag == "replace":
                    take = known(sb[j]) and not known(sa[i])
                    give[i] = (b[j] if take else a[i], b[j] if take or close(sa[i], sb[j]) else None)
        for i, w in enumerate(a):
            x, y = give.get(i, (w, None))
            words.append(x)
            donors.append(y)
    return " ".join(words), " ".join(inject_vowels(w, d) if d else w for w, d in zip(words, donors))


def merged(df: DataFrame, first: str, second: str, reference: str, keys: list[str], vocabulary: set[str]) -> DataFrame:
    """keys, words, voweled. `vocabulary` holds the skeletons of the fixed corpus, a set of bounded size."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [merge_engines(x or "", y or "", z, vocabulary.__contains__) for x, y, z in zip(*(b.column(n).to_pylist() for n in (first, second, reference)))]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keys], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*keys, "words", "voweled"])

    return df.select(*keys, first, second, reference).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in keys) + ", words string, voweled string")


def split_known(texts: Column, vocabulary: set[str]) -> Column:
    """Word boundaries put right with a bounded vocabulary."""
    return _each(lambda t: " ".join(k.recover_boundaries(t.split(), vocabulary)), "string")(texts)


def split_known_of(texts: Column, surah: Column, vocabularies: dict[int, set[str]]) -> Column:
    """Word boundaries put right with the words of one chapter, or of all where surah is null; an unknown chapter changes nothing."""
    everything = set().union(*vocabularies.values())

    def run(text: str, of: int) -> str:
        words = everything if of < 0 else vocabularies.get(of, set())
        return " ".join(k.recover_boundaries(text.split(), words)) if words else text

    return _each(run, "string")(texts, F.coalesce(surah.cast("int"), F.lit(-1)))
