"""Texts that look the same in one form: a confusables skeleton for the scripts of this project.

skeleton(t) = NFD(prototypes(NFD(t))). Two texts look the same if their skeletons are equal. What is seen stays: dots, hamza,
vowel marks, madda, elongation strokes, case, punctuation and the number of spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasm.functions.text import span
from rasm.session import broadcast_if_small

# Letters and digits of other scripts drawn like the letter on the right in any place.
LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹",
}
# Capitals of scripts that share the Latin shapes (Cherokee, Lisu, Coptic), letter for letter.
CAPITALS = [
    ("ABCDEGHJKLMPRSTVWYZ", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ"),
    ("ABCDEFGHIJKLMNOPRSTUVWXYZ", "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"),
    ("BCHIKMNOPTXYoc", "ⲂⲤⲎⲒⲔⲘⲚⲞⲢⲦⲬⲨⲟⲥ"),
]
# Cf characters that are drawn.
DRAWN_FORMATS = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x8E2, 0x890, 0x891}
# Characters of other categories without a visible sign.
UNSEEN = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0]
FORMS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<vertical>"}

# Arabic letters whose Persian forms differ from them at the end of a word only.
KEHEH, KAF, FARSI_YEH, YEH, ALEF_MAKSURA = "ک", "ك", "ی", "ي", "ى"
MARK = "[" + span("0610-061A 064B-065F 0670 06D6-06DC 06DF-06E4 06E7-06E8 06EA-06ED 0300-036F") + "]"
JOINS = "[" + span("0620 0622-063F 0640-064A 066E-066F 0671-06D3 06FA-06FF") + "]"
#: Before a letter that joins, Farsi yeh has two dots and keheh no sign inside, as yeh and kaf; at the end of a word they differ.
BEFORE_JOIN = re.compile(f"[{KEHEH}{FARSI_YEH}](?={MARK}*{JOINS})")
PLAIN = re.compile("[^" + span("0020-007E 060C 061B 061F 0621-063A 0640-064A 064B-0652 0660-0669") + "]")


@lru_cache(1)
def prototypes() -> dict[int, str | None]:
    """Code point -> what it looks like, None if it is not seen; by rule from the Unicode data, and the fixed values above."""
    table: dict[int, str | None] = {}
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        cat, (tag, *parts) = unicodedata.category(ch), (unicodedata.decomposition(ch).split() or [""])
        if cat == "Cf" and cp not in DRAWN_FORMATS or cp in UNSEEN or cp >= 0xE0100:
            table[cp] = None
        elif cat in ("Zs", "Zl", "Zp") or cp == 0x85:
            table[cp] = " "
        elif (tag in FORMS or tag == "<font>" or tag == "<compat>" and cat == "Nl") and len(parts) <= 3 and parts[0] != "0020":
            table[cp] = unicodedata.normalize("NFKD", ch)
    table |= dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")
    table |= {ord(x): k for k, xs in LOOK_ALIKES.items() for x in xs}
    table |= {ord(x): k for ks, xs in CAPITALS for k, x in zip(ks, xs, strict=True)}
    return table


def skeleton(text: str) -> str:
    """The form in which texts that look the same are equal. '' stays ''."""
    if PLAIN.search(text):
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))
        if KEHEH in text or FARSI_YEH in text:
            text = BEFORE_JOIN.sub(lambda m: KAF if m.group() == KEHEH else YEH, text).replace(FARSI_YEH, ALEF_MAKSURA)
        return text
    return unicodedata.normalize("NFD", text)


def _map(batches: Iterator[pa.RecordBatch], columns: list[str], replace: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in columns:
            known: dict[str | None, str | None] = {None: None}
            out = []
            for t in b.column(c).to_pylist():
                s = known.get(t, known)
                if s is known:
                    s = known[t] = skeleton(t)
                out.append(s)
            b = b.set_column(b.schema.get_field_index(c), c, pa.array(out, pa.string()))
        yield b


def with_skeletons(df: DataFrame, *columns: str) -> DataFrame:
    """df with each named string column replaced by its skeleton. Null stays null, '' stays ''; rows are neither lost nor merged."""
    return df.mapInArrow(lambda it: _map(it, list(columns), True), df.schema)


def look_alike(df: DataFrame, left: str, right: str) -> DataFrame:
    """The rows whose two texts are non-empty, differ in code points and look the same. Equal, null and empty texts are no case."""
    cand = df.where((F.col(left) != F.col(right)) & (F.col(left) != "") & (F.col(right) != ""))
    return with_skeletons(cand, left, right).where(F.col(left) == F.col(right))


def groups(texts: DataFrame, column: str) -> DataFrame:
    """`skeleton, variants, records, least, greatest`: distinct texts that share a skeleton. Null texts are left out.

    Texts are counted before the skeleton is taken and before the shuffle on it, so a text that a third of all rows repeat is
    one row. The least and greatest original stand for the group; no list of members is gathered."""
    counted = texts.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.count("*").alias("n"))
    both = with_skeletons(counted.select(F.col("text").alias("skeleton"), "text", "n"), "skeleton")
    return both.groupBy("skeleton").agg(F.count("*").alias("variants"), F.sum("n").alias("records"), F.min("text").alias("least"), F.max("text").alias("greatest"))


def found(chunks: DataFrame, evals: DataFrame, labeled: DataFrame, verses: DataFrame, other: DataFrame) -> DataFrame:
    """`tab, rec_key`, each once: records of the four tables whose two texts differ and look the same."""
    c = F.col

    def pairs(df: DataFrame, tab: str, key: object, a: str, b: str) -> DataFrame:
        return df.select(F.lit(tab).alias("tab"), key.alias("rec_key"), c(a).alias("a"), c(b).alias("b")).where("a <> b and a <> '' and b <> ''")

    v = verses.select(c("surah").alias("vs"), c("ayah").alias("va"), c("text").alias("vt"))
    e = evals.select("eval_id", "surah", "ayah", "ref").join(broadcast_if_small(v), (c("surah") == c("vs")) & (c("ayah") == c("va")))
    x = v.withColumn("k", F.concat_ws("_", "vs", "va"))
    o = other.select("ayah_key", c("text").alias("ot")).join(broadcast_if_small(x), c("ayah_key") == c("k"))
    all_pairs = pairs(chunks, "chunk_results", F.concat_ws(":", "session_id", "chunk_index"), "raw_asr", "corrected_text")
    all_pairs = all_pairs.unionByName(pairs(e, "eval_rows", c("eval_id").cast("string"), "ref", "vt"))
    all_pairs = all_pairs.unionByName(pairs(labeled, "labeled_examples", c("example_id").cast("string"), "predicted_word", "reference_word"))
    all_pairs = all_pairs.unionByName(pairs(o, "ayah_entries", F.concat_ws(":", "vs", "va"), "vt", "ot"))
    return look_alike(all_pairs, "a", "b").select("tab", "rec_key").distinct()
