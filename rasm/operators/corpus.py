"""The reference corpus and what is derived from it once: order, vocabulary, postings, n-gram index, spans, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm.functions import text as tx


def from_export(rows: DataFrame, key: str = "ayah_key", text: str = "text") -> DataFrame:
    """`surah, ayah, text` of rows keyed "surah_ayah": bad keys and texts empty after normalization are dropped, repeats once."""
    parts = F.split(F.col(key), "_", 2)
    out = rows.select(F.get(parts, F.lit(0)).try_cast("int").alias("surah"), F.get(parts, F.lit(1)).try_cast("int").alias("ayah"), F.col(text).alias("text"))
    return out.where("surah is not null and ayah is not null").where(tx.normalize(F.col("text")) != "").distinct()


def reference(verses: DataFrame) -> DataFrame:
    """`surah, ayah, global_idx, raw_text, norm_text, tokens`: verses in corpus order, counted from 0.

    The order is settled per chapter and over the table of chapters, so no task sorts the corpus."""
    norm = tx.normalize(F.col("text"))
    base = verses.select("surah", "ayah", F.col("text").alias("raw_text"), norm.alias("norm_text"))
    sizes = base.groupBy("surah").agg(F.count("*").alias("n"))
    before = sizes.select("surah", F.coalesce(F.sum("n").over(Window.orderBy("surah").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("surah").orderBy("ayah"))
    return base.join(F.broadcast(before), "surah").select("surah", "ayah", (F.col("before") + place - 1).alias("global_idx"), "raw_text", "norm_text", tx.tokens(F.col("norm_text")).alias("tokens"))


def vocabulary(ref: DataFrame) -> DataFrame:
    return ref.select("surah", F.explode("tokens").alias("word")).distinct()


def skeletons(ref: DataFrame) -> DataFrame:
    """`s`: the different forms without vowels of the corpus's words, as they are printed."""
    words = ref.select(F.explode(F.split(tx.display(F.col("raw_text")), " ")).alias("w")).where("w <> ''")
    return words.select(tx.smart_word(F.col("w")).alias("s")).distinct()


def postings(ref: DataFrame) -> DataFrame:
    """`surah, ayah, term, tf, dl`"""
    words = ref.select("surah", "ayah", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return words.groupBy("surah", "ayah", "term", "dl").agg(F.count("*").alias("tf"))


def term_stats(ref: DataFrame) -> DataFrame:
    """`term, df, idf`, idf = ln((N - df + 0.5) / (df + 0.5) + 1)"""
    n = ref.select(F.count("*").alias("total"))
    df = ref.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def ngram_index(ref: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """`gram, n, global_idx`, one row for each occurrence."""
    grams = [ref.select("global_idx", F.lit(n).alias("n"), F.explode(tx.ngrams(F.col("tokens"), n)).alias("gram")) for n in sizes]
    out = grams[0]
    for g in grams[1:]:
        out = out.unionByName(g)
    return out


def spans(ref: DataFrame, most: int) -> DataFrame:
    """`surah, start, end, text, tokens`: every run of up to `most` successive verses. Joined within unbroken stretches only."""
    w = Window.partitionBy("surah", "island").orderBy("ayah")
    isl = ref.withColumn("island", F.col("ayah") - F.row_number().over(Window.partitionBy("surah").orderBy("ayah")))
    ahead = F.collect_list(F.struct("ayah", "norm_text")).over(w.rowsBetween(0, most - 1))
    each = isl.select("surah", F.col("ayah").alias("start"), ahead.alias("run")).select("surah", "start", "run", F.posexplode("run").alias("i", "last"))
    return each.select("surah", "start", F.col("last.ayah").alias("end"), F.array_join(F.transform(F.slice("run", 1, F.col("i") + 1), lambda x: x["norm_text"]), " ").alias("text"))


def prefixes(ref: DataFrame) -> DataFrame:
    """`depth, prefix, is_end, verses`: the prefix tree of the verses' words."""
    n = F.size("tokens")
    each = ref.where("size(tokens) > 0").select(F.explode(F.sequence(F.lit(1), n)).alias("depth"), "tokens", n.alias("n"))
    return each.groupBy("depth", F.array_join(F.slice("tokens", 1, F.col("depth")), " ").alias("prefix")).agg(F.max(F.col("depth") == F.col("n")).alias("is_end"), F.count("*").alias("verses"))


def prompts(ref: DataFrame, back: int = 2) -> DataFrame:
    """The texts of up to `back` verses before each verse."""
    w = Window.partitionBy("surah").orderBy("ayah").rowsBetween(-back, -1)
    return ref.select("surah", "ayah", F.array_join(F.collect_list("norm_text").over(w), " ").alias("prompt"))


def bm25(tf: Column, df_idf: Column, dl: Column, mean: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return df_idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
