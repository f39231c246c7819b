"""Retrieval of verses for a text: BM25 and n-gram candidates by equi-joins on terms, reranking of the few that remain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm import kernels
from rasm.operators import corpus
from rasm.session import bounded, broadcast_if_small, spread, written


def bm25(queries: DataFrame, key: str, ref: DataFrame, k: int = 30) -> DataFrame:
    """`key, surah, ayah, global_idx, score, rank`: the k best verses of each query (`words`), ties in corpus order.

    A word counts as often as the query has it. Scores are rounded to 6 places before they are ranked. Verses that share no word
    with the query score 0 and are left out; rerank() puts them back where fewer than k remain."""
    c = F.col
    docs = ref.select("surah", "ayah", "global_idx")
    mean = ref.select(F.avg(F.size("tokens")).alias("mean"))
    weights = corpus.postings(ref).join(broadcast_if_small(corpus.term_stats(ref)), "term").crossJoin(F.broadcast(mean))
    weights = weights.select("term", "surah", "ayah", corpus.bm25(c("tf"), c("idf"), c("dl"), c("mean")).alias("w")).join(broadcast_if_small(docs), ["surah", "ayah"])
    weights = written(weights)  # once, and then of a known size
    # spread by query once: the counts of words, the sums and the ranks all stay with their query
    terms = queries.select(key, "words").repartition(key).select(key, F.explode("words").alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))
    score = terms.join(broadcast_if_small(weights), "term").groupBy(key, "surah", "ayah", "global_idx").agg(F.round(F.sum(c("times") * c("w")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "global_idx"))
    return score.withColumn("rank", rank).where(c("rank") <= k)


def top_chapters(top: DataFrame, key: str, k: int) -> DataFrame:
    """`key, surah, score, rank`: the k (one at least) best chapters of each query by their best verse, ties by number."""
    c = F.col
    best = top.groupBy(key, "surah").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "surah"))
    return best.withColumn("rank", rank).where(c("rank") <= max(1, k))


def likeness(a: Column, b: Column) -> Column:
    """Indel ratio of two texts, 0 to 100; null of a null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 0.0 if bool(p) != bool(q) else kernels.indel_ratio(p, q) for p, q in zip(x, y)], dtype=float)

    return run(a, b)


def closest(hyp: DataFrame, ref: DataFrame, keys: list[str], k: int, back: int = 5, ahead: int = 10) -> DataFrame:
    """`keys, rank, surah, ayah, ratio`: the k verses of the band around the one expected with the best ratio, ties in order.

    Without a chapter, or with an empty band, there are none; neither are there of an empty text."""
    from rasm.operators import match

    c = F.col
    rows = match.band(hyp.where("norm <> ''"), ref.select("surah", "ayah", "norm_text"), "ayah", back, ahead, fallback=None)
    pairs = spread(rows.select(*keys, "norm", F.inline("near")), *keys).withColumn("ratio", F.round(likeness(c("norm"), c("norm_text")), 6))
    best = pairs.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-c("ratio")).alias("m"), "surah", "ayah"))), 1, k).alias("b"))  # of one band
    return best.select(*keys, F.posexplode("b").alias("_at", "_x")).select(*keys, (c("_at") + 1).alias("rank"), "_x.surah", "_x.ayah", (-c("_x.m")).alias("ratio"))


def perfect(queries: DataFrame, key: str, ref: DataFrame) -> DataFrame:
    """`key, perfect`: the score of a verse with each of the query's words."""
    words = queries.select(key, F.explode(F.array_distinct("words")).alias("term"))
    return words.join(broadcast_if_small(corpus.term_stats(ref)), "term").groupBy(key).agg(F.sum("idf").alias("perfect"))


def ngram_candidates(queries: DataFrame, key: str, index: DataFrame, sizes: tuple[int, ...] = (2, 3), k: int = 30) -> DataFrame:
    """`key, global_idx, hits, rank`: verses by the weighted number of shared n-grams (weight n, each occurrence in the index)."""
    from rasm.functions import text as tx

    c = F.col
    of = lambda n: F.transform(F.array_distinct(tx.ngrams(c("words"), n)), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    grams = F.flatten(F.array(*map(of, sizes)))
    q = queries.select(key, "words").repartition(key).select(key, F.inline(grams))
    hits = q.join(broadcast_if_small(written(index)), ["n", "gram"]).groupBy(key, "global_idx").agg(F.sum("n").alias("hits"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hits"), "global_idx"))
    return hits.withColumn("rank", rank).where(c("rank") <= k)


def rerank(queries: DataFrame, key: str, ref: DataFrame, k: int = 30, best: bool = False, once: bool = False) -> DataFrame:
    """`key, surah, score, bm25, fuzzy`: best verse of each chapter by 0.4 x BM25 (of the perfect score) + 0.6 x partial ratio; with `best`
    only the best of all, of equal ones the first chapter.

    Each different text is ranked once, in one pass over arrays of the small and fixed corpus. `once`: the texts are known to differ, and
    are ranked where they are."""
    c = F.col
    order = bounded(ref.select("global_idx", "surah", "norm_text").orderBy("global_idx"))
    mean = ref.select(F.avg(F.size("tokens")).alias("mean"))
    own = corpus.postings(ref).join(broadcast_if_small(corpus.term_stats(ref)), "term").crossJoin(F.broadcast(mean)).join(broadcast_if_small(ref.select("surah", "ayah", "global_idx")), ["surah", "ayah"])
    place = {r["global_idx"]: i for i, r in enumerate(order)}
    terms: dict[str, list[tuple[int, float]]] = {}
    idf: dict[str, float] = {}
    for r in bounded(own.select("term", "idf", "global_idx", corpus.bm25(c("tf"), c("idf"), c("dl"), c("mean")).alias("w"))):
        terms.setdefault(r["term"], []).append((place[r["global_idx"]], r["w"]))
        idf[r["term"]] = r["idf"]
    weights = {t: (np.array([i for i, _ in sorted(x)]), np.array([w for _, w in sorted(x)])) for t, x in terms.items()}
    verses, surah = [r["norm_text"] or "" for r in order], np.array([r["surah"] for r in order], np.int32)
    group = np.zeros(len(surah), np.int32) if best else surah

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = kernels.Ranker(verses, weights, idf)
        for b in batches:
            found = ranker.best([(t or "", w or []) for t, w in zip(b.column("norm").to_pylist(), b.column("words").to_pylist())], group, k)
            each = [x for f in found for x in f]
            own = pa.StructArray.from_arrays([pa.array([int(surah[i]) for i, _, _ in each], pa.int32()), pa.array([s for _, s, _ in each], pa.float64()), pa.array([f for _, _, f in each], pa.float64())], ["surah", "bm25", "fuzzy"])
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.ListArray.from_arrays(ends, own)], names=[*kept, "found"])

    kept = [key] if once else ["norm", "words"]
    kind = "found array<struct<surah: int, bm25: double, fuzzy: double>>"
    score = [F.round(0.4 * c("bm25") + 0.6 * c("fuzzy"), 6).alias("score"), F.round("bm25", 4).alias("bm25"), F.round("fuzzy", 4).alias("fuzzy")]
    if once:
        return queries.select(key, "norm", "words").mapInArrow(run, f"{key} {dict(queries.dtypes)[key]}, {kind}").select(key, F.inline("found")).select(key, "surah", *score)
    texts = spread(queries.select("norm", "words").distinct(), "norm")
    done = texts.mapInArrow(run, f"norm string, words array<string>, {kind}").withColumnsRenamed({"norm": "_norm", "words": "_words"})
    rows = queries.join(done, c("norm").eqNullSafe(c("_norm")) & c("words").eqNullSafe(c("_words"))).select(key, F.inline("found"))
    return rows.select(key, "surah", *score)


def viterbi(queries: DataFrame, key: str, ref: DataFrame, window: int = 5, step: int = 3, online: bool = False, locked: int | None = None, start: int | None = None) -> DataFrame:
    """`key, step, global_idx, emission`: the best path of each text through the corpus, in windows of words; with the chapter found on
    the way (`online`), or given (`locked`), or with one that the path more likely starts in (kernels.viterbi).

    Emissions (0.6 x shared n-grams + 0.4 x ratio) are taken once per different window: of its candidates in the index of 2- and
    3-grams, an equi-join; where it has none, of the whole corpus, whose texts (small and fixed) go to each task. The search runs per
    text, whose windows are as many as its words / step."""
    from rasm.functions import text as tx

    c = F.col
    n = F.size("words")
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.array_join(F.slice("words", i + 1, window), " "))
    wins = queries.where(n > 0).select(key, F.posexplode(cut).alias("t", "window"))
    texts = wins.select("window").distinct().withColumn("words", tx.tokens(c("window")))
    index = corpus.ngram_index(ref).where(F.size(F.split("gram", " ")) == c("n"))  # texts shorter than n are no n-gram here
    cand = ngram_candidates(texts, "window", index).groupBy("window").agg(F.sort_array(F.collect_list(F.struct("rank", "global_idx"))).alias("hits"))  # at most 30
    each = spread(texts.select("window").join(cand, "window", "left").select("window", c("hits.global_idx").alias("hits")), "window")
    fixed = bounded(ref.select("global_idx", "surah", "ayah", "norm_text").orderBy("global_idx"))  # one short text per verse of the fixed corpus
    order, verses, first = [r["surah"] for r in fixed], [r["norm_text"] for r in fixed], [r["ayah"] == 1 for r in fixed]
    within = 0.4 if online else 0.0  # what the lock may add to one verse and take from another

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = kernels.emitter(verses, within=within)
        for b in batches:
            cand = of.many([(w.split(" "), h) for w, h in zip(b.column("window").to_pylist(), b.column("hits").to_pylist())])
            ends = pa.array(np.cumsum([0, *map(len, cand)]), pa.int32())
            each = [pa.array([x[i] for c in cand for x in c], t) for i, t in ((0, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("window"), *[pa.ListArray.from_arrays(ends, x) for x in each]], names=["window", "verses", "scores"])

    em = each.mapInArrow(emit, "window string, verses array<long>, scores array<double>")
    paths = spread(wins.join(em, "window"), key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "verses", "scores"))).alias("steps"))
    paths = paths.select(key, *[c(f"steps.{x}").alias(x) for x in ("t", "verses", "scores")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = kernels.chapters(order, first)
        for b in batches:
            every, size = [], []
            for t, v, s in zip(*(b.column(x).to_pylist() for x in ("t", "verses", "scores"))):
                path = kernels.viterbi([list(zip(x, y)) for x, y in zip(v, s)], order, False if locked is None else locked, start=start, first=first, online=online, corpus=whole)
                every += [(n, *x) for n, x in zip(t, path)]
                size.append(len(path))
            own = b.column(key).take(pa.array(np.repeat(np.arange(len(size)), size), pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *[pa.array([x[i] for x in every], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.float64()))]], names=[key, "step", "global_idx", "emission"])

    return paths.mapInArrow(run, f"{key} {dict(queries.dtypes)[key]}, step int, global_idx long, emission double")


def aligned(paths: DataFrame, queries: DataFrame, key: str, step: int = 3) -> DataFrame:
    """`key, at, global_idx, words, confidence, level`: the verses of each path with the words said of them, the mean emission in
    percent, and high where that is over 75. The last window takes the words that are left."""
    c = F.col
    last = paths.groupBy(key).agg(F.max("step").alias("last"))
    each = paths.join(last, key).join(queries.select(key, "words"), key)
    n = F.when(c("step") == c("last"), F.size("words")).otherwise(step)
    said = each.select(key, "step", "global_idx", "emission", F.slice("words", c("step") * step + 1, n).alias("said"))
    g = said.groupBy(key, "global_idx").agg(F.min("step").alias("at"), F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", "said"))), lambda x: x["said"])), " ").alias("words"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.avg("emission") * 100)).alias("confidence"))
    return g.where("words <> ''").select(key, "at", "global_idx", "words", F.round("confidence", 4).alias("confidence"), F.when(c("confidence") > 75, "high").otherwise("low").alias("level"))


def beginnings(queries: DataFrame, key: str, ref: DataFrame, window: int = 5, step: int = 3) -> DataFrame:
    """`key, global_idx, confidence` of texts (key, norm): the verse that each path of viterbi(online=True) begins with, as aligned() has
    it. All of a text is done where it is, with arrays of the small and fixed corpus; nothing is shuffled."""
    c = F.col
    fixed = bounded(ref.select("global_idx", "surah", "ayah", "norm_text", "tokens").orderBy("global_idx"))
    order, verses, first = [r["surah"] for r in fixed], [r["norm_text"] for r in fixed], [r["ayah"] == 1 for r in fixed]
    places: dict[tuple[str, ...], list[int]] = {}
    for r in fixed:
        for n in (2, 3):
            for i in range(len(r["tokens"]) - n + 1):
                places.setdefault(tuple(r["tokens"][i : i + n]), []).append(r["global_idx"])

    def candidates(words: list[str], k: int = 30) -> list[int]:
        """As ngram_candidates()."""
        hits: dict[int, int] = {}
        for g in dict.fromkeys(tuple(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)):
            for v in places.get(g, ()):
                hits[v] = hits.get(v, 0) + len(g)
        return sorted(hits, key=lambda v: (-hits[v], v))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, whole, known = kernels.emitter(verses, within=0.4), kernels.chapters(order, first), {}
        for b in batches:
            if len(known) > 1 << 15:
                known.clear()
            words = [t.split(" ") if t else [] for t in b.column("norm").to_pylist()]
            cut = [[tuple(w[i : i + window]) for i in range(0, len(w), step)] for w in words]
            new = [w for w in dict.fromkeys(w for x in cut for w in x) if w not in known]
            known.update(zip(new, of.many([(list(w), candidates(list(w)) or None) for w in new])))
            kept, begin, mean = [], [], []
            for i, x in enumerate(cut):
                if x:
                    path = kernels.viterbi([known[w] for w in x], order, first=first, online=True, corpus=whole)
                    own = [s for v, s in path if v == path[0][0]]
                    kept.append(i)
                    begin.append(path[0][0])
                    mean.append(sum(own) / len(own))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(kept, pa.int64())), pa.array(begin, pa.int64()), pa.array(mean, pa.float64())], names=[key, "global_idx", "mean"])

    done = queries.select(key, "norm").mapInArrow(run, f"{key} {dict(queries.dtypes)[key]}, global_idx long, mean double")
    return done.select(key, "global_idx", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c("mean") * 100)), 4).alias("confidence"))
