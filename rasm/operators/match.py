"""Matching of recognized texts against bands of the corpus, and what follows from the score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasm import kernels
from rasm.functions import metrics as m
from rasm.functions import text as tx
from rasm.session import bounded, broadcast_if_small, spread, written


def band(hyp: DataFrame, cand: DataFrame, at: str, back: int, ahead: int, fallback: str | None = "all", first: int = 12) -> DataFrame:
    """Each hypothesis (surah, expected) with `near`, the array of the candidates of its chapter whose `at` is in the band around the
    expected verse. Where the band is empty: all of the chapter, or with fallback="first" those of the `first` least places; with
    None, and where the chapter is not known, such a hypothesis is left out.

    The arrays are made once per place of the corpus and meet the hypotheses in one join on (chapter, place), broadcast behind a check
    of its size: nothing is shuffled after it."""
    c = F.col
    struct = F.struct(*[c(x) for x in cand.columns])
    places = F.sequence(c(at) - ahead, c(at) + back)
    bands = cand.where(c(at) >= 1).select(c("surah").alias("band_surah"), F.explode(places).alias("band_at"), struct.alias("x"))
    nearest = F.sort_array(F.collect_list(F.struct(F.abs(c("x")[at] - c("band_at")).alias("off"), "x")))  # with the least CER early, others are soon given up
    bands = bands.groupBy("band_surah", "band_at").agg(F.transform(nearest, lambda y: y["x"]).alias("band"))
    out = hyp.join(broadcast_if_small(written(bands)), (c("surah") == c("band_surah")) & (c("expected") == c("band_at")), "left").drop("band_surah", "band_at")
    if fallback is None:
        return out.where("band is not null").withColumnRenamed("band", "near")
    whole = cand
    if fallback == "first":
        rank = F.dense_rank().over(Window.partitionBy("surah").orderBy(at))
        whole = cand.withColumn("place", rank).where(c("place") <= first).drop("place")
    chapters = whole.groupBy(c("surah").alias("all_surah")).agg(F.collect_list(struct).alias("chapter"))
    lost = F.when(c("band").isNull(), c("surah"))  # null, and so without a partner, where the band has some
    out = out.join(broadcast_if_small(written(chapters)), lost == c("all_surah"), "left").drop("all_surah")
    return out.withColumn("near", F.coalesce("band", "chapter")).drop("band", "chapter").where("near is not null")


def closest(norm: Column, near: Column) -> Column:
    """The candidates (with `norm_text`) of the least CER, as an array of (cer, x).

    One pass with the least CER so far: a candidate whose length alone is too far off is passed over, and the distance of the others
    is given up once it is above what would do."""
    kind = F.struct(F.lit(None).cast("double").alias("cer"), F.get(near, F.lit(0)).alias("x"))
    start = F.struct(F.lit(float("inf")).alias("least"), F.filter(F.array(kind), lambda x: F.lit(False)).alias("few"))

    def step(acc: Column, v: Column) -> Column:
        size, own = F.length(v["norm_text"]), F.length(norm)
        most = F.when(F.isnan(acc["least"] - acc["least"]), F.greatest(size, own)).otherwise(F.floor(acc["least"] * size + 1e-6).cast("int"))
        edits = F.when(F.abs(size - own) > most, -1).otherwise(F.call_function("levenshtein", norm, v["norm_text"], most))
        cer = m.let(edits, lambda d: F.when(size == 0, F.lit(1.0)).when(d >= 0, d / size))

        def take(x: Column) -> Column:
            new = F.array(F.struct(x.alias("cer"), v.alias("x")))
            return F.when(x < acc["least"], F.struct(x.alias("least"), new.alias("few"))).when(x == acc["least"], F.struct(x.alias("least"), F.concat(acc["few"], new).alias("few"))).otherwise(acc)

        return m.let(cer, take)

    return F.aggregate(near, start, step, lambda acc: acc["few"])


def fewest(hyp: DataFrame, keys: list[str], cand: DataFrame, at: str, back: int, ahead: int, first: int | None = None) -> DataFrame:
    """`keys, norm, few` of hypotheses (keys, surah, expected, norm): what band(), with fallback="first" if `first` is given, and closest()
    come to, with the candidates of a small and fixed corpus as arrays in each task. Without a surah every candidate with a text counts."""
    c = F.col
    rows = bounded(cand.orderBy(*cand.columns))
    texts = [r["norm_text"] for r in rows]
    some = np.array([t is not None for t in texts], bool)
    of: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        if r["surah"] is not None:
            of.setdefault(r["surah"], []).append(i)
    places = np.array([-1 if r[at] is None else r[at] for r in rows], np.int64)  # 1 and more count in bands
    all_of = pa.StructArray.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in to_arrow_schema(cand.schema)], cand.columns)

    def near(surah: int | None, expected: int | None) -> np.ndarray | None:
        """Candidates that have a text; None where there are no candidates at all."""
        if surah is None:
            own = np.flatnonzero(some)
            return own if len(own) else None
        own = np.array(of.get(surah, []), np.int64)
        if not len(own):
            return None
        place = places[own]
        if expected is not None and (band := own[(place >= max(1, expected - back)) & (place <= expected + ahead)]).size:
            own = band
        elif first is not None:
            own = own[place <= np.unique(place)[:first][-1]]
        return own[some[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts, seen = kernels.Nearest([t or "" for t in texts]), {}
        for b in batches:
            kept, asked, size = [], [], []
            for i, (s, e, t) in enumerate(zip(*(b.column(x).to_pylist() for x in ("surah", "expected", "norm")))):
                if (s, e) not in seen:
                    seen[s, e] = near(s, e)
                if (own := seen[s, e]) is None:
                    continue
                kept.append(i)
                own = own[of_texts.sizes[own] == 0] if t is None else own  # an empty one has CER 1 whatever was said
                size.append(len(own) > 0)
                if size[-1]:
                    asked.append((t or "", own))
            found = of_texts.many(asked)
            won = iter(len(w) for _, w in found)
            ends = pa.array(np.cumsum([0, *(next(won) if x else 0 for x in size)]), pa.int32())
            ids = np.concatenate([np.zeros(0, np.int64), *(w for _, w in found)])
            cer = np.repeat([x for x, _ in found], [len(w) for _, w in found])
            few = pa.StructArray.from_arrays([pa.array(cer, pa.float64()), all_of.take(pa.array(ids))], ["cer", "x"])
            at_rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(at_rows) for x in (*keys, "norm")), pa.ListArray.from_arrays(ends, few)], names=[*keys, "norm", "few"])

    hyp = hyp.select(*keys, "surah", "expected", "norm")
    few = T.ArrayType(T.StructType([T.StructField("cer", T.DoubleType()), T.StructField("x", cand.schema)]))
    return hyp.mapInArrow(run, T.StructType([*(f for f in hyp.schema if f.name in (*keys, "norm")), T.StructField("few", few)])).select(*keys, "norm", c("few"))


def nearest(hyp: DataFrame, keys: list[str], order: Callable[[Column, Column, Column, Column], list], columns: list[str], scores: Callable[[Column, Column, Column, Column], dict]) -> DataFrame:
    """Of each hypothesis with `near` (or `few`, where fewest() found them) the candidate of the least CER, then of the least
    `order(cer, wer, coverage, x)`, with `scores`.

    CER comes first in the order, so the dearer scores are taken only of the candidates that share the least. No shuffle."""
    c = F.col
    few = hyp if "few" in hyp.columns else hyp.select(*keys, "norm", closest(c("norm"), c("near")).alias("few"))
    h = tx.tokens(c("norm"))

    def scored(x: Column) -> Column:
        r = tx.tokens(x["x"]["norm_text"])
        rates = F.struct(m.wer(h, r).alias("wer"), m.coverage(h, r).alias("coverage"))

        def row(y: Column) -> Column:
            args = (x["cer"], y["wer"], y["coverage"], x["x"])
            own = [x["cer"].alias("cer"), y["wer"].alias("wer"), y["coverage"].alias("coverage"), *[v.alias(n) for n, v in scores(*args).items()]]
            return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order(*args))], *[x["x"][n].alias(n) for n in columns], *own)

        return m.let(rates, row)

    best = few.select(*keys, F.array_min(F.transform("few", scored)).alias("b"))
    return best.select(*keys, *[f"b.{n}" for n in (*columns, "cer", "wer", "coverage", "confidence", "alignment")])


def verses(hyp: DataFrame, ref: DataFrame, keys: list[str], back: int = 1, ahead: int = 3, known: bool = False, fixed: bool = False) -> DataFrame:
    """Best single verse: keys, surah, ayah, cer, wer, coverage, confidence, alignment. Least CER, then most coverage, then confidence, then order.

    Without a surah every verse of the corpus is a candidate, each different text once. `known`: none is without. `fixed`: the corpus
    is small and fixed, and goes to each task (fewest)."""
    c = F.col

    def score(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = lambda cer, wer, cov, x: [cer, -cov, -m.verse_confidence(cer, cov), x["surah"], x["ayah"]]
        return nearest(rows, keys, order, ["surah", "ayah"], lambda cer, wer, cov, x: {"confidence": m.verse_confidence(cer, cov), "alignment": m.verse_alignment(cer, wer, cov)})

    cand = ref.select("surah", "ayah", "norm_text")
    if fixed:
        here = spread(hyp.where("surah is not null"), *keys)
        near = score(fewest(here, keys, cand, "ayah", back, ahead), keys)
    else:
        near = score(band(spread(hyp, *keys), cand, "ayah", back, ahead), keys)
    if known:
        return near
    lost = hyp.where("surah is null").select(*keys, c("norm").alias("said"))
    # each different text once, against one array of the small and fixed corpus
    if fixed:
        said = spread(lost.select("said").distinct()).select("said", F.lit(None).cast("int").alias("surah"), F.lit(None).cast("int").alias("expected"), c("said").alias("norm"))
        far = score(fewest(said, ["said"], cand, "ayah", back, ahead), ["said"])
        return near.unionByName(lost.join(far, "said").drop("said"))
    whole = cand.where("norm_text is not null").groupBy(F.lit(0).alias("one")).agg(F.sort_array(F.collect_list(F.struct("surah", "ayah", "norm_text"))).alias("near"))
    texts = spread(lost.select("said").distinct()).withColumns({"norm": c("said"), "zero": F.lit(0)})
    far = score(texts.join(broadcast_if_small(written(whole)), c("zero") == c("one")), ["said"])
    return near.unionByName(lost.join(far, "said").drop("said"))


def sequences(hyp: DataFrame, spans: DataFrame, keys: list[str], back: int = 1, ahead: int = 3, fixed: bool = False) -> DataFrame:
    """Best run of verses, with its first and last. Starts are those of the band, else the first 12 of the chapter. `fixed`: see verses()."""
    cand = spans.select("surah", "start", "end", F.col("text").alias("norm_text"))
    if fixed:
        rows = fewest(spread(hyp.where("surah is not null"), *keys), keys, cand, "start", back, ahead, first=12)
    else:
        rows = band(spread(hyp, *keys), cand, "start", back, ahead, fallback="first")

    def scores(cer: Column, wer: Column, cov: Column, x: Column) -> dict:
        return {"confidence": m.span_confidence(cer, wer, cov, x["end"] - x["start"] + 1), "alignment": m.span_alignment(cer, wer, cov)}

    order = lambda cer, wer, cov, x: [cer, -cov, -scores(cer, wer, cov, x)["confidence"], x["start"], x["end"]]
    return nearest(rows, keys, order, ["start", "end"], scores)
