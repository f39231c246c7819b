"""From a recognized text to its verse, verdict and corrected text: rules, matching, thresholds, correction policy, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasm import kernels as k
from rasm.functions import columns
from rasm.functions import metrics as m
from rasm.functions import text as tx
from rasm.operators import align, match
from rasm.session import bounded, broadcast_if_small, spread, written

# The phrases that may come before a recitation.
TAAWWUZ = "أعوذ بالله من الشيطان الرجيم"
BASMALA = " ".join(tx.BASMALA)


def strip_invocations(text: Column, how: str = "fuzzy") -> Column:
    """Normalized text without the invocations in front: `fuzzy` by the ratio of the whole phrase, `wide` with looser bounds,
    `words` word by word, `exact` the basmala as it is written."""
    phrases = [TAAWWUZ.split(), BASMALA.split()]
    norm = tx.normalize(text)
    if how == "exact":
        t = tx.tokens(norm)
        return F.array_join(F.when(tx.has_basmala(t), F.slice(t, 5, F.greatest(F.lit(1), F.size(t)))).otherwise(t), " ")
    bounds = {"fuzzy": {}, "wide": {"least": 56.0, "most": 60, "share": 0.6, "extra": 3}}.get(how)
    if bounds is None and how != "words":
        raise ValueError(f"no such way: {how}")

    def run(t: str) -> str:
        words = t.split()
        for p in phrases:
            words = k.strip_close(words, p) if bounds is None else k.strip_prefix(words, p, **bounds)
        return " ".join(words)

    return align._each(run, "string")(norm)


# Names of columns that the guard makes; a key of such a name has to be renamed before.
OWN = {"surah", "expected", "raw", "lock", "rules", "working", "norm", "at", "in", "found", "seq", "first_ayah", "last_ayah", "verse", "said", "cer", "wer", "coverage", "confidence", "alignment", "level", "verdict", "correction", "corrected", "b", "band", "near", "few", "is_sequence", "_key", "spoken"}


def guard(hyp: DataFrame, ref: DataFrame, spans: DataFrame | None, keys: list[str], mode: str = "balanced", preserve: bool = True, auto: bool = False, back: int = 1, ahead: int = 3, basmala: bool = True, lock: str | None = None) -> DataFrame:
    """keys and `raw, rules, surah, first_ayah, last_ayah, is_sequence, cer, wer, coverage, confidence, alignment, level, verdict, correction,
    corrected` for hypotheses (keys, surah, expected, raw, and the column `lock` if named).

    `lock` holds the only chapter whose verses and words count, where it is not null. The rules of the mode are applied, then word
    boundaries put right with the words of the corpus (of the locked chapter). With `basmala` one in front of a chapter's first verse
    is left out. A run of verses (`spans`) wins if its alignment is no worse. The score then counts the reference only as far as it was
    said. Thresholds go by the number of raw words. safe changes no word; preserve puts single words right; else balanced and aggressive
    replace by the verse, which takes `auto` and 3 words or more, or put words right; safe with auto is balanced. Where the raw text is
    nearer to the verse than the corrected one, it is kept.
    Without a surah the verse is looked for in the whole corpus (the locked chapter), and a run nowhere; `surah` is the one found.
    Without a candidate the scores are 1, 1, 0, 0, 0 and the verdict is error; a null raw text is ''."""
    if mode not in ("safe", "balanced", "aggressive"):
        raise ValueError(f"no such mode: {mode}")
    if taken := set(keys) & OWN:
        raise ValueError(f"key columns with names of the guard's own: {sorted(taken)}")
    mode = "balanced" if auto and mode == "safe" else mode
    c = F.col
    base = hyp.select(*keys, "surah", "expected", F.coalesce("raw", F.lit("")).alias("raw"), (c(lock) if lock else F.lit(None)).cast("int").alias("lock"))
    words: dict[int, set[str]] = {}
    for r in bounded(ref.select("surah", F.explode("tokens").alias("w")).distinct()):  # the words of the fixed corpus
        words.setdefault(r["surah"], set()).add(r["w"])
    base = spread(base, *keys).withColumn("rules", align.split_known_of(tx.fix_rules(c("raw"), mode), c("lock"), words))
    stripped = F.array_join(tx.without_basmala(tx.tokens(c("rules")), c("surah"), c("expected")), " ") if basmala else c("rules")
    base = base.withColumn("working", stripped).withColumns({"norm": c("working"), "spoken": F.size(tx.words(tx.normalize(c("raw"))))})  # the rules leave a normalized text
    # with a lock only its chapter has candidates: another one asked for has none (-1), and none asked for is all of it
    base = base.withColumn("at", F.when(c("lock").isNull() | (c("surah") == c("lock")), c("expected"))).withColumn("in", F.when(c("lock").isNull(), c("surah")).when(F.coalesce(c("surah"), c("lock")) == c("lock"), c("lock")).otherwise(-1))
    base = written(base)
    own = base.select(*keys, c("in").alias("surah"), c("at").alias("expected"), "norm")
    score = ["cer", "wer", "coverage", "confidence", "alignment"]
    one = match.verses(own, ref, keys, back, ahead, fixed=True).select(*keys, c("surah").alias("found"), c("ayah").alias("first_ayah"), c("ayah").alias("last_ayah"), F.lit(0).alias("seq"), *score)
    if spans is not None:
        runs = match.sequences(base.where("surah is not null").select(*keys, c("in").alias("surah"), c("at").alias("expected"), "norm"), spans, keys, back, ahead, fixed=True)
        one = one.unionByName(runs.select(*keys, F.lit(None).cast("int").alias("found"), c("start").alias("first_ayah"), c("end").alias("last_ayah"), F.lit(1).alias("seq"), *score))
        one = one.groupBy(*keys).agg(F.max(F.struct("alignment", "seq", *[x for x in one.columns if x not in (*keys, "alignment", "seq")])).alias("b")).select(*keys, "b.*")
    texts = ref.select("surah", F.struct("surah", c("ayah").alias("a"), c("ayah").alias("z")).alias("_key"), "norm_text")
    if spans is not None:
        texts = texts.unionByName(spans.where("start < end").select("surah", F.struct("surah", c("start").alias("a"), c("end").alias("z")).alias("_key"), c("text").alias("norm_text")))
    g = base.join(one, keys, "left")
    if spans is not None:  # without a surah a run of score 0 stands against the verse, and wins at 0
        none = c("surah").isNull() & (c("alignment") <= 0)
        g = g.select(*base.columns, *[F.when(~F.coalesce(none, F.lit(False)), c(x)).alias(x) for x in one.columns if x not in keys])
    g = g.withColumn("surah", F.when(c("in") == -1, c("surah")).otherwise(F.coalesce("surah", "found"))).withColumn("_key", F.struct("surah", c("first_ayah").alias("a"), c("last_ayah").alias("z")))
    g = spread(g.join(broadcast_if_small(texts.select("_key", c("norm_text").alias("verse"))), "_key", "left"), *keys)
    said = align._each(lambda h, r: " ".join(k.spoken_reference(h.split(), r.split())), "string")(c("norm"), c("verse"))
    g = g.withColumn("said", said).withColumn("said", F.when((c("said") != "") & (F.length("said") < F.length("verse")), c("said")))
    h, r = tx.tokens(c("norm")), tx.tokens(c("said"))
    again = {"cer": m.cer(c("norm"), c("said")), "wer": m.wer(h, r), "coverage": m.coverage(h, r)}
    g = g.withColumns({n: F.when(c("said").isNull(), c(n)).otherwise(x) for n, x in again.items()})
    n = c("last_ayah") - c("first_ayah") + 1
    conf = F.when(c("seq") == 1, m.span_confidence(c("cer"), c("wer"), c("coverage"), n)).otherwise(m.verse_confidence(c("cer"), c("coverage")))
    g = g.withColumn("confidence", F.coalesce(F.when(c("said").isNull(), c("confidence")).otherwise(conf), F.lit(0.0)))
    g = g.withColumn("level", F.when(c("verse").isNull(), "low").otherwise(m.level(c("confidence"), c("spoken"))))
    sure, fair = c("level") == "high", c("level") != "low"
    single = F.array_join(m.constrained_words(h, tx.tokens(c("verse")), F.when(sure, 0.44).otherwise(0.33)), " ")
    partly = align._each(lambda a, b: " ".join(k.fix_partly(a.split(), b.split())), "string")(c("norm"), c("verse"))
    whole = (sure if mode == "balanced" else fair) & F.lit(auto) & (c("spoken") >= 3)
    if mode == "safe":
        g = g.withColumns({"corrected": c("working"), "correction": F.lit("safe")})
    elif preserve:
        g = g.withColumns({"corrected": F.when(fair, single).otherwise(c("working")), "correction": F.when(fair, "constrained_word_correction").otherwise(mode)})
    else:
        g = g.withColumns({"corrected": F.when(whole, c("verse")).when(fair, partly).otherwise(c("working")), "correction": F.when(whole, "full_ayah_replacement").when(fair, "partial_word_correction").otherwise(mode)})
    if mode != "safe":
        nearer = m.cer(tx.normalize(c("raw")), c("verse")) <= m.cer(tx.normalize(c("corrected")), c("verse")) - 0.01
        g = g.withColumns({"corrected": F.when(nearer, tx.display(c("raw"))).otherwise(c("corrected")), "correction": F.when(nearer, "raw_preferred").otherwise(c("correction"))})
    none = {"cer": 1.0, "wer": 1.0, "coverage": 0.0, "confidence": 0.0, "alignment": 0.0}
    scores = [F.round(F.coalesce(c(x), F.lit(v)), 4).alias(x) for x, v in none.items()]
    return g.select(*keys, "raw", "rules", "surah", "first_ayah", "last_ayah", (F.coalesce("seq", F.lit(0)) == 1).alias("is_sequence"), *scores, "level", m.verdict(c("level")).alias("verdict"), "correction", "corrected")


def position(df: DataFrame, expected: str, matched: str) -> DataFrame:
    """Adds `at` (never behind the verse expected) and `skipped` (a jump of 2 or more ahead of it)."""
    c = F.col
    return df.withColumns({"at": F.greatest(c(expected), c(matched)), "skipped": F.coalesce(c(matched) - c(expected) >= 2, F.lit(False))})


def forced(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Rows (surah, matched, due) with `matched` put to the verse that is due where it is behind it or two or more ahead, `wrong` for a
    jump ahead, and `text` of the verse put in. Where the corpus has no such verse nothing changes."""
    c = F.col
    texts = ref.select(c("surah").alias("s"), c("ayah").alias("a"), c("norm_text").alias("due_text"))
    j = df.join(broadcast_if_small(texts), (c("surah") == c("s")) & (c("due") == c("a")), "left").drop("s", "a")
    known = c("due_text").isNotNull()
    jump = F.coalesce(known & (c("matched") >= c("due") + 2), F.lit(False))
    put = F.coalesce(known & (c("matched") < c("due")), F.lit(False)) | jump
    return j.withColumns({"matched": F.when(put, c("due")).otherwise(c("matched")), "wrong": jump, "text": F.when(put, c("due_text"))}).drop("due_text")


def from_api(df: DataFrame, surah: str) -> DataFrame:
    """Results of the interface in the shape of the guard's: texts never null, a key where chapter and verse are known, no coverage."""
    c = F.col
    text = lambda n: F.coalesce(n, F.lit(""))
    shown = {"raw_asr": text("raw_asr"), "corrected_text": text("corrected_text"), "display_text": text("corrected_text"), "verdict": F.coalesce("verdict", F.lit("unknown")), "coverage": F.lit(None).cast("double")}
    return df.withColumns({**shown, "matched_key": columns.verse_key(c(surah), c("matched_ayah"))})


def dual(df: DataFrame, ref: DataFrame, keys: list[str], mode: str = "balanced") -> DataFrame:
    """keys and verse, rates, verdict and corrected text of two recognizers' texts (`first`, `second`; with surah and expected), and
    whether texts, verses and verdicts are the same. Without a chapter or an expected verse only the rules are applied (rule_only)."""
    c = F.col
    parts = []
    for side in ("first", "second"):
        rows = df.select(*keys, "surah", "expected", c(side).alias("raw"))
        known = c("surah").isNotNull() & c("expected").isNotNull()
        g = guard(rows.where(known), ref, None, keys, mode).select(*keys, c("first_ayah").alias("ayah"), "cer", "wer", "verdict", "corrected")
        bare = rows.where(~known).select(*keys, F.lit(None).cast("int").alias("ayah"), F.lit(None).cast("double").alias("cer"), F.lit(None).cast("double").alias("wer"), F.lit("rule_only").alias("verdict"), tx.fix_rules(c("raw"), mode).alias("corrected"))
        parts.append(g.unionByName(bare).withColumnsRenamed({x: f"{side}_{x}" for x in ("ayah", "cer", "wer", "verdict", "corrected")}))
    both = parts[0].join(parts[1], keys)
    same = {f"same_{x}": c(f"first_{x}").eqNullSafe(c(f"second_{x}")) for x in ("ayah", "verdict", "corrected")}
    return both.withColumns(same)


def corrupted(verses: DataFrame, seed: int = 42, words: float = 0.15, vowels: float = 0.25) -> DataFrame:
    """`surah, ayah, word_index, predicted, reference, is_last, word_label, vowel_label`: labelled examples by hash, the same each time.

    A share of the words gets another first letter, of the others a share another short vowel in its first marked letter."""
    c = F.col
    each = verses.select("surah", "ayah", F.split(tx.display(c("text")), " ").alias("w")).select("surah", "ayah", F.size("w").alias("n"), F.posexplode("w").alias("word_index", "reference"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "surah", "ayah", "word_index"), F.lit(10_000)) / 10_000.0
    a, b, d = (tx.span(x) for x in ("064E", "064F", "0650"))
    swapped = F.regexp_replace("reference", f"^([^{a}{b}{d}]*)([{a}{b}{d}])", F.concat(F.lit("$1"), F.when(F.contains(F.regexp_extract("reference", f"[{a}{b}{d}]", 0), F.lit(a)), d).otherwise(a)))
    other = F.concat(F.when(F.startswith("reference", F.lit("ب")), "ج").otherwise("ب"), F.substring("reference", 2, 1 << 20))
    wrong = chance < words
    vowel = ~wrong & (chance < words + (1 - words) * vowels) & (swapped != c("reference"))
    out = each.withColumns({"wrong": wrong, "vowel": vowel})
    return out.select("surah", "ayah", "word_index", F.when(c("wrong"), other).when(c("vowel"), swapped).otherwise(c("reference")).alias("predicted"), "reference", (c("word_index") == c("n") - 1).alias("is_last"), F.when(c("wrong"), "incorrect").otherwise("correct").alias("word_label"), F.when(c("wrong"), "not_applicable").when(c("vowel"), "incorrect").otherwise("correct").alias("vowel_label"))


def messages(chunks: DataFrame, arrays: tuple[str, ...] = ("errors", "harakaat_errors", "word_errors")) -> DataFrame:
    """`session_id, message`: the wire message of each chunk, its arrays never null."""
    own = [F.coalesce(F.col(x), F.array().cast(dict(chunks.dtypes)[x])).alias(x) if x in arrays else F.col(x) for x in chunks.columns if x != "session_id"]
    return chunks.select("session_id", F.to_json(F.struct(F.lit("chunk").alias("type"), *own), {"ignoreNullFields": "false"}).alias("message"))


def _json(kind: str, *columns: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *columns), {"ignoreNullFields": "false"})


def action_messages(df: DataFrame) -> DataFrame:
    """`session_id, message` of the correction's actions (action, text, wrong_words, harakaat_errors); null where there is no action."""
    m = _json("qari_action", F.col("action"), F.col("text").alias("message"), F.col("wrong_words"), F.col("harakaat_errors"))
    return df.select("session_id", F.when(F.col("action").isNotNull(), m).alias("message"))


def summary_messages(df: DataFrame) -> DataFrame:
    """`session_id, message` at the end of each session, from its row of surah, start_ayah, final_ayah, seconds, chunks, transcript, path."""
    c = F.col
    m = _json("session_summary", c("session_id"), c("surah"), c("start_ayah"), c("final_ayah"), F.round("seconds", 2).alias("total_duration_s"), c("chunks").alias("num_chunks"), c("transcript").alias("merged_transcript"), c("path").alias("results_json_path"))
    return df.select("session_id", m.alias("message"))


def error_message(text: Column) -> Column:
    return _json("error", text.alias("message"))


def rows_for_display(chunks: DataFrame) -> DataFrame:
    """The chunks of a session as the display takes them: times to two places, rates as they are, no audio path."""
    own = [x for x in ("chunk_index", "raw_asr", "corrected_text", "matched_ayah", "matched_surah_ayah_id", "cer", "wer", "confidence", "confidence_level", "verdict", "matched_ayah_text", "word_errors", "harakaat_errors") if x in chunks.columns]
    times = [F.round(x, 2).alias(x) for x in ("start_time_s", "end_time_s", "duration_s") if x in chunks.columns]
    return chunks.select("session_id", F.struct(*own, *times).alias("chunk"))


def register(spark: object) -> None:
    """Table functions for SQL: annotate_words(hyp, ref), and of built-in expressions ngram_rows(text, most) and segments(text, size, step)."""
    from pyspark.sql.functions import udtf

    class Annotate:
        def eval(self, hyp: str, ref: str):
            for x in k.annotate((hyp or "").split(), (ref or "").split(), None):
                yield x["word"], x["reference"], x["status"], x["similarity"], x["hyp_index"], x["ref_index"]

    spark.udtf.register("annotate_words", udtf(Annotate, returnType="word string, reference string, status string, similarity double, hyp_index int, ref_index int"))
    words = "filter(split(coalesce(text, ''), ' '), w -> w <> '')"
    grams = f"flatten(transform(sequence(1, greatest(most, 1)), n -> transform(if(size({words}) >= n, sequence(1, size({words}) - n + 1), array()), i -> named_struct('n', n, 'gram', array_join(slice({words}, i, n), ' ')))))"
    parts = f"transform(if(size({words}) > 0, sequence(0, size({words}) - 1, step), array()), i -> named_struct('start', i, 'text', array_join(slice({words}, i + 1, size), ' ')))"
    spark.sql(f"create or replace temporary function ngram_rows(text string, most int) returns table (n int, gram string) return select inline({grams})")
    spark.sql(f"create or replace temporary function segments(text string, size int, step int) returns table (start int, text string) return select inline({parts})")
