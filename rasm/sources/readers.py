"""Readers of the inputs: corpus exports, label files, transcripts, lists, audio, wire messages; and the writers of results."""

from __future__ import annotations

import io
import os
import re
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rasm.functions import text as tx
from rasm.session import broadcast_if_small

SAMPLES = ArrayType(FloatType())
#: Envelopes that a corpus export may be wrapped in.
ENVELOPES = ("tafsir", "all_ayat", "verses", "data")


def corpus_json(spark: SparkSession, path: str, diacritized_only: bool = False) -> DataFrame:
    """`surah, ayah, text` of a JSON map "surah_ayah" -> text or {"text": ..}, in an envelope or not; bad keys and empty texts are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    inner = F.coalesce(*[F.from_json(F.col("m")[e], "map<string,string>") for e in ENVELOPES], F.col("m"))
    each = raw.select(F.explode(inner).alias("key", "v"))
    text = F.coalesce(F.get_json_object("v", "$.text"), F.when(~F.startswith("v", F.lit("{")), F.col("v")))
    parts = F.split("key", "_", 2)
    out = each.select(F.get(parts, F.lit(0)).try_cast("int").alias("surah"), F.get(parts, F.lit(1)).try_cast("int").alias("ayah"), text.alias("text"))
    out = out.where("surah is not null and ayah is not null").where(tx.normalize(F.col("text")) != "")
    return out.where(F.col("text").rlike(f"[{tx.VOWELS}]")) if diacritized_only else out


def piped_lines(spark: SparkSession, path: str) -> DataFrame:
    """`text`: the third field of lines a|b|text, normalized; empty ones are dropped."""
    return spark.read.text(path).select(tx.normalize(F.get(F.split("value", r"\|", 3), F.lit(2))).alias("text")).where("text <> ''")


def transcripts(spark: SparkSession, path: str, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """`PATH, TRANSCRIPT, ..` of a tab-separated file; blank transcripts are dropped. `limit` takes the first so many that are left."""
    df = spark.read.csv(path, sep="\t", header=True).where("trim(TRANSCRIPT) <> ''")
    df = df.where(F.contains("PATH", F.lit(contains))) if contains else df
    return df.limit(limit) if limit else df


def resolve_columns(columns: list[str], wanted: dict[str, list[str]], exclude: tuple[str, ...] = ()) -> dict[str, str]:
    """file column -> name, by the first pattern that a column not yet taken contains, whatever the case; a column that contains one
    of `exclude` is never taken."""
    out: dict[str, str] = {}
    able = [x for x in columns if not any(e.lower() in x.lower() for e in exclude)]
    for name, patterns in wanted.items():
        hit = next((x for p in patterns for x in able if p.lower() in x.lower() and x not in out), None)
        if hit is None:
            raise ValueError(f"no column for {name} in {columns}")
        out[hit] = name
    return out


def sheet(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet of an XLSX file, as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for n, cell in enumerate(row.findall("m:c", ns)):
                at = 0
                for ch in "".join(x for x in cell.get("r", "") if x.isalpha()):
                    at = 26 * at + ord(ch) - 64
                v, inline = cell.find("m:v", ns), cell.find("m:is", ns)
                text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None if v is None else v.text
                cells[at - 1 if at else n] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def labels(spark: SparkSession, path: str, wanted: dict[str, list[str]], exclude: tuple[str, ...] = ()) -> DataFrame:
    """A label file, CSV or XLSX (a sheet that a person filled in: read as one file), with its columns found and renamed."""
    if path.lower().endswith(".xlsx"):
        head, *rows = sheet(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
        width = len(head)
        df = spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows], ", ".join(f"`{h}` string" for h in head))
    else:
        df = spark.read.csv(path, header=True, inferSchema=True)
    names = resolve_columns(df.columns, wanted, exclude)
    return df.select(*[f"`{n}`" for n in names]).withColumnsRenamed(names)


def verse_counts(spark: SparkSession, path: str) -> DataFrame:
    """`surah, verses` of a list of numbers, a chapter to a line, with or without a comma behind. One short file: read as one."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"[,\s]+").alias("n"))
    each = text.select(F.posexplode(F.filter("n", lambda x: x != "")).alias("i", "verses"))
    return each.select((F.col("i") + 1).alias("surah"), F.col("verses").cast("int").alias("verses"))


def ended(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """`matches` (surah, ayah) with `ended`: whether the verse is its chapter's last."""
    last = counts.select(F.col("surah").alias("of"), "verses")
    return matches.join(broadcast_if_small(last), F.col("surah") == F.col("of"), "left").withColumn("ended", F.coalesce(F.col("ayah") >= F.col("verses"), F.lit(False))).drop("of", "verses")


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True).select("path", "sentence")
    return df.limit(limit) if limit else df


def lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """`line`: trimmed, not blank; a first field equal to `header` is the header's line."""
    df = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return df.where(F.get(F.split("line", r"\s"), F.lit(0)) != header) if header else df


def verse_of_file(path: Column) -> tuple[Column, Column]:
    """(surah, ayah) of a file name that begins with six digits; null of others."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, r"^(\d{3})\d{3}", 1), F.lit("")).try_cast("int"), F.nullif(F.regexp_extract(name, r"^\d{3}(\d{3})", 1), F.lit("")).try_cast("int")


def scaled(data: bytes, width: int) -> np.ndarray:
    """Samples of 1 (unsigned), 2, 3 or 4 bytes as floats from -1 to 1."""
    data = data[: len(data) // width * width]
    if width == 1:
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(b), 4), np.uint8)
        wide[:, 1:] = b
        return wide.view("<i4").ravel().astype(np.float64).astype(np.float32) / 2**31
    return np.frombuffer(data, f"<i{width}").astype(np.float64).astype(np.float32) / 2 ** (8 * width - 1)


def decode_wav(data: bytes, rate: int = 16_000) -> np.ndarray | None:
    """Mono float32 samples at `rate`; None of what is no PCM WAV."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() not in (1, 2, 3, 4):
                return None
            x = scaled(w.readframes(w.getnframes()), w.getsampwidth())
            x = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1)
            own = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return None
    return resample(x, own, rate)


def fragment(data: bytes, kind: str, channels: int, own: int, rate: int = 16_000) -> np.ndarray | None:
    """A microphone's fragment (kind: float32, int16, int32, uint8) as mono samples at `rate`; None of silence (a peak under 0.001)."""
    x = np.frombuffer(data[: len(data) // 4 * 4], "<f4") if kind == "float32" else scaled(data, {"uint8": 1, "int16": 2, "int32": 4}[kind])
    x = resample(x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), own, rate)
    return x if len(x) and float(np.abs(x).max()) >= 0.001 else None


@F.pandas_udf(SAMPLES)
def fragments(data: pd.Series, kind: pd.Series, channels: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else fragment(bytes(d), k, int(c), int(o)) for d, k, c, o in zip(data, kind, channels, own)], dtype=object)


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    if own == rate or not len(x):
        return x.astype(np.float32)
    n = int(round(len(x) * rate / own))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)


def encode_wav(x: np.ndarray, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(SAMPLES)
def wav_samples(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decode_wav(bytes(b)))


@F.pandas_udf(SAMPLES)
def pcm16_samples(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 2 * 2], "<i2").astype(np.float32) / 32768)


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """`path, surah, ayah, samples` of WAV files under a folder; samples are null where a file cannot be read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    surah, ayah = verse_of_file(F.col("path"))
    return df.select("path", surah.alias("surah"), ayah.alias("ayah"), wav_samples("content").alias("samples"))


def frames(messages: DataFrame, column: str = "value") -> DataFrame:
    """`kind, samples` of wire messages {"type": "audio", "pcm16_base64": ..} or {"type": "stop"}; other columns stay."""
    m = F.from_json(F.col(column), "type string, pcm16_base64 string")
    rest = [c for c in messages.columns if c != column]
    return messages.select(*rest, m["type"].alias("kind"), pcm16_samples(F.unbase64(m["pcm16_base64"])).alias("samples"))


def high_pass(x: np.ndarray, rate: int, hertz: float = 80.0, block: int = 128) -> np.ndarray:
    """A filter of one pole, y[i] = a (y[i-1] + x[i] - x[i-1]), a block at a time: the powers of a as a matrix."""
    a = 1 / (1 + 2 * np.pi * hertz / rate)
    d = a * np.diff(x.astype(np.float64), prepend=0.0)
    power = a ** np.arange(block + 1)
    i, j = np.indices((block, block))
    within = np.where(i >= j, power[np.maximum(i - j, 0)], 0.0)
    y = np.empty(len(d))
    last = 0.0
    for at in range(0, len(d), block):
        n = min(block, len(d) - at)
        y[at : at + n] = within[:n, :n] @ d[at : at + n] + power[1 : n + 1] * last
        last = y[at + n - 1]
    return y


def condition(x: np.ndarray, rate: int = 16_000) -> np.ndarray:
    """A segment made ready: high-pass at 80 Hz, gain of 0.5 to 2 towards an RMS of 0.12, soft limit above 0.9, 10 ms fades."""
    if not len(x):
        return x.astype(np.float32)
    y = high_pass(x, rate)
    level = float(np.sqrt(np.mean(y**2)))
    y *= min(2.0, max(0.5, 0.12 / level)) if level > 1e-8 else 1.0
    over = np.abs(y) > 0.9
    y[over] = np.sign(y[over]) * (0.9 + 0.1 * np.tanh((np.abs(y[over]) - 0.9) / 0.1))
    n = min(rate // 100, len(y) // 2)
    if n:
        y[:n] *= np.linspace(0, 1, n)
        y[-n:] *= np.linspace(1, 0, n)
    return y.astype(np.float32)


@F.pandas_udf(SAMPLES)
def conditioned(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: None if x is None else condition(np.asarray(x, np.float32)))


def uploads(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Requests (file, surah, expected_ayah, correction_mode, asr_engine) with the samples of their files, by name; what is missing has its
    default, an unknown file or one that cannot be read has null samples."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    given = {"expected_ayah": F.lit(1), "correction_mode": F.lit("balanced"), "asr_engine": F.lit("standard")}
    rows = requests.withColumns({k: F.coalesce(F.col(k), v) for k, v in given.items()})
    return rows.join(files, F.element_at(F.split("file", "/"), -1) == F.col("name"), "left").withColumn("samples", wav_samples("content")).drop("name", "content")


def resolved(wanted: DataFrame, listing: DataFrame, marker: str = "") -> DataFrame:
    """`wanted` (path) with `file`: the listed file (`file`) of the same path behind the last `marker`, else of the same name, else of the
    same name whatever its extension; the least of several, null of none."""
    own = F.element_at(F.split("path", re.escape(marker)), -1) if marker else F.col("path")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    bare = lambda c: F.regexp_replace(name(c), r"\.[^.]*$", "")
    out = wanted.withColumn("_own", own)
    hits = []
    for i, (mine, theirs) in enumerate(((F.ltrim(F.regexp_replace("_own", "^/+", "")), None), (name(F.col("_own")), name(F.col("file"))), (bare(F.col("_own")), bare(F.col("file"))))):
        if theirs is None:  # every tail of a listed path
            parts = F.split("file", "/")
            tails = listing.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias(f"_k{i}"))
        else:
            tails = listing.select("file", theirs.alias(f"_k{i}"))
        best = tails.groupBy(f"_k{i}").agg(F.min("file").alias(f"_f{i}"))
        out = out.withColumn(f"_m{i}", mine).join(best, F.col(f"_m{i}") == F.col(f"_k{i}"), "left").drop(f"_k{i}", f"_m{i}")
        hits.append(f"_f{i}")
    return out.withColumn("file", F.coalesce(*hits)).drop("_own", *hits)


def failed(rows: DataFrame, verdict: str, reason: str) -> DataFrame:
    """The result of chunks that were not decoded: verdict skipped or error, empty texts, no match."""
    if verdict not in ("skipped", "error"):
        raise ValueError(f"no such verdict: {verdict}")
    return rows.select("session_id", "chunk_index", F.lit("").alias("raw_asr"), F.lit("").alias("corrected_text"), F.lit(None).cast("int").alias("matched_ayah"), F.lit(None).cast("double").alias("confidence"), F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))


def write_prefixes(prefixes: DataFrame, path: str) -> None:
    """The prefix tree as a table, by depth."""
    prefixes.write.mode("overwrite").partitionBy("depth").parquet(path)


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("depth", "prefix", "is_end", "verses")


def write_verses(ref: DataFrame, path: str) -> None:
    """The cleaned text of a language model, a verse to a line in corpus order: one file, as it is read by line."""
    ref.where("norm_text <> ''").orderBy("global_idx").select("norm_text").coalesce(1).write.mode("overwrite").text(path)


def write_wavs(df: DataFrame, folder: str, name: str = "name", samples: str = "samples", rate: int = 16_000) -> None:
    """A WAV file of each row, written by the task that holds it into a folder that all tasks share; a null is no file."""

    def save(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            if r[1] is not None:
                part = os.path.join(folder, f".{r[0]}.part")
                with open(part, "wb") as f:
                    f.write(encode_wav(np.asarray(r[1], np.float32), rate))
                os.replace(part, os.path.join(folder, f"{r[0]}.wav"))  # a task that runs again leaves no half of a file

    df.select(name, samples).foreachPartition(save)


def session_audio(chunks: DataFrame, key: str = "session_id", order: str = "start_sample", samples: str = "samples") -> DataFrame:
    """`name, samples`: the chunks of each session (of bounded length) end to end."""
    each = F.transform(F.sort_array(F.collect_list(F.struct(order, samples))), lambda x: x[samples])
    return chunks.where(F.col(samples).isNotNull()).groupBy(F.col(key).alias("name")).agg(F.flatten(each).alias("samples"))


def write_arpa(lines_: DataFrame, path: str) -> None:
    """One sorted text file of (n, gram, line): the format wants a single file."""
    lines_.orderBy("n", "gram").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_sessions(chunks: DataFrame, path: str, key: str = "session_id", order: str = "chunk_index") -> None:
    """A JSON row per session with its chunks in order."""
    own = [order, *[c for c in chunks.columns if c not in (key, order)]]
    chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("chunks")).write.mode("overwrite").json(path)


def push(df: DataFrame, send: object, checkpoint: str) -> object:
    """A stream whose micro-batches go to send(rows, batch_id) as they come; rows are iterated, not collected at once."""
    return df.writeStream.foreachBatch(lambda b, i: send(b.toLocalIterator(), i)).option("checkpointLocation", checkpoint).start()


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_dict("records")
