import base64
import json

import numpy as np
from pyspark.sql import functions as F

from rasm.sources import readers as R


def test_corpus(spark, tmp_path):
    verses = {"1_2": {"text": "الحمد"}, "2_1": "لله", "x_1": "رب", "3_1": {"text": ""}}
    for name, doc in (("plain", verses), ("wrapped", {"verses": verses})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
        assert sorted(map(tuple, R.corpus_json(spark, str(tmp_path / f"{name}.json")).collect())) == [(1, 2, "الحمد"), (2, 1, "لله")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|2|الحمد لله|x\n1|2\n", encoding="utf-8")
    assert [r["text"] for r in R.piped_lines(spark, str(tmp_path / "a.txt")).collect()] == ["الحمد لله"]
    (tmp_path / "r.txt").write_text("reader notes\n A \n\nB\n")
    assert [r["line"] for r in R.lines(spark, str(tmp_path / "r.txt"), "reader").collect()] == ["A", "B"]
    (tmp_path / "t.tsv").write_text("PATH\tDURATION\tTRANSCRIPT\np/a.mp3\t1\tx\np/b.mp3\t1\t \n")
    assert [r["PATH"] for r in R.transcripts(spark, str(tmp_path / "t.tsv")).collect()] == ["p/a.mp3"]
    (tmp_path / "l.csv").write_text("File Name,Madd (x),Ghunnah\na.wav,1,0\n")
    got = R.labels(spark, str(tmp_path / "l.csv"), {"filename": ["file"], "madd": ["madd"], "ghunnah": ["ghun"]})
    assert got.columns == ["filename", "madd", "ghunnah"] and got.count() == 1


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(1600) / 9).astype(np.float32) * 0.5
    (tmp_path / "002005.wav").write_bytes(R.encode_wav(x))
    (tmp_path / "bad.wav").write_bytes(b"no")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in R.audio_files(spark, str(tmp_path)).collect()}
    good = rows["002005.wav"]
    assert (good["surah"], good["ayah"], len(good["samples"])) == (2, 5, 1600) and np.allclose(good["samples"], x, atol=1e-3)
    assert rows["bad.wav"]["samples"] is None and rows["bad.wav"]["surah"] is None
    assert len(R.resample(x, 8000, 16000)) == 3200 and np.abs(R.condition(x)).max() <= 1.0 and len(R.condition(x[:0])) == 0


def test_frames(spark):
    pcm = base64.b64encode(np.array([0, 16384], "<i2").tobytes()).decode()
    df = spark.createDataFrame([(1, json.dumps({"type": "audio", "pcm16_base64": pcm})), (2, '{"type": "stop"}'), (3, None)], "id int, value string")
    assert [(r["kind"], r["samples"]) for r in R.frames(df).orderBy("id").collect()] == [("audio", [0.0, 0.5]), ("stop", None), (None, None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "session_id string, chunk_index int, text string")
    R.write_sessions(df, str(tmp_path / "out"))
    assert [c["text"] for c in spark.read.json(str(tmp_path / "out")).first()["chunks"]] == ["a", "b"]
    R.write_arpa(spark.createDataFrame([(2, "a b", "y"), (1, "a", "x")], "n int, gram string, line string"), str(tmp_path / "arpa"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "arpa")).collect()] == ["x", "y"]
    surah, ayah = R.verse_of_file(F.lit("a/114006_x.mp3"))
    assert tuple(spark.range(1).select(surah, ayah).first()) == (114, 6)


def test_labels_of_sheets_and_excluded_columns(spark, tmp_path):
    import zipfile

    path = tmp_path / "labels.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>File</t></si><si><t>Ghunnah note</t></si><si><t>ghunnah</t></si><si><t>a.wav</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2" t="s"><v>3</v></c><c r="C2"><v>1</v></c></row><row><c r="A3" t="inlineStr"><is><t>b</t></is></c></row></sheetData></worksheet>')
    got = R.labels(spark, str(path), {"filename": ["file"], "ghunnah": ["ghunnah"]}, exclude=("note",)).collect()
    assert [tuple(r) for r in got] == [("a.wav", "1"), ("b", None)]


def test_verse_counts_and_paths(spark, tmp_path):
    (tmp_path / "n.txt").write_text("7,\n286,\n200\n")
    counts = R.verse_counts(spark, str(tmp_path / "n.txt"))
    assert [tuple(r) for r in counts.orderBy("surah").collect()] == [(1, 7), (2, 286), (3, 200)]
    m = spark.createDataFrame([(1, 7), (1, 6), (9, 1), (None, None)], "surah int, ayah int")
    assert sorted(map(str, (r["ended"] for r in R.ended(m, counts).collect()))) == ["False", "False", "False", "True"]
    listing = spark.createDataFrame([("/d/x/a.wav",), ("/d/y/a.wav",), ("/d/z/b.mp3",)], "file string")
    want = spark.createDataFrame([("C/data/y/a.wav", 1), ("q/a.wav", 2), ("b.wav", 3), ("none.wav", 4)], "path string, file int")
    got = {r["path"]: r["file"] for r in R.resolved(want, listing, "data/").collect()}
    assert got == {"C/data/y/a.wav": "/d/y/a.wav", "q/a.wav": "/d/x/a.wav", "b.wav": "/d/z/b.mp3", "none.wav": None}


def test_samples_of_any_width(tmp_path):
    for width in (1, 2, 3, 4):
        top = 255 if width == 1 else 2 ** (8 * width - 1) - 1
        x = R.scaled(top.to_bytes(width, "little", signed=width > 1), width)
        assert abs(float(x[0]) - 1.0) < 0.01
    f = np.array([0.5, -0.5, 0.25, 0.25], "<f4").tobytes()
    assert R.fragment(f, "float32", 2, 16_000).tolist() == [0.0, 0.25] and R.fragment(bytes(8), "int16", 1, 16_000) is None
    x = np.random.default_rng(1).normal(size=700)
    a, y, before, last = 1 / (1 + 2 * np.pi * 80 / 16_000), [], 0.0, 0.0
    for v in x:
        last = a * (last + v - before)
        before = v
        y.append(last)
    assert np.allclose(R.high_pass(x, 16_000), y)


def test_writers_and_uploads(spark, tmp_path):
    from rasm.operators import corpus

    ref = corpus.reference(spark.createDataFrame([(1, 1, "اب جد"), (1, 2, "اب")], "surah int, ayah int, text string"))
    R.write_prefixes(corpus.prefixes(ref), str(tmp_path / "p"))
    assert {(r["depth"], r["prefix"], r["is_end"], r["verses"]) for r in R.read_prefixes(spark, str(tmp_path / "p")).collect()} == {(1, "اب", True, 2), (2, "اب جد", True, 1)}
    R.write_verses(ref, str(tmp_path / "v"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["اب جد", "اب"]
    df = spark.createDataFrame([("s1", 5, [0.5, 0.5]), ("s1", 0, [0.25]), ("s2", 0, None)], "session_id string, start_sample long, samples array<float>")
    R.write_wavs(R.session_audio(df), str(tmp_path / "w"))
    assert [p.name for p in (tmp_path / "w").iterdir()] == ["s1.wav"]
    req = spark.createDataFrame([("x/s1.wav", 2, None, None, None), ("none.wav", None, 3, "safe", "combined")], "file string, surah int, expected_ayah int, correction_mode string, asr_engine string")
    got = {r["file"]: r for r in R.uploads(spark, str(tmp_path / "w"), req).collect()}
    assert len(got["x/s1.wav"]["samples"]) == 3 and got["x/s1.wav"]["correction_mode"] == "balanced" and got["none.wav"]["samples"] is None and got["none.wav"]["expected_ayah"] == 3
    bad = spark.createDataFrame([("s", 1)], "session_id string, chunk_index int")
    assert R.failed(bad, "skipped", "silence").first()["verdict"] == "skipped"


def test_messages_and_table_functions(spark):
    import json

    from pyspark.sql import functions as F

    from rasm.operators import guard

    df = spark.createDataFrame([("s", "pause", "x", ["a"]), ("s", None, None, None)], "session_id string, action string, text string, wrong_words array<string>").withColumn("harakaat_errors", F.lit(None).cast("string"))
    got = [r["message"] for r in guard.action_messages(df).collect()]
    assert json.loads(got[0]) == {"type": "qari_action", "action": "pause", "message": "x", "wrong_words": ["a"], "harakaat_errors": None} and got[1] is None
    one = spark.createDataFrame([("s", 2, 1, 9, 12.345, 3, "t", "p")], "session_id string, surah int, start_ayah int, final_ayah int, seconds double, chunks long, transcript string, path string")
    assert json.loads(guard.summary_messages(one).first()["message"])["total_duration_s"] == 12.35 or json.loads(guard.summary_messages(one).first()["message"])["total_duration_s"] == 12.34
    assert json.loads(one.select(guard.error_message(F.lit("no")).alias("m")).first()["m"]) == {"type": "error", "message": "no"}
    guard.register(spark)
    assert [tuple(r) for r in spark.sql("select * from ngram_rows('a b c', 2)").collect()] == [(1, "a"), (1, "b"), (1, "c"), (2, "a b"), (2, "b c")]
    assert [tuple(r) for r in spark.sql("select * from segments('a b c d', 3, 2)").collect()] == [(0, "a b c"), (2, "c d")] and spark.sql("select * from ngram_rows(null, 3)").count() == 0
    assert [r["status"] for r in spark.sql("select * from annotate_words('a b', 'a c')").collect()] == ["correct", "major"]
