import random

from pyspark.sql import functions as F

from rasm import kernels as k
from rasm.operators import sessions
from rasm.streaming import processors as P


def streamed(spark, df, build, tmp_path, name):
    df.repartition(1).write.mode("overwrite").parquet(str(tmp_path / name))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store for each takes its time
    q = build(src).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert q.exception() is None
    return spark.table(name)


def test_lock_stream_equals_fold(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"s{i % 3}", i, r.choice([1, 2, None]), r.random(), r.random() / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, chunk_index int, surah int, score double, margin double")
    want = sorted(map(tuple, sessions.locks(df).collect()))
    got = sorted(map(tuple, streamed(spark, df, P.lock_stream, tmp_path, "locks").collect()))
    assert got == want and any(x[2] == "ACTIVE" for x in got)


def test_correction_stream_equals_fold(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"s{i % 2}", i, r.choice(["ok", "error", None]), r.choice([0.1, 0.9, None]), r.choice([["x"], [], None])) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, chunk_index int, verdict string, confidence double, wrong array<string>")
    df = df.withColumns({"vowels": F.array().cast("array<string>"), "played": F.lit(-1)})
    want = sorted(map(tuple, sessions.corrections(df).collect()))
    assert sorted(map(tuple, streamed(spark, df, P.correction_stream, tmp_path, "fsm").collect())) == want


def test_delta_and_status():
    d = P.Delta()
    assert [d.update(n) for n in (100, 210, 300)] == [(0, 100), (100, 210), (210, 300)]
    d = P.Delta()
    assert [d.update(n) for n in (100, 100, 90)] == [(0, 100), (0, 100), (0, 90)]


def test_windowed(spark, tmp_path):
    df = spark.range(20).select((F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"))
    got = streamed(spark, df, lambda s: P.windowed(s, "ts", "5 minutes", "1 minute", by=("k",)), tmp_path, "win").collect()
    assert sum(x["n"] for x in got) == 15  # the last window is still open


def test_word_status(spark):
    df = spark.createDataFrame([("s", 1, "wrong", 1), ("s", 1, "correct", 2), ("s", 1, "wrong", 3), ("s", 2, "minor", 1), ("s", 2, "wrong", 2), ("s", 3, None, 1)], "session_id string, w int, status string, seq int")
    assert sorted(map(tuple, sessions.word_statuses(df, ["session_id"], "w", "status", "seq").collect())) == [("s", 1, "correct"), ("s", 2, "wrong")]


def test_transcripts_and_fragments(spark):
    df = spark.createDataFrame([("s", 0, "a bb cc"), ("s", 1, "bb cc dd"), ("s", 2, None)], "session_id string, chunk_index int, text string").withColumn("norm", F.col("text"))
    assert [r["kept"] for r in sessions.transcripts(df).orderBy("chunk_index").collect()] == ["a bb cc", "dd", ""]
    df = spark.createDataFrame([("s", 0, "a b"), ("s", 1, "bb c")], "session_id string, chunk_index int, text string").withColumn("ref", F.array(F.lit("a"), F.lit("bx"), F.lit("c")))
    assert [(r["carried"], r["fragment"]) for r in sessions.fragments(df).orderBy("chunk_index").collect()] == [("a", "b"), ("b bb c", "")]


def test_votes_of_sure_matches(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"s{i % 3}", i, r.choice([1, 2, None]), r.random() / 3, r.random() / 4, r.choice([1, 2, None]), r.choice([1, 2, 3]), r.random(), i) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, chunk_index int, surah int, score double, margin double, matched int, ayah int, confidence double, heard int")
    want = sorted(map(tuple, sessions.voting_locks(df).collect()))
    got = sorted(map(tuple, streamed(spark, df, P.voting_lock_stream, tmp_path, "votes").collect()))
    assert got == want and got != sorted(map(tuple, sessions.locks(df).collect()))
    lock = k.VotingLock()
    lock.update(None, None, None, 2, 3, 0.9, 2)
    assert lock.update(None, None, None, 2, 4, 0.9, 3) == ("ACTIVE", 2)


def test_chunks_of_speech(spark, tmp_path):
    c = k.Chunker(rate=1000)
    assert c.update("speech", 0, 300, 400) == [] and c.update("speech", 600, 1500, 1520) == []  # a blip, and no silence yet
    assert c.update("speech", 2000, 2600, 3000) == [(0, 1650), (1850, 2750)]
    assert c.update("pause", None, None, 5000) == [] and c.update("speech", 4500, 5600, 5900) == [(5000, 5750)]
    assert c.update("stop", None, None, 5950) == [(5600, 5950)] and k.Chunker(rate=1000).update("stop", None, None, 200) == []
    r = random.Random(5)
    rows, at = [], {}
    for i in range(90):
        s = f"s{i % 2}"
        a = at.get(s, 0) + r.randint(1000, 9000)
        z = a + r.randint(2000, 30000)
        at[s] = z
        rows.append((s, i, r.choice(["speech"] * 9 + ["pause"]) if i < 88 else "stop", a, z, z + r.randint(0, 3000)))
    df = spark.createDataFrame(rows, "session_id string, seq long, kind string, start long, end long, total long")
    want = sorted(map(tuple, sessions.chunks(df).collect()))
    assert sorted(map(tuple, streamed(spark, df, P.chunk_stream, tmp_path, "chunked").collect())) == want and len(want) > 20


def test_pairs_and_changes(spark, tmp_path):
    rows = [("s", 0, "pending", 1.0, 2.0), ("s", 1, "pending", 3.0, 4.0), ("s", 2, "discard", 1.02, None), ("s", 3, "result", None, None), ("s", 4, "result", None, None), ("s", 5, "pending", 5.0, 6.0), ("t", 6, "result", None, None), ("s", 7, "result", None, None)]
    df = spark.createDataFrame(rows, "session_id string, seq long, kind string, start double, end double")
    assert sorted(map(tuple, streamed(spark, df, P.paired_stream, tmp_path, "pairs").collect())) == [("s", 3, 1, 3.0, 4.0), ("s", 7, 2, 5.0, 6.0)]
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "a"), ("s", 2, "b"), ("t", 3, "b"), ("s", 4, None), ("s", 5, None), ("s", 6, "b")], "session_id string, seq long, value string")
    got = sorted(map(tuple, streamed(spark, df, P.changes, tmp_path, "changed").collect()))
    assert [x[:2] for x in got] == [("s", 0), ("s", 2), ("s", 4), ("s", 6), ("t", 3)]


def test_delta_and_status_streams(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 100), ("s", 1, 210), ("s", 2, 300), ("t", 0, 50)], "session_id string, seq long, samples int")
    assert sorted(map(tuple, streamed(spark, df, lambda d: P.delta_stream(d, idle_ms=600_000), tmp_path, "deltas").collect())) == [("s", 0, 0, 100), ("s", 1, 100, 210), ("s", 2, 210, 300), ("t", 0, 0, 50)]
    df = spark.createDataFrame([("s", 0, 1, "wrong"), ("s", 1, 1, "correct"), ("s", 2, 1, "wrong"), ("s", 3, 2, None)], "session_id string, seq long, word int, status string")
    assert sorted(map(tuple, streamed(spark, df, P.status_stream, tmp_path, "statuses").collect())) == [("s", 0, 1, "wrong"), ("s", 1, 1, "correct"), ("s", 2, 1, "correct"), ("s", 3, 2, None)]


def test_state_is_kept_between_batches(spark, tmp_path):
    rows = [("s", i, 1, 0.9, 0.5) for i in range(6)]
    schema = "session_id string, chunk_index int, surah int, score double, margin double"
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = P.run(P.lock_stream(src), "parquet", str(tmp_path / "out"), str(tmp_path / "cp"), None)
    assert P.health(spark) is not None
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r["chunk_index"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 6 and [s for _, s in got].count("ACTIVE") == 5


def test_starts(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, None), ("a", 3, None), ("b", None, True)], "session_id string, start_ayah int, qari_mode boolean").withColumn("ts", F.lit(1000).cast("timestamp"))
    got = {r["session_id"]: (r["start_ayah"], r["qari_mode"]) for r in streamed(spark, df, lambda d: P.starts(d, "ts", "1 minute"), tmp_path, "began").collect()}
    assert got["b"] == (1, True) and got["a"] in ((2, False), (3, False))
