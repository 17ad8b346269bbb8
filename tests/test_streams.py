"""Sessions over a stream of files."""

import json

from symlattice.streaming.reindex import idle_sessions, merged_deltas


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_sessions_end_when_events_pause(spark, tmp_path):
    events = [("a", 0), ("a", 2), ("b", 1), ("a", 10), ("z", 500)]
    for i, (user, at) in enumerate(events):
        (tmp_path / f"{i}.json").write_text(json.dumps({"user": user, "ts": f"2024-01-01 00:{at // 60:02d}:{at % 60:02d}", "seq": i, "text": f"t{i}"}))
    read = spark.readStream.schema("user string, ts timestamp, seq int, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    assert sorted((r.user, r.n_events) for r in run(spark, idle_sessions(read, "user", "ts"), "sessions")) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted(r.content for r in run(spark, merged_deltas(read, "user", "seq", "text", "ts"), "deltas")) == ["t0t1", "t2", "t3"]


def test_index_follows_deletions_and_changes(spark, tmp_path):
    import time

    from symlattice.plans.engine import Engine
    from symlattice.streaming.reindex import follow

    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.go").write_text("package p\n\nfunc A() {}\n")
    (root / "b.go").write_text("package p\n\nfunc B() {}\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    q = follow(e, str(tmp_path / "checkpoint"), "1 second")
    try:
        for change, want in ((lambda: None, {"A", "B"}), ((root / "b.go").unlink, {"A"}), (lambda: (root / "a.go").write_text("package p\n\nfunc Changed() {}\n"), {"Changed"})):
            change()
            ends = time.time() + 90
            while {r.name for r in e.read("nodes").collect()} != want and time.time() < ends:
                assert q.exception() is None
                time.sleep(1)
            assert {r.name for r in e.read("nodes").collect()} == want
    finally:
        q.stop()


def test_fragments_streamed_late_and_reordered_equal_a_batch(spark, tmp_path):
    """Fragments in any order over several batches, some twice, give the messages that one batch over all gives."""
    import random
    import time

    from symlattice.operators.chat import FRAGMENTS, merged_messages
    from symlattice.streaming.messages import assembled, whole_message

    r = random.Random(8)
    rows = []
    for m in ("m1", "m2", "m3"):
        for seq in range(12):
            call = r.random() < 0.5
            first = call and r.random() < 0.5
            rows.append((m, seq, None if call else f"c{seq} ", "why " if seq == 0 else None, r.randrange(3) if call else None, f"id{seq}" if first else None, f"tool{seq}" if first else ("" if call else None), f"{{a{seq}" if call else None, seq == 11 or None))
    r.shuffle(rows)
    batch = {x.message: x.asDict(True) for x in merged_messages(spark.createDataFrame(rows + rows[:5], FRAGMENTS)).collect()}
    for m, got in batch.items():
        assert got == whole_message(m, [x[1:] for x in rows if x[0] == m])
    source = tmp_path / "in"
    source.mkdir()

    def put(k, part):
        names = [c.split()[0] for c in FRAGMENTS.split(", ")]
        (tmp_path / "one.json").write_text("\n".join(json.dumps(dict(zip(names, x))) for x in part))
        (tmp_path / "one.json").rename(source / f"{k}.json")

    parts = [rows[:14], rows[14:25], rows[25:] + rows[:5]]
    put(0, parts[0])
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    stream = assembled(spark.readStream.schema(FRAGMENTS).json(str(source)), idle=12_000, done=12_000)
    q = stream.writeStream.format("memory").queryName("whole_messages").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for k in (1, 2):
            ends = time.time() + 60
            while not (q.lastProgress and sum(p["numInputRows"] for p in q.recentProgress) >= sum(map(len, parts[:k]))) and time.time() < ends:
                assert q.exception() is None
                time.sleep(0.2)
            put(k, parts[k])
        ends = time.time() + 90
        while spark.table("whole_messages").count() < 3 and time.time() < ends:
            assert q.exception() is None
            time.sleep(0.5)
        assert {x.message: x.asDict(True) for x in spark.table("whole_messages").collect()} == batch
    finally:
        q.stop()
        spark.conf.set(provider, before)
