"""Batches of texts to embed: both limits, restarts and no empty texts."""

from symlattice.operators import semantic


def test_batches_close_at_either_limit(spark):
    rows = [("many", i, 10) for i in range(3000)] + [("long", i, 9000) for i in range(5)] + [(None, 1, 5), (None, 2, 0)]
    got = semantic.embed_batches(spark.createDataFrame(rows, "source string, id long, size long"), "source", "id", "size").collect()
    assert sorted((r.source or "", r.id) for r in got) == sorted((s or "", i) for s, i, n in rows if n)
    assert [r.batch for r in sorted((r for r in got if r.source == "long"), key=lambda r: r.id)] == [0, 0, 1, 1, 2]
    batches = {}
    for r in got:
        batches.setdefault((r.source, r.chunk, r.batch), []).append(r.id)
    chunks = {c for s, c, _ in batches if s == "many"}
    assert chunks == {0, 1, 2}
    for s, c, b in batches:
        ids = batches[s, c, b]
        last = (s, c, b + 1) not in batches
        assert len(ids) == 64 or s != "many" or last and len(ids) < 64
