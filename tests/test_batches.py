import pyarrow as pa

from jestframe.functions.batches import pieces, with_strings
from jestframe.operators import infer


def test_pieces():
    """Every row once and in order, in slices of about the limit; a long row stands alone."""
    texts = ["ab", None, "é" * 30, "", "x" * 10, "y" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    got = list(pieces([batch, batch.slice(0, 0), batch.slice(4)], "text", 20))
    assert [p.column("id").to_pylist() for p in got] == [[0, 1, 2], [3, 4, 5], [6], [4, 5], [6]]
    assert [t for p in got for t in p.column("text").to_pylist()] == texts + texts[4:]
    assert [p.num_rows for p in pieces([batch], "id", 1)] == [7]  # only strings are cut
    out = with_strings(got[0], status=["ok", None, "é"])
    assert out.schema.names == ["id", "text", "status"] and out.column("status").to_pylist() == ["ok", None, "é"]


def test_requests_hold_a_piece(spark):
    """A task holds some MB of answers, not those of a whole batch."""
    rows, length = 300, 100_000

    def sender(payload):
        import tracemalloc

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        response, held = payload.replace("a", "b"), tracemalloc.get_traced_memory()[0]
        if payload.startswith("299:"):
            tracemalloc.stop()
        return response, str(held)

    df = spark.range(0, rows, numPartitions=1).selectExpr("id", f"CONCAT(id, ':', REPEAT('a', {length})) AS payload")
    out = infer._call_json(df, "payload", sender).selectExpr("id", "response = REPLACE(payload, 'a', 'b') AS same", "finish").collect()
    assert sorted(r.id for r in out) == list(range(rows)) and all(r.same for r in out)
    assert max(int(r.finish) for r in out) < 16e6


def test_scorers_get_pieces(spark):
    """A scorer gets some MB of prompts at a time; other columns stay as they are."""
    def sizes(prompts):
        for p in prompts:
            yield [str(p.str.len().sum())] * len(p)

    big = 2**60 + 1  # no double
    df = spark.range(0, 200, numPartitions=1).selectExpr("id", "REPEAT('a', 100000) AS text", f"IF(id % 2 = 0, id + {big}, NULL) AS n", "ARRAY(id, NULL) AS a")
    routed = infer.route(df, infer.F.lit("m"), {"m": infer.Route(sizes, 1)})
    for out in (infer.label_with(df, sizes, ["0"]).select("id", "response", "status"), routed):
        got = out.select("id", "response", "status").collect()
        assert sorted(r.id for r in got) == list(range(200)) and {r.status for r in got} == {"ok"}
        assert max(int(float(r.response)) for r in got) <= 5e6
    assert sorted((r.id, r.n, r.a) for r in routed.collect()) == [(i, None if i % 2 else i + big, [i, None]) for i in range(200)]
