
from jestframe.session import scratch_path
from jestframe.sources import io


def test_csv_round_trip(spark):
    texts = [" a\nb \"q\", x ", "NA", "back\\slash", "tab\t", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    path = scratch_path(spark, "test_csv")
    io.write_csv(df, path)
    back = {r.id: r.text for r in io.read_csv(spark, path, df.schema).collect()}
    assert [back[i] for i in range(4)] == texts[:4]
    assert back[4] is None  # '' comes back null (documented)


def test_prompts_source(spark):
    df = io.from_prompts(spark, ["jaja", "hola"], score=1)
    assert sorted(tuple(r) for r in df.collect()) == [("hola", 1), ("jaja", 1)]


def test_train_log_sink_and_scans(spark, tmp_path):
    logs = spark.createDataFrame(
        [(500, 0.9, 0.8, 0.5, 0.4, 0.45, "bloom", "detection"),
         (1000, 0.7, 0.6, 0.6, 0.5, 0.55, "bloom", "detection"),
         (500, 1.5, 1.4, 0.3, 0.2, 0.25, "canine", "classification")],
        "step int, train_loss double, loss double, accuracy double, macro_f1 double, weighted_f1 double, "
        "model string, task string",
    )
    root = scratch_path(spark, "logs")
    io.write_train_logs(logs, root)
    back = io.read_train_logs(spark, root)
    assert sorted(tuple(r) for r in back.select(*logs.columns).collect()) == sorted(tuple(r) for r in logs.collect())
    assert back.where("model = 'bloom'").count() == 2

    # the reference's layout: loose {model}_{task}.csv files
    import os
    flat = str(tmp_path)
    for (model, task), rows in {("bloom", "detection"): "500,0.9,0.8,0.5,0.4,0.45\n1000,0.7,0.6,0.6,0.5,0.55\n",
                                ("canine_c", "classification"): "500,1.5,1.4,0.3,0.2,0.25\n"}.items():
        with open(os.path.join(flat, f"{model}_{task}.csv"), "w") as fh:
            fh.write("step,train_loss,loss,accuracy,macro_f1,weighted_f1\n" + rows)
    named = io.read_named_logs(spark, os.path.join(flat, "*.csv"))
    got = sorted((r.model, r.task, r.step) for r in named.collect())
    assert got == [("bloom", "detection", 500), ("bloom", "detection", 1000), ("canine_c", "classification", 500)]


def test_sorted_sink(spark):
    df = spark.range(200).selectExpr("CAST((id * 7919) % 200 AS BIGINT) AS id").repartition(4)
    path = scratch_path(spark, "sorted")
    io.write_table(df, path, order_by=["id"])
    assert [r.id for r in spark.read.parquet(path).collect()] == list(range(200))


def test_json_array_scan_and_registry(spark, tmp_path):
    """S3: a file holding one JSON array of objects (pretty-printed over many
    lines); S2: datasets loaded by registered name or by path."""
    import json
    import os

    items = [{"id": 1, "body": "uno\n\"dos\"", "rating": 2.5}, {"id": 2, "body": "tres, ñ", "rating": 3.0}]
    path = os.path.join(str(tmp_path), "rated.json")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(items, fh, indent=2, ensure_ascii=False)
    got = sorted(tuple(r) for r in io.read_json_array(spark, path).collect())
    assert got == [(1, "uno\n\"dos\"", 2.5), (2, "tres, ñ", 3.0)]

    df = spark.createDataFrame([("a b", 1), ("c", 0)], io.LABELLED)
    io.write_csv(df, os.path.join(str(tmp_path), "base"))
    reg = io.Registry(spark, str(tmp_path))
    reg.register("base", "base")
    by_name = sorted(tuple(r) for r in reg.load("base").collect())
    by_path = sorted(tuple(r) for r in reg.load(os.path.join(str(tmp_path), "base")).collect())
    assert by_name == by_path == [("a b", 1), ("c", 0)]


def test_json_arrays_grow_in_number(spark, tmp_path):
    """Many equal rows too go to files of bounded size."""
    import glob
    import json

    rows = [(7, 'the "same" \n row \u00e9', 1.5)] * 3000 + [(i, None if i % 5 == 0 else "x" * (i % 90), None) for i in range(3000)]
    path = str(tmp_path / "arrays")
    io.write_json_arrays(spark.createDataFrame(rows, io.RATED), path, array_bytes=20_000)
    files = glob.glob(f"{path}/part-*")
    arrays = [open(f, encoding="utf-8").read() for f in files]
    assert len(files) > 15 and max(map(len, arrays)) < 30_000 and sum(len(json.loads(a)) for a in arrays) == 6000
    back = io.read_json_array(spark, path).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, rows))
    io.write_json_arrays(spark.createDataFrame([], io.RATED), path)
    assert io.read_json_array(spark, path).count() == 0
