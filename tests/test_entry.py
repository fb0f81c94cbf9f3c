import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["corpus", "id", "text"]


def test_every_query_has_oracle_or_is_documented(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {name for name in q if name.startswith("t")}
    assert own - set(o) == {"t38_fit_predict"} and len(own) == 61


def test_queries_run_on_smallest_scale(spark):
    for name, fn in E.queries().items():
        if not name.startswith("t"):  # those have tests of their own
            continue
        df = fn(spark, SF_SMALL)
        df.limit(1).collect()  # plans and runs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_exchange_in_core_jobs(spark):
    from jestframe.plans import queries as Q

    for fn in (Q.t05_drop_all_duplicates, Q.t04_rated_items, Q.t02_annotation_detection,
               Q.t03_annotation_classification, Q.t07_union_unique):
        plan = _plan(fn(spark, SF_SMALL))
        assert "SinglePartition" not in plan, fn.__name__


def _read_schemas(df):
    import re

    plan = _plan(df)
    found = []
    for line in plan.splitlines():
        m = re.search(r"ReadSchema: struct<(.*)>\s*$", line)
        if m:
            fields = re.findall(r"(?:^|,)([A-Za-z_][A-Za-z0-9_]*):", m.group(1))
            found.append(frozenset(fields))
    return set(found)


def test_scans_read_only_the_columns_they_need(spark):
    """Column pruning reaches the parquet scans (through stand-ins, spread
    repartitions and generators)."""
    from jestframe.plans import queries as Q

    expect = {
        Q.t02_annotation_detection: {frozenset({"l_orderkey", "l_partkey", "l_linenumber", "l_quantity"})},
        Q.t04_rated_items: {frozenset({"doc_id", "text"})},
        Q.t13_sample_rows: {frozenset({"doc_id"})},
        Q.t25_best_step: {frozenset({"event_id", "user_id", "value"})},
        Q.t22_classification_report: {frozenset({"vec_id", "embedding", "label"})},
        Q.t07_union_unique: {frozenset({"doc_id", "text"}), frozenset({"conv_id", "turn", "text"}),
                             frozenset({"item_id", "text"})},
    }
    for fn, schemas in expect.items():
        assert _read_schemas(fn(spark, SF_SMALL)) == schemas, fn.__name__
    # the text predicates of C4 reach the scan
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in _plan(Q.t04_rated_items(spark, SF_SMALL))
