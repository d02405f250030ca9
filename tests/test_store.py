import shutil

from docgrid.plans import registry, store
from docgrid.plans.domain import with_views
from docgrid.plans.relational import run_sql

SF = "/root/testdata/sf0.001"
registry.load()


def scans(df, table="lineitem"):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{table}.parquet") or df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet")


def test_one_scan_of_the_facts(spark, monkeypatch):
    """Over all that a report runs, the fact table is read once."""
    from docgrid import shared

    store.forget_all(spark)
    read = []
    real = shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: (read.append((name, scans(df))), real(df, name))[1])
    for name in ("pipeline_input", "flat_file", "complete_issues", "systemops_flat", "viz_join_or"):
        df = registry.QUERIES[name].run(spark, SF)
        assert scans(df) == 0, name
    assert sum(n for _, n in read) == 1, read
    assert len({name for name, _ in read}) == len(read)  # each view once
    store.forget_all(spark)


def test_a_changed_table_is_read_again(spark, tmp_path):
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(100).write.parquet(f"{tmp_path}/{t}.parquet")
    first = store.view(spark, str(tmp_path), "spots").count()
    assert store.view(spark, str(tmp_path), "spots").count() == first
    shutil.rmtree(tmp_path / "lineitem.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(60).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert store.view(spark, str(tmp_path), "spots").count() < first


def test_views_keep_their_meaning(spark):
    for name in ("doc_tables", "table_tags", "issues", "projects"):
        got = store.view(spark, SF, name)
        want = run_sql(spark, SF, with_views(f"select * from {name}"))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


def test_what_is_written_is_not_broadcast(spark):
    """Written views look small by their files; a broadcast would take their rows through the driver."""
    for name, most in (("complete_issues", 2), ("viz_join_or", 0), ("flat_file", 2)):  # orders and customers go by their own files
        plan = registry.QUERIES[name].run(spark, SF)._jdf.queryExecution().sparkPlan().toString()
        sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
        assert "SortMergeJoin" in plan and len(sent) <= most, (name, sent)
    store.forget_all(spark)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_numbered_views_are_written(spark, monkeypatch):
    """What is made row by row isn't written, and the rows of the facts are sent once to be grouped and numbered."""
    from docgrid import shared

    written = []
    real = shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: (written.append((name, plan(df).count("Exchange hash"))), real(df, name))[1])
    for name in ("without_sublabels", "processing_sequence", "tables_by_tag"):
        store.forget_all(spark)
        written.clear()
        registry.QUERIES[name].run(spark, SF)
        assert written == [("view-spots", 1)], (name, written)
    store.forget_all(spark)


def test_tags_in_one_pass(spark):
    """A table's tags come from one pass over the facts; a matrix sends each table once, not once for each tag."""
    for name, most in (("tag_matrix", 2), ("pivot_tags", 1), ("tag_lists_with_nulls", 2)):
        df = registry.QUERIES[name].run(spark, SF)
        assert plan(df).count("FileScan") - plan(df).count("nation.parquet") <= most, name
    cross = plan(registry.QUERIES["tag_matrix"].run(spark, SF))
    assert cross.index("NestedLoop") < cross.index("SortMergeJoin" if "SortMergeJoin" in cross else "HashJoin")


def test_median_without_one_sorted_task(spark):
    """Only the facts are numbered, order by order; no window holds all counts in one task."""
    shown = [line for line in plan(registry.QUERIES["issue_stats_median"].run(spark, SF)).splitlines() if "Window [" in line]
    assert shown and all("windowspecdefinition(l_orderkey" in line for line in shown)


def test_rows_of_large_facts_are_dealt_by_number(spark, monkeypatch):
    """Partitions grow in number with the facts, not in rows: nothing that Spark may put together takes all of a key's rows."""
    from docgrid.plans import domain

    def rows(name):
        return sorted(map(tuple, registry.QUERIES[name].run(spark, SF).collect()))

    names = ("page_candidates", "pivot_tags", "tag_lists_with_nulls")
    small = {name: rows(name) for name in names}
    monkeypatch.setattr(domain, "PART_BYTES", 1 << 13)
    for name in names:
        shown = plan(registry.QUERIES[name].run(spark, SF))
        assert "REPARTITION_BY_NUM" in shown and "ENSURE_REQUIREMENTS" not in shown.replace("SinglePartition, ENSURE_REQUIREMENTS", ""), name
        assert rows(name) == small[name] != []


def test_pictures_of_large_facts(spark, monkeypatch):
    """Captured lines are grouped once, and pictures meet their captions in partitions whose number grows with the facts."""
    from docgrid.plans import domain

    store.forget_all(spark)
    df = registry.QUERIES["tagged_pictures"].run(spark, SF)
    small = sorted(map(str, df.collect()))
    assert not scans(df) and "lineitem.parquet" not in plan(df)
    monkeypatch.setattr(domain, "PART_BYTES", 1 << 13)
    df = registry.QUERIES["tagged_pictures"].run(spark, SF)
    assert "REPARTITION_BY_NUM" in plan(df) and sorted(map(str, df.collect())) == small != []
    store.forget_all(spark)
