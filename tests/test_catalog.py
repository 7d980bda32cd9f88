import re
import uuid

import pytest
from pyspark.sql import functions as F

from edgetide import __main__ as cli
from edgetide.operators.edges import edges_in_window
from edgetide.operators.layout import lay_out, partitions_on, spread_join
from edgetide.plans import catalog, jobs
from edgetide.scratch import Scratch
from micro import M1, edge_frame


@pytest.fixture
def db(spark, tmp_path):
    name = f"graph_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name, str(tmp_path / name))
    for table in catalog.TABLES:
        catalog.create_table(spark, name, table, buckets=4)
    yield name
    catalog.drop_tables(spark, name)
    spark.sql("USE default")
    spark.sql(f"DROP DATABASE {name}")


@pytest.fixture
def filled(spark, db):
    edges = edge_frame(spark, M1).withColumn("edge_type", F.lit("TO"))
    person = spark.range(1, 7).selectExpr("id AS node_id", "concat('p', id, '@x.test') AS email")
    for _ in range(2):  # the second load adds nothing
        catalog.append(edges, db, "edges")
        catalog.append(person, db, "person")
    jobs.build_two_hop(spark, db)
    jobs.build_two_hop(spark, db)
    return db


def test_layout(spark, db):
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {db}.edges").collect()}
    assert described["Num Buckets"] == "4"
    assert described["Bucket Columns"] == "[`src`]"
    assert described["Sort Columns"] == "[`src`, `sent_at`]"
    assert "parquet" in described["Provider"].lower()


def test_loading_twice(spark, filled):
    counts = {r.table_name: r.row_count for r in catalog.table_report(spark, filled).collect()}
    assert counts == {"person": 6, "edges": 9, "two_hop_index": 6, "mail_rejects": 0}


def test_report(spark, filled):
    columns = [(r.column_name, r.data_type) for r in
               catalog.table_report(spark, filled).filter("table_name = 'two_hop_index'").orderBy("position").collect()]
    assert columns == [("n1", "bigint"), ("t1", "timestamp"), ("n2", "bigint"), ("t2", "timestamp"), ("n3", "bigint")]
    assert catalog.sample_rows(spark, filled, "edges", 4).count() == 4
    catalog.table_properties(spark, filled, "edges").collect()


@pytest.mark.parametrize("two_hop", [False, True])
def test_reach_report(spark, filled, two_hop):
    rows = jobs.reach_report(spark, filled, "p1@x.test", "2024-01-01T00:00:00Z", 1, two_hop=two_hop).collect()
    assert [r.email for r in rows] == ["p1@x.test", "p2@x.test", "p3@x.test", "p4@x.test"]
    assert jobs.reach_report(spark, filled, "none@x.test", "2024-01-01 00:00:00", 1).count() == 0


def test_other_reports(spark, filled):
    window = ("p1@x.test", "2024-01-01 00:00:00", 1)
    assert jobs.reach_sql_report(spark, filled, *window).count() == 4
    assert [r.email for r in jobs.reach_hops_report(spark, filled, *window, 1).collect()] == ["p1@x.test", "p2@x.test", "p3@x.test"]
    assert jobs.reach_hops_report(spark, filled, "o'hara@x.test", *window[1:]).count() == 0
    path = jobs.path_report(spark, filled, window[0], "p4@x.test", *window[1:]).collect()
    assert [r.email for r in path] == ["p1@x.test", "p2@x.test", "p3@x.test", "p4@x.test"]
    hit = jobs.find_path(spark, filled, 1, 4).collect()
    assert [(r.n1, r.n3) for r in hit] == [(3, 1)]
    assert jobs.degree_report(spark, filled).count() == 6
    assert jobs.degree_stats_report(spark, filled).first().max_degree == 4


@pytest.mark.parametrize("single_file", [False, True])
def test_csv_export(spark, filled, tmp_path, single_file):
    out = tmp_path / "csv"
    catalog.export_csv(spark, filled, str(out), single_file)
    if single_file:
        assert len(list((out / "edges").glob("part-*"))) == 1
    back = spark.read.option("header", True).csv(str(out / "edges"))
    assert back.columns == ["edge_id", "src", "dst", "edge_type", "sent_at", "created_at"] and back.count() == 9


def test_unbucketed_table_and_drop(spark, db):
    catalog.drop_tables(spark, db)
    assert catalog.table_report(spark, db).count() == 0
    catalog.create_table(spark, db, "edges", buckets=0)
    assert "Num Buckets" not in {r.col_name for r in spark.sql(f"DESCRIBE FORMATTED {db}.edges").collect()}


def test_command_line(spark, filled, tmp_path, capsys):
    cli.main(["--db", filled, "reach", "--email", "p1@x.test", "--start", "2024-01-01 00:00:00", "--hours", "1"])
    assert "p4@x.test" in capsys.readouterr().out
    cli.main(["--db", filled, "export-csv", "--out", str(tmp_path / "out"), "--single-file"])
    assert (tmp_path / "out" / "person").is_dir()
    cli.main(["--db", filled, "list"])
    assert "two_hop_index" in capsys.readouterr().out


def test_mail_to_tables(spark, db, tmp_path):
    folder = tmp_path / "mail"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.").write_text(f"Date: 1 Jun 2001 08:0{i}:00 -0700\nFrom: a{i}@x\nTo: a{i + 1}@x\n\n")
    jobs.load_mail(spark, db, str(folder))
    jobs.mail_to_json(spark, str(folder), str(tmp_path / "json"))
    jobs.load_json(spark, db, str(tmp_path / "json"), multiline=False)
    assert spark.table(f"{db}.edges").count() == 3 and spark.table(f"{db}.person").count() == 4
    rows = jobs.reach_report(spark, db, "a0@x", "2001-06-01 15:00:00", 1).collect()
    assert [r.email for r in rows] == ["a0@x", "a1@x", "a2@x", "a3@x"]


def mail_folder(path, mails):
    path.mkdir()
    for i, (sender, recipient) in enumerate(mails):
        (path / f"{i}.").write_text(f"Date: 1 Jun 2001 08:0{i}:00 -0700\nFrom: {sender}\nTo: {recipient}\n\n")
    return str(path)


def test_a_second_corpus_keeps_persons(spark, db, tmp_path):
    """Edges of any order of loads name the same persons; a repeated load adds nothing; rejects are stored."""
    first, second = mail_folder(tmp_path / "one", [("m@x", "n@x")]), mail_folder(tmp_path / "two", [("a@x", "b@x"), ("a@x", "m@x"), ("a@x", "")])
    for folder in (first, second, first, second):
        jobs.load_mail(spark, db, folder)
    names = {r.node_id: r.email for r in spark.table(f"{db}.person").collect()}
    assert sorted(names.values()) == ["a@x", "b@x", "m@x", "n@x"]
    edges = spark.table(f"{db}.edges").collect()
    assert sorted((names[e.src], names[e.dst]) for e in edges) == [("a@x", "b@x"), ("a@x", "m@x"), ("m@x", "n@x")]
    assert spark.table(f"{db}.mail_rejects").count() == 1


def test_graph_files_with_other_ids_are_refused(spark, db, tmp_path):
    jobs.load_mail(spark, db, mail_folder(tmp_path / "one", [("m@x", "n@x")]))
    jobs.mail_to_json(spark, mail_folder(tmp_path / "two", [("a@x", "b@x")]), str(tmp_path / "json"))
    with pytest.raises(ValueError, match="in the table"):
        jobs.load_json(spark, db, str(tmp_path / "json"), multiline=False)


@pytest.fixture
def daily(spark, tmp_path):
    name = f"graph_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name, str(tmp_path / name))
    catalog.create_tables(spark, name, buckets=2, by_day=True)
    yield name
    catalog.drop_tables(spark, name)
    spark.sql("USE default")
    spark.sql(f"DROP DATABASE {name}")


def folders(plan):
    found = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)
    return found and found.group(1)


def day_edges(spark, days, offset=0):
    return edge_frame(spark, [(i % 5, i % 7 + 5, d * 1440 + i) for d in days for i in range(offset, offset + 20)]).withColumn(
        "edge_id", F.concat("src", F.lit("-"), "dst", F.lit("-"), F.col("sent_at").cast("string"))).withColumn("edge_type", F.lit("TO"))


def test_a_window_lists_the_folders_of_its_days(spark, daily):
    catalog.append(day_edges(spark, range(10)), daily, "edges")
    table = spark.table(f"{daily}.edges")
    assert table.select("sent_day").distinct().count() == 10
    window = edges_in_window(table, "2024-01-03 00:00:00", 23)
    assert {r.sent_day.day for r in window.select("sent_day").distinct().collect()} == {3}
    read = {r[0].split("sent_day=")[1][:10] for r in window.select(F.input_file_name()).distinct().collect()}
    assert read == {"2024-01-03"}
    assert "sent_day" in folders(window._jdf.queryExecution().executedPlan().toString())
    assert jobs.degree_report(spark, daily).count() == 12


def test_a_load_looks_for_its_keys_in_its_days(spark, daily, monkeypatch):
    catalog.append(day_edges(spark, range(10)), daily, "edges")
    seen = []
    days_of = catalog._days_of
    monkeypatch.setattr(catalog, "_days_of", lambda rows: seen.append(days_of(rows)) or seen[-1])
    undated = day_edges(spark, [3], 50).withColumn("sent_at", F.lit(None).cast("timestamp_ntz"))
    catalog.append(day_edges(spark, [3, 4], 10).unionByName(undated), daily, "edges")
    table = spark.table(f"{daily}.edges")
    read = {r[0].split("sent_day=")[1][:10] for r in table.filter(seen[0]).select(F.input_file_name()).distinct().collect()}
    assert read == {"2024-01-04", "2024-01-05", "__HIVE_DEFAULT_PARTITION__"[:10]}
    assert table.count() == 200 + 20 + 20
    catalog.append(day_edges(spark, [3, 4], 10).unionByName(undated), daily, "edges")
    assert spark.table(f"{daily}.edges").count() == 240


def test_joins_leave_the_edges_in_their_buckets(spark, filled):
    """Neither the rounds of a relaxation nor a look-up join shuffles a table that is bucketed on the key."""
    table = spark.table(f"{filled}.edges")
    assert partitions_on(table.select("src", "dst"), "src") == 4 and partitions_on(table, "dst") is None
    temporal = table.select("src", F.col("sent_at").alias("start_time"), F.col("sent_at").alias("end_time"), "dst")
    layout = lay_out(temporal, "src", ["dst"], ["start_time"], Scratch(spark), collapse=True)
    plan = layout.rows._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert layout.rows.rdd.getNumPartitions() == 4 and layout.rows.count() == 9
    layout.release()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dim = spark.range(7).select(F.col("id").alias("src"), (F.col("id") * 2).alias("twice"))
        joined = spread_join(table.select("src", "dst"), dim, ["src"], ["dst"], Scratch(spark))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 9
        arrivals = jobs.reach_report(spark, filled, "p1@x.test", "2024-01-01 00:00:00", 1)
        assert arrivals.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_kept_up_over_loads(spark, db):
    edges = edge_frame(spark, M1).withColumn("edge_type", F.lit("TO"))
    early = edges.filter("edge_id < 'e00004'").withColumn("created_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    catalog.append(early, db, "edges")
    jobs.build_two_hop(spark, db)
    catalog.append(edges.filter("edge_id >= 'e00004'").withColumn("created_at", F.lit("2024-02-02 00:00:00").cast("timestamp")), db, "edges")
    jobs.update_two_hop(spark, db, "2024-02-02 00:00:00")
    kept = sorted(map(tuple, jobs.index_of(spark, db).collect()))
    jobs.build_two_hop(spark, db)
    assert kept == sorted(map(tuple, spark.table(f"{db}.two_hop_index").collect())) and len(kept) == 6
