"""Command line of the jobs in ``edgetide.plans``: ``spark-submit --py-files edgetide.zip edgetide/__main__.py ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from edgetide.plans import catalog, jobs


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="edgetide")
    parser.add_argument("--db", default=jobs.DEFAULTS["db"])
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for flag, default in arguments:
            kind = type(default) if default is not None else str
            sub.add_argument(flag, default=default, type=kind, required=default is None)
        return sub

    window = (("--email", None), ("--start", jobs.DEFAULTS["start"]),
              ("--hours", jobs.DEFAULTS["hours"]))
    command("create-tables", ("--buckets", 16), ("--format", "parquet")).add_argument("--by-day", action="store_true")
    command("load-mail", ("--folder", None))
    command("mail-to-json", ("--folder", None), ("--out", None))
    command("load-json", ("--folder", None)).add_argument("--lines", action="store_true")
    command("build-two-hop")
    command("update-two-hop", ("--loaded-from", None))
    command("reach", *window).add_argument("--two-hop", action="store_true")
    command("reach-sql", *window)
    command("reach-hops", *window, ("--k", 50))
    command("path", *window, ("--target-email", None))
    search = command("find-path", ("--margin", 0), ("--max-depth", 10))
    for end in ("--from-node", "--to-node"):
        search.add_argument(end, type=int, required=True)
    command("degree")
    command("degree-stats")
    command("list")
    command("export-csv", ("--out", "csv_export")).add_argument("--single-file", action="store_true")
    command("drop-tables")
    a = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"edgetide {a.command}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    span = (a.email, a.start, a.hours) if hasattr(a, "email") else ()
    run = {
        "create-tables": lambda: catalog.create_tables(spark, a.db, a.buckets, a.format, a.by_day),
        "load-mail": lambda: jobs.load_mail(spark, a.db, a.folder),
        "mail-to-json": lambda: jobs.mail_to_json(spark, a.folder, a.out),
        "load-json": lambda: jobs.load_json(spark, a.db, a.folder, not a.lines),
        "build-two-hop": lambda: jobs.build_two_hop(spark, a.db),
        "update-two-hop": lambda: jobs.update_two_hop(spark, a.db, a.loaded_from),
        "reach": lambda: jobs.reach_report(spark, a.db, *span, two_hop=a.two_hop),
        "reach-sql": lambda: jobs.reach_sql_report(spark, a.db, *span),
        "reach-hops": lambda: jobs.reach_hops_report(spark, a.db, *span, a.k),
        "path": lambda: jobs.path_report(spark, a.db, a.email, a.target_email, a.start, a.hours),
        "find-path": lambda: jobs.find_path(spark, a.db, a.from_node, a.to_node, a.margin, a.max_depth),
        "degree": lambda: jobs.degree_report(spark, a.db),
        "degree-stats": lambda: jobs.degree_stats_report(spark, a.db),
        "list": lambda: catalog.table_report(spark, a.db),
        "export-csv": lambda: catalog.export_csv(spark, a.db, a.out, a.single_file),
        "drop-tables": lambda: catalog.drop_tables(spark, a.db),
    }
    result = run[a.command]()
    if result is not None:
        result.show(100, truncate=False)


if __name__ == "__main__":
    main()
