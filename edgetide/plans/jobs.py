"""The jobs of the engine over its catalog tables; ``python -m edgetide`` runs them from the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.degree import degree, degree_stats
from edgetide.operators.edges import unified_edges
from edgetide.operators.ingest import edge_flatten, mail_edges, mail_recipients, person_dim, person_flatten
from edgetide.operators.messages import reach_hop_bounded
from edgetide.operators.paths import earliest_path
from edgetide.operators.reach import Reach, named, reach, sources_by_email
from edgetide.operators.recursive import reach_recursive_sql
from edgetide.operators.two_hop import current_index, two_hop_index, two_hop_path_search, two_hop_update
from edgetide.plans import catalog
from edgetide.scratch import Scratch
from edgetide.sources.graph_json import load_graph_json, write_graph_json
from edgetide.sources.mail import accepted, parse_mail, read_mail, rejects

# What the jobs use when the command line does not say otherwise.
DEFAULTS = {"db": "graph_db", "start": "2001-10-05 00:00:00", "hours": 100}


def mail_to_graph(spark: SparkSession, mail_folder: str,
                  known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(person, edges, rejects) of a mail corpus; persons in ``known`` (node_id, email) are there and keep their ids."""
    scratch = Scratch(spark)
    # the messages are parsed once; recipients and rejects read the parsed rows
    parsed = scratch.save(parse_mail(read_mail(spark, mail_folder)), "parsed")
    recipients = scratch.save(mail_recipients(accepted(parsed)), "recipients")
    person = scratch.save(person_dim(recipients, scratch, known), "person")
    return person, mail_edges(recipients, person, scratch=scratch), rejects(parsed)


def load_mail(spark: SparkSession, db: str, mail_folder: str) -> None:
    """Mail corpus -> person, edge and reject tables, without files in between.

    Persons of earlier loads keep their ids, so any number of folders may be loaded, also the same one again.
    """
    person, edges, rejected = mail_to_graph(spark, mail_folder, spark.table(f"{db}.person"))
    catalog.append(person, db, "person")
    catalog.append(edges, db, "edges")
    catalog.append(rejected, db, "mail_rejects")


def mail_to_json(spark: SparkSession, mail_folder: str, out: str, max_records: int = 50_000) -> None:
    person, edges, _ = mail_to_graph(spark, mail_folder)
    write_graph_json(person, edges, out, max_records)


def load_json(spark: SparkSession, db: str, folder: str, multiline: bool = True) -> None:
    """Graph files -> person and edge tables. Ids that the table has for another e-mail are an error."""
    graph = load_graph_json(spark, folder, multiline)
    person = person_flatten(graph["nodes"])
    known = spark.table(f"{db}.person").select("node_id", F.col("email").alias("known"))
    clash = person.join(known, "node_id").filter(~F.col("email").eqNullSafe(F.col("known"))).first()
    if clash:
        raise ValueError(f"node {clash.node_id} is {clash.known} in the table and {clash.email} in {folder}")
    catalog.append(person, db, "person")
    catalog.append(edge_flatten(graph["edges"]), db, "edges")


def build_two_hop(spark: SparkSession, db: str) -> None:
    catalog.overwrite(two_hop_index(spark.table(f"{db}.edges")), db, "two_hop_index")


def update_two_hop(spark: SparkSession, db: str, loaded_from: str) -> None:
    """Bring the index up to date with the edges loaded (``created_at``) from a moment on.

    Rows are added only: readers take ``index_of``, and ``build_two_hop`` now and then removes rows that were beaten.
    """
    edges = spark.table(f"{db}.edges")
    new = F.col("created_at") >= F.lit(loaded_from).cast("timestamp")
    rows = Scratch(spark).save(two_hop_update(spark.table(f"{db}.two_hop_index"), edges.filter(~new), edges.filter(new)), "update")
    catalog.append(rows, db, "two_hop_index")


def index_of(spark: SparkSession, db: str) -> DataFrame:
    return current_index(spark.table(f"{db}.two_hop_index"))


def reach_from_email(spark: SparkSession, db: str, email: str, start: str, hours: int, two_hop: bool = False,
                     **options) -> Reach:
    """Earliest arrivals from the person with this e-mail; with ``two_hop`` over one-hop and two-hop edges together."""
    edges = spark.table(f"{db}.edges")
    sources = sources_by_email(edges, spark.table(f"{db}.person"), email, start, hours)
    if two_hop:
        edges = unified_edges(edges, index_of(spark, db), start, hours)
    return reach(edges, sources, **options)


def reach_report(spark: SparkSession, db: str, email: str, start: str, hours: int, **options) -> DataFrame:
    """(email, arrival_time) of everyone reached, earliest first."""
    found = reach_from_email(spark, db, email, start, hours, **options)
    listing = named(found.arrivals.select("node_id", "arrival_time"), spark.table(f"{db}.person"))
    return listing.orderBy("arrival_time", "node_id").select("email", "arrival_time")


def _start_node(spark: SparkSession, db: str, email: str) -> int | None:
    row = spark.table(f"{db}.person").filter(f"email = '{_quoted(email)}'").select("node_id").first()
    return row and row[0]


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def reach_sql_report(spark: SparkSession, db: str, email: str, start: str, hours: int) -> DataFrame:
    node = _start_node(spark, db, email)
    found = reach_recursive_sql(spark.table(f"{db}.edges"), -1 if node is None else node, start, hours)
    return named(found, spark.table(f"{db}.person")).orderBy("arrival_time", "node_id").select("email", "arrival_time")


def reach_hops_report(spark: SparkSession, db: str, email: str, start: str, hours: int, k: int = 50) -> DataFrame:
    node = _start_node(spark, db, email)
    found = reach_hop_bounded(spark.table(f"{db}.edges"), -1 if node is None else node, start, hours, k)
    return named(found, spark.table(f"{db}.person")).orderBy("arrival_time", "node_id").select("email", "arrival_time")


def path_report(spark: SparkSession, db: str, email: str, target_email: str, start: str, hours: int) -> DataFrame:
    """The nodes of one earliest-arrival path from one person to another."""
    edges, person = spark.table(f"{db}.edges"), spark.table(f"{db}.person")
    sources = sources_by_email(edges, person, email, start, hours)
    targets = person.filter(f"email = '{_quoted(target_email)}'").select("node_id")
    path = earliest_path(edges, sources, targets)
    return path.join(person.select("node_id", "email"), "node_id").orderBy("step").select(
        "step", "email", "edge_id", "arrival_time")


def find_path(spark: SparkSession, db: str, start: int, target: int, margin_s: int = 0, max_depth: int = 10) -> DataFrame:
    return two_hop_path_search(index_of(spark, db), start, target, margin_s, max_depth)


def degree_report(spark: SparkSession, db: str) -> DataFrame:
    return degree(spark.table(f"{db}.edges"))


def degree_stats_report(spark: SparkSession, db: str) -> DataFrame:
    return degree_stats(spark.table(f"{db}.edges"))
