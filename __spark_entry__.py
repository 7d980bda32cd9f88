"""Registered queries and the DuckDB statements they are compared with.

Graphs: ``EVENTS`` from the events table, ``TRADE`` from orders and lineitem (see ``edgetide.sources.tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions.mail_text import edge_id, header, header_block, unix_lines
from edgetide.functions.names import normalize_time, route
from edgetide.operators import degree as deg
from edgetide.operators import edges as edge_ops
from edgetide.operators import ingest, reach as rch
from edgetide.operators.messages import reach_hop_bounded
from edgetide.operators.paths import earliest_path
from edgetide.operators.recursive import reach_recursive_sql
from edgetide.operators.sweep import sweep
from edgetide.operators.two_hop import current_index, two_hop_index, two_hop_path_search, two_hop_update
from edgetide.plans.catalog import row_counts
from edgetide.scratch import Scratch
from edgetide.sources import tables as src
from edgetide.sources.mail import accepted, parse_mail
from edgetide.streaming.reach_stream import ReachStream

try:
    import corpus_pipeline
    from edgetide.llm import queries as llm
except ImportError:
    llm = None

# Both windows hold all edges of their graph; the trade graph has whole days only, so many equal times.
EVENT_SEED, EVENT_START, EVENT_HOURS = 3, "2024-01-01 00:00:00", 720
TRADE_SEED, TRADE_START, TRADE_HOURS = 1, "1995-01-01 00:00:00", 60_000
# The first quarter of 1998, for the queries that are about a window.
QUARTER_START, QUARTER_HOURS = "1998-01-01 00:00:00", 2160
TWO_LOADS_FROM = "1995-01-01"
HOPS = 3
TOP_K = 10
PATH_FROM, PATH_TO, PATH_MARGIN = 3, 14, 60
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return src.event_edges(src.read(spark, d, "events"))


def _trade(spark: SparkSession, d: str) -> DataFrame:
    return src.trade_edges(src.read(spark, d, "orders"), src.read(spark, d, "lineitem"))


def _persons(spark: SparkSession, d: str) -> DataFrame:
    return src.trade_persons(src.read(spark, d, "customer"), src.read(spark, d, "supplier"))


def _mail(spark: SparkSession, d: str) -> DataFrame:
    return src.order_mail(src.read(spark, d, "orders"), src.read(spark, d, "lineitem"))


def _event_reach(spark: SparkSession, d: str, **options) -> DataFrame:
    return rch.reach_one(_events(spark, d), EVENT_SEED, EVENT_START, EVENT_HOURS, **options)


def _trade_reach(spark: SparkSession, d: str, **options) -> DataFrame:
    return rch.reach_one(_trade(spark, d), TRADE_SEED, TRADE_START, TRADE_HOURS, **options)


# ---- reachability

def q_reach(spark, d):
    return _event_reach(spark, d)


def q_reach_ties(spark, d):
    return _trade_reach(spark, d)


def q_reach_strict(spark, d):
    return _trade_reach(spark, d, strict=True)


def q_reach_time_slices(spark, d):
    """The same as ``reach_ties``, in four time slices."""
    total = src.read(spark, d, "lineitem").count() * 2
    return _trade_reach(spark, d, slice_rows=-(-total // 4))


def _supplier_seeds(spark, d):
    """Every supplier, from its region's day on, over all of the trade graph."""
    return _suppliers(spark, d).select(
        "source_id", "node_id", _day(F.col("region") * 100).alias("start_time"), _day(F.lit(4000)).alias("window_end"))


def q_reach_batch(spark, d):
    """From every supplier at once: a row for each node that each reaches."""
    return sweep(_trade(spark, d), _supplier_seeds(spark, d)).arrivals()


def q_reach_batch_totals(spark, d):
    """From every supplier at once: how many nodes each reaches and when the last."""
    return sweep(_trade(spark, d), _supplier_seeds(spark, d)).totals()


def _day(number):
    return F.lit("1992-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(number.cast("int"))


def _suppliers(spark, d):
    nations = src.read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    return src.read(spark, d, "supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") * 2 + 1).alias("node_id"), "region")


def q_reach_windows(spark, d):
    """Three windows for each supplier, two of which overlap; a walk keeps to the window it starts in."""
    window = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("w")
    seeds = _suppliers(spark, d).select("source_id", "node_id", window).select(
        "source_id", "node_id", _day(1100 + F.col("w") * 200).alias("start_time"), _day(1400 + F.col("w") * 80).alias("window_end"))
    return sweep(_trade(spark, d), seeds).arrivals()


def q_reach_count(spark, d):
    return _event_reach(spark, d).agg(F.count(F.lit(1)).alias("reachable"))


def q_reach_named(spark, d):
    return rch.named(_trade_reach(spark, d), _persons(spark, d)).select("email", "arrival_time")


def q_reach_top_k(spark, d):
    return rch.earliest(_event_reach(spark, d), TOP_K)


def q_reach_millis(spark, d):
    return rch.with_millis(_event_reach(spark, d))


def q_reach_one_round(spark, d):
    """One relaxation round over the trade graph, from every supplier at the start of the window."""
    edges = edge_ops.edges_in_window(_trade(spark, d), TRADE_START, TRADE_HOURS)
    frontier = src.read(spark, d, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("node_id"), F.lit(TRADE_START).cast("timestamp_ntz").alias("arrival_time"))
    return rch.one_round(edges, frontier)


def q_reach_two_hop(spark, d):
    events = _events(spark, d)
    index = Scratch(spark).save(two_hop_index(events), "index")
    unified = edge_ops.unified_edges(events, index, EVENT_START, EVENT_HOURS)
    return rch.reach_one(unified, EVENT_SEED, EVENT_START, EVENT_HOURS)


def q_reach_hop_bounded(spark, d):
    return reach_hop_bounded(_events(spark, d), EVENT_SEED, EVENT_START, EVENT_HOURS, HOPS)


def q_reach_recursive_sql(spark, d):
    return reach_recursive_sql(_trade(spark, d), TRADE_SEED, TRADE_START, TRADE_HOURS)


def q_reach_stream(spark, d):
    events = spark.readStream.schema(src.read(spark, d, "events").schema).option(
        "pathGlobFilter", "events.parquet").parquet(d)
    job = ReachStream(spark, rch.single_source(_events(spark, d), EVENT_SEED, EVENT_START, EVENT_HOURS), late="60 days",
                      partitions=spark.sparkContext.defaultParallelism)
    job.start(src.event_edges(events)).awaitTermination()
    return job.arrivals().select("node_id", "arrival_time")


def q_reach_stream_weeks(spark, d):
    """The same as ``reach_stream``, with the events of each week as a file or more, in as many batches as weeks."""
    scratch = Scratch(spark)
    events = src.read(spark, d, "events")
    by_week = scratch.save(events.withColumn("week", F.weekofyear("ts")).hint("rebalance", "week"), "in", ["week"])
    weeks = by_week.select("week").distinct().count()
    stream = spark.readStream.schema(by_week.schema).option(
        "maxFilesPerTrigger", -(-len(by_week.inputFiles()) // weeks)).parquet(scratch.path("in"))
    job = ReachStream(spark, rch.single_source(_events(spark, d), EVENT_SEED, EVENT_START, EVENT_HOURS), late="60 days",
                      partitions=spark.sparkContext.defaultParallelism)
    job.start(src.event_edges(stream)).awaitTermination()
    return job.arrivals().select("node_id", "arrival_time")


def q_earliest_path(spark, d):
    events = _events(spark, d)
    sources = rch.single_source(events, EVENT_SEED, EVENT_START, EVENT_HOURS)
    return earliest_path(events, sources).drop("source_id")


def q_earliest_path_slices(spark, d):
    """The same as ``earliest_path``, in five time slices."""
    events = _events(spark, d)
    sources = rch.single_source(events, EVENT_SEED, EVENT_START, EVENT_HOURS)
    return earliest_path(events, sources, slice_rows=-(-events.count() // 5)).drop("source_id")


# ---- two-hop index

def q_two_hop_index(spark, d):
    return two_hop_index(_events(spark, d))


def q_two_hop_index_two_loads(spark, d):
    """The index of the events of even users, brought up to date with those of all others."""
    events = _events(spark, d)
    first, second = events.filter("src % 2 = 0"), events.filter("src % 2 = 1")
    index = Scratch(spark).save(two_hop_index(first), "index")
    return current_index(index.unionByName(two_hop_update(index, first, second)))


def q_unified_edges(spark, d):
    events = _events(spark, d)
    return edge_ops.unified_edges(events, two_hop_index(events), EVENT_START, EVENT_HOURS)


def q_two_hop_path_search(spark, d):
    index = Scratch(spark).save(two_hop_index(_events(spark, d)), "index")
    return two_hop_path_search(index, PATH_FROM, PATH_TO, PATH_MARGIN)


# ---- edges and degrees

def q_edges_in_window(spark, d):
    return edge_ops.edges_in_window(_trade(spark, d), QUARTER_START, QUARTER_HOURS).select("edge_id", "src", "dst", "sent_at")


def q_node_lookup(spark, d):
    return edge_ops.node_lookup(_persons(spark, d), src.read(spark, d, "supplier").select(F.col("s_name").alias("email")))


def q_vertices_in_window(spark, d):
    return edge_ops.vertices(edge_ops.edges_in_window(_trade(spark, d), QUARTER_START, QUARTER_HOURS))


def q_edges_chronological(spark, d):
    return edge_ops.chronological(_events(spark, d))


def q_adjacency_list(spark, d):
    listed = edge_ops.adjacency_list(_events(spark, d)).select(
        "src", F.col("period").alias("day"), F.size("neighbours").cast("long").alias("entries"),
        F.array_join(F.transform("neighbours", lambda n: F.concat(
            F.date_format(n["sent_at"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(">"), n["dst"].cast("string"))), ",")
        .alias("neighbours"))
    return listed


def q_out_degree(spark, d):
    return deg.out_degree(_trade(spark, d))


def q_in_degree(spark, d):
    return deg.in_degree(_trade(spark, d))


def q_degree(spark, d):
    return deg.degree(_trade(spark, d))


def q_degree_stats(spark, d):
    return deg.degree_stats(_trade(spark, d))


def q_batch_union_dedup(spark, d):
    """The order dates of all lines and those of all orders as two batches of one load."""
    orders, lines = src.read(spark, d, "orders"), src.read(spark, d, "lineitem")
    one = orders.select("o_custkey", "o_orderdate")
    two = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderdate")
    return edge_ops.combine_batches(one, two)


def q_table_row_counts(spark, d):
    return row_counts({t: src.read(spark, d, t) for t in TABLES})


# ---- ingest

def q_mail_headers(spark, d):
    return parse_mail(_mail(spark, d)).select(
        "path", "sender", "sent_at_iso", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at_utc"),
        F.size("to").cast("long").alias("n_to"), F.size("cc").cast("long").alias("n_cc"),
        F.size("bcc").cast("long").alias("n_bcc"), F.coalesce("reason", F.lit("")).alias("reason"))


def _recipients(spark, d):
    return ingest.mail_recipients(accepted(parse_mail(_mail(spark, d))))


def q_mail_recipients(spark, d):
    return _recipients(spark, d).select("sender", "recipient", "edge_type", "sent_at_iso")


def q_person_dim(spark, d):
    return ingest.person_dim(_recipients(spark, d))


def q_mail_edges(spark, d):
    scratch = Scratch(spark)
    recipients = scratch.save(_recipients(spark, d), "recipients")
    person = scratch.save(ingest.person_dim(recipients, scratch), "person")
    return ingest.mail_edges(recipients, person, scratch=scratch).select("edge_id", "src", "dst", "edge_type", "sent_at_iso")


def q_mail_two_loads(spark, d):
    """Mails before and from a day on as two loads: persons keep their ids, and the second load adds what is new."""
    scratch = Scratch(spark)
    recipients = scratch.save(_recipients(spark, d), "recipients")
    early = F.col("sent_at_iso") < TWO_LOADS_FROM
    person = scratch.save(ingest.person_dim(recipients.filter(early), scratch), "person-1")
    edges = scratch.save(ingest.mail_edges(recipients.filter(early), person, scratch=scratch), "edges-1")
    later = Scratch(spark)
    person = later.save(ingest.person_dim(recipients.filter(~early), later, person), "person-2")
    more = ingest.mail_edges(recipients.filter(~early), person, scratch=later)
    edges = edges.unionByName(more.join(edges.select("edge_id"), "edge_id", "left_anti"))
    sender, recipient = (person.select(F.col("node_id").alias(k), F.col("email").alias(v)) for k, v in (("src", "sender"), ("dst", "recipient")))
    return edges.join(sender, "src").join(recipient, "dst").select("sender", "recipient", "edge_type", "sent_at_iso")


def q_edge_hash(spark, d):
    iso = F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss")
    return _trade(spark, d).select(
        F.col("edge_id").alias("line"), edge_id(F.col("src"), F.col("dst"), iso, F.col("edge_type")).alias("edge_id"))


def q_person_flatten(spark, d):
    nodes = _persons(spark, d).select(
        "node_id", F.array(F.lit("Person")).alias("labels"), F.struct("email").alias("static_props"),
        F.lit(True).alias("is_active"))
    return ingest.person_flatten(nodes)


def q_edge_flatten(spark, d):
    """Edge records with ISO times; every user's error events carry an unreadable time, and some edges are self loops."""
    records = src.read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("edge_id"), F.col("user_id").alias("source_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("target_id"), F.col("event_type").alias("edge_type"),
        F.struct(F.when(F.col("event_type") == "error", F.lit("unreadable")).otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss-07:00")).alias("timestamp")).alias("static_props"))
    flat = ingest.edge_flatten(records)
    return flat.withColumn("sent_at", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"))


def q_route_file_names(spark, d):
    """One node or edge file name per order; even customers give node files."""
    name = F.concat(F.lit("path_1_"), F.when(F.col("o_custkey") % 2 == 0, F.lit("person")).otherwise(F.lit("edges")),
                    F.lit("_static_props_"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    named = src.read(spark, d, "orders").select(name.alias("file_name"))
    return named.select("file_name", *(column.alias(k) for k, column in route(F.col("file_name")).items()))


def q_normalize_time(spark, d):
    written = src.read(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"))
    return written.select("event_id", normalize_time(F.col("text")).alias("time_text"),
                          normalize_time(F.col("text")).cast("timestamp_ntz").alias("moment"))


def q_conversation_headers(spark, d):
    """Whole conversation texts as folded subjects, one line after the other, found again among the headers."""
    folded = F.replace(unix_lines(F.col("text")), F.lit("\n"), F.lit("\n "))
    content = F.concat(F.lit("From: "), F.col("role"), F.lit("@x.test\nSubject: "), folded, F.lit("\nTo: a@x.test\n\nDate: none\n"))
    block = header_block(unix_lines(content))
    return src.read(spark, d, "conversations").select(
        "conv_id", "turn", header(block, "From").alias("sender"), header(block, "To").alias("to_value"),
        header(block, "Subject").alias("subject"), header(block, "Date").isNull().alias("undated"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: earliest arrival at every node reachable within the window."""
    return queries()["reach"](spark, "/root/testdata/sf0.001")


def _in_utc(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The statements know no time zones, so the queries run in a session set to UTC."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)
    return run


def graph_queries() -> list[str]:
    return [name[2:] for name in globals() if name.startswith("q_")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: globals()[f"q_{name}"] for name in graph_queries()}
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return {name: _in_utc(f) for name, f in found.items()}


# ---- DuckDB statements

EVENTS = """select cast(event_id as varchar) as edge_id, user_id as src, cast(json_extract_string(props, '$.k') as bigint) as dst,
  event_type as edge_type, ts as sent_at
from events where user_id <> cast(json_extract_string(props, '$.k') as bigint)"""

TRADE = """select 'ORDER-' || l_orderkey || '-' || l_linenumber as edge_id, 2 * o_custkey as src, 2 * l_suppkey + 1 as dst,
  'ORDER' as edge_type, o_orderdate as sent_at
from orders join lineitem on l_orderkey = o_orderkey
union all
select 'SHIP-' || l_orderkey || '-' || l_linenumber, 2 * l_suppkey + 1, 2 * o_custkey, 'SHIP', l_shipdate
from orders join lineitem on l_orderkey = o_orderkey"""

PERSONS = """select 2 * c_custkey as node_id, c_name as email from customer
union all select 2 * s_suppkey + 1, s_name from supplier"""

INDEX = """select e1.src as n1, e1.sent_at as t1, e1.dst as n2, min(e2.sent_at) as t2, e2.dst as n3
from edges e1 join edges e2 on e1.dst = e2.src and e1.sent_at < e2.sent_at
group by e1.src, e1.sent_at, e1.dst, e2.dst"""


def _window(start: str, hours: int) -> str:
    return f"e.sent_at between timestamp '{start}' and timestamp '{start}' + interval {hours} hour"


def _walk(graph: str, seed: int, start: str, hours: int, later: str = ">=") -> str:
    return f"""with recursive edges as ({graph}),
walk(node_id, arrival_time) as (
  select {seed}::bigint, timestamp '{start}'
  union
  select e.dst, e.sent_at from walk r join edges e
    on e.src = r.node_id and e.sent_at {later} r.arrival_time and {_window(start, hours)}),
arrivals as (select node_id, min(arrival_time) as arrival_time from walk group by node_id)
"""


def _hop_walk(graph: str, seed: int, start: str, hours: int, hops: int) -> str:
    return f"""with recursive edges as ({graph}),
walk(node_id, arrival_time, hop) as (
  select {seed}::bigint, timestamp '{start}', 0
  union
  select e.dst, e.sent_at, r.hop + 1 from walk r join edges e
    on e.src = r.node_id and e.sent_at >= r.arrival_time and {_window(start, hours)}
  where r.hop < {hops}),
arrivals as (select node_id, min(arrival_time) as arrival_time from walk group by node_id)
"""


EVENT_WALK = _walk(EVENTS, EVENT_SEED, EVENT_START, EVENT_HOURS)
TRADE_WALK = _walk(TRADE, TRADE_SEED, TRADE_START, TRADE_HOURS)

# A node's predecessor is the sender of the edge by which its final arrival was found first, counted in edges from the
# start; among several the least node, then the least edge id. ``best`` is the earliest arrival over at most hop edges.
PATH = """with recursive edges as (%s),
walk(node_id, arrival_time, hop) as (
  select %d::bigint, timestamp '%s', 0
  union
  select node_id, min(arrival_time), any_value(hop) from (
    select e.dst as node_id, e.sent_at as arrival_time, r.hop + 1 as hop from walk r join edges e
      on e.src = r.node_id and e.sent_at >= r.arrival_time and %s
    where r.hop < 40) group by node_id),
arrivals as (select node_id, min(arrival_time) as arrival_time from walk group by node_id),
found as (select w.node_id, w.arrival_time, min(w.hop) as hop from walk w join arrivals a
  on w.node_id = a.node_id and w.arrival_time = a.arrival_time group by w.node_id, w.arrival_time),
sender as (select node_id, arrival_time, hop, src, edge_id from (
  select f.node_id, f.arrival_time, f.hop, e.src, e.edge_id,
    row_number() over (partition by f.node_id order by e.src, e.edge_id) as pick
  from found f join edges e on e.dst = f.node_id and e.sent_at = f.arrival_time
    join (select distinct node_id, arrival_time, hop from walk) w
      on w.node_id = e.src and w.hop = f.hop - 1 and w.arrival_time <= e.sent_at
  where f.hop > 0) where pick = 1
  union all select node_id, arrival_time, hop, null, null from found where hop = 0),
back(target, node_id, src, edge_id, arrival_time, back) as (
  select node_id, node_id, src, edge_id, arrival_time, 0 from sender
  union all
  select b.target, s.node_id, s.src, s.edge_id, s.arrival_time, b.back + 1 from back b join sender s on s.node_id = b.src)
select target, cast(max(back) over (partition by target) - back as integer) as step, node_id, edge_id, arrival_time from back
""" % (EVENTS, EVENT_SEED, EVENT_START, _window(EVENT_START, EVENT_HOURS))

SUPPLIERS = "suppliers as (select n_regionkey as region, s_suppkey as source_id from supplier join nation on n_nationkey = s_nationkey)"


def _seeded_walk(start: str, end: str, windows: str) -> str:
    """Each seed row is walked on its own and keeps the least arrival of each node; then the least of a source counts."""
    return f"""with recursive edges as ({TRADE}),
{SUPPLIERS},
sources as (select source_id, w, 2 * source_id + 1 as node_id, timestamp '1992-01-01' + to_days(cast({start} as int)) as start_time,
  timestamp '1992-01-01' + to_days(cast({end} as int)) as window_end from suppliers, {windows}),
walk(source_id, w, node_id, arrival_time, window_end) using key (source_id, w, node_id) as (
  select source_id, w, node_id, start_time, window_end from sources
  union
  select r.source_id, r.w, e.dst, min(e.sent_at), any_value(r.window_end) from walk r join edges e
    on e.src = r.node_id and e.sent_at >= r.arrival_time and e.sent_at <= r.window_end
    left join recurring.walk k on k.source_id = r.source_id and k.w = r.w and k.node_id = e.dst
  where k.arrival_time is null or e.sent_at < k.arrival_time
  group by r.source_id, r.w, e.dst)
select source_id, node_id, min(arrival_time) as arrival_time from walk group by source_id, node_id"""


# The rendered mail of an order: its boxes by return flag.
MAIL = """select o_orderkey, 'customer' || o_custkey || '@x.test' as sender,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S-07:00') as sent_at_iso, o_orderdate,
  count(*) filter (l_returnflag = 'R') as n_to, count(*) filter (l_returnflag = 'A') as n_cc,
  count(*) filter (l_returnflag = 'N') as n_bcc
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderdate"""

RECIPIENTS = f"""mail as ({MAIL}),
recipients as (select distinct sender, 'supplier' || l_suppkey || '@x.test' as recipient,
    case l_returnflag when 'R' then 'TO' when 'A' then 'CC' else 'BCC' end as edge_type, sent_at_iso
  from mail join lineitem on l_orderkey = o_orderkey where n_to > 0),
person as (select row_number() over (order by email) as node_id, email
  from (select sender as email from recipients union select recipient from recipients))"""


def oracle_sql() -> dict[str, str]:
    return graph_sql() | (llm.oracle_sql() if llm else {})


def graph_sql() -> dict[str, str]:
    events, trade = f"with edges as ({EVENTS})", f"with edges as ({TRADE})"
    trade_window = _window(QUARTER_START, QUARTER_HOURS)
    hashed = "sha256('{\"dst\": ' || dst || ', \"src\": ' || src || ', \"timestamp\": \"' || %s || '\", \"type\": \"' || edge_type || '\"}')"
    arrivals = "select node_id, arrival_time from arrivals"
    return {
        "reach": EVENT_WALK + arrivals,
        "reach_ties": TRADE_WALK + arrivals,
        "reach_strict": _walk(TRADE, TRADE_SEED, TRADE_START, TRADE_HOURS, ">") + arrivals,
        "reach_time_slices": TRADE_WALK + arrivals,
        "reach_batch": _seeded_walk("region * 100", "4000", "(values (0)) x(w)"),
        "reach_batch_totals": f"""select source_id, count(*) as reached, max(arrival_time) as last_arrival
from ({_seeded_walk("region * 100", "4000", "(values (0)) x(w)")}) group by source_id""",
        "reach_windows": _seeded_walk("1100 + w * 200", "1400 + w * 80", "(values (0), (1), (2)) x(w)"),
        "reach_count": EVENT_WALK + "select count(*) as reachable from arrivals",
        "reach_named": TRADE_WALK + f"select email, arrival_time from arrivals join ({PERSONS}) using (node_id)",
        "reach_top_k": EVENT_WALK + f"select node_id, arrival_time from arrivals order by arrival_time, node_id limit {TOP_K}",
        "reach_millis": EVENT_WALK + """select node_id, epoch_us(arrival_time) // 1000 as arrival_millis,
  date_trunc('milliseconds', arrival_time) as arrival_time from arrivals""",
        "reach_one_round": f"""{trade} select e.dst as node_id, min(e.sent_at) as candidate_time
from edges e join supplier on e.src = 2 * s_suppkey + 1 where {_window(TRADE_START, TRADE_HOURS)} group by e.dst""",
        "reach_two_hop": EVENT_WALK + arrivals,
        "reach_hop_bounded": _hop_walk(EVENTS, EVENT_SEED, EVENT_START, EVENT_HOURS, HOPS) + arrivals,
        "reach_recursive_sql": TRADE_WALK + arrivals,
        "reach_stream": EVENT_WALK + arrivals,
        "reach_stream_weeks": EVENT_WALK + arrivals,
        "earliest_path": PATH,
        "earliest_path_slices": PATH,
        "two_hop_index": f"{events} {INDEX}",
        "two_hop_index_two_loads": f"{events} {INDEX}",
        "unified_edges": f"""{events} select e.src, e.sent_at as start_time, e.sent_at as end_time, e.dst
from edges e where {_window(EVENT_START, EVENT_HOURS)}
union all select n1, t1, t2, n3 from ({INDEX})
where t1 >= timestamp '{EVENT_START}' and t2 <= timestamp '{EVENT_START}' + interval {EVENT_HOURS} hour""",
        "two_hop_path_search": f"""with recursive edges as ({EVENTS}), two_hop as ({INDEX}),
level as (
  select n1, t1, n2, t2, n3, 0 as depth from two_hop where n1 = {PATH_FROM}
  union
  select t.n1, t.t1, t.n2, t.t2, t.n3, depth + 1
  from (select n3, min(t2) as t2, any_value(depth) as depth from level
        where not exists (select 1 from level where n2 = {PATH_TO} or n3 = {PATH_TO}) group by n3) n
    join two_hop t on t.n1 = n.n3 and n.t2 + interval {PATH_MARGIN} second < t.t1
  where depth < 10)
select n1, t1, n2, t2, n3 from level where n2 = {PATH_TO} or n3 = {PATH_TO}""",
        "edges_in_window": f"{trade} select e.edge_id, e.src, e.dst, e.sent_at from edges e where {trade_window}",
        "node_lookup": f"select s_name as email, node_id from supplier join ({PERSONS}) on email = s_name",
        "vertices_in_window": f"""{trade} select e.src as node_id from edges e where {trade_window}
union select e.dst from edges e where {trade_window}""",
        "edges_chronological": f"{events} select edge_id, src, dst, edge_type, sent_at from edges order by sent_at, edge_id",
        "adjacency_list": f"""{events} select src, date_trunc('day', sent_at)::timestamp as day, count(*) as entries,
  string_agg(strftime(sent_at, '%Y-%m-%d %H:%M:%S.%f') || '>' || dst, ',' order by sent_at, dst) as neighbours
from edges group by src, date_trunc('day', sent_at)""",
        "out_degree": f"{trade} select src as node_id, count(*) as out_degree from edges group by src",
        "in_degree": f"{trade} select dst as node_id, count(*) as in_degree from edges group by dst",
        "degree": f"""{trade} select node_id, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree,
  coalesce(out_degree, 0) + coalesce(in_degree, 0) as total_degree
from (select src as node_id, count(*) as out_degree from edges group by src)
  full join (select dst as node_id, count(*) as in_degree from edges group by dst) using (node_id)""",
        "degree_stats": f"""{trade} select avg(total_degree) as avg_degree, max(total_degree) as max_degree from (
  select node_id, count(*) as total_degree from (select src as node_id from edges union all select dst from edges)
  group by node_id)""",
        "batch_union_dedup": """select o_custkey, o_orderdate from orders
union select o_custkey, o_orderdate from lineitem join orders on l_orderkey = o_orderkey""",
        "table_row_counts": "\nunion all\n".join(
            f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES),
        "mail_headers": f"""select 'maildir/' || o_orderkey || '.' as path, sender, sent_at_iso,
  strftime(o_orderdate + interval 7 hour, '%Y-%m-%d %H:%M:%S') as sent_at_utc, n_to, n_cc, n_bcc,
  case when n_to = 0 then 'no To' else '' end as reason
from ({MAIL})""",
        "mail_recipients": f"with {RECIPIENTS} select sender, recipient, edge_type, sent_at_iso from recipients",
        "person_dim": f"with {RECIPIENTS} select node_id, email from person",
        "mail_edges": f"""with {RECIPIENTS}, edges as (
  select s.node_id as src, r.node_id as dst, edge_type, sent_at_iso from recipients
    join person s on s.email = sender join person r on r.email = recipient where sender <> recipient)
select {hashed % 'sent_at_iso'} as edge_id, src, dst, edge_type, sent_at_iso from edges""",
        "mail_two_loads": f"with {RECIPIENTS} select sender, recipient, edge_type, sent_at_iso from recipients where sender <> recipient",
        "edge_hash": f"""{trade} select edge_id as line, {hashed % "strftime(sent_at, '%Y-%m-%dT%H:%M:%S')"} as edge_id
from edges""",
        "person_flatten": PERSONS,
        "edge_flatten": f"""{events} select edge_id, src, dst, edge_type,
  case when edge_type = 'error' then null else strftime(sent_at + interval 7 hour, '%Y-%m-%d %H:%M:%S') end as sent_at
from edges""",
        "route_file_names": """select 'path_1_' || kind_word || '_static_props_' || o_orderkey || '.json' as file_name,
  case kind_word when 'person' then 'nodes' else 'edges' end as kind, 'path_1_' || o_orderkey as map_key,
  cast(o_orderkey as varchar) as partition, 'static' as prop_type, kind_word || '_static_props' as element_key
from (select o_orderkey, case when o_custkey % 2 = 0 then 'person' else 'edges' end as kind_word from orders)""",
        "normalize_time": """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time_text,
  date_trunc('second', ts) as moment from events""",
        "conversation_headers": r"""select conv_id, turn, role || '@x.test' as sender, 'a@x.test' as to_value,
  ltrim(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10), chr(10) || ' '), ' ' || chr(9)) as subject, true as undated
from conversations""",
    }
