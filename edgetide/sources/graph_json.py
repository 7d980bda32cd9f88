"""Graph files in JSON: one record per node or edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions.names import route
from edgetide.schema import EDGE_JSON, NODE_JSON

EDGE_FILES = "path_1_edges_static_props_0.json"
NODE_FILES = "path_1_person_static_props_0.json"


def _graph_file() -> Column:
    """The graph file a record comes from: a file, or a folder of part files with such a name."""
    return F.regexp_extract("_metadata.file_path", r"/([^/]+\.json)(?:/|$)", 1)


def _in_folder(spark: SparkSession, folder: str) -> Column:
    """Whether a file is a graph file of ``folder`` itself, or a part file of one; other sub-folders, such as a
    warehouse below it, do not count."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?", "")
    below = F.when(F.startswith(below, F.lit(base)), F.substr(below, F.lit(len(base) + 1)))
    return F.coalesce(below.rlike(r"^/[^/]+\.json(?:/[^/]+)?$"), F.lit(False))


def list_graph_files(spark: SparkSession, folder: str) -> DataFrame:
    """The graph files in ``folder`` and what each holds: (name, kind, map_key, partition, prop_type, element_key)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    names = files.load(folder).filter(_in_folder(spark, folder)).select(_graph_file().alias("name")).distinct()
    return names.select("name", *(column.alias(name) for name, column in route(F.col("name")).items()))


def load_graph_json(spark: SparkSession, folder: str, multiline: bool = True, prop_type: str = "static",
                    elements: list[str] | None = None) -> dict[str, DataFrame]:
    """{"nodes": ..., "edges": ...} from all files of a kind in one read with a fixed schema, equal rows once.

    Only files with this property type count and, where ``elements`` is given, with one of these element keys.

    ``multiline`` reads files that hold one JSON array; without it, one record per line as ``write_graph_json`` writes.
    The condition on the file's name is checked before the file is opened.
    """
    def load(schema, kind: str) -> DataFrame:
        reader = spark.read.schema(schema).option("multiLine", multiline).option("pathGlobFilter", "*.json")
        records = reader.option("recursiveFileLookup", True).json(folder)
        held = route(_graph_file())
        wanted = (held["kind"] == kind) & (held["prop_type"] == prop_type) & _in_folder(spark, folder)
        if elements is not None:
            wanted = wanted & held["element_key"].isin(elements)
        return records.filter(wanted).dropDuplicates()

    return {"nodes": load(NODE_JSON, "nodes"), "edges": load(EDGE_JSON, "edges")}


def node_records(person: DataFrame) -> DataFrame:
    return person.select(
        "node_id", F.array(F.lit("Person")).alias("labels"), F.struct("email").alias("static_props"),
        F.lit(True).alias("is_active"))


def edge_records(edges: DataFrame) -> DataFrame:
    return edges.select(
        "edge_id", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "edge_type",
        F.struct(F.col("sent_at_iso").alias("timestamp")).alias("static_props"))


def write_graph_json(person: DataFrame, edges: DataFrame, folder: str, max_records: int = 50_000) -> None:
    """One folder of JSON-lines files per kind, at most ``max_records`` records in a file."""
    for df, name in ((node_records(person), NODE_FILES), (edge_records(edges), EDGE_FILES)):
        df.write.mode("overwrite").option("maxRecordsPerFile", max_records).json(f"{folder}/{name}")
