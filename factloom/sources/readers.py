"""Sources and sinks: program files, archives, result payloads, directory pages, manifests, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan passes over; one list for every entry point.
EXCLUDED = "vendor node_modules tests test freemius .git bower_components".split()
#: Limits of an archive: entries, and bytes of all of them when unpacked.
MAX_ENTRIES, MAX_BYTES = 50_000, 512 * 1024 * 1024

LOCATION = "struct<path:string,line:int,snippet:string>"
CONTEXT = (
    "struct<access:string,required_capability:string,minimum_role:string,"
    "entrypoints:array<struct<kind:string,name:string,route:string,methods:string,access:string>>>"
)
PAYLOAD = (
    "summary struct<generated_at:string,elapsed_ms:bigint,total_results:int,total_errors:int,results_per_rule:map<string,int>>, "
    f"results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,"
    f"dataflow_trace:struct<source:{LOCATION},sink:{LOCATION},callable:string>,context:{CONTEXT},stored_write_context:{CONTEXT}>>>, "
    "errors array<string>"
)


def program_files(spark: SparkSession, folder: str, excluded: list[str] | None = None, glob: str = "*.php") -> DataFrame:
    """(root, path, source) of program files below ``folder``; the first folder below it names the program."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    base = folder.split("://")[-1].rstrip("/")
    local = F.regexp_extract("path", f"{base.replace('.', chr(92) + '.')}/(.*)$", 1)
    rows = raw.select(local.alias("p"), F.decode("content", "UTF-8").alias("source"))
    names = EXCLUDED if excluded is None else excluded
    if names:
        rows = rows.where(~F.col("p").rlike(r"(?:^|/)(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")/"))
    return rows.select(
        F.split("p", "/")[0].alias("root"), F.regexp_replace("p", r"^[^/]*/", "").alias("path"), "source"
    )


def archive_files(archives: DataFrame, suffix: str = ".php", max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(root, path, source, error) of ``archives`` (root, content): members of ZIP archives, read safely.

    Members that point outside of the archive are refused, as are archives
    beyond the limits or unreadable ones; each refusal is a row with ``error``.
    Nothing is written to disk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for root, content in zip(batch["root"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = z.infolist()
                        if len(members) > max_entries or sum(m.file_size for m in members) > max_bytes:
                            raise ValueError("archive exceeds its limits")
                        for m in members:
                            parts = m.filename.replace("\\", "/").split("/")
                            if m.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                                rows.append((root, m.filename, None, "member points outside"))
                            elif not m.is_dir() and m.filename.endswith(suffix):
                                rows.append((root, m.filename, z.read(m).decode("utf-8", "replace"), None))
                except Exception as ex:  # any damage of the archive concerns this archive only
                    rows.append((root, None, None, str(ex)[:300] or type(ex).__name__))
            yield pd.DataFrame(rows, columns=["root", "path", "source", "error"])

    return archives.select("root", "content").mapInPandas(run, "root string, path string, source string, error string")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Result payloads (one JSON document a file) with their file."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def payload_findings(payloads: DataFrame) -> DataFrame:
    """One row for each result of the payloads, in the shape of the findings table."""
    r = payloads.select("file", F.explode("results").alias("r")).select("file", "r.*")
    trace, context = F.col("extra.dataflow_trace"), F.col("extra.context")
    return r.select(
        "file",
        F.col("check_id").alias("rule_id"),
        F.col("extra.message").alias("message"),
        "path",
        F.col("start.line").alias("line"),
        context.getField("access").alias("access"),
        context.getField("required_capability").alias("required_capability"),
        context.getField("minimum_role").alias("minimum_role"),
        trace.getField("source").alias("source"),
        trace.getField("sink").alias("sink"),
        trace.getField("callable").alias("callable"),
        context.getField("entrypoints").alias("entrypoints"),
        F.col("extra.stored_write_context.access").alias("stored_access"),
    )


def directory_plugins(pages: DataFrame) -> DataFrame:
    """Plugins of directory pages (body: JSON text with ``plugins``), tolerant of scalars where none belong.

    Text fields take strings and numbers and read ``false`` and null as null;
    ``icons`` takes an object and reads anything else as an empty map.
    """
    listed = F.explode(F.from_json(F.get_json_object("body", "$.plugins"), "array<string>")).alias("p")
    p = pages.select(listed)

    def text(name: str):
        value = F.get_json_object("p", f"$.{name}")
        return F.when(~value.isin("false", "true", ""), value).alias(name)

    whole = [F.get_json_object("p", f"$.{n}").try_cast("bigint").alias(n) for n in ("rating", "num_ratings", "active_installs", "downloaded")]
    texts = [text(n) for n in ("slug", "name", "version", "author", "last_updated", "added", "short_description", "requires", "tested", "requires_php")]
    icons = F.get_json_object("p", "$.icons")
    as_map = F.when(F.startswith(icons, F.lit("{")), F.from_json(icons, "map<string,string>"))
    return p.select(*texts, *whole, F.coalesce(as_map, F.create_map().cast("map<string,string>")).alias("icons"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a manifest: a JSON document with ``cases``."""
    return spark.read.schema(f"cases array<struct<{schema}>>").json(path, multiLine=True).select(F.inline("cases"))


def write_findings(findings: DataFrame, path: str, files: int | None = None) -> None:
    """Findings as JSON lines in their total order within each file."""
    order = ["path", "line", "rule_id", "source.path", "source.line", "callable"]
    ranged = findings.repartitionByRange(files, *order) if files else findings.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").json(path)


def payload_summaries(findings: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, generated_at, elapsed_ms, total_results, total_errors, results_per_rule) of each run.

    ``runs``: key, generated_at, elapsed_ms, total_errors; a run without
    findings has none of them. Rules are counted before they are gathered, so
    a run's map is as long as its list of rules; null rules count in the total
    only.
    """
    counts = findings.groupBy(key, "rule_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.array_sort(F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", "n"))))
    per = counts.groupBy(key).agg(F.sum("n").alias("total_results"), F.map_from_entries(named).alias("results_per_rule"))
    none = F.create_map().cast("map<string,bigint>")
    return runs.join(per, key, "left").select(
        key, "generated_at", "elapsed_ms", F.coalesce("total_results", F.lit(0)).alias("total_results"),
        F.coalesce("total_errors", F.lit(0)).alias("total_errors"), F.coalesce("results_per_rule", none).alias("results_per_rule"),
    )


def job_markdown(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, markdown): a short report of each job. ``jobs``: id, title; ``counts``: id, name, n (a row for each name)."""
    row = F.concat(F.lit("| "), "name", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    rows = counts.where(F.col("name").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))).alias("rows"))
    lines = F.transform(F.coalesce("rows", F.array().cast("array<struct<name:string,row:string>>")), lambda r: r.getField("row"))
    head = F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.lit(""), F.lit("| Name | Count |"), F.lit("|---|---|"))
    return jobs.join(rows, "id", "left").select("id", F.array_join(F.concat(head, lines), "\n").alias("markdown"))
