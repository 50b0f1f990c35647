"""Writers: versioned tables with a pointer, bundles, partitioned vectors, sealed logs, metric files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.functions.arrays import packed, sealed
from vellum.sources.records import MANIFEST, bundle_findings, file_digests


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the session's file system, put in place by one rename over the old one.

    A reader, or a crash at any time, finds the old text or the new one.
    """
    hadoop, fs = _file_system(spark, path)
    parked, where = hadoop.Path(f"{path}.{uuid.uuid4().hex}"), hadoop.Path(path)
    out = fs.create(parked)
    out.write(bytearray(text.encode()))
    out.close()
    options = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(parked), fs.makeQualified(where), over)


def read_text_file(spark: SparkSession, path: str) -> str:
    """A small file through the session's file system."""
    hadoop, fs = _file_system(spark, path)
    stream = fs.open(hadoop.Path(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def file_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return fs.exists(hadoop.Path(path))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where there is no folder."""
    hadoop, fs = _file_system(spark, path)
    where = hadoop.Path(path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def publish_version(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes a new version folder below ``root`` and then turns the pointer file to it.

    Readers see the old version or the new one.  Returns the version's name.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{version}")
    write_text_file(spark, f"{root}/CURRENT", version)
    return version


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The table's current version, or the named one (time travel)."""
    name = version or spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0].strip()
    return spark.read.parquet(f"{root}/{name}")


def write_bundle(bundle: dict[str, DataFrame], path: str) -> DataFrame:
    """Checks a bundle and writes it: JSON lines per table, and a manifest of digests and sizes.

    Raises ValueError, and writes nothing, if the bundle has a finding.  Returns the manifest.
    """
    spark = bundle["documents"].sparkSession
    with_mark = {n: df if "_corrupt" in df.columns or n in ("glossary", "mappings") else df.withColumn("_corrupt", F.lit(None).cast("string")) for n, df in bundle.items()}
    problems = bundle_findings(with_mark).limit(5).collect()
    if problems:
        raise ValueError("; ".join(f"{p['check']} {p['id']}: {p['message']}" for p in problems))
    for name, df in bundle.items():
        if name in ("glossary", "mappings"):  # bounded lists, each one JSON array
            whole = F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"})
            df.agg(whole).coalesce(1).write.mode("overwrite").text(f"{path}/{name}.json")
        else:
            df.drop("_corrupt").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}.jsonl")
    manifest = file_digests(spark, path).filter("path like '%/part-%'")
    listed = manifest.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")
    rows = {r["file"]: r["sha256"] for r in listed.collect()}
    write_text_file(spark, f"{path}/manifest.json", json.dumps(rows, sort_keys=True))
    return listed


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``(model, embedding_text_sha256, vector)`` as base64 lines, a folder per model, sorted by digest.

    Raises ValueError on repeated keys or different widths within a model.
    """
    sizes = vectors.groupBy("model").agg(
        F.count_distinct(F.size("vector")).alias("widths"),
        F.count("*").alias("n"), F.count_distinct("embedding_text_sha256").alias("keys"),
    )
    bad = sizes.filter("widths > 1 or n <> keys").select("model").limit(5).collect()
    if bad:
        raise ValueError("repeated keys or several widths: " + ", ".join(r["model"] for r in bad))
    rows = vectors.select(
        "model", "embedding_text_sha256", F.size("vector").alias("dims"),
        F.translate(F.base64(packed("vector")), "\r\n", "").alias("vector"),
    )
    spread = rows.repartitionByRange("model", "embedding_text_sha256")
    spread.sortWithinPartitions("model", "embedding_text_sha256").write.mode("overwrite").partitionBy("model").json(path)


def append_sealed(df: DataFrame, path: str) -> None:
    """Appends records as JSON lines, each with the digest of its content."""
    out = df.withColumn("sha256", sealed(F.struct(*df.columns)))
    out.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_candidates(hits: DataFrame, path: str, compression: str = "none") -> None:
    """One line per query with its candidates in rank order, and a manifest of how many lines and candidates there are.

    Hashes are made after the shuffle; lines and candidates are counted as they are written.
    """
    item = F.struct("retrieval_rank", "chunk_id", "retrieval_score", "document_text", "section_id", "chunk_index")
    rows = hits.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    hashed = F.transform("candidates", lambda c: c.withField("document_hash", F.sha2(c["document_text"], 256)))
    rows = rows.withColumns({"candidates": hashed, "query_hash": F.sha2(F.trim("query"), 256)})
    counts = Observation()
    pairs = F.coalesce(F.sum(F.size("candidates")), F.lit(0))
    seen = rows.observe(counts, F.count("*").alias("record_count"), pairs.alias("pair_count"))
    seen.write.mode("overwrite").option("compression", compression).json(path)
    write_text_file(hits.sparkSession, f"{path}/{MANIFEST}", json.dumps(counts.get))


def metrics_report(breakdown: DataFrame, columns: list[str]) -> str:
    """A markdown table of a metric breakdown, which has a row per group."""
    names = ["dimension", "value", "queries", *columns]
    rows = breakdown.select(*names).orderBy("dimension", "value").collect()
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    for r in rows:
        cells = [f"{x:.4f}" if isinstance(x, float) else str(x) for x in r]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"


def publish_metrics(scored: DataFrame, breakdown: DataFrame, columns: list[str], path: str) -> None:
    """Per-query metrics as JSON lines and the report beside them."""
    scored.write.mode("overwrite").json(f"{path}/queries")
    write_text_file(scored.sparkSession, f"{path}/report.md", metrics_report(breakdown, columns))
