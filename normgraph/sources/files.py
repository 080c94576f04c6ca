"""Scans and sinks of the pipeline's files. Schemas are explicit; order is carried by `seq`, from file name and line."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import shared_dir, sized
from ..schemas import CHUNKS, CURATED, DECISIONS, EXTRACTED


def overlay(defaults: dict, path: str, section: str | None = None) -> dict:
    """defaults overlaid by a YAML file, or a section of it; the defaults alone if there is no such file."""
    if not os.path.isfile(path):
        return dict(defaults)
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    return {**defaults, **((found.get(section) or {}) if section else found)}


def load_scope(path: str) -> dict[str, set[str]]:
    """Numbers in scope of articles and annexes; an empty set stands for all."""
    found = overlay({}, path)
    found = found.get("scope", found)
    return {k: {str(x) for x in found.get(k) or ()} for k in ("articles", "annexes")}


def needs_download(now: Column | None = None, hours: int = 24) -> Column:
    """Whether a snapshot (columns html, retrieved_at) is missing, empty, of unreadable time, or older than so many hours now."""
    at = F.try_to_timestamp(F.col("retrieved_at"))
    now = F.current_timestamp() if now is None else now
    return at.isNull() | F.col("html").isNull() | (F.col("html") == "") | (now - at > F.make_dt_interval(hours=F.lit(hours)))


def download(url: str, timeout: int = 60) -> str:
    """The page at the URL as text. A bot challenge, or an answer that is only accepted, is an error and no page."""
    from urllib.request import Request, urlopen

    asked = Request(url, headers={"Accept": "application/xhtml+xml, text/html;q=0.9", "Accept-Language": "eng"})  # fixed values
    with urlopen(asked, timeout=timeout) as answer:  # other status codes raise
        if answer.status == 202 or answer.headers.get("x-amzn-waf-action"):
            raise RuntimeError(f"{url} gave a bot challenge and not the document")
        return answer.read().decode("utf-8", "replace")


def ingest(spark: SparkSession, url: str, folder: str, now: str, hours: int = 24) -> DataFrame:
    """The snapshot in the folder, downloaded first if there is none or needs_download() says so. now: ISO time that a new one carries."""
    if not os.path.isfile(f"{folder}/page.html") or read_snapshot(spark, folder).where(needs_download(None, hours)).limit(1).count():
        save_snapshot(download(url), url, folder, now)
    return read_snapshot(spark, folder)


def save_snapshot(html: str, url: str, folder: str, retrieved_at: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, text in (("page.html", html), ("last_ingest.txt", retrieved_at), ("source_url.txt", url)):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """One row: url, html, retrieved_at, sha256; null what is in an empty file."""
    whole = lambda name, to: spark.read.text(f"{folder}/{name}", wholetext=True).agg(F.first("value").alias(to))
    return whole("source_url.txt", "url").crossJoin(whole("page.html", "html")).crossJoin(
        whole("last_ingest.txt", "retrieved_at")
    ).withColumn("sha256", F.sha2("html", 256))


def _name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document a file; `file` is its name."""
    out = spark.read.schema(CHUNKS).option("multiLine", True).json(folder)
    return out.select("*", _name().alias("file"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def numbered_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """value, place: lines that are not blank, by file name and line. Files are numbered by their names and lines within each file, so nothing is
    sorted in one task but the names."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    lines = lines.select(
        "value",
        _name().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).where(F.trim("value") != "")
    names = lines.select("file").distinct().withColumn("nth", F.row_number().over(Window.orderBy("file")))
    # a large file is read in blocks, which partitions take in any order; ids rise within a block
    inside = F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))
    return lines.withColumn("line", inside).join(sized(names), "file").select(
        "value",
        (F.col("nth").cast("long") * (1 << 32) + F.col("line")).alias("place"),
    )


def read_records(spark: SparkSession, folder: str, schema: str = EXTRACTED, pattern: str = "*.jsonl") -> DataFrame:
    """JSON lines with `seq` by file name and line. Blank lines are skipped."""
    return numbered_lines(spark, folder, pattern).select(F.col("place").alias("seq"), F.from_json("value", schema).alias("r")).select("r.*", "seq")


def read_decisions(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The decision log, empty if there is none. If any line has no seq of its own, all are numbered by file name and line."""
    if not exists(spark, path):
        return spark.createDataFrame([], DECISIONS)
    lines = numbered_lines(spark, path, pattern).select("place", F.from_json("value", DECISIONS).alias("r"))
    bare = lines.where("r.seq IS NULL").limit(1).count()
    columns = [x for x in lines.schema["r"].dataType.names if x != "seq"]
    return lines.select((F.col("place") if bare else F.col("r.seq")).alias("seq"), *(f"r.{c}" for c in columns))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of curated entities, with their order; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(CURATED).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())


def read_report_tsv(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """metric, value: the first two columns of a tab-separated report with a header; of the wanted metrics, if they are named."""
    found = spark.read.option("sep", "\t").option("header", True).csv(path)
    a, b = found.columns[:2]
    out = found.select(F.col(a).alias("metric"), F.col(b).alias("value"))
    return out if wanted is None else out.where(F.col("metric").isin(wanted))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder, in the shared one, that the driver writes plain files to (configuration, small graphs, bundles)."""
    at = shared_dir(spark)
    if "://" in at and not at.startswith("file://"):
        raise RuntimeError(f"the driver cannot open files in {at}")
    at = f"{at.removeprefix('file://')}/normgraph-{uuid.uuid4().hex[:12]}-{name}"
    os.makedirs(at)
    return at


def chunk_file(kind: Column, number: Column) -> Column:
    """art_005.json, art_1005.json, annex_III.json."""
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)  # lpad() cuts what is longer
    return F.when(
        kind == "article",
        F.concat(F.lit("art_"), padded, F.lit(".json")),
    ).otherwise(F.concat(F.lit("annex_"), number, F.lit(".json")))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """A JSON document for each chunk, named by chunk_file(); the driver writes them one by one."""
    os.makedirs(folder, exist_ok=True)
    named = chunks.select(
        chunk_file(F.col("type"), F.coalesce("article_number", "annex_number")).alias("name"),
        F.to_json(F.struct("*")).alias("doc"),
    )
    for row in named.toLocalIterator():
        with open(f"{folder}/{row['name']}", "w", encoding="utf-8") as f:
            f.write(row["doc"])


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """The one row of df as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(df.limit(1).toJSON().first()), f, indent=2, ensure_ascii=False)


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache, "cache_key")


_SKIPPED = r"(^|/)(__pycache__|\.cache|\.git|\.work)(/|$)|\.(pyc|aux|log|out|toc)$|(^|/)(\.gitkeep|\.DS_Store)$"


def wanted(path: Column, length: Column) -> Column:
    """Files that a bundle takes: no caches, build files, place holders or empty files."""
    return ~path.rlike(_SKIPPED) & (length > 0)


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), length of all files below it, from Spark's listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    inside = re.escape(re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/")
    return files.select(F.regexp_extract("path", f"{inside}(.*)$", 1).alias("path"), "length")


def size_text(total: Column) -> Column:
    """Ties go to even, as bundle() prints them; format_string() alone would round them up."""
    return F.when(total >= 1 << 20, F.format_string("%.1f MB", F.bround(total / (1 << 20), 1))).otherwise(
        F.format_string("%.0f KB", F.bround(total / 1024, 0))
    )


def manifest(files: DataFrame) -> DataFrame:
    """grp, n_files, size of the groups of files (grp, path, length) that are taken."""
    return files.where(wanted(F.col("path"), F.col("length"))).groupBy("grp").agg(
        F.count("*").alias("n_files"),
        size_text(F.sum("length")).alias("size"),
    )


def bundle(spark: SparkSession, folder: str, out: str, groups: dict[str, list[str]], zipped: bool = False) -> list[str]:
    """Copies the wanted files of each group's paths to out, with MANIFEST.md; zipped adds out.zip. Returns the files copied."""
    copied, lines = [], ["# Contents", ""]
    os.makedirs(out, exist_ok=True)
    here = folder.removeprefix("file://")
    for group, paths in groups.items():
        found = [
            r["path"] for r in file_tree(spark, folder).where(wanted(F.col("path"), F.col("length"))).toLocalIterator() if any(
                r["path"] == p or r["path"].startswith(p.rstrip("/") + "/") for p in paths
            )
        ]
        for p in found:
            os.makedirs(os.path.dirname(f"{out}/{p}") or out, exist_ok=True)
            shutil.copy2(f"{here}/{p}", f"{out}/{p}")
        if found:
            size = sum(os.path.getsize(f"{out}/{p}") for p in found)
            lines += [f"## {group}", "", f"{len(found)} files, " + (f"{size / (1 << 20):.1f} MB" if size >= 1 << 20 else f"{size / 1024:.0f} KB"), ""]
        copied += found
    with open(f"{out}/MANIFEST.md", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    if zipped:
        with zipfile.ZipFile(f"{out.rstrip('/')}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in [*copied, "MANIFEST.md"]:
                z.write(f"{out}/{p}", p)
    return copied
