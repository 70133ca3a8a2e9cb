"""Readers of trees, logs and lists, and writers with a fixed order. Everything stays a DataFrame; only rule files are read by the driver."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.charsets import decoded

_TSV = {"sep": "\t", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
HTML = r"(?i)\.(?:html?|cgi|shtml)$"


def tree(spark: SparkSession, root: str, pattern: str = HTML, skip: str = r"/(?:\.git|scripts)/") -> DataFrame:
    """(path, length, content) of the files below `root`; empty trees give no rows, and empty files are passed by, as by every reader of Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(re.sub("^file:/+", "/", root).rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "")
    return files.where(F.col("path").rlike(pattern) & ~F.col("path").rlike(skip)).select(rel.alias("path"), "length", "content")


def pages(spark: SparkSession, root: str, how: str = "chain") -> DataFrame:
    """(path, text, encoding) of the HTML files below `root`."""
    return tree(spark, root).select("path", decoded(F.col("content"), how).alias("d")).select("path", "d.text", "d.encoding")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, md5, length) of every file below `root`."""
    return tree(spark, root, pattern=".").select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), "length")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a given schema; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def capture_log(spark: SparkSession, path: str) -> DataFrame:
    """(urlkey, ts, original, mime, status, length) from white-space separated capture lines; short lines fall out, a bad length is 0."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.size(f) >= 6)
    name = ["urlkey", "original", "ts", "status", "mime"]
    return lines.select(*[f[i].alias(n) for i, n in enumerate(name)], F.coalesce(f[5].try_cast("long"), F.lit(0)).alias("length"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(url, path) of a tab-separated list; blank lines and lines that start with # fall out."""
    f = F.split("value", "\t", -1)
    return lines(spark, path).where(F.size(f) >= 2).select(F.trim(f[0]).alias("url"), F.trim(f[1]).alias("path"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a list; blank lines and lines that start with # fall out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[ \r]+$", "").alias("value")).where("trim(value) <> '' and not startswith(ltrim(value), '#')")


def rules(path: str, required: bool = False) -> dict:
    """A rule file in JSON, or in YAML where a parser is installed. Missing or empty: {}, but an error if required."""
    p = Path(path)
    if not p.exists() or not p.read_text("utf-8").strip():
        if required:
            raise FileNotFoundError(f"{path} is required and missing or empty")
        return {}
    raw = p.read_text("utf-8")
    if p.suffix == ".json":
        return json.loads(raw)
    import yaml

    return yaml.safe_load(raw) or {}


def rule_table(spark: SparkSession, held: dict[str, dict[str, str]]) -> DataFrame:
    """(key, field, value, expect) of nested rules key -> {field: value}, with an optional "expect" map."""
    rows = [(k, f, v, r.get("expect", {}).get(f)) for k, r in held.items() if not k.startswith("_") for f, v in r.get("set", r).items() if f not in ("expect", "note")]
    return spark.createDataFrame(rows, "key string, field string, value string, expect string")


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order of rows and columns; ranges of the order keep the files sorted and parallel."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Distinct rows, sorted, tab-separated."""
    d = df.distinct()
    d.orderBy(*d.columns).write.mode("overwrite").options(**_TSV).csv(path)


def tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a tab-separated table, blanks kept."""
    return spark.read.schema(schema).options(**_TSV).csv(path)


def replace_scope(df: DataFrame, path: str, scope: str) -> None:
    """Writes the partitions of the scopes that `df` holds and leaves the others, so a run can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def tombstoned(records: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """Records without the denied keys."""
    return records.join(denied.select(key).distinct(), key, "left_anti")


def type_agrees(path: Column, content: Column) -> Column:
    """Whether the first bytes fit the suffix: images by their marks, pages by a < near the start, all else true."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 200))
    return (
        F.when(ext == "gif", head.startswith("47494638"))
        .when(ext.isin("jpg", "jpeg"), head.startswith("FFD8"))
        .when(ext == "png", head.startswith("89504E47"))
        .when(ext.isin("htm", "html"), head.rlike("^(?:..)*3C"))
        .otherwise(F.lit(True))
    )


def error_stub(path: Column, content: Column, marks: list[str], most: int = 1200) -> Column:
    """Whether a small page holds one of the marks of an error page."""
    text = F.lower(content.cast("string"))
    hit = F.lit(False)
    for m in marks:
        hit = hit | text.contains(m.lower())
    return (F.length(content) <= most) & path.rlike(HTML) & hit


def soft_404(page: Column, least: int = 4500, most: int = 7500, mark: str = "adsbygoogle") -> Column:
    """Whether a page is the error page that a host gives for missing ones with a good status: of its size and with its mark."""
    return (F.length(page) > least) & (F.length(page) < most) & page.contains(mark)


def write_report(df: DataFrame, path: str, indent: bool = True) -> None:
    """A JSON document of its own for each row, over several lines if indented, the columns in their order."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": str(indent).lower(), "ignoreNullFields": "false"})
    # one file a row: the reader takes a file for a document
    rows = df.select(text.alias("value"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_document"))
    rows.write.mode("overwrite").partitionBy("_document").text(path)


def write_rules(held: dict, path: str, note: str = "written by the last run") -> None:
    """A rule file with sorted keys; JSON has no comments, so its header is a key of its own."""
    p = Path(path)
    if p.suffix == ".json":
        p.write_text(json.dumps({"_note": {"note": note}, **held}, ensure_ascii=False, indent=2, sort_keys=True) + "\n", "utf-8")
        return
    import yaml

    p.write_text(f"# {note}\n" + yaml.safe_dump(held, allow_unicode=True, sort_keys=True), "utf-8")


def write_files(df: DataFrame, root: str, path: Column, content: Column) -> None:
    """A file for each row, by the tasks that hold the rows; a file is written aside and then renamed, so none is seen half."""

    def place(rows) -> None:
        import os
        import uuid
        from urllib.parse import urlparse

        base = urlparse(root).path
        for r in rows:
            at = os.path.join(base, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            aside = f"{at}.{uuid.uuid4().hex}"
            with open(aside, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(aside, at)

    df.select(path.alias("path"), content.alias("content")).where("path is not null and content is not null").foreachPartition(place)


def written(df: DataFrame, path: str, check: bool = False) -> DataFrame:
    """`df`, written as Parquet unless the run is one that only checks."""
    if not check:
        df.write.mode("overwrite").parquet(path)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def staged(files_: DataFrame, held: DataFrame, marks: list[str], least: int = 10) -> DataFrame:
    """`files_` (path, content) with the decision: too-small, stub (an error page), exists (in held(path), also as .html) or place."""
    h = held.select(F.col("path").alias("_h")).distinct()
    forms = files_.withColumn("_f", F.explode(F.array_distinct(F.array("path", F.when(F.col("path").rlike(r"\.[A-Za-z0-9]+$"), F.col("path")).otherwise(F.concat("path", F.lit(".html")))))))
    there = forms.join(h, F.col("_f") == F.col("_h")).select("path", F.lit(True).alias("_there")).distinct()
    decision = F.when(F.length("content") < least, "too-small").when(error_stub(F.col("path"), F.col("content"), marks), "stub").when(F.col("_there"), "exists").otherwise("place")
    return files_.join(there, "path", "left").withColumn("decision", decision).drop("_there")


def markdown_table(df: DataFrame, order: list[str], most: int = 10_000) -> list[str]:
    """The lines of a report table; a report of more than `most` rows is an error, as nobody reads it."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)]
