"""Template files to templates, and back. Templates are few and are read by the driver."""

from __future__ import annotations

from pathlib import PurePosixPath

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regexes import effective, java
from ..operators.match import Template

SCHEMA = "template_id string, path_parts array<string>, issuer string, keywords array<string>, fields map<string,string>"


def parse(path: tuple[str, ...], text: str) -> tuple[Template | None, str | None]:
    """The template of a file, or why it is none. Keywords and fields that are no texts are left out."""
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return None, f"not YAML: {e}"
    if not isinstance(found, dict):
        return None, "not an object"
    keywords = [k for k in found.get("keywords") or [] if isinstance(k, str)]
    fields = {k: v for k, v in (found.get("fields") or {}).items() if isinstance(k, str) and isinstance(v, str)} if isinstance(found.get("fields") or {}, dict) else {}
    try:
        for p in (*keywords, *map(effective, fields.values())):
            java(p)
    except ValueError as e:
        return None, str(e)
    issuer = found.get("issuer")
    return Template(issuer if isinstance(issuer, str) else None, tuple(keywords), fields, path, found.get("options") or {}), None


def read_templates(spark: SparkSession, *roots: str) -> tuple[list[Template], list[tuple[str, str]]]:
    """Templates of all *.yml and *.yaml files below the roots, each file once, in path order; and the files that
    hold none, with the reason."""
    good: dict[tuple[str, ...], Template] = {}
    bad: list[tuple[str, str]] = []
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yml,yaml}").load(root)
        name = PurePosixPath(root.rstrip("/")).name
        for path, text in files.select("path", F.decode("content", "UTF-8")).collect():
            rest = path.split(root.split("://")[-1].rstrip("/").lstrip("/"), 1)[-1].strip("/")
            parts = (name, *rest.split("/"))
            template, why = parse(parts, text)
            if template:
                good.setdefault(parts, template)
            else:
                bad.append((path, why or ""))
    return [good[k] for k in sorted(good)], sorted(bad)


def as_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    return spark.createDataFrame([(t.template_id, list(t.path), t.issuer, list(t.keywords), t.fields) for t in templates], SCHEMA)


def existing(spark: SparkSession, folder: str) -> list[str]:
    """The paths of the template files below a folder, relative to it; none if it isn't there."""
    root, fs = _filesystem(spark, folder)
    found = []
    if fs.exists(root):
        files, base = fs.listFiles(root, True), fs.getFileStatus(root).getPath().toUri()
        while files.hasNext():
            path = base.relativize(files.next().getPath().toUri()).getPath()
            if path.endswith((".yml", ".yaml")):
                found.append(path)
    return sorted(found)


def write_templates(made: DataFrame, folder: str) -> int:
    """Generated templates (path, content) as files below a folder, each under its own path; how many. A file that is
    there already is an error, not overwritten. Rows reach the driver one partition after the other: templates are few,
    and any file system that Spark knows will do."""
    spark = made.sparkSession
    root, fs = _filesystem(spark, folder)
    n = 0
    for path, content in made.select("path", "content").toLocalIterator():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, path), False)
        out.write(content.encode())
        out.close()
        n += 1
    return n


def _filesystem(spark: SparkSession, folder: str) -> tuple:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())
