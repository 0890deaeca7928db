"""A folder of knowledge, listed and read by executors: links not followed, ignore rules by folder, every skip counted.

Folders are listed a level at a time, each by the task that holds it, and a
folder carries the rules of those above it. It needs a file system that all
executors see under one path; other stores go through routing.walk.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.sources import loaders as ld
from stancelake.sources.routing import IMAGE_EXTENSIONS, export_kind, ignore_pattern
from stancelake.tables import settle

LISTED = "kind string, path string, relative string, rules string, reason string, extension string, size long, modified timestamp"
READ = "path string, extension string, modified timestamp, content binary, problem string"
#: Bytes of files after which a task hands them on.
HELD = 1 << 24
Rules = list[tuple[str, str]]


def _ignored(rules: Rules, relative: str) -> bool:
    """rules: (folder, pattern); a folder's rules see paths from it on."""
    return any(relative.startswith(base) and re.search(pattern, relative[len(base) :]) for base, pattern in rules)


def _ending(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def entries(folder: str, relative: str, rules: Rules, images: bool, ignore_file: str) -> Iterator[tuple]:
    """What is in a folder, as rows of LISTED: dir, file or skip with its reason."""
    base = f"{relative}/" if relative else ""

    def skip(path: str, reason: str) -> tuple:
        return "skip", path, "", "", reason, "", None, None

    try:
        with open(os.path.join(folder, ignore_file), encoding="utf-8", errors="replace") as f:
            rules = rules + [(base, p) for p in map(ignore_pattern, f.read().splitlines()) if p]
    except OSError:  # there is none, or it can't be read
        pass
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except FileNotFoundError:
        yield skip(folder, "vanished")
        return
    except PermissionError:
        yield skip(folder, "permission")
        return
    for e in found:
        own = base + e.name
        try:
            if e.is_symlink():
                yield skip(e.path, "link")
            elif e.is_dir():
                if e.name.startswith("."):
                    yield skip(e.path, "hidden")
                elif _ignored(rules, own + "/"):
                    yield skip(e.path, "ignored")
                else:
                    yield "dir", e.path, own, json.dumps(rules), "", "", None, None
            elif e.name == ignore_file:
                continue
            elif _ignored(rules, own):
                yield skip(e.path, "ignored")
            elif not images and _ending(e.name) in IMAGE_EXTENSIONS:
                yield skip(e.path, "image")
            else:
                at = e.stat()
                yield "file", e.path, own, "", "", _ending(e.name), at.st_size, datetime.fromtimestamp(int(at.st_mtime), timezone.utc)
        except FileNotFoundError:
            yield skip(e.path, "vanished")
        except PermissionError:
            yield skip(e.path, "permission")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in LISTED.split(", ")])
    return out.astype({"size": "Int64"}).assign(modified=pd.to_datetime(out["modified"], utc=True))


def listed(spark: SparkSession, root: str, images: bool = False, ignore: list[str] | None = None, ignore_file: str = ".ignore") -> tuple[DataFrame, DataFrame]:
    """((path, relative, extension, size, modified), (reason, n)): the files below root, and what was skipped.

    ignore: rules that hold for all of root. A root that is one file gives
    that file, an image too.
    """
    root = re.sub(r"^file:/+", "/", root).rstrip("/") or "/"
    rules = [("", p) for p in map(ignore_pattern, ignore or []) if p]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    first = spark.createDataFrame([(root, "", json.dumps(rules))], "path string, relative string, rules string")

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path in pdf["path"]:
                if os.path.isfile(path):
                    at = os.stat(path)
                    rows.append(("file", path, os.path.basename(path), "", "", _ending(path), at.st_size, datetime.fromtimestamp(int(at.st_mtime), timezone.utc)))
                elif os.path.isdir(path):
                    rows.append(("dir", path, "", json.dumps(rules), "", "", None, None))
            yield _frame(rows)

    def level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, relative, own in zip(pdf["path"], pdf["relative"], pdf["rules"], strict=True):
                yield _frame(list(entries(path, relative, [tuple(r) for r in json.loads(own)], images, ignore_file)))

    levels = [settle(first.mapInPandas(alone, LISTED), "corpus")]
    while not (folders := levels[-1].where("kind = 'dir'").select("path", "relative", "rules")).isEmpty():
        levels.append(settle(folders.repartition(wide, "path").mapInPandas(level, LISTED), "corpus"))
    found = reduce(lambda a, b: a.unionByName(b), levels)
    files = found.where("kind = 'file'").select("path", "relative", "extension", "size", "modified")
    return files, found.where("kind = 'skip'").groupBy("reason").agg(F.count("*").alias("n"))


def contents(files: DataFrame) -> DataFrame:
    """(path, extension, modified, content, problem): whole files; one that has vanished or can't be read has a problem and no content."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            start, held, rows = 0, 0, []
            for i, path in enumerate(pdf["path"]):
                content, problem = None, None
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except FileNotFoundError:
                    problem = "vanished"
                except OSError as e:
                    problem = f"unreadable: {type(e).__name__}"
                rows.append((content, problem))
                held += len(content or b"")
                if held >= HELD or i == len(pdf) - 1:
                    one = pdf.iloc[start : i + 1][["path", "extension", "modified"]]
                    yield one.assign(content=[c for c, _ in rows], problem=[x for _, x in rows])
                    start, held, rows = i + 1, 0, []

    wide = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return files.select("path", "extension", "modified").repartition(wide, "path").mapInPandas(read, READ)


def _pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text, problem) of an extractor; a file that it fails on has a problem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, text, None) for i, text in enumerate(extract(bytes(content)), 1)]
                except Exception as e:
                    rows.append((path, None, None, f"not extracted: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "problem"]).astype({"page": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page long, text string, problem string")


def load(spark: SparkSession, root: str, ignore: list[str] | None = None, images: bool = False, extract: Callable[[bytes], list[str]] | None = None, describe: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, warnings(path, problem), (reason, n) of what was skipped) of a folder: every file by the loader of its type.

    Text formats by their extension, JSON exports by their keys, YAML as image
    metadata, PDF by the pages that extract gives, images by describe or a
    plain sentence. A file that can't be read, has no loader or gives no unit
    is a warning.
    """
    files, skipped = listed(spark, root, images, ignore)
    raw = settle(contents(files), "corpus-content")
    reg, e = ld.catalogue(), F.col("extension")
    text = raw.where("content is not null").select("path", "extension", "modified", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("content"))
    rows = lambda condition: text.where(condition).select("path", "content", "modified")
    parts = [reg.resolve(name)(rows(e == ending)) for ending, name in ld.BY_EXTENSION.items()]
    exported = rows(e == ".json")
    parts += [reg.resolve(f"{kind}_export")(exported.where(export_kind(F.col("content")) == kind)) for kind in ("chatgpt", "claude", "mistral")]
    meta = rows(e.isin(".yaml", ".yml"))
    parts.append(ld.image_meta_units(meta))
    pictures = files.where(e.isin(*IMAGE_EXTENSIONS)).select("path", "modified")
    parts.append(ld.describe_images(pictures, describe))
    problems = [raw.where("problem is not null").select("path", "problem"), ld.image_meta(meta).where("error is not null").select("path", F.col("error").alias("problem"))]
    pdfs = raw.where((e == ".pdf") & F.col("content").isNotNull())
    if extract is None:
        problems.append(pdfs.select("path", F.lit("no extractor for PDF").alias("problem")))
    else:
        pages = settle(_pages(pdfs, extract), "corpus-pages")
        parts.append(ld.pdf_chunks(pages.where("problem is null")))
        problems.append(pages.where("problem is not null").select("path", "problem"))
    known = [*ld.BY_EXTENSION, ".json", ".yaml", ".yml", ".pdf", *IMAGE_EXTENSIONS]
    problems.append(files.where(~e.isin(*known)).select("path", F.lit("no loader").alias("problem")))
    units = settle(reduce(lambda a, b: a.unionByName(b), parts), "corpus-units")
    told = settle(reduce(lambda a, b: a.unionByName(b), problems), "corpus-problems")
    silent = files.select("path").join(units.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti").join(told.select("path"), "path", "left_anti")
    return units, told.unionByName(silent.select("path", F.lit("no units").alias("problem"))), skipped
