"""Which files are read, what they are, and what they are called."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_EXTENSIONS = (".md", ".canvas", ".pdf")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp")


def name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.[^.]*$", 0))


def file_id(path: Column) -> Column:
    """The file's name and eight digits of its path's SHA-256."""
    return F.concat(basename(path), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def _kind(form: str, mode: str, source: str) -> Column:
    return F.struct(F.lit(form).alias("format"), F.lit(mode).alias("mode"), F.lit(source).alias("source_type"))


def route(path: Column, head: Column | None = None) -> Column:
    """format, mode and source_type by name, then extension, then (for .json) the start of the content; null if unsure."""
    base, ext = basename(path), extension(path)
    out = F.when(base.startswith("transcription_") & base.endswith(".txt"), _kind("transcription", "conversation", "transcription"))
    out = out.when(base.startswith("image-") & base.endswith(".meta.yaml"), _kind("image_meta", "knowledge_base", "vault_image_meta"))
    out = out.when(ext.isin(".jsonl", ".srt", ".vtt", ".ass"), _kind("chat_native", "conversation", "chat_native"))
    out = out.when(ext == ".md", _kind("markdown", "knowledge_base", "vault_markdown"))
    out = out.when(ext == ".canvas", _kind("canvas", "knowledge_base", "vault_canvas"))
    out = out.when(ext == ".pdf", _kind("pdf", "knowledge_base", "vault_pdf"))
    out = out.when(ext.isin(*IMAGE_EXTENSIONS), _kind("image", "knowledge_base", "vault_image"))
    if head is not None:
        kind = export_kind(head)
        out = out.when((ext == ".json") & (kind == "chatgpt"), _kind("chatgpt_export", "conversation", "chat_chatgpt"))
        out = out.when((ext == ".json") & (kind == "claude"), _kind("claude_export", "conversation", "chat_claude"))
    return out


def export_kind(content: Column) -> Column:
    """chatgpt, claude or mistral by the keys of a JSON export; null otherwise."""
    return F.when(content.rlike(r'"mapping"\s*:'), "chatgpt").when(content.rlike(r'"chat_messages"\s*:'), "claude").when(content.rlike(r'"chatId"\s*:'), "mistral")


def ignore_pattern(rule: str) -> str | None:
    """A rule of an ignore file as a regular expression on relative paths; null for blanks and comments.

    A slash at the start or inside anchors the rule; one at its end asks for a
    folder; * and ? stay within a part, ** crosses parts.
    """
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    folder = rule.endswith("/")
    body = rule.strip("/")
    anchored = rule.startswith("/") or "/" in body
    out = ""
    i = 0
    while i < len(body):
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = body[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def corpus(spark: SparkSession, root: str, ignore: list[str] | None = None, images: bool = False, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """path, relative, modified, size and content of the files under root; hidden, ignored and foreign ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(bare) + "/?", "")
    out = files.withColumn("relative", relative).where(~F.col("relative").rlike(r"(^|/)\."))
    for p in filter(None, map(ignore_pattern, ignore or [])):
        out = out.where(~F.col("relative").rlike(p))
    out = out.where(extension(F.col("path")).isin(*extensions, *(IMAGE_EXTENSIONS if images else ())))
    return out.select("path", "relative", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def ignored(relative: Column, rules: dict[str, list[str]]) -> Column:
    """Whether a relative path is ignored by rules(folder -> lines): a folder's rules hold below it, on paths seen from it."""
    out = F.lit(False)
    for folder, lines in rules.items():
        base = folder.strip("/")
        inside = F.lit(True) if not base else relative.startswith(base + "/")
        seen = relative if not base else F.substring(relative, len(base) + 2, 1 << 30)
        for pattern in filter(None, map(ignore_pattern, lines)):
            out = out | (inside & seen.rlike(pattern))
    return out


def ignore_rules(spark: SparkSession, root: str, name: str = ".ignore") -> dict[str, list[str]]:
    """The lines of every ignore file below root, by its folder: one listing a level, as deep as there are folders."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(fs_path(root)).toUri().getPath().rstrip("/")
    out: dict[str, list[str]] = {}
    stars = ""
    while any(x.isDirectory() for x in fs.globStatus(fs_path(root.rstrip("/") + stars)) or ()):
        for f in fs.globStatus(fs_path(f"{root.rstrip('/')}{stars}/{name}")) or ():
            folder = f.getPath().getParent().toUri().getPath()[len(base) :].strip("/")
            out[folder] = spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(f.getPath()), "UTF-8").splitlines()
        stars += "/*"
    return out


def walk(spark: SparkSession, root: str, images: bool = False, extensions: tuple[str, ...] = TEXT_EXTENSIONS, ignore_file: str = ".ignore") -> tuple[DataFrame, DataFrame]:
    """(files, (reason, n) of what was skipped) below root, with the rules of the ignore files found there.

    Files that vanish or can't be read on the way are skipped by Spark, which
    doesn't list hidden ones (with a dot or an underscore first) nor empty ones. A root
    that is one file gives that file, an image too.
    """
    single = root.rstrip("/").rsplit("/", 1)[-1].lower().endswith(tuple(extensions) + IMAGE_EXTENSIONS)
    read = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    files = read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    local = F.regexp_replace("path", r"^\w+:/*", "/")
    files = files.withColumn("relative", F.lit(bare.rsplit("/", 1)[-1]) if single else F.regexp_replace(local, "^" + re.escape(bare) + "/?", ""))
    rules = {} if single else ignore_rules(spark, root, ignore_file)
    kind = extension(F.col("path"))
    why = F.when(ignored(F.col("relative"), rules), "ignored")
    if not images and not single:
        why = why.when(kind.isin(*IMAGE_EXTENSIONS), "image")
    why = why.when(~kind.isin(*extensions, *IMAGE_EXTENSIONS), "foreign")
    marked = files.withColumn("why", why)
    kept = marked.where("why is null").select("path", "relative", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return kept, marked.where("why is not null").groupBy(F.col("why").alias("reason")).agg(F.count("*").alias("n"))
