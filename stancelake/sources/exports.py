"""Exports, transcripts parsed elsewhere, reports read again, model listings, and targets."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.functions.text import slug


def conversation_name(title: Column, ident: Column) -> Column:
    """A title's slug and the first eight characters of an id."""
    return F.concat_ws("-", F.when(slug(title) != "", slug(title)).otherwise("conversation"), F.substring(ident, 1, 8))


def expand(units: DataFrame, path: str) -> None:
    """Native chat lines of each conversation, in a folder of its own."""
    lines = units.select(F.col("document_key").alias("conversation_id"), F.col("speaker").alias("name"), "is_user", F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("send_date"), F.col("text").alias("mes"), "section_id")
    lines.repartition("conversation_id").sortWithinPartitions("conversation_id", F.regexp_extract("section_id", r"(\d+)$", 1).cast("long")).drop("section_id").write.mode("overwrite").partitionBy("conversation_id").json(path)


HEADER = r"(?m)^\s*(?:#{1,6}\s+|\*\*)([^\n*:]{1,60}?)(?:\*\*)?\s*:?\s*$"


def check_parsed(turns: DataFrame) -> DataFrame:
    """Turns (id, pos, name, mes) that a model made of a transcript, with `problem` where one breaks the contract.

    Bodies that hold \\n as two characters are decoded, unless real line
    breaks stand beside them (mixed_escape). A body with a heading that names
    another speaker is wrongly attributed.
    """
    literal, real = F.col("mes").contains("\\n"), F.col("mes").contains("\n")
    body = F.when(literal & ~real, F.replace("mes", F.lit("\\n"), F.lit("\n"))).otherwise(F.col("mes"))
    body = F.regexp_replace(F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), r"(?m)^>\s?", ""), r"(?m)[ \t]+$", "")
    t = turns.withColumns({"name": F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "Unknown Speaker").otherwise(F.trim("name")), "mixed": literal & real, "double_escaped": literal & ~real, "mes": body})
    names = t.groupBy("id").agg(F.collect_set("name").alias("names"))
    t = t.join(names, "id").withColumn("heads", F.transform(F.regexp_extract_all("mes", F.lit(HEADER), F.lit(1)), lambda h: F.lower(h)))
    foreign = F.exists("names", lambda n: (F.lower(n) != F.lower(F.col("name"))) & F.exists("heads", lambda h: F.array_contains(F.split(h, r"[^\p{L}\p{N}]+"), F.lower(n))))
    return t.select("id", "pos", "name", "mes", "double_escaped", F.when(foreign, "speaker_attribution").when(F.col("mixed"), "mixed_escape").alias("problem"))


def accepted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of transcripts without a problem, (id, problem) of the others): a transcript is taken whole or not at all."""
    bad = checked.where("problem is not null").groupBy("id").agg(F.min("problem").alias("problem"))
    return checked.join(bad, "id", "left_anti"), bad


REPORT = "metadata struct<conversation_id:string,turn_count:long>, turns array<struct<turn_id:long,speaker:string,dominant_mood:string,tenor_shift:double,avg_tenor:double>>, speaker_profiles map<string,struct<turn_count:long>>"


def read_report(files: DataFrame) -> DataFrame:
    """Turn rows of JSON reports; a report without its metadata or turns has `problem`."""
    r = files.select("path", F.from_json("content", REPORT).alias("r")).select("path", "r.*")
    problem = F.when(F.col("metadata").isNull(), "no metadata").when(F.col("turns").isNull(), "no turns")
    return r.select("path", problem.alias("problem"), "metadata.conversation_id", F.explode_outer("turns").alias("t")).select("path", "problem", "conversation_id", "t.*")


def model_rows(files: DataFrame) -> DataFrame:
    """(provider, model_id, context_window, capabilities) of local and hosted model listings."""
    local = files.select(F.explode(F.from_json("content", "models array<struct<name:string,model:string>>")["models"]).alias("m"))
    chat = F.when(F.col("m.name").rlike("(?i)embed"), F.array(F.lit("embedding"))).otherwise(F.array(F.lit("chat")))
    local = local.select(F.lit("local").alias("provider"), F.coalesce("m.model", "m.name").alias("model_id"), F.lit(None).cast("long").alias("context_window"), chat.alias("capabilities"))
    hosted = files.select(F.explode(F.from_json("content", "data array<struct<id:string,context_length:long,architecture:struct<input_modalities:array<string>>>>")["data"]).alias("m"))
    sees = F.when(F.array_contains("m.architecture.input_modalities", "image"), F.array(F.lit("chat"), F.lit("vision"))).otherwise(F.array(F.lit("chat")))
    return local.unionByName(hosted.select(F.lit("hosted").alias("provider"), F.col("m.id").alias("model_id"), F.col("m.context_length").alias("context_window"), sees.alias("capabilities")))


def capable(models: DataFrame, capability: str) -> DataFrame:
    return models.where(F.array_contains("capabilities", capability)).orderBy("provider", "model_id")


def resolve_target(target: str) -> tuple[str, str]:
    """(kind, value) of an argument: a git remote, a file URL, a folder under version control, a folder or a file; raises with what was tried."""
    if re.match(r"^[\w.-]+@[\w.-]+:.+", target) or re.match(r"^https?://.+\.git$", target) or re.match(r"^https://(?:github|gitlab)\.com/[^/]+/[^/]+/?$", target):
        return "git", target
    path = Path(target.removeprefix("file://"))
    if path.is_dir():
        for p in (path, *path.resolve().parents):
            if (p / ".git").exists():
                return "worktree", str(p)
        return "folder", str(path)
    if path.is_file():
        return "file", str(path)
    raise ValueError(f"{target}: not a git remote, folder or file")
