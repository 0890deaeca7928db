"""Loaders: rows of (path, content, modified) to units.

Every loader is a plan of column expressions over whole files' contents, so
many files are read side by side; only YAML needs a parser in Python. Rows
that a loader can't use are left out and can be had from the `rejected_*`
functions where the source distinguishes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancelake.functions.text import strip_markdown
from stancelake.sources.routing import basename, file_id

LEAST_TEXT = 40


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and modified of text files, byte order marks removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select("path", text.alias("content"), F.col("modificationTime").alias("modified"))


def _units(df: DataFrame, section: Column, text: Column, **more: Column) -> DataFrame:
    """df's rows in the shape of units."""
    none = F.lit(None).cast("string")
    cols = {
        "section_id": section, "document_key": F.col("path"), "source_path": F.col("path"), "parent_section_id": none, "text": text, "heading": none,
        "speaker": none, "is_user": F.lit(None).cast("boolean"), "sent_at": F.lit(None).cast("timestamp"), "metadata": F.create_map().cast("map<string,string>"),
    }
    return df.select(*[c.alias(k) for k, c in {**cols, **more}.items()])


def _lines(content: str = "content") -> Column:
    return F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")


# --- subtitles ----------------------------------------------------------------------------------


def _seconds(h: Column, m: Column, s: Column, frac: Column, scale: float) -> Column:
    n = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    return n(h) * 3600 + n(m) * 60 + n(s) + n(frac) / scale


def _blocks(files: DataFrame) -> DataFrame:
    """(path, modified, pos, lines) of the blocks between blank lines."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    rows = files.select("path", "modified", F.posexplode(F.split(text, r"\n\n+")).alias("pos", "block")).withColumn("block", F.trim(F.btrim("block", F.lit("\n"))))
    return rows.where("block <> ''").withColumn("lines", F.split("block", "\n"))


def _cues(files: DataFrame, time: str, scale: float, label: str, close: str = "") -> DataFrame:
    b = _blocks(files)
    at = F.expr(f"array_position(transform(lines, x -> x rlike '{time}'), true)")
    b = b.withColumn("at", at)
    clock = F.get("lines", F.col("at") - 1)
    part = lambda i: F.regexp_extract(clock, time, i)
    body = F.trim(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " "))
    b = b.where("at > 0").withColumns({"start": _seconds(part(1), part(2), part(3), part(4), scale), "body": body})
    speaker = F.regexp_extract("body", label, 1)
    clean = F.regexp_replace("body", label, "")
    clean = F.replace(clean, F.lit(close), F.lit("")) if close else clean
    out = b.select("path", "modified", "pos", F.when(speaker != "", F.trim(speaker)).alias("speaker"), "start", F.trim(clean).alias("text"))
    return out.where("text <> ''")


def srt_cues(files: DataFrame) -> DataFrame:
    """path, modified, pos, speaker, start, text; a block without a time line is left out."""
    return _cues(files, r"^([0-9]{2}):([0-9]{2}):([0-9]{2}),([0-9]{3})[ ]*-->", 1000.0, r"^\[(Speaker \d+(?: \([^)]*\))?)\]\s*")


def vtt_cues(files: DataFrame) -> DataFrame:
    """As srt_cues, with optional hours and voice tags; headers, notes, styles and regions have no time line."""
    return _cues(files, r"^(?:([0-9]{2}):)?([0-9]{2}):([0-9]{2})[.]([0-9]{3})[ ]*-->", 1000.0, r"^<v\s+([^>]+)>\s*", "</v>")


def ass_cues(files: DataFrame) -> DataFrame:
    """Dialogue lines of the [Events] part, cut by its Format line's columns; override tags and line marks go."""
    rows = files.withColumn("lines", _lines())
    events = F.array_position(F.transform("lines", lambda x: F.trim(x)), "[Events]")
    rows = rows.withColumn("e", events).where("e > 0")
    body = F.slice("lines", F.col("e") + 1, F.size("lines"))
    stop = F.array_position(F.transform(body, lambda x: x.startswith("[")), True)
    rows = rows.withColumn("body", F.when(stop > 0, F.slice(body, 1, stop - 1)).otherwise(body))
    form = F.get(F.filter("body", lambda x: x.startswith("Format:")), F.lit(0))
    columns = F.transform(F.split(F.regexp_replace(form, "^Format:", ""), ","), lambda x: F.trim(x))
    rows = rows.withColumn("columns", columns).where("columns is not null")
    talk = F.filter("body", lambda x: x.startswith("Dialogue:"))
    d = rows.select("path", "modified", "columns", F.posexplode(talk).alias("pos", "line"))
    d = d.withColumn("fields", F.split(F.trim(F.regexp_replace("line", "^Dialogue:", "")), ",", F.size("columns"))).where("size(fields) = size(columns)")
    field = lambda n: F.trim(F.get("fields", (F.array_position("columns", n) - 1).cast("int")))
    time = r"^(\d+):(\d{2}):(\d{2})\.(\d{2})$"
    d = d.withColumns({"clock": field("Start"), "who": field("Name"), "said": field("Text")}).where(F.col("clock").rlike(time))
    part = lambda i: F.regexp_extract("clock", time, i)
    said = F.trim(F.regexp_replace(F.regexp_replace("said", r"\{[^}]*\}", ""), r"\\N|\\n", " "))
    out = d.select("path", "modified", "pos", F.when(F.col("who") != "", F.col("who")).alias("speaker"), _seconds(part(1), part(2), part(3), part(4), 100.0).alias("start"), said.alias("text"))
    return out.where("text <> ''")


def cue_units(cues: DataFrame) -> DataFrame:
    """Neighbouring cues of one speaker as one turn; a missing speaker is `Speaker`; times count from the file's."""
    w = Window.partitionBy("path").orderBy("pos")
    named = cues.withColumn("speaker", F.coalesce("speaker", F.lit("Speaker")))
    marked = named.withColumn("new", F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1)))
    marked = marked.withColumn("turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = marked.groupBy("path", "turn").agg(F.first("speaker").alias("who"), F.min("start").alias("start"), F.first("modified").alias("modified"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"))
    sent = F.timestamp_micros(F.unix_micros("modified") + (F.col("start") * 1_000_000).cast("long"))
    return _units(g, F.concat(file_id(F.col("path")), F.lit("#turn-"), F.col("turn").cast("string")), F.array_join(F.transform("x", lambda s: s["text"]), " "), speaker=F.col("who"), is_user=F.lit(False), sent_at=sent)


def srt(files: DataFrame) -> DataFrame:
    return cue_units(srt_cues(files))


def vtt(files: DataFrame) -> DataFrame:
    return cue_units(vtt_cues(files))


def ass(files: DataFrame) -> DataFrame:
    return cue_units(ass_cues(files))


# --- chats --------------------------------------------------------------------------------------

_CHAT = "struct<name:string,is_user:boolean,send_date:string,mes:string,text:string,speaker:string,start_ms:string>"


def send_time(value: Column) -> Column:
    """A lenient time; null if no known form fits."""
    v = F.regexp_replace(F.regexp_replace(value, "(?i)(am|pm)$", "$1"), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(v, F.lit("MMMM d, yyyy h:mma")), F.try_to_timestamp(v, F.lit("MMMM d, yyyy h:mm a")), v.try_cast("timestamp"))


def chat_jsonl(files: DataFrame) -> DataFrame:
    """Lines of {name, mes, send_date, is_user}; if a file has none, lines of {speaker, text, start_ms} as cues.

    Lines that aren't JSON objects or hold neither are left out.
    """
    rows = files.select("path", "modified", F.posexplode(_lines()).alias("pos", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("r", F.from_json("line", _CHAT))
    native = rows.where("r.mes is not null").withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("pos")))
    sent = F.coalesce(send_time(F.col("r.send_date")), F.col("modified"))
    turns = _units(native, F.concat(file_id(F.col("path")), F.lit("#turn-"), F.col("turn").cast("string")), F.col("r.mes"), speaker=F.col("r.name"), is_user=F.col("r.is_user"), sent_at=sent)
    has = native.select("path").distinct()
    cues = rows.where("r.text is not null and r.speaker is not null").join(has, "path", "left_anti")
    start = F.coalesce(F.trim("r.start_ms").try_cast("double") / 1000, F.lit(0.0))
    cues = cues.select("path", "modified", "pos", F.col("r.speaker").alias("speaker"), start.alias("start"), F.trim("r.text").alias("text")).where("text <> ''")
    return turns.unionByName(cue_units(cues))


def notebook_jsonl(files: DataFrame) -> DataFrame:
    """Lines of {role, content} as native chat lines: name, is_user, mes."""
    rows = files.select("path", F.posexplode(_lines()).alias("pos", "line")).withColumn("r", F.from_json("line", "struct<role:string,content:string>"))
    return rows.where("r.content is not null").select("path", "pos", F.when(F.col("r.role") == "user", "User").otherwise("Assistant").alias("name"), (F.col("r.role") == "user").alias("is_user"), F.col("r.content").alias("mes"))


def transcription(files: DataFrame) -> DataFrame:
    """A turn for every line that isn't blank, all by User at the file's time."""
    rows = files.select("path", "modified", F.posexplode(_lines()).alias("pos", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1)
    return _units(rows, F.concat(file_id(F.col("path")), F.lit("#turn-"), F.col("turn").cast("string")), F.trim("line"), speaker=F.lit("User"), is_user=F.lit(True), sent_at=F.col("modified"))


_MESSAGE = "struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>"
_CHATGPT = f"array<struct<id:string,title:string,mapping:map<string,struct<id:string,message:{_MESSAGE},parent:string,children:array<string>>>>>"


def _conversations(content: Column) -> Column:
    """The array of conversations, bare or in an envelope."""
    return F.coalesce(F.get_json_object(content, "$.conversations"), content)


def chatgpt(files: DataFrame) -> DataFrame:
    """One thread a conversation: from the first node without children up to the root, system and empty messages left out."""
    c = files.select("path", F.explode(F.from_json(_conversations(F.col("content")), _CHATGPT)).alias("c")).select("path", "c.*")
    nodes = F.map_values("mapping")
    leaf = F.get(F.filter(nodes, lambda n: F.size(F.coalesce(n["children"], F.array().cast("array<string>"))) == 0), F.lit(0))
    c = c.withColumn("leaf", leaf)
    # walk up: at most as many steps as there are nodes
    step = F.expr(
        "aggregate(sequence(1, greatest(size(mapping), 1)), named_struct('at', leaf, 'out', cast(array() as array<" + f"struct<message:{_MESSAGE}>" + ">)), (a, i) -> if(a.at is null, a, named_struct('at', try_element_at(mapping, a.at.parent), 'out', concat(array(named_struct('message', a.at.message)), a.out))), a -> a.out)"
    )
    m = c.withColumn("thread", step).select("path", "id", "title", F.posexplode("thread").alias("pos", "n")).select("path", "id", "title", "pos", "n.message")
    body = F.array_join(F.coalesce("message.content.parts", F.array().cast("array<string>")), "\n")
    m = m.where("message is not null and coalesce(message.author.role, '') <> 'system'").withColumn("mes", body).where(F.trim("mes") != "")
    m = m.withColumn("turn", F.row_number().over(Window.partitionBy("path", "id").orderBy("pos")) - 1)
    user = F.coalesce(F.col("message.author.role") == "user", F.lit(False))
    meta = F.map_from_arrays(F.array(F.lit("conversation_id"), F.lit("conversation_title")), F.array("id", "title"))
    return _units(m, F.concat("id", F.lit("#turn-"), F.col("turn").cast("string")), F.col("mes"), document_key=F.col("id"), speaker=F.when(user, "User").otherwise("ChatGPT"), is_user=user, sent_at=F.timestamp_seconds("message.create_time"), metadata=meta)


_CLAUDE = "array<struct<uuid:string,name:string,created_at:string,chat_messages:array<struct<uuid:string,sender:string,text:string,created_at:string,content:array<struct<type:string,text:string>>>>>>"


def claude(files: DataFrame) -> DataFrame:
    """Messages in order; text blocks, a blank line between, or else the plain text; empty ones left out."""
    c = files.select("path", F.explode(F.from_json(_conversations(F.col("content")), _CLAUDE)).alias("c")).select("path", "c.*")
    m = c.select("path", "uuid", "name", F.posexplode("chat_messages").alias("pos", "m"))
    texts = F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"])
    m = m.withColumn("mes", F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")).otherwise(F.col("m.text"))).where(F.trim("mes") != "")
    m = m.withColumn("turn", F.row_number().over(Window.partitionBy("path", "uuid").orderBy("pos")) - 1)
    human = F.coalesce(F.col("m.sender") == "human", F.lit(False))
    meta = F.map_from_arrays(F.array(F.lit("conversation_id"), F.lit("conversation_title")), F.array("uuid", "name"))
    return _units(m, F.concat("uuid", F.lit("#turn-"), F.col("turn").cast("string")), F.col("mes"), document_key=F.col("uuid"), speaker=F.when(human, "Human").otherwise("Assistant"), is_user=human, sent_at=F.col("m.created_at").try_cast("timestamp"), metadata=meta)


def claude_memories(files: DataFrame) -> DataFrame:
    """The memory texts of an export's memories file: of conversations, and of each project; blank ones are left out."""
    shape = "array<struct<account_uuid:string,conversations_memory:string,project_memories:map<string,string>>>"
    m = files.select("path", F.posexplode(F.from_json(_conversations(F.col("content")), shape)).alias("pos", "m")).select("path", "pos", "m.*")
    whole = m.select("path", "pos", F.lit("conversations").alias("of"), F.col("conversations_memory").alias("text"))
    each = m.select("path", "pos", F.explode("project_memories").alias("of", "text"))
    rows = whole.unionByName(each).where(F.trim("text") != "")
    return _units(rows, F.concat(file_id(F.col("path")), F.lit("#memory-"), F.col("pos").cast("string"), F.lit("-"), F.col("of")), F.trim("text"), heading=F.col("of"), metadata=F.create_map(F.lit("content_type"), F.lit("memory")))


def mistral(files: DataFrame) -> DataFrame:
    """A flat list of messages; the chat's id is the first message's, or else the file's name."""
    c = files.select("path", F.from_json("content", "array<struct<id:string,chatId:string,content:string,role:string,createdAt:string>>").alias("a"))
    m = c.select("path", F.coalesce(F.get("a", F.lit(0))["chatId"], basename(F.col("path"))).alias("chat"), F.posexplode("a").alias("pos", "m")).where(F.trim("m.content") != "")
    m = m.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1)
    user = F.coalesce(F.col("m.role") == "user", F.lit(False))
    return _units(m, F.concat("chat", F.lit("#turn-"), F.col("turn").cast("string")), F.col("m.content"), document_key=F.col("chat"), speaker=F.when(user, "User").otherwise("Mistral"), is_user=user, sent_at=F.col("m.createdAt").try_cast("timestamp"), metadata=F.create_map(F.lit("conversation_id"), F.col("chat")))


# --- documents ----------------------------------------------------------------------------------


_FRONT = r"(?s)\A---\n(.*?)\n---[ \t]*(?:\n|\z)"


def front_matter(front: Column) -> Column:
    """The plain `key: value` lines of a front matter as a map, quotes taken off; lists and nested values stay text."""
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pair = lambda x: F.struct(F.concat(F.lit("front."), F.regexp_extract(x, r"^([\w-]+)", 1)).alias("k"), F.btrim(F.trim(F.regexp_extract(x, r"^[\w-]+\s*:(.*)$", 1)), F.lit("\"'")).alias("v"))
    pairs = F.transform(lines, pair)
    # of a key that stands twice, the last one
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def markdown(files: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """A unit for every heading's section and one for what stands before the first; short ones are left out; parents by level."""
    whole = F.regexp_replace("content", "\r\n?", "\n")
    front = F.regexp_extract(whole, _FRONT, 1)
    # fenced blocks go before the split: a # within them is no heading, and code is no prose
    body = F.regexp_replace(F.regexp_replace(whole, _FRONT, ""), r"(?ms)^[ ]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\z)", "")
    rows = files.select("path", front.alias("front"), F.posexplode(F.split(body, r"(?m)(?=^#{1,6} )")).alias("pos", "chunk")).where(F.trim("chunk") != "")
    head = F.regexp_extract("chunk", r"\A(#{1,6}) +([^\n]*)", 2)
    level = F.length(F.regexp_extract("chunk", r"\A(#{1,6}) ", 1))
    rest = F.regexp_replace("chunk", r"\A#{1,6} +[^\n]*\n?", "")
    rows = rows.withColumns({"level": F.when(level > 0, level), "head": F.when(level > 0, F.trim(head)), "prose": strip_markdown(rest)})
    rows = rows.where(F.length("prose") >= least)
    slug = F.btrim(F.regexp_replace(F.lower("head"), "[^a-z0-9]+", "-"), F.lit("-"))
    same = F.row_number().over(Window.partitionBy("path", "head").orderBy("pos"))
    rows = rows.withColumn("slug", F.when(F.col("level").isNull(), "preamble").otherwise(F.when(same > 1, F.concat(slug, F.lit("-"), (same - 1).cast("string"))).otherwise(slug)))
    rows = rows.withColumn("section", F.concat(file_id(F.col("path")), F.lit("#"), F.col("slug")))
    parents = nest(rows.where("level is not null").select("path", "pos", "level", "section"))
    j = rows.join(parents, ["path", "section"], "left")
    meta = F.map_filter(F.map_from_arrays(F.array(F.lit("heading_level"), F.lit("heading_slug")), F.array(F.col("level").cast("string"), F.col("slug"))), lambda k, v: v.isNotNull())
    meta = F.map_concat(front_matter(F.col("front")), meta)
    return _units(j, F.col("section"), F.col("prose"), heading=F.col("head"), parent_section_id=F.col("parent"), metadata=meta)


def nest(sections: DataFrame) -> DataFrame:
    """(path, section, parent): the nearest section before of a smaller level, from (path, pos, level, section).

    Six running maxima, one a level: no self-join over a document's sections.
    """
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {i: F.max(F.when(F.col("level") == i, F.struct("pos", "section"))).over(w) for i in range(1, 7)}
    s = sections.withColumns({f"l{i}": c for i, c in last.items()})
    above = F.greatest(*[F.when(F.col("level") > i, F.col(f"l{i}")) for i in range(1, 7)])
    return s.select("path", "section", above["section"].alias("parent"))


def canvas(files: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """Text nodes of a canvas, short ones left out."""
    n = files.select("path", F.explode(F.from_json("content", "struct<nodes:array<struct<id:string,type:string,text:string>>>")["nodes"]).alias("n")).select("path", "n.*")
    n = n.where("type = 'text'").withColumn("prose", strip_markdown(F.col("text"))).where(F.length("prose") >= least)
    return _units(n, F.concat(file_id(F.col("path")), F.lit("#"), F.col("id")), F.col("prose"), metadata=F.create_map(F.lit("heading_level"), F.lit("1")))


def csv(spark: SparkSession, path: str, text: str = "text", speaker: str | None = "speaker", heading: str | None = None, ident: str | None = "id") -> DataFrame:
    """Rows of CSV files with a header; empty texts are left out; a byte order mark isn't part of a name."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in rows.columns], F.col("_metadata.file_path").alias("path"))
    return _records(rows, text, speaker, heading, ident)


def json(spark: SparkSession, path: str, text: str = "text", speaker: str | None = "speaker", heading: str | None = None, ident: str | None = "id", lines: bool | None = None) -> DataFrame:
    """Rows of JSON arrays or, with lines (or a name that ends in jsonl or ndjson), of JSON lines."""
    lines = path.endswith(("jsonl", "ndjson")) if lines is None else lines
    rows = spark.read.option("multiLine", not lines).json(path)
    return _records(rows.select("*", F.col("_metadata.file_path").alias("path")), text, speaker, heading, ident)


def _records(rows: DataFrame, text: str, speaker: str | None, heading: str | None, ident: str | None) -> DataFrame:
    """Units of records; one without an id is named by a hash of its values, equal ones by their count, whatever the partitions."""
    have = [c for c in rows.columns if c != "path"]
    if text not in have:
        raise ValueError(f"no column {text}; there are: {', '.join(have)}")
    rows = rows.where(F.trim(F.col(text).cast("string")) != "")
    at = lambda c: F.col(c).cast("string") if c and c in have else F.lit(None).cast("string")
    whole = F.sha2(F.to_json(F.struct(*have)), 256)
    rows = rows.withColumn("__hash", F.substring(whole, 1, 12))
    again = F.row_number().over(Window.partitionBy("path", "__hash").orderBy(F.lit(1)))
    made = F.concat(F.lit("row-"), F.col("__hash"), F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise(F.lit("")))
    plain = [c for c in have if c != text]
    meta = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in plain]), F.array(*[F.col(c).cast("string") for c in plain])), lambda k, v: v.isNotNull()) if plain else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("__id", F.coalesce(at(ident), made))
    return _units(rows, F.concat(file_id(F.col("path")), F.lit("#"), F.col("__id")), F.col(text).cast("string"), speaker=at(speaker), heading=at(heading), metadata=meta)


def required(units: DataFrame, files: DataFrame) -> DataFrame:
    """units, unless a file of files(path) gives none: then an error that names such files, as a blank transcript or chat does."""
    empty = files.select("path").join(units.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")
    if names := [r.path for r in empty.orderBy("path").limit(5).collect()]:
        raise ValueError(f"nothing to load in: {', '.join(names)}")
    return units


def image_meta(files: DataFrame) -> DataFrame:
    """YAML beside images: a description (required, not blank), a lenient time, model and evaluation; others have `error`."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                error, x = None, {}
                try:
                    x = yaml.safe_load(content)
                except Exception as e:
                    error = f"not safe YAML: {type(e).__name__}"
                if error is None and not isinstance(x, dict):
                    error, x = "root is not a mapping", {}
                x = x if isinstance(x, dict) else {}
                d = x.get("description")
                if error is None and not (isinstance(d, str) and d.strip()):
                    error = "description is not a non-blank string"
                out.append((path, d if isinstance(d, str) else None, None if x.get("timestamp") is None else str(x["timestamp"]), None if x.get("model_used") is None else str(x["model_used"]), error))
            yield pd.DataFrame(out, columns=["path", "description", "stamp", "model", "error"])

    return files.select("path", "content").mapInPandas(parse, "path string, description string, stamp string, model string, error string")


def image_meta_units(files: DataFrame) -> DataFrame:
    rows = image_meta(files).where("error is null")
    meta = F.map_filter(F.create_map(F.lit("model_used"), F.col("model")), lambda k, v: v.isNotNull())
    return _units(rows, F.concat(file_id(F.col("path")), F.lit("#meta")), F.col("description"), sent_at=F.col("stamp").try_cast("timestamp"), metadata=meta)


def describe_images(files: DataFrame, describe: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """A unit an image; the describer takes a batch of paths. Without one, and where it fails or has none, a plain sentence names the file."""
    plain = F.concat(F.lit("Image file "), basename(F.col("path")), F.lit(" (no description available)."))
    text = plain
    if describe is not None:

        @F.pandas_udf("string")
        def said(paths: pd.Series) -> pd.Series:
            try:
                return pd.Series(list(describe(paths.tolist())), index=paths.index, dtype=object)
            except Exception:  # a describer that is down is no reason to lose the image
                return pd.Series([None] * len(paths), index=paths.index, dtype=object)

        answer = said(F.col("path"))
        text = F.when(F.trim(F.coalesce(answer, F.lit(""))) != "", answer).otherwise(plain)
    return _units(files, F.concat(file_id(F.col("path")), F.lit("#image")), text, metadata=F.create_map(F.lit("content_type"), F.lit("image")))


def pdf_chunks(pages: DataFrame, size: int = 1000) -> DataFrame:
    """(path, page, text) of an extractor to chunks of at most `size` characters, without overlap."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size))
    rows = pages.where(F.trim("text") != "").select("path", "page", F.posexplode(starts).alias("chunk", "at"), "text")
    slug = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-chunk"), F.col("chunk").cast("string"))
    return _units(rows, F.concat(file_id(F.col("path")), F.lit("#"), slug), F.expr(f"substring(text, at, {size})"))


def section_shape(units: DataFrame) -> DataFrame:
    """kind, label, level and document of units."""
    level = F.col("metadata")["heading_level"].try_cast("int")
    kind = F.when(F.col("speaker").isNotNull(), "turn").when(level.isNotNull(), "heading").otherwise("block")
    key = F.coalesce("document_key", F.split_part("section_id", F.lit("#"), F.lit(1)))
    path = F.coalesce("source_path", key)
    return units.select(
        "section_id", kind.alias("kind"), F.when(F.col("speaker").isNotNull(), F.col("speaker")).otherwise(F.col("heading")).alias("label"),
        F.when(F.col("speaker").isNull(), level).alias("level"), key.alias("document_key"), path.alias("source_path"), F.coalesce(F.col("metadata")["conversation_title"], basename(path)).alias("title"),
    )


# --- registry -----------------------------------------------------------------------------------


class Registry:
    """Loaders by name; a name is taken once, and an unknown one raises."""

    def __init__(self):
        self._of: dict[str, Callable] = {}

    def register(self, name: str, loader: Callable) -> None:
        if name in self._of:
            raise ValueError(f"loader {name} is registered already")
        self._of[name] = loader

    def resolve(self, name: str) -> Callable:
        if name not in self._of:
            raise KeyError(f"no loader {name}; there are: {', '.join(sorted(self._of))}")
        return self._of[name]

    def names(self) -> list[str]:
        return sorted(self._of)


#: Loaders that read records at a path themselves: (spark, path, options) to units. All others take rows of whole files.
RECORDS = ("csv", "json")
#: The loader of each file type in a folder of knowledge.
BY_EXTENSION = {".md": "markdown", ".markdown": "markdown", ".canvas": "canvas", ".txt": "transcription", ".srt": "srt", ".vtt": "vtt", ".ass": "ass", ".jsonl": "chat"}


def catalogue() -> Registry:
    r = Registry()
    for name, f in {
        "markdown": markdown, "pdf": pdf_chunks, "canvas": canvas, "srt": srt, "vtt": vtt, "ass": ass, "chat": chat_jsonl, "transcription": transcription, "image_meta": image_meta_units,
        "image": describe_images, "chatgpt_export": chatgpt, "claude_export": claude, "claude_memories": claude_memories, "mistral_export": mistral, "json": json, "csv": csv, "notebook": notebook_jsonl,
    }.items():
        r.register(name, f)
    return r
