"""Reports and exports as rows, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancelake.functions.text import preview, slug


def two_places(milli: Column) -> Column:
    """Thousandths as a number with two places, half away from zero; empty for null."""
    h = F.floor((F.abs(milli) + 5) / 10).cast("long")
    sign = F.when((milli < 0) & (h > 0), "-").otherwise("")
    text = F.concat(sign, F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))
    return F.when(milli.isNull(), "").otherwise(text)


def tenor_label(x: Column) -> Column:
    """casual to 0.3, mixed to 0.6, formal to 1.0: the first that fits."""
    return F.when(x.between(0.0, 0.3), "casual").when(x.between(0.0, 0.6), "mixed").when(x.between(0.0, 1.0), "formal")


def turn_report(turns: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of the turn report: preview, means, mood, tallies and shift."""
    from stancelake.operators.conversation import shifts

    s = shifts(turns).join(units.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return s.select(
        F.col("turn").alias("turn_id"), "conv_id", "speaker", preview(F.regexp_replace("text", r"\s+", " "), 50).alias("message_preview"), "avg_tenor", "avg_modality",
        "dominant_mood", "process_counts", two_places(F.col("tenor_shift_milli")).alias("tenor_shift"), tenor_label(F.col("avg_tenor")).alias("tenor_label"),
    )


def export_jsonl(clauses: DataFrame, sections: DataFrame, with_id: bool = False) -> DataFrame:
    """One JSON line a clause, in the order of document, section and clause; a clause picked twice counts once."""
    j = clauses.join(sections, "section_id")
    w = Window.partitionBy("clause_id").orderBy("document_position", "ordinal")
    once = j.withColumn("__k", F.row_number().over(w)).where("__k = 1")
    said = F.struct("process_type").alias("ideational")
    how = F.struct("mood", "modality_milli", "tenor_milli", "annotation_source").alias("interpersonal")
    line = F.to_json(F.struct("collection", "document_key", "section_id", "section_path", F.col("ctext").alias("text"), said, how))
    return once.orderBy("document_position", "ordinal", "idx").select(line.alias("value"), *(["clause_id"] if with_id else []))


def annotated_documents(clauses: DataFrame, by: str) -> DataFrame:
    """(file_name, body): one document a source, clauses in order with their labels; names made distinct by a number."""
    line = F.concat(F.col("ctext"), F.lit(" ["), F.col("mood"), F.lit("/"), F.col("process_type"), F.lit("]"))
    docs = clauses.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("l")))).alias("x"))
    docs = docs.select(by, slug(F.col(by).cast("string")).alias("s"), F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("body"))
    k = F.row_number().over(Window.partitionBy("s").orderBy(by))
    return docs.select(F.concat("s", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.lit("")), F.lit(".md")).alias("file_name"), "body")


def report_markdown(profiles: DataFrame, stance: DataFrame, moments: DataFrame, rows: int = 50) -> str:
    """A short report over small tables: `rows` of each at most."""
    parts = ["# Conversation report", "", "## Speakers", ""]
    parts += [f"- {r.speaker}: {r.turn_count} turns, tenor {'insufficient data' if r.avg_tenor is None else f'{r.avg_tenor:.3f}'}" for r in profiles.orderBy("speaker").limit(rows).collect()]
    parts += ["", "## Process and stance", "", "| process | clauses | trusted | tenor |", "|-|-|-|-|"]
    parts += [f"| {r.process_type} | {r.clause_count} | {r.annotated_count} | {'-' if r.avg_tenor is None else f'{r.avg_tenor:.3f}'} |" for r in stance.orderBy("process_type").limit(rows).collect()]
    parts += ["", "## Key moments", ""]
    parts += [f"- turn {r.turn}: {r.type} ({r.magnitude_milli / 1000:+.3f})" for r in moments.orderBy("conv_id", "turn", "type").limit(rows).collect()]
    return "\n".join(parts) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
