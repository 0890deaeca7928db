"""Stance filters: named, checked, joined by and; nulls are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.contracts import trusted

FILTERS = {
    "mood": lambda v: F.col("mood") == v,
    "process_type": lambda v: F.col("process_type") == v,
    "source_type": lambda v: F.col("source_type") == v,
    "min_modality": lambda v: F.col("modality") >= v,
    "max_modality": lambda v: F.col("modality") <= v,
    "min_tenor": lambda v: F.col("tenor") >= v,
    "max_tenor": lambda v: F.col("tenor") <= v,
    "annotation_source": lambda v: F.col("annotation_source") == v,
}


def condition(**filters) -> Column:
    """The filters' conjunction; an unknown name raises, a null value doesn't count."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    return reduce(lambda a, b: a & b, [FILTERS[k](v) for k, v in filters.items() if v is not None], F.lit(True))


def apply(df: DataFrame, **filters) -> DataFrame:
    return df.where(condition(**filters))


def untrusted(source: Column) -> Column:
    return ~F.coalesce(trusted(source), F.lit(False))


def citable(source: Column, flagged: Column, include_fallback: bool = False) -> Column:
    """May be cited: a trusted or unstated source (any, with include_fallback), and not flagged."""
    return (F.lit(include_fallback) | source.isNull() | trusted(source)) & ~F.coalesce(flagged, F.lit(False))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """A page in a total order, and the number of all rows."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def gate(deterministic: Column, mode: Column, confidence: Column, form: Column) -> Column:
    """Where an incoming file goes: dispatch, low_confidence or draft."""
    sure = deterministic | (mode.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) >= 0.6))
    return F.when(sure, "dispatch").when(form.isNotNull() & (form != "unknown"), "low_confidence").otherwise("draft")


#: What a hit of retrieval shows, and a row of the review queue.
HIT_COLUMNS = ("clause_id", "section_id", "ctext", "process_type", "mood", "modality", "tenor", "theme_type", "annotation_source", "score")
QUEUE_COLUMNS = ("clause_id", "section_id", "document_key", "collection", "idx", "ctext", "process_type", "mood", "modality", "tenor", "theme_type", "topical_theme", "annotation_source", "queued_at")


def projected(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df in these columns, in this order; one that it lacks is null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def parameters(raw: dict[str, str | None]) -> dict:
    """Parameters of a request: blanks are nulls, numbers are numbers, limit is 1 or more and offset 0 or more; the old key `id` is refused."""
    if "id" in raw:
        raise ValueError("id is no longer taken; use clause_id")
    out: dict = {}
    for k, v in raw.items():
        v = v.strip() if isinstance(v, str) else v
        if v in ("", None):
            out[k] = None
        elif k in ("limit", "offset"):
            out[k] = max(1 if k == "limit" else 0, int(v))
        elif k.startswith(("min_", "max_")):
            out[k] = float(v)
        else:
            out[k] = v
    return out


def run_state(status: Column, heartbeat: Column, as_of: Column, after_s: int = 30, alive: Column | None = None) -> Column:
    """running, dead (its process is known to be gone), stalled (no heartbeat for longer than after_s), or the stored status."""
    late = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(heartbeat.cast("timestamp")) > after_s * 1_000_000
    gone = F.lit(False) if alive is None else ~F.coalesce(alive, F.lit(True))
    return F.when(status != "running", status).when(gone, "dead").when(late, "stalled").otherwise("running")
