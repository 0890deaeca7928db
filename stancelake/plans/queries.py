"""The catalogue: every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancelake.contracts import MOODS, PROCESSES, TRUSTED
from stancelake.functions import labels, lexicon, text as tx
from stancelake.operators import annotation, catalog, clauses as cl, conversation as cv, digest, filters, graph, grounding, kb, retrieval, sinks, topics
from stancelake.sources import exports
from stancelake.tables import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    """Register a function under its own name, and its SQL where there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clause_rows(spark: SparkSession, d: str) -> DataFrame:
    """Conversation clauses with the surface instrument's payloads (a test instrument, not a linguistic finding)."""
    units = cl.turn_units(read(spark, d, "conversations"))
    return cl.surface(cl.split_clauses(units, "conv_id", "turn", F.col("speaker").alias("role")))


def turn_rows(spark: SparkSession, d: str) -> DataFrame:
    return cv.turns(clause_rows(spark, d))


_M, _P = ", ".join(f"'{m}'" for m in MOODS), ", ".join(f"'{p}'" for p in PROCESSES)


def _clauses(table: str = "conversations", prefix: str = "conv_id||'#turn-'||turn", keys: str = "conv_id, turn, role", seat: str = "(conv_id*31 + turn*7 + idx) % 10") -> str:
    return f"""s AS (SELECT {keys}, {prefix} AS section_id, unnest(l) AS ctext, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT *, regexp_extract_all(text, '[^.!?\\n]+[.!?]+') AS l FROM {table})),
 w AS (SELECT *, length(regexp_replace(ctext, '[^A-Za-zÀ-ÿ]', '', 'g')) AS letters, len(regexp_extract_all(ctext, '[^ \\n]+')) AS words, length(ctext) - length(replace(ctext, ',', '')) AS commas FROM s),
 c AS (SELECT *, section_id||':'||idx AS clause_id, least(1000, (100*letters)//greatest(words, 1)) AS tenor_milli, greatest(0, 1000 - 500*commas) AS modality_milli,
  ([{_M}])[(words % 7) + 1] AS mood, ([{_P}])[(letters % 6) + 1] AS process_type, {seat} AS seat,
  CASE WHEN {seat} <= 5 THEN 'llm' WHEN {seat} = 6 THEN 'human' WHEN {seat} = 7 THEN 'fallback' WHEN {seat} = 8 THEN 'stub' ELSE 'chunk_artifact' END AS annotation_source FROM w)"""


C = "WITH " + _clauses()
T = (
    C
    + """, mc AS (SELECT conv_id, turn, mood, count(*) AS n, min(idx) AS seen FROM c GROUP BY ALL),
 md AS (SELECT conv_id, turn, mood FROM mc QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, seen) = 1),
 pc AS (SELECT conv_id, turn, string_agg(process_type||':'||n, ' ' ORDER BY process_type||':'||n) AS process_counts FROM (SELECT conv_id, turn, process_type, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT g.*, md.mood AS dominant_mood, pc.process_counts, floor(tenor_sum/n_clauses::DOUBLE + 0.5)/1000.0 AS avg_tenor, floor(modality_sum/n_clauses::DOUBLE + 0.5)/1000.0 AS avg_modality,
  floor(tenor_sum/n_clauses::DOUBLE + 0.5)::BIGINT AS tm, floor(modality_sum/n_clauses::DOUBLE + 0.5)::BIGINT AS mm
  FROM (SELECT conv_id, turn, any_value(role) AS speaker, count(*) AS n_clauses, sum(tenor_milli)::BIGINT AS tenor_sum, sum(modality_milli)::BIGINT AS modality_sum, count(*) FILTER (annotation_source IN ('llm','human')) AS n_trusted FROM c GROUP BY conv_id, turn) g
  JOIN md USING (conv_id, turn) JOIN pc USING (conv_id, turn)),
 sh AS (SELECT *, tm - lag(tm) OVER o AS tenor_shift_milli, mm - lag(mm) OVER o AS modality_shift_milli FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"""
)


# --- clauses and filters ------------------------------------------------------------------------


@query(C + " SELECT conv_id, turn, idx::BIGINT AS idx, clause_id, ctext FROM c")
def clause_scan(spark, d):
    return clause_rows(spark, d).select("conv_id", "turn", "idx", "clause_id", "ctext")


@query(C + " SELECT clause_id, words::BIGINT AS words, letters::BIGINT AS letters, tenor_milli::BIGINT AS tenor_milli, modality_milli::BIGINT AS modality_milli, mood, process_type, annotation_source FROM c")
def clause_payloads(spark, d):
    return clause_rows(spark, d).select("clause_id", "words", "letters", "tenor_milli", "modality_milli", "mood", "process_type", "annotation_source")


@query(C + " SELECT clause_id, sha256(section_id||'|'||idx||'|'||ctext) AS stable_id FROM c")
def stable_ids(spark, d):
    return clause_rows(spark, d).select("clause_id", cl.stable_id(F.col("section_id"), F.col("idx"), F.col("ctext")).alias("stable_id"))


@query(C + " SELECT clause_id, ctext, process_type, mood, tenor_milli::BIGINT AS tenor_milli, annotation_source FROM c WHERE annotation_source = 'llm'")
def payload_join(spark, d):
    base, said, how = cl.separate(clause_rows(spark, d))
    return cl.rejoin(base, said, how).where("annotation_source = 'llm'").select("clause_id", "ctext", "process_type", "mood", "tenor_milli", "annotation_source")


@query(C + " SELECT clause_id, mood, process_type FROM c WHERE mood = 'declarative' AND modality_milli >= 500 AND tenor_milli <= 600 AND tenor_milli >= 200")
def stance_filter(spark, d):
    df = clause_rows(spark, d).withColumns({"modality": F.col("modality_milli") / 1000, "tenor": F.col("tenor_milli") / 1000})
    return filters.apply(df, mood="declarative", min_modality=0.5, max_tenor=0.6, min_tenor=0.2, process_type=None).select("clause_id", "mood", "process_type")


@query(C + " SELECT conv_id, clause_id, idx::BIGINT AS idx, (SELECT count(*) FROM c WHERE annotation_source = 'llm') AS total FROM c WHERE annotation_source = 'llm' ORDER BY idx, clause_id LIMIT 25 OFFSET 50")
def clause_page(spark, d):
    df = filters.apply(clause_rows(spark, d), annotation_source="llm")
    rows, total = filters.page(df, ["idx", "clause_id"], 25, 50)
    return rows.select("conv_id", "clause_id", "idx", F.lit(total).cast("long").alias("total"))


@query(C + " SELECT clause_id, ctext FROM c WHERE section_id = '0#turn-1'")
def find_section(spark, d):
    return clause_rows(spark, d).where("section_id = '0#turn-1'").select("clause_id", "ctext")


@query(C + " SELECT clause_id, annotation_source, seat % 3 <> 0 AND annotation_source IN ('llm','human') AS citable FROM c WHERE annotation_source NOT IN ('llm','human') OR seat % 2 = 0")
def citable_clauses(spark, d):
    seat = (F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("idx")) % 10
    df = clause_rows(spark, d).where(filters.untrusted(F.col("annotation_source")) | (seat % 2 == 0))
    return df.select("clause_id", "annotation_source", filters.citable(F.col("annotation_source"), seat % 3 == 0).alias("citable"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' OR (event_type <> 'error' AND value >= 6) THEN 'dispatch' WHEN event_type <> 'view' THEN 'low_confidence' ELSE 'draft' END AS route FROM events""")
def ingest_gate(spark, d):
    e = read(spark, d, "events")
    route = filters.gate(F.col("event_type") == "signup", F.when(F.col("event_type") != "error", F.col("event_type")), F.col("value") / 10, F.when(F.col("event_type") == "view", "unknown").otherwise(F.col("event_type")))
    return e.select("event_id", route.alias("route"))


# --- turns --------------------------------------------------------------------------------------


@query(T + " SELECT conv_id, turn, speaker, n_clauses, avg_tenor, avg_modality, dominant_mood, process_counts FROM t")
def turn_aggregates(spark, d):
    return turn_rows(spark, d).select("conv_id", "turn", "speaker", "n_clauses", "avg_tenor", "avg_modality", "dominant_mood", "process_counts")


@query(T + " SELECT conv_id, turn, speaker, tenor_shift_milli, modality_shift_milli FROM sh")
def tenor_shift(spark, d):
    return cv.shifts(turn_rows(spark, d)).select("conv_id", "turn", "speaker", "tenor_shift_milli", "modality_shift_milli")


@query(T + " SELECT conv_id, turn, speaker, tenor_shift_milli, CASE WHEN tenor_shift_milli > 0 THEN 'increased' ELSE 'decreased' END AS direction FROM sh WHERE abs(tenor_shift_milli) > 150")
def significant_shifts(spark, d):
    return cv.significant_shifts(turn_rows(spark, d))


_COHERENCE = "(conv_id*17 + turn*29) % 1000"


@query(
    T
    + f""" SELECT conv_id, turn, 'tenor_shift' AS type, tenor_shift_milli AS magnitude_milli FROM sh WHERE abs(tenor_shift_milli) > 150
 UNION ALL SELECT conv_id, turn, 'modality_shift', modality_shift_milli FROM sh WHERE abs(modality_shift_milli) > 300
 UNION ALL SELECT conv_id, turn, CASE WHEN dominant_mood IN ('interrogative','imperative') OR avg_modality < 0.4 OR avg_tenor < 0.4 THEN 'deflation_anomaly' ELSE 'semantic_anomaly' END, {_COHERENCE} FROM t WHERE {_COHERENCE} < 350"""
)
def key_moments(spark, d):
    t = turn_rows(spark, d)
    return cv.key_moments(t, t.select("conv_id", "turn", F.expr(_COHERENCE).alias("coherence_milli")))


@query(
    T
    + """, g AS (SELECT speaker, count(*) AS turn_count, count(*) FILTER (n_trusted > 0) AS n_ok, sum(tm) FILTER (n_trusted > 0)::BIGINT AS ts, sum(mm) FILTER (n_trusted > 0)::BIGINT AS ms, min(tm) FILTER (n_trusted > 0) AS tenor_min_milli, max(tm) FILTER (n_trusted > 0) AS tenor_max_milli, sum(tm*tm) FILTER (n_trusted > 0)::BIGINT AS sq FROM t GROUP BY speaker),
 m AS (SELECT *, floor(ts/n_ok::DOUBLE + 0.5)::BIGINT AS mean FROM g)
 SELECT speaker, turn_count, CASE WHEN n_ok > 0 THEN mean/1000.0 END AS avg_tenor, tenor_min_milli, tenor_max_milli,
  CASE WHEN n_ok = 0 THEN NULL WHEN n_ok < 2 THEN 0.0::DOUBLE ELSE floor((sq - 2*mean*ts + n_ok*mean*mean)::DOUBLE/n_ok/100 + 0.5)/10000.0 END AS tenor_variance,
  CASE WHEN n_ok > 0 THEN floor(ms/n_ok::DOUBLE + 0.5)/1000.0 END AS avg_modality FROM m"""
)
def speaker_profiles(spark, d):
    return cv.speaker_profiles(turn_rows(spark, d))


@query(T + " SELECT speaker, dominant_mood, count(*) AS n, floor(count(*)*1000.0::DOUBLE/sum(count(*)) OVER (PARTITION BY speaker) + 0.5)/1000.0 AS share FROM t GROUP BY speaker, dominant_mood")
def mood_distribution(spark, d):
    return cv.mood_distribution(turn_rows(spark, d))


@query(C + " SELECT role AS speaker, process_type, count(*) AS n FROM c GROUP BY ALL")
def process_totals(spark, d):
    return cv.process_totals(clause_rows(spark, d))


@query(
    C
    + """ SELECT process_type, count(*) AS clause_count, count(*) FILTER (annotation_source IN ('llm','human')) AS annotated_count,
 floor((sum(tenor_milli) FILTER (annotation_source IN ('llm','human')))::DOUBLE/(count(*) FILTER (annotation_source IN ('llm','human'))) + 0.5)/1000.0 AS avg_tenor,
 floor((sum(modality_milli) FILTER (annotation_source IN ('llm','human')))::DOUBLE/(count(*) FILTER (annotation_source IN ('llm','human'))) + 0.5)/1000.0 AS avg_modality FROM c GROUP BY process_type"""
)
def process_stance(spark, d):
    return cv.process_stance(clause_rows(spark, d))


@query(
    T
    + """, p AS (SELECT conv_id, arg_max(turn, tm*1000 - turn) AS a, arg_min(turn, tm*1000 + turn) AS b, arg_max(turn, mm*1000 - turn) AS e, arg_min(turn, mm*1000 + turn) AS f FROM t GROUP BY conv_id),
 l AS (SELECT conv_id, 'Most Formal' AS label, a AS turn FROM p UNION ALL SELECT conv_id, 'Most Casual', b FROM p UNION ALL SELECT conv_id, 'Most Certain', e FROM p UNION ALL SELECT conv_id, 'Most Hedged', f FROM p)
 SELECT l.conv_id, label, l.turn, speaker, CASE WHEN label IN ('Most Formal','Most Casual') THEN avg_tenor ELSE avg_modality END AS value FROM l JOIN t USING (conv_id, turn)"""
)
def example_passages(spark, d):
    return cv.example_passages(turn_rows(spark, d))


@query(
    T
    + """, e AS (SELECT conv_id, count(*) AS n_turns, count(DISTINCT speaker) AS ns, arg_max(tm, turn) - arg_min(tm, turn) AS trend_milli FROM t GROUP BY conv_id),
 k AS (SELECT conv_id, speaker, n FROM (SELECT conv_id, speaker, count(*) AS n, min(turn) AS seen FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, seen) = 1)
 SELECT conv_id, trend_milli, CASE WHEN trend_milli > 100 THEN 'increased' WHEN trend_milli < -100 THEN 'decreased' END AS trend, CASE WHEN ns > 1 THEN speaker END AS top_speaker, CASE WHEN ns > 1 THEN n END AS top_turns, n_turns FROM e JOIN k USING (conv_id)"""
)
def conversation_insights(spark, d):
    return cv.insights(turn_rows(spark, d))


@query(T + " SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS turn_id, turn, speaker, avg_tenor, tenor_shift_milli FROM sh")
def tenor_timeline(spark, d):
    return cv.timeline(turn_rows(spark, d))


@query(C + """ SELECT conv_id, turn, process_type AS dominant_process FROM (SELECT conv_id, turn, process_type, count(*) AS n, min(idx) AS seen FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, seen) = 1""")
def field_evolution(spark, d):
    return cv.field_evolution(clause_rows(spark, d))


@query("""WITH m AS (SELECT *, CASE WHEN role = lag(role) OVER o THEN 0 ELSE 1 END AS new FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM m)
 SELECT conv_id, island, any_value(role) AS speaker, min(turn) AS first_turn, count(*) AS n_merged, string_agg(text, ' ' ORDER BY turn) AS merged_text FROM i GROUP BY conv_id, island""")
def speaker_islands(spark, d):
    return cv.speaker_islands(read(spark, d, "conversations"))


@query("""SELECT conv_id, role, min(turn) AS first_at, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role)::INTEGER AS position FROM conversations GROUP BY conv_id, role""")
def first_seen_speakers(spark, d):
    return cv.first_seen(read(spark, d, "conversations"), "role", "conv_id", "turn")


@query("""WITH l AS (SELECT user_id, event_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events)
 SELECT user_id, count(*) FILTER (back) AS n_backward, count(*) FILTER (back) = 0 AS in_order FROM l GROUP BY user_id""")
def temporal_order(spark, d):
    return cv.temporal_order(read(spark, d, "events"), "user_id", "event_id", "value")


@query(C + """ SELECT role, count(*) AS total, count(*) FILTER (annotation_source='llm') AS llm, count(*) FILTER (annotation_source='human') AS human, count(*) FILTER (annotation_source='fallback') AS fallback, count(*) FILTER (annotation_source='stub') AS stub, count(*) FILTER (annotation_source='chunk_artifact') AS chunk_artifact,
 count(*) FILTER (annotation_source NOT IN ('llm','human')) AS defaulted, floor(count(*) FILTER (annotation_source NOT IN ('llm','human'))*1000.0::DOUBLE/count(*) + 0.5)/10.0 AS defaulted_percent FROM c GROUP BY role""")
def annotation_coverage(spark, d):
    return cv.coverage(clause_rows(spark, d), ["role"])


@query(C + """ SELECT conv_id, count(*) FILTER (annotation_source <> 'chunk_artifact') AS n_reliable, coalesce(floor((sum(modality_milli) FILTER (annotation_source <> 'chunk_artifact'))::DOUBLE/nullif(count(*) FILTER (annotation_source <> 'chunk_artifact'), 0) + 0.5)/1000.0, 0.5) AS avg_modality FROM c GROUP BY conv_id""")
def reliable_means(spark, d):
    return cv.reliable_means(clause_rows(spark, d), ["conv_id"])


_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "CCONJ", "SCONJ", "PRON", "PROPN")


@query("""WITH k AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS lemma FROM conversations),
 p AS (SELECT *, (['NOUN','VERB','ADJ','ADV','CCONJ','SCONJ','PRON','PROPN'])[(length(lemma) % 8) + 1] AS pos FROM k),
 g AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (regexp_matches(pos, 'NOUN|VERB|ADJ|ADV')) AS c, count(DISTINCT lemma) FILTER (regexp_matches(pos, 'NOUN|VERB|ADJ|ADV')) AS u, count(*) FILTER (regexp_matches(pos, 'CCONJ|SCONJ')) AS cj, count(*) FILTER (contains(pos, 'PRON')) AS pr FROM p GROUP BY ALL)
 SELECT conv_id, turn, CASE WHEN c > 1 THEN 1.0::DOUBLE - u/c::DOUBLE ELSE 0.0::DOUBLE END AS repetition_score, cj/n::DOUBLE AS conjunction_density, pr/n::DOUBLE AS pronoun_density FROM g""")
def cohesion(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("lemma"))
    pos = F.element_at(F.array(*[F.lit(x) for x in _TAGS]), (F.length("lemma") % 8 + 1).cast("int"))
    return cv.cohesion(t.withColumn("pos", pos), ["conv_id", "turn"])


@query(C + """, n AS (SELECT conv_id, turn, count(*) AS n FROM c GROUP BY ALL) SELECT conv_id, turn, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS boundary FROM n""")
def chunk_boundaries(spark, d):
    return cv.chunk_boundaries(clause_rows(spark, d).groupBy("conv_id", "turn").agg(F.count("*").alias("n")), "conv_id", "turn", "n")


@query("""WITH p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split(text, E'\\n'), lambda x: x <> '') AS l FROM documents)),
 f AS (SELECT *, regexp_extract(ltrim(piece), '^[A-Za-z'']+') AS fw, right(rtrim(piece), 1) IN ('.','!','?','"') AS term FROM p),
 g AS (SELECT *, fw <> '' AND ((fw[1] = lower(fw[1]) AND fw[1] <> upper(fw[1])) OR lower(fw) IN ('and','but','or','because','although','though','since','unless','while','which','that','where','when')) AS cont FROM f),
 h AS (SELECT *, coalesce(NOT lag(term) OVER o AND cont, false) AS into_ FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
 SELECT doc_id, pos::INTEGER AS pos, into_ OR coalesce(lead(into_) OVER (PARTITION BY doc_id ORDER BY pos), false) AS is_artifact FROM h""")
def chunk_artifacts(spark, d):
    pieces = read(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("pos", "piece"))
    return cv.chunk_artifacts(pieces, "doc_id", "pos", "piece").select("doc_id", "pos", "is_artifact")


# --- retrieval ----------------------------------------------------------------------------------

_WORDS = ["the", "of", "and"]
_QUERY_ID = 7
_TOK = "string_split_regex(lower(text), '[^a-z]+')"
_SCORE = " + ".join(f"len(list_filter({_TOK}, lambda x: x = '{w}'))" for w in _WORDS)
_HAS = " AND ".join(f"list_contains({_TOK}, '{w}')" for w in _WORDS)
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT doc_id, score::BIGINT AS keyword_score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS keyword_rank FROM (SELECT doc_id, {_SCORE} AS score FROM documents WHERE {_HAS} ORDER BY score DESC, doc_id LIMIT 30)")
def keyword_topk(spark, d):
    return retrieval.keyword_top(read(spark, d, "documents"), _WORDS, 30).select("doc_id", "keyword_score", "keyword_rank")


def _vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where(F.col("vec_id") == _QUERY_ID).first()["embedding"]]


@query(f"SELECT a.vec_id, row_number() OVER (ORDER BY {_COS} DESC, a.vec_id)::INTEGER AS semantic_rank FROM embeddings a, embeddings b WHERE b.vec_id = {_QUERY_ID} QUALIFY semantic_rank <= 30")
def vector_topk(spark, d):
    return retrieval.vector_top(read(spark, d, "embeddings"), _vector(spark, d), 30).select("vec_id", "semantic_rank")


@query(
    f"""WITH s AS (SELECT a.vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, a.vec_id)::INTEGER AS semantic_rank FROM embeddings a, embeddings b WHERE b.vec_id = {_QUERY_ID} QUALIFY semantic_rank <= 30),
 k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS keyword_rank FROM (SELECT doc_id, {_SCORE} AS score FROM documents WHERE {_HAS}) QUALIFY keyword_rank <= 30)
 SELECT id, semantic_rank, keyword_rank, floor((coalesce(1.0::DOUBLE/(60+semantic_rank), 0) + coalesce(1.0::DOUBLE/(60+keyword_rank), 0))*1000000 + 0.5)/1000000.0 AS rrf_score FROM s FULL JOIN k USING (id) ORDER BY rrf_score DESC, id LIMIT 10"""
)
def rrf_fusion(spark, d):
    s = retrieval.vector_top(read(spark, d, "embeddings"), _vector(spark, d), 30).withColumnRenamed("vec_id", "id")
    k = retrieval.keyword_top(read(spark, d, "documents"), _WORDS, 30).withColumnRenamed("doc_id", "id")
    return retrieval.fuse(s, k, 10)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_SCORE} DESC, doc_id)::INTEGER AS keyword_rank FROM documents WHERE {_HAS} AND source = 'src3' QUALIFY keyword_rank <= 9")
def filter_before_limit(spark, d):
    return retrieval.keyword_top(read(spark, d, "documents").where("source = 'src3'"), _WORDS, 9).select("doc_id", "keyword_rank")


@query(f"SELECT a.vec_id AS source, b.vec_id AS target, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id)::INTEGER AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND {_COS} >= 0.2 QUALIFY rank <= 5")
def semantic_edges(spark, d):
    v = read(spark, d, "embeddings")
    return retrieval.neighbours(v, v.where("vec_id % 50 = 0"), least=0.2, k=5, by="label").select("source", "target", "rank")


# --- knowledge base -----------------------------------------------------------------------------

_DOC = "WITH " + _clauses("documents", "doc_id::VARCHAR", "doc_id", "(doc_id*31 + idx) % 10")
_UPDATED = "TIMESTAMP '2024-01-31 00:00:00' - to_seconds((doc_id * 79191919) % 63072000)"
_Q = (
    _DOC
    + f""", mc AS (SELECT doc_id, mood, count(*) AS n, min(idx) AS seen FROM c GROUP BY ALL), md AS (SELECT doc_id, mood FROM mc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) = 1),
 pc AS (SELECT doc_id, process_type, count(*) AS n, min(idx) AS seen FROM c GROUP BY ALL), pd AS (SELECT doc_id, process_type FROM pc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) = 1),
 g AS (SELECT doc_id, count(*) AS n, sum(CASE annotation_source WHEN 'llm' THEN 1000 WHEN 'human' THEN 1000 WHEN 'fallback' THEN 400 WHEN 'stub' THEN 100 WHEN 'chunk_artifact' THEN 150 ELSE 300 END)::BIGINT AS ss, sum(modality_milli)::BIGINT AS ms,
  count(*) FILTER (annotation_source='llm') AS llm, count(*) FILTER (annotation_source='human') AS human, count(*) FILTER (annotation_source NOT IN ('llm','human')) AS fallback FROM c GROUP BY doc_id),
 a AS (SELECT d.doc_id, d.text, d.source, coalesce(g.n, 0) AS n, ss, ms, md.mood, pd.process_type, llm, human, fallback, {_UPDATED} AS updated, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE greatest(1.0::DOUBLE - ((d.doc_id * 79191919) % 63072000)*1000000.0::DOUBLE/2592000000000.0::DOUBLE/18, 0.0::DOUBLE) END AS fr0 FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN md USING (doc_id) LEFT JOIN pd USING (doc_id)),
 q AS (SELECT *, CASE WHEN n > 0 THEN least(greatest(floor(0.4::DOUBLE*(ss/n::DOUBLE) + 0.3::DOUBLE*(ms/n::DOUBLE) + 200.0::DOUBLE*least(n/20.0::DOUBLE, 1.0::DOUBLE) + 100.0::DOUBLE*coalesce(fr0, 0.5::DOUBLE) + 0.5::DOUBLE), 0), 1000) ELSE 0 END::BIGINT AS quality_milli FROM a),
 k AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'ai responses?\\s+may\\s+include\\s+mistakes') THEN 'ai_generated' WHEN doc_id % 23 = 0 THEN 'draft' WHEN doc_id % 29 = 0 THEN 'tutorial' WHEN n <= 2 AND length(text) < 250 THEN 'index'
  WHEN n > 0 AND ms/n::DOUBLE/1000 > 0.7 AND mood = 'declarative' THEN 'technical_reference' WHEN n > 0 AND process_type = 'material' AND mood = 'imperative' THEN 'tutorial' ELSE 'research_note' END AS content_type FROM q),
 z AS (SELECT *, CASE WHEN content_type IN ('ai_generated','draft','code_snippet','image') THEN 'review' WHEN quality_milli < 350 THEN 'archive' WHEN content_type IN ('technical_reference','tutorial') AND quality_milli >= 650 THEN 'keep' WHEN quality_milli >= 500 THEN 'update' ELSE 'archive' END AS action,
  CASE WHEN quality_milli >= 650 THEN 'high' WHEN quality_milli >= 400 THEN 'medium' ELSE 'low' END AS bucket, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE updated END AS upd FROM k)"""
)


def doc_clauses(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("section_id"), "text")
    c = cl.split_clauses(units, "doc_id").withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0).cast("long")})
    return cl.surface(c).drop("conv_id", "turn")


def assessed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as artifacts; tags and ages are made from ids, so that every branch occurs."""
    c = doc_clauses(spark, d)
    g = kb.profiled(c, "doc_id")
    as_of = F.lit(AS_OF).cast("timestamp")
    updated = F.when(F.col("doc_id") % 11 != 0, F.timestamp_micros(F.unix_micros(as_of) - (F.col("doc_id") * 79191919) % 63072000 * 1_000_000))
    tags = F.when(F.col("doc_id") % 23 == 0, F.array(F.lit("WIP"))).when(F.col("doc_id") % 29 == 0, F.array(F.lit("a-guide"))).otherwise(F.array().cast("array<string>"))
    a = read(spark, d, "documents").select("doc_id", "text", "source").join(g, "doc_id", "left")
    a = a.withColumns({"n": F.coalesce("n", F.lit(0)), "last_updated": updated})
    a = a.withColumn("quality_milli", kb.quality_milli(F.col("source_sum"), F.col("modality_sum"), F.col("n"), kb.freshness(F.col("last_updated"), as_of)))
    a = a.withColumn("content_type", kb.content_type(F.col("text"), F.col("n"), F.try_divide("modality_sum", "n") / 1000, F.col("dominant_mood"), F.col("dominant_process_type"), tags))
    return a.withColumns({"artifact_id": F.col("doc_id"), "action": kb.action(F.col("content_type"), F.col("quality_milli")), "bucket": kb.bucket(F.col("quality_milli")), "is_stale": kb.stale(F.col("last_updated"), as_of)})


@query(_Q + " SELECT doc_id, n, quality_milli, bucket FROM z")
def kb_quality(spark, d):
    return assessed(spark, d).select("doc_id", "n", "quality_milli", "bucket")


@query(_Q + " SELECT doc_id, content_type FROM z")
def kb_content_type(spark, d):
    return assessed(spark, d).select("doc_id", "content_type")


@query(_Q + " SELECT doc_id, content_type, quality_milli, action FROM z")
def kb_manifest(spark, d):
    return assessed(spark, d).select("doc_id", "content_type", "quality_milli", "action")


@query(_Q + " SELECT a.action, count(z.doc_id) AS n FROM (SELECT unnest(['keep','update','merge_candidate','archive','review']) AS action) a LEFT JOIN z USING (action) GROUP BY a.action")
def kb_action_counts(spark, d):
    from stancelake.contracts import ACTIONS

    every = spark.createDataFrame([(a,) for a in ACTIONS], "action string")
    return every.join(assessed(spark, d).groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n"))


@query(_Q + " SELECT content_type, count(*) AS n, count(*) FILTER (bucket='high') AS high, count(*) FILTER (bucket='medium') AS medium, count(*) FILTER (bucket='low') AS low FROM z GROUP BY content_type")
def kb_distribution(spark, d):
    return assessed(spark, d).groupBy("content_type").agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("high", "medium", "low")])


@query(_Q + " SELECT doc_id, coalesce(llm, 0) AS llm, coalesce(human, 0) AS human, coalesce(fallback, 0) AS fallback, n AS total FROM z")
def kb_coverage(spark, d):
    return assessed(spark, d).select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("llm", "human", "fallback")], F.col("n").alias("total"))


@query(_Q + " SELECT doc_id, content_type, quality_milli, row_number() OVER (PARTITION BY content_type ORDER BY quality_milli DESC, doc_id)::INTEGER AS place FROM z QUALIFY place <= 5")
def kb_top_per_type(spark, d):
    return kb.top_per_type(assessed(spark, d)).select("doc_id", "content_type", "quality_milli", "place")


@query(_Q + " SELECT doc_id, strftime(upd, '%Y-%m-%dT%H:%M:%SZ') AS last_updated FROM z WHERE upd IS NOT NULL AND ((doc_id * 79191919) % 63072000) > 18*2592000")
def stale_flags(spark, d):
    return assessed(spark, d).where("is_stale").select("doc_id", F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_updated"))


# --- catalog ------------------------------------------------------------------------------------


@query(_DOC + " SELECT clause_id, annotation_source FROM c WHERE annotation_source NOT IN ('llm','human') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 1)")
def review_queue(spark, d):
    reviews = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"))
    return catalog.review_queue(doc_clauses(spark, d), reviews, "doc_id").select("clause_id", "annotation_source")


@query("""WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 're_annotated' END AS decision, ts FROM events)
 SELECT user_id, arg_max(decision, (ts, event_id)) AS decision, count(*) AS n_decisions FROM r WHERE decision IN ('accepted','rejected') GROUP BY user_id""")
def latest_decision(spark, d):
    decision = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("re_annotated")
    return catalog.latest_decision(read(spark, d, "events").withColumn("decision", decision), "user_id", ["ts", "event_id"])


@query("""WITH r AS (SELECT user_id, max(ts) AS heartbeat, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id)
 SELECT user_id, CASE WHEN last_event IN ('purchase','signup') THEN 'done' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(heartbeat) > 86400000000 THEN 'stalled' ELSE 'running' END AS state FROM r""")
def run_state(spark, d):
    runs = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    status = F.when(F.col("last_event").isin("purchase", "signup"), "done").otherwise("running")
    return runs.select("user_id", filters.run_state(status, F.col("heartbeat"), F.lit(AS_OF).cast("timestamp"), 86400).alias("state"))


@query("SELECT user_id, max(ts) AS started_at FROM events GROUP BY user_id ORDER BY started_at DESC, user_id LIMIT 10")
def newest_runs(spark, d):
    return catalog.newest(read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("started_at")), 10, key="user_id")


@query("""WITH r AS (SELECT user_id, max(ts) AS heartbeat, min(ts) AS started_at, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id)
 SELECT user_id, started_at FROM r WHERE last_event NOT IN ('purchase','signup') AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(heartbeat) > 86400000000 ORDER BY started_at DESC, user_id LIMIT 10""")
def newest_stalled_runs(spark, d):
    runs = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.min("ts").alias("started_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    status = F.when(F.col("last_event").isin("purchase", "signup"), "done").otherwise("running")
    state = filters.run_state(status, F.col("heartbeat"), F.lit(AS_OF).cast("timestamp"), 86400)
    return catalog.newest(runs.where(state.isin("stalled", "dead")), 10, key="user_id").select("user_id", "started_at")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree: node, parent, label, position."""
    r = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("label"))
    return r.unionByName(n).unionByName(c)


_TREE = """RECURSIVE e AS (SELECT 'r'||r_regionkey AS node, NULL AS parent, r_name AS label FROM region UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, n_name FROM nation UNION ALL SELECT 'c'||c_custkey, 'n'||c_nationkey, c_name FROM customer),
 up(node, ancestor, level) AS (SELECT node, parent, 1 FROM e WHERE parent IS NOT NULL UNION ALL SELECT u.node, e.parent, u.level+1 FROM up u JOIN e ON e.node = u.ancestor WHERE e.parent IS NOT NULL)"""


@query(f"WITH {_TREE} SELECT node, ancestor, level::INTEGER AS level FROM up")
def ancestors(spark, d):
    return graph.ancestors(_tree(spark, d))


@query(f"WITH {_TREE}, p AS (SELECT up.node, count(*) AS depth, string_agg(a.label, ' > ' ORDER BY level DESC) AS above FROM up JOIN e a ON a.node = up.ancestor GROUP BY up.node) SELECT e.node, coalesce(depth, 0) AS depth, CASE WHEN above IS NULL THEN label ELSE above||' > '||label END AS path FROM e LEFT JOIN p USING (node)")
def catalog_tree(spark, d):
    return graph.paths(_tree(spark, d))


@query(f"WITH {_TREE} SELECT node FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.parent = e.node)")
def tree_leaves(spark, d):
    return graph.leaves(_tree(spark, d))


@query(f"WITH {_TREE}, p AS (SELECT up.node, string_agg(a.label, ' ' ORDER BY level DESC) AS above FROM up JOIN e a ON a.node = up.ancestor GROUP BY up.node) SELECT e.node, coalesce(above||' ', '')||label AS evidence FROM e LEFT JOIN p USING (node)")
def widened_evidence(spark, d):
    t = _tree(spark, d)
    return graph.widened(t, t, "label")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1 WHEN p_partkey % 10 = 4 THEN p_partkey - 1 WHEN p_partkey % 10 > 4 THEN p_partkey - 1 END AS parent FROM part),
 up(node, ancestor, level) AS (SELECT node, parent, 1 FROM e WHERE parent IS NOT NULL UNION ALL SELECT u.node, e.parent, u.level+1 FROM up u JOIN e ON e.node = u.ancestor WHERE u.level < 32 AND e.parent IS NOT NULL)
 SELECT DISTINCT node FROM up WHERE node = ancestor""")
def cycle_check(spark, d):
    k = F.col("p_partkey")
    parent = F.when(k % 10 == 3, k + 1).when(k % 10 == 4, k - 1).when(k % 10 > 4, k - 1)
    return graph.cycles(read(spark, d, "part").select(k.alias("node"), parent.alias("parent")))


@query(f"WITH {_TREE}, ch AS (SELECT 'c'||c_custkey AS node FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'n3'), lf AS (SELECT node FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.parent = e.node)), st AS (SELECT lf.node, (lf.node IN (SELECT node FROM ch)) OR EXISTS (SELECT 1 FROM up WHERE up.node = lf.node AND up.ancestor IN (SELECT node FROM ch)) AS on_ FROM lf), sp AS (SELECT node, on_ FROM st UNION ALL SELECT up.ancestor, on_ FROM st JOIN up USING (node)) SELECT node, CASE WHEN bool_and(on_) THEN 'full' WHEN bool_or(on_) THEN 'partial' ELSE 'none' END AS state FROM sp GROUP BY node")
def tree_selection(spark, d):
    chosen = read(spark, d, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(spark.createDataFrame([("n3",)], "node string"))
    return graph.selection(_tree(spark, d).drop("label"), chosen)


@query("SELECT n_regionkey AS k, count(l_orderkey) AS n_0, count(DISTINCT o_orderkey) AS n_1, count(DISTINCT c_custkey) AS n_2, count(DISTINCT n_nationkey) AS n_3 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_regionkey")
def collection_counts(spark, d):
    levels = [(read(spark, d, t), k, p) for t, k, p in (("nation", "n_nationkey", "n_regionkey"), ("customer", "c_custkey", "c_nationkey"), ("orders", "o_orderkey", "o_custkey"), ("lineitem", "l_linenumber", "l_orderkey"))]
    return catalog.descendant_counts(levels)


@query("SELECT r_name AS collection, n_name AS document, c_custkey AS section FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (1, 5, 9, 70)")
def locate_sections(spark, d):
    wanted = spark.createDataFrame([(1,), (5,), (9,), (70,)], "section_id long")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("document_id"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("collection_id"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("collection_id"), F.col("r_name").alias("name"))
    return catalog.located(c, n, r, wanted).select("collection", "document", F.col("section_id").alias("section"))


@query("SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INTEGER AS ordinal FROM lineitem")
def ordinal_backfill(spark, d):
    return catalog.ordinals(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "l_partkey", "ordinal")


@query("SELECT split_part(c_name, '#', 1) AS document_key, max(c_custkey) AS newest, min(c_custkey) AS oldest, count(*) AS section_count FROM customer GROUP BY 1")
def backfill_documents(spark, d):
    return catalog.documents_of(read(spark, d, "customer"), "c_name", "c_custkey")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL AND (d.doc_id IS NULL OR l.quality = 0) THEN l.quality ELSE d.quality END::INTEGER AS quality, CASE WHEN d.doc_id IS NULL THEN 'inserted' WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'updated' ELSE 'kept' END AS outcome
 FROM (SELECT doc_id, 1::INTEGER AS quality FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def upsert_rewrite(spark, d):
    old = read(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.lit(1).alias("quality"))
    return catalog.upsert(old, read(spark, d, "labels"), "doc_id", ["quality"], when=F.col("n_quality") == 0)


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE role = 'system'")
def replace_sections(spark, d):
    c = read(spark, d, "conversations")
    new = c.where("role = 'system'").select("conv_id", "turn", F.lit("new").alias("text"))
    return catalog.replace_section(c.select("conv_id", "turn", "text"), new, "conv_id")


@query("SELECT min(trim(c_mktsegment)) AS name FROM customer WHERE trim(c_mktsegment) <> '' AND lower(trim(c_mktsegment)) NOT IN ('household', 'machinery') GROUP BY lower(trim(c_mktsegment))")
def find_or_create(spark, d):
    have = spark.createDataFrame([(" Household",), ("MACHINERY ",)], "name string")
    return catalog.find_or_create(have, read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")))


@query(_DOC + """, k AS (SELECT clause_id, doc_id, sha256(section_id||idx||ctext) AS cache_key, annotation_source FROM c) SELECT 'hit' AS side, count(*) AS n, min(cache_key) AS least_key FROM k WHERE cache_key IN (SELECT cache_key FROM k WHERE doc_id % 4 = 0 AND annotation_source IN ('llm','human')) UNION ALL SELECT 'miss', count(*), min(cache_key) FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE doc_id % 4 = 0 AND annotation_source IN ('llm','human'))""")
def cache_partition(spark, d):
    rows = doc_clauses(spark, d).select("doc_id", "annotation_source", catalog.cache_key(F.col("section_id"), F.col("idx"), F.col("ctext")).alias("cache_key"))
    cache = rows.where((F.col("doc_id") % 4 == 0) & F.col("annotation_source").isin(*TRUSTED)).select("cache_key").distinct()
    hit, miss = catalog.cache_split(rows, cache)
    one = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.min("cache_key").alias("least_key"))
    return one(hit, "hit").unionByName(one(miss, "miss"))


@query("SELECT 'kept' AS side, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'purged', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def collection_purge(spark, d):
    gone = read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    stay, go = catalog.purge(read(spark, d, "orders"), gone, "o_custkey")
    return stay.agg(F.lit("kept").alias("side"), F.count("*").alias("n")).unionByName(go.agg(F.lit("purged").alias("side"), F.count("*").alias("n")))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def sections_with_gaps(spark, d):
    return catalog.distinct_of(read(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "P")


# --- grounding and text -------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_CW = "list_filter(list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z]+'), lambda x: length(x) >= 3)), lambda x: NOT list_contains([" + _STOP + "], x))"


@query(f"""WITH s AS (SELECT item_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark)),
 r AS (SELECT item_id, pos, sentence, CASE WHEN pos % 4 = 0 THEN NULL WHEN pos % 4 = 1 THEN 999999 ELSE (item_id + (pos % 2)) END AS ref FROM s),
 j AS (SELECT r.*, b.text AS cited, CASE WHEN b.text IS NULL THEN 0 ELSE len(list_intersect({_CW.format(x="sentence")}, {_CW.format(x="b.text")})) END AS shared FROM r LEFT JOIN benchmark b ON b.item_id = r.ref)
 SELECT item_id, pos::INTEGER AS pos, (CASE WHEN ref IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_refs, CASE WHEN ref IS NULL THEN 'no citation marker' WHEN cited IS NULL THEN 'clause not found' WHEN shared < 2 THEN 'no keyword overlap' ELSE 'grounded' END AS verdict FROM j""")
def citation_grounding(spark, d):
    b = read(spark, d, "benchmark")
    rows = grounding.sentence_rows(b, "item_id")
    ref = F.when(F.col("pos") % 4 == 1, F.lit(999999)).otherwise(F.col("item_id") + F.col("pos") % 2)
    cited = F.when(F.col("pos") % 4 == 0, F.col("sentence")).otherwise(F.concat("sentence", F.lit(" [doc:"), ref.cast("string"), F.lit("]")))
    return grounding.check_citations(rows.withColumn("sentence", cited), b, "item_id", "item_id", "text")


@query(f"""WITH s AS (SELECT item_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark)),
 j AS (SELECT s.item_id, pos % 3 = 0 AND len(list_intersect({_CW.format(x="sentence")}, {_CW.format(x="b.text")})) >= 2 AS ok FROM s JOIN benchmark b USING (item_id))
 SELECT item_id, count(*) AS n, count(*) FILTER (ok) AS grounded, count(*) FILTER (ok)/count(*)::DOUBLE AS coverage FROM j GROUP BY item_id""")
def citation_coverage(spark, d):
    b = read(spark, d, "benchmark")
    rows = grounding.sentence_rows(b, "item_id")
    cited = F.when(F.col("pos") % 3 == 0, F.concat("sentence", F.lit(" ["), F.col("item_id").cast("string"), F.lit("]"))).otherwise(F.col("sentence"))
    return grounding.citation_coverage(grounding.check_citations(rows.withColumn("sentence", cited), b, "item_id", "item_id", "text"), "item_id")


@query("""WITH n AS (SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+(?:\\.[0-9]+)?')) AS literal FROM pages), f AS (SELECT page_id, page_id % 1000 AS fact FROM pages UNION ALL SELECT page_id, 2 FROM pages)
 SELECT n.page_id, 0::INTEGER AS pos, literal, bool_or(f.fact = literal::DOUBLE) AS grounded FROM n JOIN f USING (page_id) GROUP BY n.page_id, literal""")
def digest_numbers(spark, d):
    p = read(spark, d, "pages")
    claims = grounding.number_claims(p.select("page_id", F.lit(0).alias("pos"), F.col("url").alias("sentence")), "page_id").distinct()
    facts = p.select("page_id", (F.col("page_id") % 1000).cast("double").alias("fact")).unionByName(p.select("page_id", F.lit(2.0).alias("fact")))
    return grounding.grounded_number(claims, facts, "page_id")


@query(T + """, m AS (SELECT conv_id, turn FROM sh WHERE abs(tenor_shift_milli) > 150) SELECT t.conv_id, t.turn, EXISTS (SELECT 1 FROM m WHERE m.conv_id = t.conv_id AND abs(m.turn - t.turn) <= 1) AS supported FROM t""")
def causal_support(spark, d):
    t = turn_rows(spark, d)
    return grounding.causal_support(t.select("conv_id", "turn"), cv.significant_shifts(t), "conv_id")


@query("SELECT 1.0 - (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END * (CASE user_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 10 END)))::DOUBLE / sum(CASE user_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 10 END)::DOUBLE AS precision FROM events")
def grounding_precision(spark, d):
    band = F.element_at(F.array(F.lit("high"), F.lit("median"), F.lit("low"), F.lit("none")), (F.col("user_id") % 4 + 1).cast("int"))
    claims = read(spark, d, "events").select((F.col("event_type") == "error").alias("failed"), F.round(grounding.claim_weight(band) * 10).alias("weight"))
    return grounding.weighted_precision(claims)


@query(f"SELECT item_id, len({_CW.format(x='text')}) AS n_words, array_to_string(list_sort({_CW.format(x='text')}), ' ') AS words FROM benchmark")
def content_words(spark, d):
    w = tx.content_words(F.col("text"))
    return read(spark, d, "benchmark").select("item_id", F.size(w).cast("long").alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(url) > 30 THEN substr(url, 1, 30)||'...' ELSE url END AS preview FROM pages")
def slugs(spark, d):
    return read(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"), tx.preview(F.col("url"), 30).alias("preview"))


@query("SELECT page_id, CASE WHEN ends_with(u, '.pdf') THEN 'pdf' WHEN ends_with(u, '.md') THEN 'markdown' WHEN ends_with(u, '.srt') THEN 'chat_native' ELSE NULL END AS format, f||'-'||substr(sha256(u), 1, 8) AS file_id FROM (SELECT page_id, u, regexp_extract(u, '[^/]*$') AS f FROM (SELECT page_id, '/vault/'||page_id||(['.pdf','.md','.srt','.xyz'])[(page_id % 4) + 1] AS u FROM pages))")
def file_routing(spark, d):
    from stancelake.sources.routing import file_id, route

    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".md", ".srt", ".xyz")]), (F.col("page_id") % 4 + 1).cast("int"))
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("/vault/"), F.col("page_id").cast("string"), ext).alias("path"))
    return p.select("page_id", route(F.col("path"))["format"].alias("format"), file_id(F.col("path")).alias("file_id"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS prose FROM pages")
def stripped_pages(spark, d):
    h = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), "&[a-z#0-9]+;", " ")
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(h, r"\s+", " ")).alias("prose"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'imperative' WHEN 'view' THEN 'interrogative' WHEN 'error' THEN 'declarative' WHEN 'click' THEN 'fragment' ELSE 'exclamative' END AS raw_label, CASE event_type WHEN 'signup' THEN 'exact' WHEN 'view' THEN 'aliased' WHEN 'error' THEN 'unknown' WHEN 'click' THEN 'exact' ELSE 'aliased' END AS raw_status FROM events")
def mood_labels(spark, d):
    raw = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": " Imperative (polite)", "view": "Query", "error": "zz", "click": "noun_phrase", "purchase": "EXCLAMATORY"}.items() for x in kv]), F.col("event_type"))
    return labels.normalise(read(spark, d, "events").select("event_id", raw.alias("raw")), "raw").drop("raw")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])no([^a-z]|$)') THEN true ELSE false END AS has_negator FROM documents")
def negators(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_contains(F.split(F.lower("text"), "[^a-z]+"), "no").alias("has_negator"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalised_text(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("norm"))


@query("WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type||':'||n, ' ' ORDER BY event_type) AS counts, sum(n)::BIGINT AS total FROM p GROUP BY user_id")
def map_rendering(spark, d):
    p = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return p.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda s: F.concat_ws(":", s["event_type"], s["n"].cast("string"))), " ").alias("counts"), F.sum("n").alias("total"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- reports, queues and places -----------------------------------------------------------------


@query(T + " SELECT conv_id, turn, CASE WHEN avg_tenor BETWEEN 0 AND 0.3 THEN 'casual' WHEN avg_tenor BETWEEN 0 AND 0.6 THEN 'mixed' WHEN avg_tenor BETWEEN 0 AND 1 THEN 'formal' END AS tenor_label, CASE WHEN tenor_shift_milli IS NULL THEN '' ELSE (CASE WHEN tenor_shift_milli <= -5 THEN '-' ELSE '' END)||((abs(tenor_shift_milli)+5)//10//100)||'.'||lpad(((abs(tenor_shift_milli)+5)//10%100)::VARCHAR, 2, '0') END AS tenor_shift, CASE WHEN length(x) > 50 THEN substr(x, 1, 50)||'...' ELSE x END AS message_preview FROM sh JOIN (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM conversations) USING (conv_id, turn)")
def turn_report(spark, d):
    return sinks.turn_report(turn_rows(spark, d), read(spark, d, "conversations")).select("conv_id", F.col("turn_id").alias("turn"), "tenor_label", "tenor_shift", "message_preview")


@query(C + """ SELECT section_id||'.md' AS file_name, string_agg(ctext||' ['||mood||'/'||process_type||']', E'\\n' ORDER BY idx) AS body FROM (SELECT *, regexp_replace(c.section_id, '[^a-z0-9]+', '-', 'g') AS sl FROM c) GROUP BY section_id""".replace("section_id||'.md'", "regexp_replace(section_id, '[^a-z0-9]+', '-', 'g')||'.md'"))
def annotated_documents(spark, d):
    return sinks.annotated_documents(clause_rows(spark, d), "section_id")


@query(C + """ SELECT '{"collection":"chat","document_key":"'||conv_id||'","section_id":"'||section_id||'","section_path":"'||conv_id||' > '||role||'","ideational":{"process_type":"'||process_type||'"},"interpersonal":{"mood":"'||mood||'","modality_milli":'||modality_milli||',"tenor_milli":'||tenor_milli||',"annotation_source":"'||annotation_source||'"}}' AS value, clause_id FROM c""")
def jsonl_export(spark, d):
    c = clause_rows(spark, d)
    sections = c.groupBy("section_id").agg(F.first("conv_id").cast("string").alias("document_key"), F.first("conv_id").alias("document_position"), F.first("turn").alias("ordinal"), F.concat_ws(" > ", F.first("conv_id").cast("string"), F.first("role")).alias("section_path")).withColumn("collection", F.lit("chat"))
    out = sinks.export_jsonl(c, sections, with_id=True)
    return out.select(F.regexp_replace("value", '"text":"(?:[^"\\\\\\\\]|\\\\\\\\.)*",', "").alias("value"), "clause_id")


@query(_Q + " SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'image' WHEN doc_id % 17 = 0 THEN 'audio_transcript' WHEN coalesce(fallback, 0) * 2 > n THEN 'fallback_annotation' WHEN quality_milli < 400 THEN 'low_quality_score' END AS reason FROM z")
def queue_reasons(spark, d):
    media = F.when(F.col("doc_id") % 13 == 0, "image").when(F.col("doc_id") % 17 == 0, "audio")
    source = F.when(F.coalesce("fallback", F.lit(0)) * 2 > F.col("n"), "fallback").otherwise("llm")
    return assessed(spark, d).select("doc_id", kb.queue_reason(source, F.col("quality_milli"), media).alias("reason"))


@query(_Q + " SELECT doc_id, action, 'score '||quality_milli AS reason FROM z")
def manifest_backfill(spark, d):
    a = assessed(spark, d)
    manifest = a.select("artifact_id", "action", F.concat(F.lit("score "), F.col("quality_milli").cast("string")).alias("reason"))
    return catalog.backfilled(a.select("artifact_id"), manifest, ["action", "reason"]).select(F.col("artifact_id").alias("doc_id"), "action", "reason")


@query("SELECT l.doc_id, l.quality, d.source, d.lang FROM labels l LEFT JOIN documents d USING (doc_id)")
def hit_places(spark, d):
    return catalog.hit_places(read(spark, d, "labels"), read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "quality", "source", "lang")


@query("SELECT n_name, coalesce(n, 0) AS section_count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def section_count_refresh(spark, d):
    return catalog.section_counts(read(spark, d, "nation"), read(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey").select("n_name", "section_count")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20 OFFSET 10")
def pending_reviews(spark, d):
    rows, _ = filters.page(read(spark, d, "events").where("event_type = 'error'"), ["ts", "event_id"], 20, 10)
    return rows.select("event_id", "ts")


@query(C + ", g AS (SELECT conv_id, count(*) AS total, count(*) FILTER (annotation_source NOT IN ('llm','human')) AS excluded FROM c GROUP BY conv_id) SELECT conv_id, CASE WHEN excluded > 0 THEN '_Data Quality: '||excluded||'/'||total||' retrieved clauses excluded due to fallback annotation._' END AS note FROM g")
def quality_notes(spark, d):
    g = clause_rows(spark, d).groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(filters.untrusted(F.col("annotation_source"))).alias("excluded"))
    return g.select("conv_id", digest.quality_note(F.col("excluded"), F.col("total")).alias("note"))


@query(C + " SELECT clause_id, '['||(idx+1)||'] '||ctext||E'\\n    (mood='||mood||', tenor='||tenor_milli||', modality='||modality_milli||', process='||process_type||'; source: '||section_id||')' AS evidence FROM c")
def evidence_lines(spark, d):
    c = clause_rows(spark, d)
    return c.select("clause_id", digest.evidence_line(F.col("idx") + 1, F.col("ctext"), F.col("mood"), F.col("tenor_milli"), F.col("modality_milli"), F.col("process_type"), F.col("section_id")).alias("evidence"))


@query("WITH m AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'pending' WHEN vec_id % 11 = 0 THEN 'failed' ELSE 'embedded' END AS st, vec_id // 5 AS section_id FROM embeddings) SELECT vec_id, section_id FROM m WHERE section_id IN (SELECT section_id FROM m WHERE st <> 'embedded')")
def embedding_redrive(spark, d):
    status = F.when(F.col("vec_id") % 7 == 0, "pending").when(F.col("vec_id") % 11 == 0, "failed").otherwise("embedded")
    rows = read(spark, d, "embeddings").select("vec_id", status.alias("embedding_status"), F.expr("vec_id div 5").alias("section_id"))
    return annotation.redrive(rows).select("vec_id", "section_id")


@query("SELECT vec_id, len(embedding) AS dim, CASE WHEN len(embedding) <> 64 THEN 'failed' ELSE 'embedded' END AS embedding_status FROM embeddings")
def embedding_checks(spark, d):
    good, bad = annotation.embeddings(read(spark, d, "embeddings"), 64)
    return good.unionByName(bad).select("vec_id", F.size("embedding").cast("long").alias("dim"), "embedding_status")


@query("WITH r AS (SELECT user_id, count(*) AS done, count(*) FILTER (event_type = 'error') AS failed, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id) SELECT user_id, done, failed, floor(done*3600000000.0::DOUBLE/us*1000 + 0.5)/1000.0 AS per_hour, floor((100 - done)*(us/done::DOUBLE)/1000000 + 0.5)::BIGINT AS eta_s FROM r WHERE us > 0 AND done > 1")
def run_rates(spark, d):
    us = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    r = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), us.alias("us")).where("us > 0 and done > 1")
    return catalog.rates(r, "done", "failed", F.lit(100), "us").select("user_id", "done", "failed", "per_hour", "eta_s")


@query(f"WITH {_TREE}, st AS (SELECT 'c'||c_custkey AS node, CASE WHEN c_custkey % 40 = 0 THEN 'pending' ELSE 'accepted' END AS status FROM customer), hit AS (SELECT node FROM st WHERE status = 'pending') SELECT node FROM hit UNION SELECT ancestor FROM up WHERE node IN (SELECT node FROM hit)")
def status_filter(spark, d):
    status = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.when(F.col("c_custkey") % 40 == 0, "pending").otherwise("accepted").alias("status"))
    return graph.matching(_tree(spark, d), status.where("status = 'pending'"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'chat,vision' ELSE 'chat' END AS capabilities FROM part WHERE p_size > 25")
def capable_models(spark, d):
    caps = F.when(F.col("p_size") > 25, F.array(F.lit("chat"), F.lit("vision"))).otherwise(F.array(F.lit("chat")))
    m = read(spark, d, "part").select("p_partkey", F.lit("x").alias("provider"), F.col("p_partkey").cast("string").alias("model_id"), caps.alias("capabilities"))
    return exports.capable(m, "vision").select("p_partkey", F.array_join("capabilities", ",").alias("capabilities"))


@query()
def narrative_checks(spark, d):
    """A narrative of each conversation that tells of every turn what holds of the next one, held against the conversation."""
    t = settle(cv.shifts(turn_rows(spark, d)).withColumns({"mood": F.col("dominant_mood"), "shifted": F.col("tenor_shift_milli").isNotNull()}), "narrative-turns")
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.format_string('Turn %d by %s is %s because of %d clauses. It reads "%s".', F.col("turn") + 1, F.lead("speaker").over(w), F.lead("mood").over(w), F.col("n_clauses"), F.col("shown"))
    c = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.substring("text", 1, 200), r'["“”]', "").alias("preview"))
    lines = t.join(c.withColumn("shown", F.regexp_extract("preview", r"^((?:\S+\s+){0,6}\S+)", 1)), ["conv_id", "turn"]).select("conv_id", "turn", said.alias("s")).where("s is not null")
    narratives = lines.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda r: r["s"]), "\n").alias("text"))
    rows = settle(digest.narrative_sentences(narratives), "narrative-sentences")  # read by four checks
    own = t.withColumn("id", F.col("conv_id").cast("string")).select("id", "turn", "speaker", "mood", "shifted", "n_clauses")
    numbers = own.select("id", F.col("n_clauses").cast("double").alias("value"), F.lit(False).alias("percent"))
    claims = [digest.number_claims(rows, numbers), digest.turn_claims(rows, own), digest.connective_claims(rows, own.where("shifted").select("id", "turn")), digest.quote_claims(rows, c.select(F.col("conv_id").cast("string").alias("id"), "preview"))]
    return digest.precision(catalog.union_all(claims))


# --- topics -------------------------------------------------------------------------------------


def _distributions(spark: SparkSession, d: str) -> DataFrame:
    """A distribution of processes for each turn (a stand-in for topics), with its dominant one."""
    n = clause_rows(spark, d).groupBy("conv_id", "turn", "process_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("conv_id", "turn"))
    p = n.withColumn("p", F.col("n") / total)
    g = p.groupBy("conv_id", "turn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("process_type", "p")))).alias("distribution"), F.max_by("process_type", F.struct("p", "process_type")).alias("top"), F.max("p").alias("top_p"))
    excess = (F.col("top_p") - 1.0 / 6) / (1.0 - 1.0 / 6)
    return g.withColumn("dominant_topic", F.when(excess >= topics.DOMINANCE, F.col("top")))


_DIST = C + """, n AS (SELECT conv_id, turn, process_type, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT *, n/sum(n) OVER (PARTITION BY conv_id, turn)::DOUBLE AS p FROM n),
 g AS (SELECT conv_id, turn, arg_max(process_type, (p, process_type)) AS top, max(p) AS top_p FROM p GROUP BY ALL),
 x AS (SELECT conv_id, turn, CASE WHEN (top_p - 1.0::DOUBLE/6)/(1.0::DOUBLE - 1.0::DOUBLE/6) >= 0.35 THEN top END AS dominant_topic, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM g)"""


@query(_DIST + " SELECT conv_id, turn, dominant_topic FROM x")
def dominant_topics(spark, d):
    return _distributions(spark, d).select("conv_id", "turn", "dominant_topic")


@query(_DIST + """, y AS (SELECT a.conv_id, a.turn, b.dominant_topic AS from_topic, a.dominant_topic AS to_topic, a.pt FROM x a JOIN x b ON b.conv_id = a.conv_id AND b.turn = a.pt WHERE a.dominant_topic <> b.dominant_topic),
 z AS (SELECT y.conv_id, y.turn, from_topic, to_topic, (SELECT sum(n*n) FROM n WHERE n.conv_id = y.conv_id AND n.turn = y.turn) AS aa, (SELECT sum(n*n) FROM n WHERE n.conv_id = y.conv_id AND n.turn = y.pt) AS bb, coalesce((SELECT sum(u.n*v.n) FROM n u JOIN n v ON u.process_type = v.process_type WHERE u.conv_id = y.conv_id AND u.turn = y.turn AND v.conv_id = y.conv_id AND v.turn = y.pt), 0) AS ab FROM y)
 SELECT conv_id, turn, from_topic, to_topic FROM z WHERE 1 - ab/(sqrt(aa)*sqrt(bb)) >= 0.29995""")
def topic_shifts(spark, d):
    return topics.topic_shifts(_distributions(spark, d), "conv_id", "turn").select("conv_id", "turn", "from_topic", "to_topic")


_BASE = _DIST + """, u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT DISTINCT conv_id, turn FROM n)), k AS (SELECT conv_id, count(*) AS k FROM u GROUP BY conv_id),
 m AS (SELECT conv_id, process_type, floor(sum(p)/k*10000 + 0.5 + 1e-7)/10000 AS b FROM p JOIN k USING (conv_id) GROUP BY conv_id, process_type, k)"""


@query(_BASE + """, bb AS (SELECT conv_id, sum(b*b) AS bb FROM m GROUP BY conv_id), ab AS (SELECT conv_id, turn, sum(p*p) AS aa, sum(p*b) AS ab FROM p JOIN m USING (conv_id, process_type) GROUP BY conv_id, turn)
 SELECT u.conv_id, u.turn, CASE WHEN place >= 3 THEN floor(greatest(0, least(1, 1 - floor((1 - ab/(sqrt(aa)*sqrt(bb)))*10000 + 0.5)/10000))*10000 + 0.5)/10000 END AS coherence FROM u JOIN ab USING (conv_id, turn) JOIN bb ON bb.conv_id = u.conv_id""")
def topic_coherence(spark, d):
    return topics.baseline_coherence(_distributions(spark, d), "conv_id", "turn")


@query(_BASE + " SELECT conv_id, process_type AS topic, b AS mean FROM m")
def topic_baseline(spark, d):
    return topics.baseline(_distributions(spark, d), "conv_id")


@query()
def topic_model(spark, d):
    texts = read(spark, d, "documents")
    k = topics.clamp_k(4, texts.count())
    shares, _ = topics.fit_lda(texts.select("doc_id", "text"), k)
    return shares.select("doc_id", topics.dominant(F.col("shares"), k).alias("dominant_topic"))


@query()
def readability(spark, d):
    return read(spark, d, "benchmark").select("item_id", tx.readability(F.col("text")).alias("r")).select("item_id", "r.*")


@query()
def modality_bands(spark, d):
    rows = cl.annotate_lexicon(cl.split_clauses(cl.turn_units(read(spark, d, "conversations"))))
    return rows.select("clause_id", "modality", "mood", "process_type", "annotation_source", lexicon.contradicts(F.col("modality"), F.col("ctext")).alias("contradicts"))


# --- streaming ----------------------------------------------------------------------------------


@query("SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, event_type, count(*) AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def windowed_events(spark, d):
    from stancelake.streaming.runs import hourly

    return hourly(read(spark, d, "events"))


@query(ORACLE_SQL["windowed_events"])
def windowed_stream(spark, d):
    from stancelake.streaming.runs import hourly_stream

    return hourly_stream(spark, d)


@query()
def stall_stream(spark, d):
    from stancelake.streaming.runs import stalled_runs

    return stalled_runs(spark, d)


from stancelake.plans import evidence  # noqa: E402, F401  (registers more queries by the functions above)
from stancelake.plans import ledger  # noqa: E402, F401
from stancelake.plans import lookup  # noqa: E402, F401
