"""Queries over loaders, reports, runs and language functions, on files and rows made from the tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancelake.functions import labels, lexicon, text as tx
from stancelake.operators import annotation, catalog, clauses as cl, conversation as cv, digest, filters, graph, kb, reports, retrieval, topics
from stancelake.plans import queries as q
from stancelake.plans.queries import _DIST, _DOC, _Q, _TREE, ORACLE_SQL, C, clause_rows, query, read
from stancelake.sources import exports, loaders as ld
from stancelake.streaming import runs
from stancelake.tables import scratch_path

SAID = "This sentence is long enough to be kept as a section."
STAMP = "2024-01-01 00:00:00"


def files(rows: DataFrame, path, content) -> DataFrame:
    return rows.select(path.alias("path"), content.alias("content"), F.lit(STAMP).cast("timestamp").alias("modified"))


def _id(path: str) -> str:
    """The stable id of a file, in SQL."""
    return f"parse_filename({path})||'-'||substr(sha256({path}), 1, 8)"


def _name(prefix: str, column: str, suffix: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(suffix))


# --- loaders ------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT '/kb/'||doc_id||'.md' AS path, doc_id FROM documents), s(slug, heading, parent) AS (VALUES ('preamble', NULL, NULL), ('alpha', 'Alpha', NULL), ('beta', 'Beta', 'alpha'))
 SELECT {_id("path")}||'#'||slug AS section_id, heading, {_id("path")}||'#'||parent AS parent_section_id, 'T'||doc_id AS title, CASE WHEN slug = 'preamble' THEN 'block' ELSE 'heading' END AS kind, '{SAID}' AS text FROM f CROSS JOIN s""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("---\ntitle: 'T"), F.col("doc_id").cast("string"), F.lit(f"'\ntags: [a, b]\n---\n{SAID}\n# Alpha\n{SAID}\n```sh\n# not a heading\n```\n## Beta\n{SAID}\n# Gamma\nshort\n"))
    u = ld.markdown(files(read(spark, d, "documents"), _name("/kb/", "doc_id", ".md"), body))
    kind = ld.section_shape(u).select("section_id", "kind")
    return u.join(kind, "section_id").select("section_id", "heading", "parent_section_id", F.col("metadata")["front.title"].alias("title"), "kind", "text")


@query(f"SELECT {_id("'/kb/'||page_id||'.canvas'")}||'#n1' AS section_id, '{SAID}' AS text FROM pages")
def canvas_nodes(spark, d):
    body = F.lit(f'{{"nodes": [{{"id": "n1", "type": "text", "text": "**{SAID}**"}}, {{"id": "n2", "type": "text", "text": "short"}}, {{"id": "n3", "type": "file"}}]}}')
    return ld.canvas(files(read(spark, d, "pages"), _name("/kb/", "page_id", ".canvas"), body)).select("section_id", "text")


_CUES = """WITH m AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM m)
 SELECT {file}||'#turn-'||k AS section_id, {who} AS speaker, string_agg('line '||turn, ' ' ORDER BY turn) AS text FROM i GROUP BY conv_id, k, role"""


def _cue_files(spark: SparkSession, d: str, head: str, end: str, one, suffix: str) -> DataFrame:
    c = read(spark, d, "conversations")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), one), end)
    return files(c.groupBy("conv_id").agg(F.concat(F.lit(head), body, F.lit("\n")).alias("body")), _name("/talk/", "conv_id", suffix), F.col("body"))


@query(_CUES.format(file=_id("'/talk/'||conv_id||'.vtt'"), who="role"))
def vtt_turns(spark, d):
    one = lambda r: F.concat(F.lit("00:00:01.000 --> 00:00:02.000\n<v "), r["role"], F.lit(">line "), r["turn"].cast("string"), F.lit("</v>"))
    return ld.vtt(_cue_files(spark, d, "WEBVTT\n\nNOTE made\n\n", "\n\n", one, ".vtt")).select("section_id", "speaker", "text")


@query(_CUES.format(file=_id("'/talk/'||conv_id||'.srt'"), who="'Speaker 1 ('||role||')'"))
def srt_turns(spark, d):
    one = lambda r: F.concat(r["turn"].cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n[Speaker 1 ("), r["role"], F.lit(")] line "), r["turn"].cast("string"))
    return ld.srt(_cue_files(spark, d, "", "\n\n", one, ".srt")).select("section_id", "speaker", "text")


@query(_CUES.format(file=_id("'/talk/'||conv_id||'.ass'"), who="role"))
def ass_turns(spark, d):
    one = lambda r: F.concat(F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,Default,"), r["role"], F.lit(",{\\i1}line "), r["turn"].cast("string"))
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, Text\n"
    return ld.ass(_cue_files(spark, d, head, "\n", one, ".ass")).select("section_id", "speaker", "text")


@query("SELECT doc_id::VARCHAR||'.txt' AS file, count(*) AS n_turns, min(l) AS first_line FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '\\r\\n?', E'\\n', 'g'), E'\\n'))) AS l FROM documents) WHERE l <> '' GROUP BY doc_id")
def transcript_lines(spark, d):
    u = ld.transcription(files(read(spark, d, "documents"), _name("/t/", "doc_id", ".txt"), F.col("text")))
    return u.groupBy(F.substring_index("document_key", "/", -1).alias("file")).agg(F.count("*").alias("n_turns"), F.min("text").alias("first_line"))


_TURN = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"


def _export(spark: SparkSession, d: str, one, wrap) -> DataFrame:
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return files(c, _name("/x/", "conv_id", ".json"), F.to_json(wrap(F.transform("m", one))))


@query(f"SELECT 'u'||conv_id||'#turn-'||({_TURN}) AS section_id, CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END AS speaker, text FROM conversations WHERE trim(text) <> ''")
def claude_turns(spark, d):
    one = lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("assistant").alias("sender"), F.lit("plain").alias("text"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content"))
    wrap = lambda a: F.array(F.struct(F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("uuid"), F.lit("n").alias("name"), a.alias("chat_messages")))
    return ld.claude(_export(spark, d, one, wrap)).select("section_id", "speaker", "text")


@query(f"SELECT 'k'||conv_id||'#turn-'||({_TURN}) AS section_id, CASE WHEN role = 'user' THEN 'User' ELSE 'Mistral' END AS speaker, text FROM conversations WHERE trim(text) <> ''")
def mistral_turns(spark, d):
    one = lambda m: F.struct(F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("chatId"), m["text"].alias("content"), m["role"].alias("role"))
    return ld.mistral(_export(spark, d, one, lambda a: a)).select("section_id", "speaker", "text")


@query("SELECT 'm'||conv_id||':'||turn AS id, role AS speaker, text FROM conversations WHERE trim(text) <> '' AND role <> 'system'")
def chatgpt_turns(spark, d):
    """Mapping trees of a root and a chain of messages: the leaf's way up to the root, turned round."""
    c = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    ident = F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    c = c.withColumn("id", ident).withColumns({"up": F.coalesce(F.lag("id").over(w), F.lit("root")), "down": F.lead("id").over(w)})
    message = F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    node = F.struct("id", message.alias("message"), F.col("up").alias("parent"), F.array_compact(F.array("down")).alias("children"))
    g = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").alias("k"), node.alias("v")))).alias("m"), F.min_by("id", "turn").alias("first"))
    content = F.concat(F.lit('[{"id": "c'), F.col("conv_id").cast("string"), F.lit('", "title": "t", "mapping": {"root": {"id": "root", "children": ["'), "first", F.lit('"]}, '), F.substring(F.to_json("m"), 2, 1 << 30), F.lit("}]"))
    u = ld.chatgpt(files(g, _name("/x/", "conv_id", ".json"), content))
    known = c.select("id", "conv_id", F.col("text").alias("t"), F.row_number().over(w).alias("n"), "role")
    # told apart by conversation and text, since units are numbered within what was kept
    return u.join(known, (F.col("text") == F.col("t")) & (F.col("document_key").endswith(F.concat(F.lit("c"), F.col("conv_id").cast("string"))))).select("id", F.col("role").alias("speaker"), "text").distinct()


@query(f"SELECT {_id("'/x/'||conv_id||'.jsonl'")}||'#turn-'||row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS section_id, role AS speaker, role = 'user' AS is_user, text FROM conversations")
def native_chat(spark, d):
    c = read(spark, d, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("name"), F.col("text").alias("mes"), (F.col("role") == "user").alias("is_user")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda r: r["l"]), "\n")
    f = files(c.groupBy("conv_id").agg(F.concat(body, F.lit("\nnot json\n{}\n")).alias("b")), _name("/x/", "conv_id", ".jsonl"), F.col("b"))
    return ld.chat_jsonl(f).select("section_id", "speaker", "is_user", "text")


@query("SELECT conv_id::VARCHAR AS conv, turn AS pos, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS name, text AS mes FROM conversations")
def notebook_chat(spark, d):
    c = read(spark, d, "conversations")
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda r: r["l"]), "\n")
    n = ld.notebook_jsonl(files(c.groupBy("conv_id").agg(body.alias("b")), F.col("conv_id").cast("string"), F.col("b")))
    first = c.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.min("turn").alias("first"))
    return n.join(first, "path").select(F.col("path").alias("conv"), (F.col("pos") + F.col("first")).cast("long").alias("pos"), "name", "mes")


@query("SELECT c_custkey::VARCHAR AS id, c_mktsegment AS speaker, c_name||', \"said\"' AS text FROM customer")
def csv_records(spark, d):
    from stancelake.plans.engine import Engine

    path = scratch_path(spark, "csv")
    c = read(spark, d, "customer")
    c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("speaker"), F.concat("c_name", F.lit(', "said"')).alias("text")).write.option("header", True).option("escape", '"').csv(path)
    u = Engine(spark, path).load(path, "csv")
    return u.select(F.col("metadata")["id"].alias("id"), "speaker", "text")


@query("SELECT c_custkey::VARCHAR AS id, c_mktsegment AS heading, c_name AS text FROM customer")
def json_records(spark, d):
    from stancelake.plans.engine import Engine

    path = scratch_path(spark, "json")
    c = read(spark, d, "customer")
    c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("said")).write.json(path)
    u = Engine(spark, path).load(path, "json", text="said", heading="segment", ident="key", lines=True)
    return u.select(F.split_part("section_id", F.lit("#"), F.lit(2)).alias("id"), "heading", "text")


@query(f"SELECT {_id("'/p/'||doc_id||'.pdf'")}||'#p1-chunk'||((place - 1)//1000) AS section_id, substr(text, place, 1000) AS text FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1)::BIGINT + 1, 1000)) AS place FROM documents WHERE trim(text) <> '')")
def pdf_chunks(spark, d):
    pages = read(spark, d, "documents").select(_name("/p/", "doc_id", ".pdf").alias("path"), F.lit(1).alias("page"), "text")
    return ld.pdf_chunks(pages).select("section_id", "text")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Image file '||page_id||'.png (no description available).' ELSE 'Picture '||page_id END AS text FROM pages")
def image_descriptions(spark, d):
    """A describer that knows some images: the others get the plain sentence."""

    def describe(paths):
        names = [p.rsplit("/", 1)[-1].split(".")[0] for p in paths]
        return [None if int(n) % 3 == 0 else f"Picture {n}" for n in names]

    u = ld.describe_images(read(spark, d, "pages").select(_name("/i/", "page_id", ".png").alias("path")), describe)
    return u.select(F.split_part(F.substring_index("document_key", "/", -1), F.lit("."), F.lit(1)).cast("long").alias("page_id"), "text")


@query("SELECT page_id, 'Seen at '||page_id AS text, 'm'||(page_id % 3) AS model FROM pages WHERE page_id % 5 <> 0")
def image_sidecars(spark, d):
    good = F.concat(F.lit("description: Seen at "), F.col("page_id").cast("string"), F.lit("\nmodel_used: m"), (F.col("page_id") % 3).cast("string"), F.lit("\n"))
    f = files(read(spark, d, "pages"), _name("/i/", "page_id", ".meta.yaml"), F.when(F.col("page_id") % 5 == 0, "- a list").otherwise(good))
    u = ld.image_meta_units(f)
    return u.select(F.split_part(F.substring_index("document_key", "/", -1), F.lit("."), F.lit(1)).cast("long").alias("page_id"), "text", F.col("metadata")["model_used"].alias("model"))


@query("""SELECT conv_id||'' AS id, turn AS pos, CASE WHEN turn % 3 = 1 THEN 'a'||chr(92)||'n'||role||chr(10) ELSE 'a'||chr(10)||role END AS mes, turn % 3 = 0 AS double_escaped, CASE WHEN turn % 3 = 1 THEN 'mixed_escape' END AS problem FROM conversations""")
def parsed_transcripts(spark, d):
    slash = F.lit("\\n")
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a"), slash, "role")).when(F.col("turn") % 3 == 1, F.concat(F.lit("a"), slash, "role", F.lit("\n"))).otherwise(F.concat(F.lit("a\n"), "role"))
    t = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("pos"), F.col("role").alias("name"), body.alias("mes"))
    return exports.check_parsed(t).select("id", "pos", "mes", "double_escaped", "problem")


@query("SELECT 'hosted' AS provider, 'm'||p_partkey AS model_id, p_size::BIGINT AS context_window, p_size > 25 AS sees FROM part")
def model_listings(spark, d):
    p = read(spark, d, "part")
    kinds = F.when(F.col("p_size") > 25, F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text")))
    one = F.struct(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("context_length"), F.struct(kinds.alias("input_modalities")).alias("architecture"))
    f = p.select(_name("/m/", "p_partkey", ".json").alias("path"), F.to_json(F.struct(F.array(one).alias("data"))).alias("content"))
    return exports.model_rows(f).select("provider", "model_id", "context_window", F.array_contains("capabilities", "vision").alias("sees"))


# --- reports, queues, runs ----------------------------------------------------------------------


@query(C + """, g AS (SELECT conv_id, count(*) AS clause_count, count(DISTINCT turn) AS turn_count, count(*) FILTER (annotation_source <> 'llm') AS defaulted, count(DISTINCT role) AS n_speakers FROM c GROUP BY conv_id)
 SELECT conv_id, clause_count, turn_count, defaulted, n_speakers, clause_count < 30 AS low_confidence FROM g""")
def json_report(spark, d):
    """The JSON report of every conversation, read back."""
    c = clause_rows(spark, d)
    t = cv.turns(c)
    stance = c.groupBy("conv_id", "process_type").agg(F.count("*").alias("clause_count"), F.count_if(~filters.untrusted(F.col("annotation_source"))).alias("annotated_count"), F.avg("tenor_milli").alias("avg_tenor"))
    r = reports.report_json(t, c, cv.key_moments(t), stance, cv.insights(t), read(spark, d, "conversations").select("conv_id", "turn", "text"))
    shape = "metadata struct<conversation_id:string,turn_count:long,clause_count:long,low_confidence:boolean,speakers:array<string>>, turns array<struct<turn_id:long,defaulted_count:long>>"
    x = F.from_json("value", shape)
    return r.select("conv_id", x.alias("x")).select("conv_id", "x.metadata.clause_count", "x.metadata.turn_count", F.aggregate("x.turns", F.lit(0).cast("long"), lambda a, u: a + u["defaulted_count"]).alias("defaulted"), F.size("x.metadata.speakers").cast("long").alias("n_speakers"), "x.metadata.low_confidence")


@query(C + """, g AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (annotation_source <> 'llm') AS d FROM c GROUP BY ALL)
 SELECT conv_id, sum(n) < 30 AS noticed, count(*) FILTER (d::DOUBLE/n > 0.5) AS unreliable FROM g GROUP BY conv_id""")
def digest_texts(spark, d):
    c = clause_rows(spark, d)
    t = reports.digest_text(cv.turns(c), c, read(spark, d, "conversations").select("conv_id", "turn", "text"))
    return t.select("conv_id", F.col("digest").startswith("== LOW CONFIDENCE").alias("noticed"), F.regexp_count("digest", F.lit(r" UNRELIABLE \(\d+% fallback\)")).cast("long").alias("unreliable"))


@query(C + """, l AS (SELECT conv_id, turn, idx, CASE WHEN idx = 0 THEN '**'||role||':**'||chr(10)||chr(10) ELSE '' END||ctext||chr(10)||chr(10) AS l FROM c)
 SELECT conv_id::VARCHAR AS document_key, '# Talk '||conv_id||chr(10)||chr(10)||string_agg(l, '' ORDER BY turn, idx) AS body FROM l GROUP BY conv_id""")
def markdown_export(spark, d):
    c = clause_rows(spark, d)
    s = c.groupBy("section_id").agg(F.first("conv_id").cast("string").alias("document_key"), F.first("turn").alias("ordinal"), F.first("role").alias("speaker")).withColumns({"title": F.concat(F.lit("Talk "), "document_key"), "label": F.lit(None).cast("string"), "depth": F.lit(0)})
    return reports.export_markdown(c.select("section_id", "idx", "ctext"), s)


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    a = q.assessed(spark, d)
    return a.withColumns({"title": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "source_file": F.col("source"), "section_path": F.col("source"), "tags": F.array(F.lit("a"), F.lit("b"))})


@query(_Q + " SELECT doc_id AS artifact_id, content_type, (quality_milli // 1000)||'.'||lpad((quality_milli % 1000)::VARCHAR, 3, '0') AS quality_score, action AS migration_action, 'a; b' AS tags, strftime(upd, '%Y-%m-%d') AS last_updated, llm AS llm_clause_count FROM z")
def kb_report_csv(spark, d):
    return reports.kb_csv(_artifacts(spark, d)).select("artifact_id", "content_type", "quality_score", "migration_action", "tags", "last_updated", "llm_clause_count")


@query(_Q + ", n AS (SELECT content_type, count(*) AS n FROM z GROUP BY 1) SELECT 'type' AS part, content_type AS k, n FROM n UNION ALL SELECT 'artifact', content_type, count(*) FILTER (action = 'review') FROM z GROUP BY content_type")
def kb_report_json(spark, d):
    head, lines = reports.kb_json(_artifacts(spark, d))
    totals = head.select(F.explode(F.from_json(F.get_json_object("value", "$.content_type_distribution"), "map<string,long>")).alias("k", "n")).select(F.lit("type").alias("part"), "k", "n")
    back = lines.groupBy(F.get_json_object("value", "$.content_type").alias("k")).agg(F.count_if(F.get_json_object("value", "$.migration_action") == "review").alias("n"))
    return totals.unionByName(back.select(F.lit("artifact").alias("part"), "k", "n"))


@query(_Q + """, r AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'image' WHEN coalesce(fallback, 0) * 2 > n THEN 'fallback_annotation' WHEN quality_milli < 400 THEN 'low_quality_score' END AS reason FROM z)
 SELECT doc_id, reason, 'pending' AS status FROM r WHERE reason IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def review_enqueue(spark, d):
    a = q.assessed(spark, d)
    source = F.when(F.coalesce("fallback", F.lit(0)) * 2 > F.col("n"), "fallback").otherwise("llm")
    items = a.select("doc_id", kb.queue_reason(source, F.col("quality_milli"), F.when(F.col("doc_id") % 13 == 0, "image")).alias("reason"))
    queue = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "pending").otherwise("approved").alias("status"))
    return catalog.enqueued(queue, items, "doc_id", q.AS_OF).select("doc_id", "reason", "status")


@query("""WITH s AS (SELECT conv_id AS section_id, turn, text FROM conversations) SELECT section_id, turn, text FROM s WHERE section_id % 4 NOT IN (0, 1) OR section_id % 8 >= 6 UNION ALL SELECT DISTINCT section_id, 0, 'new' FROM s WHERE section_id % 4 = 1 AND section_id % 8 < 6""")
def content_decisions(spark, d):
    """Sections by number: rejected, edited, approved or undecided; those that aren't pending stay as they are."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("section_id"), "turn", "text")
    ids = c.select("section_id").distinct()
    k = F.col("section_id") % 4
    queue = ids.withColumn("status", F.when(F.col("section_id") % 8 < 6, "pending").otherwise("approved"))
    decided = ids.select("section_id", F.when(k == 0, "reject").when(k == 1, "edit").when(k == 2, "approve").alias("decision")).where("decision is not null")
    edited = ids.select("section_id", F.lit(0).cast("long").alias("turn"), F.lit("new").alias("text"))
    return catalog.content_decided(c.withColumn("turn", F.col("turn").cast("long")), queue, decided, edited)[0]


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS source, n_chars::BIGINT AS n_chars FROM documents")
def payload_update(spark, d):
    old = read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))
    new = read(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    return annotation.update_payload(old, new, "doc_id", ["source", "n_chars"])


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND n_chars >= 0")
def source_filter(spark, d):
    return filters.apply(read(spark, d, "documents").withColumn("source_type", F.col("source")), source_type="src1", mood=None).select("doc_id")


@query("SELECT page_id FROM pages WHERE page_id % 4 <> 0")
def unresolved_files(spark, d):
    p = read(spark, d, "pages")
    reviews = p.where("page_id % 2 = 0").select("page_id", F.when(F.col("page_id") % 4 == 0, "approved").otherwise("pending").alias("status"))
    return catalog.unresolved(p, reviews, "page_id").select("page_id")


@query("""WITH e AS (SELECT user_id AS run_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'advance' WHEN 'purchase' THEN 'finish' ELSE 'heartbeat' END AS kind, ts, event_id AS done FROM events),
 b AS (SELECT *, max(CASE WHEN kind = 'start' THEN ts END) OVER (PARTITION BY run_id) AS begun FROM e), k AS (SELECT * FROM b WHERE begun IS NULL OR ts >= begun)
 SELECT run_id, min(ts) FILTER (kind = 'start') AS started_at, max(ts) AS heartbeat_at, coalesce(max(done) FILTER (kind = 'advance'), 0) AS done, CASE WHEN bool_or(kind = 'finish') THEN 'done' ELSE 'running' END AS status FROM k GROUP BY run_id""")
def run_lifecycle(spark, d):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "click", "advance").when(F.col("event_type") == "purchase", "finish").otherwise("heartbeat")
    e = read(spark, d, "events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("done"), F.lit(100).alias("total"), F.lit("done").alias("status"), "event_id")
    return runs.lifecycle(e, order=["at", "event_id"]).select("run_id", "started_at", "heartbeat_at", "done", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS done, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS total FROM orders")
def progress_lines(spark, d):
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("progress turn="), F.col("o_custkey").cast("string"), F.lit(" total="), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("log: "), "o_orderpriority"))
    p = read(spark, d, "orders").select("o_orderkey", runs.progress(line).alias("p"))
    return p.select("o_orderkey", "p.done", "p.total")


@query("SELECT l_returnflag AS kind, count(*) AS n, sum(l_quantity::BIGINT * 1000)::BIGINT AS total_us, (sum(l_quantity::BIGINT * 1000) // count(*))::BIGINT AS mean_us, max(l_quantity::BIGINT * 1000) AS longest_us FROM lineitem GROUP BY 1")
def span_timings(spark, d):
    return runs.timings(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_quantity").cast("long") * 1000).alias("us")))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def resumed_batches(spark, d):
    """Nations asked about in batches, by a run that is stopped after its first round and then taken up again."""
    path = scratch_path(spark, "resume")
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("clause_id"), F.col("n_regionkey").cast("string").alias("ctext"))
    call = lambda texts: [("declarative", 0.5, 0.5, t) for t in texts]
    rounds = iter((False, True))
    some, whole = annotation.answered(n, [call], path, batch=4, at_once=3, stop=lambda: next(rounds))
    if whole or not 0 < some.count() < n.count():
        raise RuntimeError("it did not stop between two rounds")
    rest, _ = annotation.answered(n, [call], path, batch=4, at_once=3)
    return rest.groupBy(F.col("theme_raw").cast("int").alias("n_regionkey")).agg(F.count("*").alias("n"))


@query(C + """, a AS (SELECT clause_id, length(ctext) % 4 AS k FROM c) SELECT clause_id, CASE k WHEN 1 THEN 'interrogative' WHEN 2 THEN 'imperative' ELSE 'declarative' END AS mood, CASE k WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 ELSE 0.5 END::DOUBLE AS modality, CASE WHEN k IN (1, 2) THEN 'llm' ELSE 'fallback' END AS annotation_source, CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 END AS attempt FROM a""")
def answers_kept(spark, d):
    """Clauses that a first annotator leaves unanswered go to a second; what neither answers gets the defaults."""
    c = clause_rows(spark, d).select("clause_id", "ctext")
    first = lambda texts: [("Interrogative", 0.25, 0.5, "unmarked") if len(t) % 4 == 1 else None for t in texts]
    second = lambda texts: [(i, ("imperative", 0.75, 0.5, "unmarked")) for i, t in enumerate(texts) if len(t) % 4 == 2][::-1]
    raw, _ = annotation.answered(c, [first, second], scratch_path(spark, "answers"))
    p = annotation.payloads(c, raw).select("clause_id", "mood", "modality", "annotation_source")
    return p.join(raw.select("clause_id", "attempt"), "clause_id", "left")


# --- places, trees ------------------------------------------------------------------------------


@query("SELECT c_custkey AS section_id, c_nationkey AS document_id, n_regionkey AS collection_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def section_owner(spark, d):
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("document_id"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_regionkey").alias("collection_id"))
    return catalog.section_owners(s, n)


@query(C + " SELECT clause_id, process_type, mood, idx AS weight FROM c WHERE idx % 2 = 0")
def embedded_payload_join(spark, d):
    c = clause_rows(spark, d)
    vectors = c.where("idx % 2 = 0").select("clause_id", F.col("idx").alias("weight"))
    return cl.rejoin_embedded(vectors, *cl.separate(c)).select("clause_id", "process_type", "mood", "weight")


@query(C + ", x AS (SELECT clause_id, lag(clause_id) OVER (PARTITION BY section_id ORDER BY idx) AS up FROM c) SELECT up AS source, clause_id AS target, 'parent_child' AS edge_type FROM x WHERE up IS NOT NULL UNION ALL SELECT source::VARCHAR, target::VARCHAR, 'semantic' FROM (" + ORACLE_SQL["semantic_edges"] + ")")
def graph_edges(spark, d):
    """Structural and semantic edges together."""
    from stancelake.plans.engine import Engine

    up = F.lag("clause_id").over(Window.partitionBy("section_id").orderBy("idx"))
    _, structural = Engine(spark, "/none").graph(clause_rows(spark, d).withColumn("parent_clause_id", up))
    near = q.semantic_edges(spark, d).select(F.col("source").cast("string"), F.col("target").cast("string"), F.lit("semantic").alias("edge_type"))
    return catalog.union_all([structural, near])


@query(C + " SELECT clause_id AS id, ctext, process_type, mood FROM c")
def graph_nodes(spark, d):
    from stancelake.plans.engine import Engine

    return Engine(spark, "/none").graph(clause_rows(spark, d))[0]


@query(f"WITH {_TREE} SELECT ancestor AS node, node AS descendant, level::INTEGER AS level FROM up WHERE ancestor LIKE 'r%'")
def descendants(spark, d):
    t = q._tree(spark, d)
    return graph.descendants(t, t.where("parent is null").select("node")).select("node", "descendant", "level")


@query(f"WITH {_TREE} SELECT node, ancestor AS owner FROM up WHERE ancestor LIKE 'r%' UNION ALL SELECT node, node FROM e WHERE parent IS NULL")
def collection_of(spark, d):
    t = q._tree(spark, d)
    return graph.owners(t, t.select("node"), t.select("node", F.substring("node", 1, 1).alias("kind")), "r")


@query("SELECT p_partkey AS node, (p_partkey % 1000)::BIGINT AS depth, CASE WHEN p_partkey % 1000 > 0 THEN p_partkey - p_partkey % 1000 END AS root FROM part")
def deep_chains(spark, d):
    """Chains of a thousand levels: every node's depth and root."""
    k = F.col("p_partkey")
    e = read(spark, d, "part").select(k.alias("node"), F.when(k % 1000 != 0, k - 1).alias("parent"))
    return graph.intervals(e).select("node", "depth", F.when(F.col("depth") > 0, F.col("root")).alias("root"))


@query("SELECT p_partkey AS node FROM part WHERE p_partkey % 50 < 40")
def ring_cycles(spark, d):
    """Rings of forty nodes, each with a tail of ten that is on none."""
    k, at = F.col("p_partkey"), F.col("p_partkey") % 50
    parent = F.when(at < 39, k + 1).when(at == 39, k - 39).otherwise(k - 1)
    return graph.cycles(read(spark, d, "part").select(k.alias("node"), parent.alias("parent")))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'refused' ELSE 'admitted' END AS outcome FROM nation")
def write_guard(spark, d):
    """New edges that would put a region below one of its own nations' nodes, and others that close nothing."""
    n = read(spark, d, "nation")
    old = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("own"), "n_nationkey").alias("parent"))
    new = n.select(F.concat(F.lit("own"), "n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("n"), "n_nationkey")).otherwise("top").alias("parent"), "n_nationkey")
    good, bad = graph.admitted(old, new)
    return good.select("n_nationkey", F.lit("admitted").alias("outcome")).unionByName(bad.select("n_nationkey", F.lit("refused").alias("outcome")))


@query('SELECT count(*) FILTER (state = \'full\') AS "full", count(*) FILTER (state = \'partial\') AS "partial", count(*) FILTER (state = \'none\') AS "none" FROM (' + ORACLE_SQL["tree_selection"] + ")")
def selection_totals(spark, d):
    return graph.selection_counts(q.tree_selection(spark, d))


# --- language -----------------------------------------------------------------------------------

_SENTENCES = ("it might rain", "you must go now", "we should do it", "not certainly so", "plain words here", '"perhaps" he said')
_BANDS = ("low", "high", "median", "low", None, None)


def _pick(values: tuple, column: str = "p_partkey"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _case(values: tuple, column: str = "p_partkey") -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


@query(f"WITH b AS (SELECT p_partkey, p_size, {_case(_BANDS)} AS band FROM part) SELECT p_partkey, band, coalesce(CASE band WHEN 'low' THEN p_size::DOUBLE/50 >= 0.8 WHEN 'high' THEN p_size::DOUBLE/50 <= 0.3 END, false) AS contradicts FROM b")
def lexicon_bands(spark, d):
    p = read(spark, d, "part").select("p_partkey", _pick(_SENTENCES).alias("s"), (F.col("p_size") / 50.0).alias("m"))
    return p.select("p_partkey", lexicon.band(F.col("s")).alias("band"), lexicon.contradicts(F.col("m"), F.col("s")).alias("contradicts"))


_ODD = ("declaratve", "Interrogativ", "Theme_unmarked", "zz", "exclamativ", "fragment")


@query(f"SELECT p_partkey, {_case(('declarative', 'interrogative', 'declarative', 'declarative', 'exclamative', 'fragment'))} AS raw_label, {_case(('fuzzy', 'fuzzy', 'unknown', 'unknown', 'fuzzy', 'exact'))} AS raw_status FROM part")
def fuzzy_labels(spark, d):
    return labels.normalise(read(spark, d, "part").select("p_partkey", _pick(_ODD).alias("raw")), "raw").drop("raw")


_VERB = ("think", "say", "look", "throw")


@query(f"SELECT p_partkey, {_case(_VERB)} AS lemma, {_case(('mental', 'verbal', 'relational', 'material'))} AS process, 'Actor:they' AS actor, 4::BIGINT AS n_tokens FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, 'they', 'material', '', 4 FROM part WHERE p_partkey % 4 = 3")
def clause_tokens(spark, d):
    """Tokens by rules, the root's lemma in the transitivity structure, its process, and the participants."""
    text = F.concat(F.lit("they "), _pick(_VERB), F.lit(" things."))
    t = read(spark, d, "part").select("p_partkey", text.alias("s")).withColumn("t", cl.parse(F.col("s")))
    t = t.withColumn("x", cl.transitivity(F.col("t")))
    actors = F.array_join(F.transform(F.filter(lexicon.participants(F.col("t")), lambda p: p["role"] == "Actor"), lambda p: F.concat_ws(":", p["role"], p["text"])), ",")
    return t.select("p_partkey", F.col("x.root.lemma").alias("lemma"), lexicon.process(F.col("x.root.lemma"), F.col("s"), F.col("x.root.tag")).alias("process"), actors.alias("actor"), F.size("x.dependencies").cast("long").alias("n_tokens"))


@query("SELECT p_partkey, 'it''s \"'||p_name||'\"  -  so...' AS plain FROM part")
def plain_punctuation(spark, d):
    s = F.concat(F.lit("it’s “"), "p_name", F.lit("” – so…"))
    return read(spark, d, "part").select("p_partkey", tx.plain_punctuation(s).alias("plain"))


@query("SELECT p_partkey, p_name||' code & x' AS prose FROM part")
def markdown_prose(spark, d):
    s = F.concat(F.lit("**"), "p_name", F.lit("** `code` &amp; <b>x</b>"))
    return read(spark, d, "part").select("p_partkey", tx.strip_markdown(s).alias("prose"))


@query("SELECT doc_id, n_chars > 0 AND doc_id % 2 = 0 AS heavy FROM documents WHERE n_chars BETWEEN 10 AND 400")
def code_shares(spark, d):
    """Texts with a code span as long as themselves and 80 more, and without."""
    t = read(spark, d, "documents").where("n_chars between 10 and 400")
    bare = F.replace("text", F.lit("`"), F.lit(""))
    code = F.concat(F.lit(" `"), F.repeat(F.lit("x"), 80), F.repeat(F.lit("y"), F.length(bare)), F.lit("`"))
    return t.select("doc_id", tx.code_heavy(F.when(F.col("doc_id") % 2 == 0, F.concat(bare, code)).otherwise(bare)).alias("heavy"))


@query(C + """, a AS (SELECT clause_id, ctext, length(ctext) % 4 AS k FROM c) SELECT clause_id, CASE k WHEN 1 THEN 'interrogative' WHEN 2 THEN 'imperative' ELSE 'declarative' END AS mood, CASE WHEN k IN (1, 2) THEN 0.25 ELSE 0.5 END::DOUBLE AS modality, CASE WHEN k IN (1, 2) THEN 'llm' ELSE 'fallback' END AS annotation_source, k IN (3) AS asked_wrongly FROM a""")
def annotated_payloads(spark, d):
    """Batches through an annotator that answers by index, misses some clauses and breaks the contract on others."""

    def call(texts):
        out = []
        for i, t in enumerate(texts):
            k = len(t) % 4
            if k:
                out.append((i, ({1: "Interrogative", 2: "imperative", 3: "declarative"}[k], 7.0 if k == 3 else 0.25, 0.5, "unmarked")))
        return out[::-1]

    c = clause_rows(spark, d).select("clause_id", "ctext")
    p = annotation.payloads(c, annotation.annotate(c, call))
    return p.select("clause_id", "mood", "modality", "annotation_source", (F.length("ctext") % 4 == 3).alias("asked_wrongly"))


_ARG = '{"premises":[{"type":"clause","source":"a"},{"type":"marker","source":"\'||n_name||\'"}],"inference_rule":"band","conclusion":{"modality":"\'||n_regionkey||\'","mood":"declarative"}}'


@query(f"SELECT n_nationkey, sha256('{_ARG}') AS derivation_hash FROM nation")
def reasoning_hashes(spark, d):
    premise = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("source"))
    premises = F.array(premise("marker", F.col("n_name")), premise("clause", F.lit("a")))
    conclusion = F.create_map(F.lit("mood"), F.lit("declarative"), F.lit("modality"), F.col("n_regionkey").cast("string"))
    return read(spark, d, "nation").select("n_nationkey", annotation.trace(premises, F.lit("band"), conclusion).alias("derivation_hash"))


@query(C + ", r AS (SELECT clause_id, tenor_milli, annotation_source IN ('llm','human') AS ok FROM c) SELECT clause_id, ok AS is_citable, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY tenor_milli DESC, clause_id) END::INTEGER AS citation FROM r")
def citable_marks(spark, d):
    hits = clause_rows(spark, d).select(F.col("clause_id").alias("id"), F.col("tenor_milli").alias("rrf_score"), "annotation_source", F.lit(False).alias("untrusted"))
    return retrieval.citable_split(hits).select(F.col("id").alias("clause_id"), "is_citable", "citation")


@query(C + ", r AS (SELECT clause_id, row_number() OVER (ORDER BY tenor_milli DESC, clause_id) AS spot FROM c WHERE annotation_source IN ('llm','human')) SELECT event_id, clause_id FROM (SELECT event_id, event_id - 5 AS number FROM events) JOIN r ON spot = number")
def cited_clauses(spark, d):
    """Numbers that an answer cites, some of them below one or beyond the last, mapped back to clauses."""
    hits = clause_rows(spark, d).select(F.col("clause_id").alias("id"), F.col("tenor_milli").alias("rrf_score"), "annotation_source", F.lit(False).alias("untrusted"))
    numbers = read(spark, d, "events").select("event_id", (F.col("event_id") - 5).alias("number"))
    return retrieval.cited(numbers, retrieval.citable_split(hits)).select("event_id", F.col("cited_id").alias("clause_id"))


@query(_DIST + ", y AS (SELECT conv_id, turn, dominant_topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id FROM x) SELECT conv_id, turn, turn_id::INTEGER AS turn_id, dominant_topic FROM y WHERE dominant_topic IS NOT NULL")
def topic_evolution(spark, d):
    return topics.evolution(q._distributions(spark, d), "conv_id", "turn").select("conv_id", "turn", "turn_id", "dominant_topic")


@query(_DIST + ", y AS (SELECT conv_id, dominant_topic AS topic, count(*) AS n_turns, min(turn) AS first FROM x WHERE dominant_topic IS NOT NULL GROUP BY ALL) SELECT conv_id, topic, n_turns, 'Most prominent topic: topic '||topic||' ('||n_turns||' turns)' AS insight FROM y QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n_turns DESC, first) = 1")
def topic_insights(spark, d):
    return topics.topic_insight(q._distributions(spark, d), "conv_id", "turn")


@query("SELECT conv_id||':'||turn AS id, h AS heading FROM conversations CROSS JOIN (VALUES ('Overview'), ('Takeaways')) t(h)")
def narrative_headings(spark, d):
    body = F.concat(F.lit("intro\n## Overview\n"), "role", F.lit("\n## Takeaways\nend\n"))
    c = read(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.explode(digest.narrative_sections(body)).alias("s"))
    return c.select("id", "s.heading")
