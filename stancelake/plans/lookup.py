"""Queries over the keyword index and topic models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stancelake.functions.text import normalise
from stancelake.operators import digest, postings, retrieval, topics
from stancelake.plans.queries import query, read

_FOUND = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
 q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:2]) AS ws FROM benchmark), x AS (SELECT item_id, len(ws) AS need, unnest(ws) AS w FROM q),
 s AS (SELECT item_id AS query_id, doc_id AS id, sum(c)::BIGINT AS score FROM x JOIN n USING (w) GROUP BY item_id, doc_id, need HAVING count(*) = need)"""


#: The same with all words of an item.
_FOUND_WHOLE = _FOUND.replace("[1:2]", "")


def _searched(spark, d, text):
    docs = postings.numbered(read(spark, d, "documents"), "doc_id")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))
    return postings.search(postings.postings(docs), docs, asked, 10)


@query(f"WITH {_FOUND} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def indexed_search(spark, d):
    """The first two words of every benchmark item, looked up in the index of all documents."""
    two = F.array_join(F.slice(postings.lexemes(F.col("text")), 1, 2), " ")
    return _searched(spark, d, two)[0].withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_FOUND_WHOLE}, e AS (SELECT item_id AS query_id, sum(k)::BIGINT AS held FROM x JOIN (SELECT w, count(*) AS k FROM n GROUP BY w) USING (w) GROUP BY 1) SELECT query_id, held, true AS fewer FROM e")
def search_effort(spark, d):
    """How many postings the words of every benchmark item have, all of its text asked for, and that a search reads no more."""
    return _searched(spark, d, F.col("text"))[1].select("query_id", "held", (F.col("read") <= F.col("held")).alias("fewer"))


@query("SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def planted_topics(spark, d):
    """Texts of words of one market segment each; the model is not told how many there are. A text's topic is known by its first word's segment."""
    seg = F.lower("c_mktsegment")
    word = lambda i: F.concat(seg, F.translate(F.lpad(F.pmod(F.xxhash64("c_custkey", F.lit(i)), F.lit(40)).cast("string"), 2, "0"), "0123456789", "bcdfghjklm"))
    texts = read(spark, d, "customer").select("c_custkey", F.concat_ws(" ", *[word(i) for i in range(30)]).alias("text"))
    shares, words = topics.fit_topics(texts, 0, "c_custkey", stemmed=False, features=4096, rounds=10)
    first = words.where("place = 1").select("topic", F.regexp_extract("word", "^(.*)..$", 1).alias("segment"))
    top = shares.select(F.col("id").alias("c_custkey"), (F.array_position("shares", F.array_max("shares")) - 1).cast("int").alias("topic"))
    return top.join(F.broadcast(first), "topic").select("c_custkey", "segment")


@query()
def topic_words(spark, d):
    """The words of the topics that the model finds in the documents."""
    return topics.fit_topics(read(spark, d, "documents").select("doc_id", "text"), 0, "doc_id", features=8192, rounds=10)[1]


#: Eight words from the middle of a turn as they are, without every third letter, or turned about.
_QUOTES = """t AS (SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM conversations),
 q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN s WHEN 1 THEN regexp_replace(s, '([^ ]{4})[^ ]', '\\1', 'g') ELSE reverse(s) END AS quote FROM (SELECT conv_id, turn, array_to_string(w[5:12], ' ') AS s FROM t WHERE len(w) >= 20)),
 y AS (SELECT conv_id, array_to_string(w[i : i + 7], ' ') AS run FROM (SELECT conv_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM t))"""


@query(f"WITH {_QUOTES} SELECT q.conv_id, q.turn, coalesce(bool_or(jaro_winkler_similarity(quote, run) >= 0.85), false) AS found FROM q JOIN y USING (conv_id) GROUP BY q.conv_id, q.turn")
def quotes_found(spark, d):
    """Quotes looked for in whole turns of their conversation, however deep they stand."""
    t = read(spark, d, "conversations").select("conv_id", "turn", normalise(F.col("text")).alias("text"))
    words = F.split("text", " ")
    plain = F.array_join(F.slice(words, 5, 8), " ")
    quote = F.when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, F.regexp_replace(plain, "([^ ]{4})[^ ]", "$1")).otherwise(F.reverse(plain))
    q = t.where(F.size(words) >= 20).select("conv_id", "turn", quote.alias("quote"))
    return digest.found_in(q, t.select("conv_id", "text"), ["conv_id"]).groupBy("conv_id", "turn").agg(F.bool_or("found").alias("found"))


_SPENT = ", ".join(f"sum(CASE WHEN o_orderpriority LIKE '{i}%' THEN o_totalprice ELSE 0 END)" for i in range(1, 6))
_PROFILES = f"v AS (SELECT o_custkey AS id, c_mktsegment AS seg, [{_SPENT}]::DOUBLE[] AS e FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _alike(spark, d):
    spent = [F.sum(F.when(F.col("o_orderpriority").startswith(str(i)), F.col("o_totalprice")).otherwise(0)).cast("double") for i in range(1, 6)]
    seg = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    # sums of doubles depend on their order: a customer's orders are added one by one, by their keys, however the table is split
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    orders = orders.repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    v = orders.groupBy("o_custkey").agg(F.array(*spent).alias("e")).join(seg, "o_custkey")
    return retrieval.similar(v, v, 0.98, 5, "o_custkey", "e", "c_mktsegment")


@query(f"WITH {_PROFILES} SELECT a.id AS source, b.id AS target, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id)::INTEGER AS rank FROM v a JOIN v b ON a.seg = b.seg AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.98 QUALIFY rank <= 5")
def alike_customers(spark, d):
    """For every customer, the five of its segment that spend most alike over the order priorities, at a cosine of 0.98 or more."""
    return _alike(spark, d)[0].select("source", "target", "rank")


@query(f"WITH {_PROFILES}, n AS (SELECT seg, count(*) AS k FROM v GROUP BY seg) SELECT sum(k * k)::BIGINT AS pairs, true AS fewer FROM n")
def alike_effort(spark, d):
    """All pairs within the segments, and that pivots leave some of them out."""
    return _alike(spark, d)[1].select(F.col("pairs").cast("long"), (F.col("compared") < F.col("pairs")).alias("fewer"))
