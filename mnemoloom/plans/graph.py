"""Queries for graphs: attributes, relations and entities derived from documents and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import r6
from mnemoloom.operators import graph as G
from mnemoloom.operators.components import connected_components
from mnemoloom.plans.registry import query
from mnemoloom.session import table

# Attributes of a document: language, source and length class in text; one more as visual. Banks: id modulo 50.
A = """a AS (SELECT doc_id % 50 AS bank, doc_id AS memory_id, 'lang=' || lang AS attribute, 'text' AS side FROM documents UNION ALL SELECT doc_id % 50, doc_id, 'len=' || (n_chars // 1000), 'text' FROM documents UNION ALL SELECT doc_id % 50, doc_id, 'src=' || source, 'text' FROM documents
    UNION ALL SELECT doc_id % 50, doc_id, 'lang=' || CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END, 'visual' FROM documents WHERE doc_id % 2 = 0), b AS (SELECT bank, count(DISTINCT memory_id) AS n FROM a GROUP BY 1),
    w AS (SELECT a.bank, attribute, count(DISTINCT memory_id) AS df, ln((max(n) + 1) / (count(DISTINCT memory_id) + 1)) AS weight FROM a JOIN b USING (bank) GROUP BY 1, 2)"""
C = f"""{A}, t AS (SELECT DISTINCT bank, attribute, memory_id FROM a WHERE side = 'text'), v AS (SELECT DISTINCT bank, attribute, memory_id FROM a WHERE side = 'visual'),
    p AS (SELECT x.bank, x.attribute, x.memory_id AS source, y.memory_id AS target, 0 AS c FROM t x JOIN t y ON x.bank = y.bank AND x.attribute = y.attribute AND x.memory_id < y.memory_id
      UNION SELECT x.bank, x.attribute, least(x.memory_id, y.memory_id), greatest(x.memory_id, y.memory_id), 1 FROM t x JOIN v y ON x.bank = y.bank AND x.attribute = y.attribute AND x.memory_id <> y.memory_id),
    cand AS (SELECT bank, source, target, sum(weight) AS weight, count(*) FILTER (c = 0) AS n_text, count(*) FILTER (c = 1) AS n_cross FROM p JOIN w USING (bank, attribute) GROUP BY 1, 2, 3)"""


def attrs(spark, d):
    x = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("bank"), F.col("doc_id").alias("memory_id"), "lang", "source", "n_chars")
    said = x.select("bank", "memory_id", F.explode(F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("len="), F.floor(F.col("n_chars") / 1000).cast("string")), F.concat(F.lit("src="), "source"))).alias("attribute"), F.lit("text").alias("side"))
    seen = x.where("memory_id % 2 = 0").select("bank", "memory_id", F.concat(F.lit("lang="), F.when(F.col("memory_id") % 3 == 0, "en").otherwise(F.col("lang"))).alias("attribute"), F.lit("visual").alias("side"))
    return said.unionByName(seen)


def weights(spark, d):
    a = attrs(spark, d)
    return G.attribute_weights(a, a.groupBy("bank").agg(F.countDistinct("memory_id").alias("n")))


@query(f"WITH {A} SELECT bank, attribute, df, round(weight, 6) AS weight FROM w")
def g1_attribute_weights(spark, d):
    return weights(spark, d).withColumn("weight", r6("weight"))


@query(f"WITH {C} SELECT bank, source, target, round(weight, 6) AS weight, n_text, n_cross FROM cand")
def g2_candidate_edges(spark, d):
    return G.candidate_edges(attrs(spark, d), weights(spark, d), first=False, weight=r6)


@query()
def g3_cap_degree(spark, d):
    return G.capped_graph(attrs(spark, d), weights(spark, d)).withColumn("weight", r6("weight"))


@query("SELECT user_id AS bank, event_id AS memory_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id % 5, ts, event_id)")
def g4_temporal_chain(spark, d):
    e = table(spark, d, "events")
    m = e.select(F.col("user_id").alias("bank"), F.col("event_id").alias("memory_id"), F.to_date("ts").alias("date"), (F.col("event_id") % 5).alias("session"), F.col("ts").alias("round"), F.when(F.col("event_type") == "error", "ARCHIVED").otherwise("ACTIVE").alias("status"))
    return G.temporal_chain(m)


@query("""WITH x AS (SELECT DISTINCT doc_id % 50 AS bank, doc_id AS memory_id, unnest(['l' || lang, 's' || source, 'n' || (n_chars // 500)]) AS bucket FROM documents), t AS (SELECT bank, count(DISTINCT memory_id) AS n FROM x GROUP BY 1),
    s AS (SELECT bank, bucket, count(*) / max(n) AS df, count(*) AS k FROM x JOIN t USING (bank) GROUP BY 1, 2), y AS (SELECT x.*, df FROM x JOIN s USING (bank, bucket) WHERE df <= 0.5 AND k > 1),
    p AS (SELECT a.bank, a.memory_id AS source, b.memory_id AS target, min(a.df) AS df, count(*) AS shared FROM y a JOIN y b ON a.bank = b.bank AND a.bucket = b.bucket AND a.memory_id < b.memory_id GROUP BY 1, 2, 3) SELECT bank, source, target, round(df, 6) AS df, shared FROM p WHERE df <= 0.3 OR shared >= 2""")
def g5_rare_pairs(spark, d):
    x = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("bank"), F.col("doc_id").alias("memory_id"), F.explode(F.array(F.concat(F.lit("l"), "lang"), F.concat(F.lit("s"), "source"), F.concat(F.lit("n"), F.floor(F.col("n_chars") / 500).cast("string")))).alias("bucket"))
    return G.rare_pairs(x, x.groupBy("bank").agg(F.countDistinct("memory_id").alias("n")), df=r6)


@query("""WITH m AS (SELECT conv_id % 10 AS bank, conv_id * 1000 + turn AS memory_id, conv_id // 10 AS session, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS ord FROM conversations)
    SELECT a.bank, a.memory_id AS source, b.memory_id AS target FROM m a JOIN m b ON a.bank = b.bank AND abs(a.session - b.session) <= 1 AND a.ord < b.ord UNION SELECT bank, memory_id, memory_id + 5 FROM m""")
def g6_relation_candidates(spark, d):
    t = table(spark, d, "conversations").withColumn("bank", F.col("conv_id") % 10)
    m = t.select("bank", (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.floor(F.col("conv_id") / 10).alias("session"), F.row_number().over(Window.partitionBy("bank").orderBy("conv_id", "turn")).alias("ord"))
    return G.relation_candidates(m, m.select("bank", F.col("memory_id").alias("source"), (F.col("memory_id") + 5).alias("target")))


@query("""WITH s AS (SELECT 'u' || user_id AS entity, event_type AS attribute, event_id AS memory_id, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN 'V' ELSE 'v' END || (event_id % 3) AS value FROM events)
    SELECT a.entity, a.attribute, a.memory_id AS earlier, b.memory_id AS later, a.value AS earlier_value, b.value AS later_value FROM s a JOIN s b ON a.entity = b.entity AND a.attribute = b.attribute AND a.ord < b.ord AND lower(a.value) <> lower(b.value)""")
def g7_conflicts(spark, d):
    e = table(spark, d, "events")
    s = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.col("event_type").alias("attribute"), F.col("event_id").alias("memory_id"), F.col("event_id").alias("ord"), F.concat(F.when(F.col("event_id") % 2 == 0, "V").otherwise("v"), (F.col("event_id") % 3).cast("string")).alias("value"))
    return G.conflicts(s)


@query("""SELECT source, target, type, max(confidence) AS confidence FROM (SELECT user_id AS source, event_id % 20 AS target, ['CAUSES', 'NONE', 'UPDATES'][event_id % 3 + 1] AS type, (event_id % 11) / 10.0::DOUBLE AS confidence FROM events) WHERE type <> 'NONE' AND confidence >= 0.7 GROUP BY 1, 2, 3""")
def g8_accept_relations(spark, d):
    kinds = F.array(*map(F.lit, ["CAUSES", "NONE", "UPDATES"]))
    r = table(spark, d, "events").select(F.col("user_id").alias("source"), (F.col("event_id") % 20).alias("target"), F.element_at(kinds, (F.col("event_id") % 3 + 1).cast("int")).alias("type"), (F.col("event_id") % 11 / 10.0).alias("confidence"))
    return G.accept_relations(r)[0]


# Customers are linked to the next one who ordered on the same day with the same priority.
EDGES = "e AS (SELECT * FROM (SELECT lag(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey) AS a, o_custkey AS b FROM orders) WHERE a IS NOT NULL)"


def linked_customers(spark, d):
    same = Window.partitionBy("o_orderdate", "o_orderpriority").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.lag("o_custkey").over(same).alias("source"), F.col("o_custkey").alias("target")).where("source is not null")


@query(f"WITH RECURSIVE {EDGES}, e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS x FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.x = e2.a) SELECT node, min(x) AS component FROM r GROUP BY 1")
def g9_connected_components(spark, d):
    return connected_components(linked_customers(spark, d), "source", "target")


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4), r AS (SELECT vec_id AS node, vec_id AS x FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a) SELECT node AS memory_id, min(x) AS cluster FROM r GROUP BY 1""")
def g10_threshold_clusters(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"), "label")
    return G.threshold_clusters(v, 0.4, "label")


@query("""WITH n AS (SELECT event_id AS node_id, 'E' || CASE WHEN event_id % 40 >= 30 THEN event_id % 10 ELSE event_id % 40 END AS name, event_type AS kind, value FROM events)
    SELECT name, arg_min(kind, node_id) AS kind, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, round(max(value), 6) AS value FROM n GROUP BY 1""")
def g11_merge_entities(spark, d):
    e = table(spark, d, "events")
    nodes = e.select(F.col("event_id").alias("node_id"), F.concat(F.lit("E"), (F.col("event_id") % 40).cast("string")).alias("name"), F.col("event_type").alias("kind"), F.col("event_type").alias("kinds"), "value")
    alias = nodes.select(F.col("name").alias("alias")).distinct().withColumn("k", F.substring("alias", 2, 9).cast("int")).where("k >= 30").select("alias", F.concat(F.lit("E"), (F.col("k") % 10).cast("string")).alias("name"))
    edges = e.select(F.concat(F.lit("E"), (F.col("event_id") % 40).cast("string")).alias("source"), F.concat(F.lit("E"), (F.col("user_id") % 40).cast("string")).alias("target"), F.lit(1.0).alias("weight"))
    return G.merge_entities(nodes, edges, alias, {"kind": "keep_first", "kinds": "join_unique", "value": "max"})[0].withColumn("value", r6("value"))


@query("""WITH n AS (SELECT event_id AS node_id, 'E' || CASE WHEN event_id % 40 >= 30 THEN event_id % 10 ELSE event_id % 40 END AS s, 'E' || CASE WHEN user_id % 40 >= 30 THEN user_id % 10 ELSE user_id % 40 END AS t FROM events)
    SELECT least(s, t) AS source, greatest(s, t) AS target, count(*)::DOUBLE AS weight, count(*) AS n FROM n WHERE s <> t GROUP BY 1, 2""")
def g11_merge_edges(spark, d):
    e = table(spark, d, "events")
    name = lambda x: F.concat(F.lit("E"), (F.col(x) % 40).cast("string"))
    nodes = e.select(F.col("event_id").alias("node_id"), name("event_id").alias("name"))
    alias = nodes.select(F.col("name").alias("alias")).distinct().withColumn("k", F.substring("alias", 2, 9).cast("int")).where("k >= 30").select("alias", F.concat(F.lit("E"), (F.col("k") % 10).cast("string")).alias("name"))
    return G.merge_entities(nodes, e.select(name("event_id").alias("source"), name("user_id").alias("target"), F.lit(1.0).alias("weight")), alias, {"node_id": "max"})[1]


@query("""SELECT 'N' || user_id % 30 AS name, event_type AS type, list_sort(list_distinct(list('s' || event_id % 7))) AS sources, list_sort(list_distinct(list('a' || event_id % 3))) AS aliases, arg_min('v' || event_id, event_id) AS attribute, count(*) AS mentions, min(ts) AS first_seen FROM events GROUP BY 1, 2""")
def g12_upsert_entities(spark, d):
    s = F.col("event_id").cast("string")
    e = table(spark, d, "events").select(F.concat(F.lit("N"), (F.col("user_id") % 30).cast("string")).alias("name"), F.col("event_type").alias("type"), F.array(F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))).alias("sources"), F.array(F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))).alias("aliases"), F.concat(F.lit("v"), s).alias("attribute"), F.lit(1).alias("mentions"), F.col("ts").alias("first_seen"), F.col("event_id").alias("seq"))
    return G.upsert_entities(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))


@query("SELECT user_id AS s, event_type AS p, event_id % 5 AS o, count(*) AS mentions, max(value) AS confidence, list_sort(list_distinct(list(event_id % 9))) AS sources FROM events GROUP BY 1, 2, 3")
def g13_upsert_relations(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("s"), F.col("event_type").alias("p"), (F.col("event_id") % 5).alias("o"), F.col("value").alias("confidence"), (F.col("event_id") % 9).alias("source"), "event_id")
    return G.upsert_relations(e.where("event_id % 3 = 0").drop("event_id"), e.where("event_id % 3 <> 0").drop("event_id"))


@query(f"WITH RECURSIVE {EDGES}, e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, 0 AS hop FROM e2 WHERE a % 97 = 0 UNION SELECT e2.b, hop + 1 FROM r JOIN e2 ON node = a WHERE hop < 3) SELECT node, min(hop)::INT AS hop FROM r GROUP BY 1")
def g14_k_hop(spark, d):
    e = linked_customers(spark, d)
    seeds = e.select(F.explode(F.array("source", "target")).alias("node")).where("node % 97 = 0")
    return G.k_hop(e, seeds, 3)


@query(f"WITH {EDGES} SELECT a AS source, b AS target FROM e WHERE a % 3 <> 0 AND b % 3 <> 0")
def g15_subgraph(spark, d):
    e = linked_customers(spark, d)
    return G.subgraph(e, e.select(F.explode(F.array("source", "target")).alias("node")).where("node % 3 <> 0"))


@query("WITH n AS (SELECT c_name AS name, c_mktsegment AS type, c_custkey % 100 AS mentions FROM customer) SELECT name, mentions FROM n WHERE contains(lower(name), '00') AND type = 'BUILDING' ORDER BY mentions DESC, name LIMIT 10")
def g16_search_entities(spark, d):
    n = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.array().cast("array<string>").alias("aliases"), (F.col("c_custkey") % 100).alias("mentions"))
    return G.search_entities(n, "00", "BUILDING").select("name", "mentions")


@query("""WITH e AS (SELECT DISTINCT user_id AS source, user_id + 1 + event_id % 3 AS target, 3.0 AS weight FROM events), d AS (SELECT event_id % 150 AS node, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN -0.5 ELSE 0.1 END AS delta FROM events),
    s AS (SELECT source, target, weight, seq, sum(2 * delta) AS d FROM e JOIN d ON node = source OR node = target GROUP BY 1, 2, 3, 4), r AS (SELECT *, weight + sum(d) OVER (PARTITION BY source, target ORDER BY seq) AS now FROM s), z AS (SELECT source, target, min(now) AS low, arg_max(now, seq) AS last FROM r GROUP BY 1, 2)
    SELECT source, target, round(coalesce(last, weight), 6)::DOUBLE AS weight FROM e LEFT JOIN z USING (source, target) WHERE low IS NULL OR low > 0""")
def g17_weight_deltas(spark, d):
    ev = table(spark, d, "events")
    e = ev.select(F.col("user_id").alias("source"), (F.col("user_id") + 1 + F.col("event_id") % 3).alias("target"), F.lit("3.0").cast("decimal(20,1)").alias("weight")).distinct()
    deltas = ev.select((F.col("event_id") % 150).alias("node"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.lit("-0.5")).otherwise(F.lit("0.1")).cast("decimal(20,1)").alias("delta"))
    return G.apply_weight_deltas(e, deltas).withColumn("weight", F.col("weight").cast("double"))


@query()
def g18_drop_redundant(spark, d):
    v = table(spark, d, "embeddings")
    e = v.select(F.col("label").cast("long").alias("source"), F.col("vec_id").alias("target"), (F.col("vec_id") % 7).alias("weight"))
    return G.drop_redundant(e, v.select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector")), 0.5)


@query(f"WITH {EDGES} SELECT a AS source, b AS target FROM e WHERE a % 20 <= 12 AND b % 20 <= 12 AND (a + b) % 20 <= 12")
def g19_graph_as_of(spark, d):
    e = linked_customers(spark, d).withColumn("clip", (F.col("source") + F.col("target")) % 20)
    n = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("clip", F.col("node") % 20)
    return G.graph_as_of(n, e, 12)[1].select("source", "target")


@query("""WITH s AS (SELECT a.vec_id AS source, b.vec_id AS target, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS k FROM s) SELECT source, target, round(score, 6) AS score FROM r WHERE k <= 3 AND score >= 0.3""")
def g20_link_similar(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("bank"), F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    return G.link_similar(v, 3, 0.3).withColumn("score", r6("score"))


CONCEPTS = "c AS (SELECT DISTINCT user_id % 5 AS bank, user_id AS node, event_type || (event_id % 4) AS concept FROM events)"


def concepts(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("bank"), F.col("user_id").alias("node"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("concept")).distinct()


@query(f"WITH {CONCEPTS}, q AS (SELECT node AS query_id, concept FROM c WHERE node % 10 = 0), nq AS (SELECT query_id, count(*) AS nq FROM q GROUP BY 1), nn AS (SELECT node, count(*) AS nn FROM c GROUP BY 1) SELECT query_id, node, round(count(*) / greatest(max(nq), max(nn)), 6)::DOUBLE AS overlap FROM q JOIN c USING (concept) JOIN nq USING (query_id) JOIN nn USING (node) GROUP BY 1, 2 HAVING count(*) / greatest(max(nq), max(nn)) > 0.5")
def g21_concept_match(spark, d):
    c = concepts(spark, d)
    return G.concept_match(c.where("node % 10 = 0").select(F.col("node").alias("query_id"), "concept"), c.select("node", "concept"), 0.5, symmetric=True, overlap=r6)


@query("""WITH x AS (SELECT a.vec_id AS source, b.vec_id AS target, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, 'item ' || a.vec_id AS ta, 'item ' || b.vec_id AS tb FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    w AS (SELECT source, target, 0.7 * c + 0.3 * (1 - levenshtein(ta, tb) / greatest(length(ta), length(tb))) AS weight FROM x WHERE c > 0), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS k FROM w WHERE weight >= 0.4) SELECT source, target, round(weight, 6) AS weight FROM r WHERE k <= 3""")
def g22_similarity_links(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("text"))
    return G.similarity_links(v, 0.7, 0.3, 3, 0.4, "label").select("source", "target", r6("weight").alias("weight"))


@query("WITH x AS (SELECT user_id AS bank, lag(event_id) OVER w AS source, event_id AS target, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT bank, source, target, round(exp(-gap / 3600), 6) AS weight FROM x WHERE source IS NOT NULL")
def g23_succession_edges(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("bank"), F.col("event_id").alias("memory_id"), F.struct("ts", "event_id").alias("ord"), "ts")
    return G.succession_edges(e).withColumn("weight", r6("weight"))


@query(f"WITH {CONCEPTS}, s AS (SELECT bank, node, count(*) AS n FROM c GROUP BY 1, 2) SELECT a.bank, b.node AS source, a.node AS target, round(count(*) / greatest(max(sa.n), max(sb.n)), 6)::DOUBLE AS weight FROM c a JOIN c b ON a.bank = b.bank AND a.concept = b.concept AND a.node < b.node JOIN s sa ON sa.bank = a.bank AND sa.node = a.node JOIN s sb ON sb.bank = b.bank AND sb.node = b.node GROUP BY 1, 2, 3 HAVING count(*) >= 8")
def g24_concept_edges(spark, d):
    return G.concept_edges(concepts(spark, d), 8, weight=r6)


# Sessions of a bank: its documents in order, ten a session. Checkpoints: after the first, the third and the last of six sessions.
PREFIX = f"""{A}, o AS (SELECT *, memory_id // 500 AS ord FROM a), k AS (SELECT bank, c AS checkpoint, [0, 2, 1000000][c] AS t FROM (SELECT DISTINCT bank FROM a), unnest([1, 2, 3]) u(c)),
    pn AS (SELECT k.bank, checkpoint, count(DISTINCT memory_id) AS n FROM k JOIN o ON o.bank = k.bank AND ord <= t GROUP BY 1, 2),
    pw AS (SELECT k.bank, k.checkpoint, attribute, count(DISTINCT memory_id) AS df, ln((max(n) + 1) / (count(DISTINCT memory_id) + 1)) AS weight FROM k JOIN o ON o.bank = k.bank AND ord <= t JOIN pn ON pn.bank = k.bank AND pn.checkpoint = k.checkpoint GROUP BY 1, 2, 3)"""


def ordered_attrs(spark, d):
    return attrs(spark, d).withColumn("ord", F.floor(F.col("memory_id") / 500))


def checkpoints(spark, d):
    return attrs(spark, d).select("bank").distinct().select("bank", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("checkpoint"), F.lit(t).cast("long").alias("at")) for i, t in ((1, 0), (2, 2), (3, 1_000_000))))).alias("c")).select("bank", "c.*")


@query(f"WITH {PREFIX} SELECT bank, checkpoint, attribute, df, round(weight, 6) AS weight FROM pw")
def v29_prefix_weights(spark, d):
    return G.prefix_weights(ordered_attrs(spark, d), checkpoints(spark, d)).drop("at").withColumn("weight", r6("weight"))


@query(f"""WITH {PREFIX}, t AS (SELECT DISTINCT bank, attribute, memory_id, ord FROM o WHERE side = 'text'), v AS (SELECT DISTINCT bank, attribute, memory_id, ord FROM o WHERE side = 'visual'),
    p AS (SELECT x.bank, x.attribute, x.memory_id AS source, y.memory_id AS target, 0 AS c, greatest(x.ord, y.ord) AS born FROM t x JOIN t y ON x.bank = y.bank AND x.attribute = y.attribute AND x.memory_id < y.memory_id
      UNION SELECT x.bank, x.attribute, least(x.memory_id, y.memory_id), greatest(x.memory_id, y.memory_id), 1, greatest(x.ord, y.ord) FROM t x JOIN v y ON x.bank = y.bank AND x.attribute = y.attribute AND x.memory_id <> y.memory_id)
    SELECT p.bank, k.checkpoint, source, target, round(sum(weight), 6) AS weight, count(*) FILTER (c = 0) AS n_text, count(*) FILTER (c = 1) AS n_cross FROM p JOIN k ON k.bank = p.bank AND born <= k.t JOIN pw ON pw.bank = p.bank AND pw.checkpoint = k.checkpoint AND pw.attribute = p.attribute GROUP BY 1, 2, 3, 4""")
def v29_prefix_edges(spark, d):
    return G.prefix_edges(ordered_attrs(spark, d), checkpoints(spark, d), first=False, weight=r6)


@query()
def v29_prefix_graphs(spark, d):
    """The capped graph of each bank at each of its checkpoints."""
    return G.prefix_graphs(ordered_attrs(spark, d), checkpoints(spark, d)).withColumn("weight", r6("weight"))
