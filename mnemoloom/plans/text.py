"""Queries for text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.functions.columns import words
from mnemoloom.operators import text as T
from mnemoloom.plans.registry import query
from mnemoloom.session import table

NORMAL = r"""trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(translate(regexp_replace(regexp_replace(
    regexp_replace(lower({}), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '\.', ' ', 'g'),
    '!"#$%&''()*+,-/:;<=>?@[\]^`{{|}}~', '                              '), '\s+', ' ', 'g')), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', 'and')), ' ') , chr(1), '.', 'g'))"""
NORMAL = NORMAL.replace("\n    ", " ")


def docs(spark, d):
    return table(spark, d, "documents")


@query(f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents")
def t1_normalize_answer(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_answer("text").alias("normal"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS normal FROM documents")
def t2_normalize_alnum(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_alnum("text").alias("normal"))


@query("""SELECT doc_id, replace(replace(translate(text || ' “x” ’y‘ — ' , '–—“”’‘', '--""' || chr(39) || chr(39)), '…', '...'), ' . . . ', ' ... ') AS folded FROM documents""")
def t3_fold_unicode(spark, d):
    return docs(spark, d).select("doc_id", T.fold_unicode(F.concat("text", F.lit(" “x” ’y‘ — "))).alias("folded"))


@query(r"""WITH x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents)
    SELECT doc_id, w, 'color' AS k, CASE
      WHEN w IN ('children','feet','geese','men','mice','people','teeth','women') THEN map {'children':'child','feet':'foot','geese':'goose','men':'man','mice':'mouse','people':'person','teeth':'tooth','women':'woman'}[w]
      WHEN length(w) > 3 AND w LIKE '%ies' THEN w[:-4] || 'y'
      WHEN length(w) > 4 AND regexp_matches(w, '(sses|shes|ches|xes|zes)$') THEN w[:-3]
      WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END AS v
    FROM x WHERE w NOT IN ('none', 'unknown', 'seated')""")
def t4_normalize_attribute(spark, d):
    w = docs(spark, d).select("doc_id", F.explode(F.array_distinct(words("text", "a-z"))).alias("w")).where(~F.col("w").isin("none", "unknown", "seated"))
    k, v = T.normalize_attribute(F.lit(" Coat Color "), "w")
    return w.select("doc_id", "w", k.alias("k"), v.alias("v"))


def attribute_rows(spark, d):
    e = table(spark, d, "events")
    keys = F.array(*map(F.lit, ["color", "owner", "mood", "trait", "status"]))
    return e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("entity"), F.element_at(keys, (F.col("event_id") % 5 + 1).cast("int")).alias("attribute"), F.array(F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("w"), (F.col("event_id") % 13).cast("string"))).alias("values"))


@query("""WITH r AS (SELECT user_id AS memory_id, event_id AS pos, event_type AS entity, ['color','owner','mood','trait','status'][event_id % 5 + 1] AS attribute, unnest([0, 1]) AS vpos, event_id FROM events),
    x AS (SELECT *, CASE vpos WHEN 0 THEN 'v' || event_id % 7 ELSE 'w' || event_id % 13 END AS value FROM r WHERE attribute <> 'mood'),
    f AS (SELECT memory_id, entity, attribute, value, min([pos, vpos]) AS at_ FROM x GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY memory_id, entity, attribute ORDER BY at_) AS n FROM f),
    g AS (SELECT memory_id, entity, attribute, min(at_) AS at_, list(value ORDER BY at_) AS "values" FROM n WHERE n <= 8 GROUP BY 1, 2, 3),
    m AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY at_) AS record FROM g) SELECT memory_id, entity, attribute, "values", record::INT AS record FROM m WHERE record <= 16""")
def t5_normalize_attributes(spark, d):
    return T.normalize_attributes(attribute_rows(spark, d))


@query("""SELECT memory_id, pos, name, type, color FROM (SELECT user_id AS memory_id, event_id AS pos, 'Item ' || event_id % 9 AS name, upper(['person','object','ghost'][event_id % 3 + 1]) AS type,
      CASE WHEN event_id % 3 = 1 THEN 'c' || event_id % 4 END AS color, row_number() OVER (PARTITION BY user_id, event_id % 9, event_id % 3 ORDER BY event_id) AS n FROM events) WHERE n = 1 AND type <> 'GHOST'""")
def t6_normalize_entities(spark, d):
    e = table(spark, d, "events")
    kinds = F.array(*map(F.lit, ["person", " Object", "ghost"]))
    rows = e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("pos"), F.concat(F.lit(" Item "), (F.col("event_id") % 9).cast("string")).alias("name"), F.element_at(kinds, (F.col("event_id") % 3 + 1).cast("int")).alias("type"), F.create_map(F.lit("Color "), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")), F.lit("size"), F.lit("x")).alias("attributes"))
    x = T.normalize_entities(rows)
    return x.select("memory_id", "pos", "name", "type", F.try_element_at("attributes", F.lit("color")).alias("color"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'WRONG' ELSE 'PARSE_ERROR' END AS label,
    CASE WHEN event_id % 4 < 2 THEN 0.25 * (event_id % 5) END AS score, event_id % 4 > 1 AS error FROM events WHERE event_id % 4 <> 2 OR TRUE""")
def t7_parse_model_json(spark, d):
    e = table(spark, d, "events")
    score = (F.col("event_id") % 5 * 0.25).cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('Sure! ```json\n{"label": "Yes", "score": '), score, F.lit("}\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"label": " no ", "score": "'), score, F.lit('"} done'))).when(F.col("event_id") % 4 == 2, F.lit("no json here")).otherwise(F.lit('{"label": '))
    p = T.parse_model_json(raw, {"yes": "CORRECT", "no": "WRONG"})
    return e.select("event_id", p.alias("p")).select("event_id", "p.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS strict, CASE WHEN event_id % 4 IN (0, 1) THEN event_type END AS recovered FROM events""")
def t8_extract_answer(spark, d):
    e = table(spark, d, "events")
    block = F.concat(F.lit("<answer> "), "event_type", F.lit(" </answer>"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), block)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("I think "), block)).when(F.col("event_id") % 4 == 2, F.concat(block, block)).otherwise(F.lit("<answer> </answer>"))
    strict, recovered = T.extract_answer(raw)
    return e.select("event_id", strict.alias("strict"), recovered.alias("recovered"))


@query("SELECT event_id, ['A', 'B', 'C', 'D', 'INVALID'][event_id % 5 + 1] AS choice FROM events")
def t9_extract_choice(spark, d):
    e = table(spark, d, "events")
    forms = F.array(*map(F.lit, [" a ", "B) because", "the answer is c", "pick: (D) or b", "none of them"]))
    return e.select("event_id", T.extract_choice(F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int"))).alias("choice"))


@query()
def t10_near_dedup(spark, d):
    return T.near_dedup(docs(spark, d), "doc_id", "text", 0.7)


@query("SELECT sha256(text) AS digest, list_sort(list_distinct(list(source))) AS sources, count(*) AS n FROM documents GROUP BY text")
def t11_collapse_by_key(spark, d):
    return T.collapse_by_key(docs(spark, d), "text", "source").select(F.sha2("text", 256).alias("digest"), "sources", "n")


@query("""SELECT event_id, date_trunc('day', ts) - INTERVAL 1 DAY AS day_start, date_trunc('day', ts) AS day_end, date_trunc('week', ts) + INTERVAL 7 DAY AS week_start,
    date_trunc('week', ts) + INTERVAL 14 DAY AS week_end, date_trunc('month', ts) - INTERVAL 30 DAY AS month_start, date_trunc('month', ts)::TIMESTAMP AS month_end FROM events""")
def t12_calendar_range(spark, d):
    e = table(spark, d, "events")
    out = [F.col("event_id")]
    for unit, offset in (("day", -1), ("week", 1), ("month", -1)):
        a, b = T.calendar_range(F.col("ts"), unit, offset)
        out += [a.alias(f"{unit}_start"), b.alias(f"{unit}_end")]
    return e.select(*out)
