"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.llm import ann, bpe, chunks, jaccard, langid, licenses, media, merkle, packing, repair, suffix, urlfilter, warc
from mnemoloom.session import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(root, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.to_media(table(spark, sf_dir, "documents")))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup_substrings(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_repeats(table(spark, sf_dir, "documents"), length=50)


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    prototypes = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.merkle_proofs(table(spark, sf_dir, "documents"), candidate=tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_packing, op3_transport_stream, op4_chunk_dedup, op5_jaccard_join, op6_suffix_dedup, op7_bpe_automaton, op8_multi_index, op9_language, op10_url_rules, op11_license_scan, op12_role_repair, op13_merkle_manifest)
}

def _counted(column: str) -> str:
    """DuckDB: ``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}, '-')"


def _crc32(text: str) -> str:
    """DuckDB: unsigned CRC-32 of a short ASCII text."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda v: ascii(v)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _edit(state: str, cost: int | str, letter: str, when: str = "") -> str:
    """DuckDB: cost and audit after an edit; where it isn't allowed, a cost beyond all others."""
    done = f"{{'c': {state}.c + {cost}, 's': {state}.s || '{letter}'}}"
    return f"CASE WHEN {when} THEN {done} ELSE {{'c': 1000000000, 's': ''}} END" if when else done


ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s),
        t AS (SELECT doc_id, unnest(sh) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.component_id
        FROM n JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON m.node = n.doc_id""",
    "op6_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT doc_id, 500 * j AS base, substr(x, 1000 * j + 1, 1098) AS y FROM h, unnest(range(0, (length(x) // 2 + 450) // 500)) v(j)),
        p AS (SELECT doc_id, base + k AS i, hash(substr(y, 2 * k + 1, 100)) AS s FROM c, unnest(range(0, least(500, length(y) // 2 - 49))) u(k)),
        m AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first_id FROM p),
        b AS (SELECT doc_id, i, i + 50 AS e FROM m WHERE doc_id > first_id),
        g AS (SELECT *, CASE WHEN i <= max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM b),
        k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        r AS (SELECT doc_id, run, min(i) AS a, max(e) AS z FROM k GROUP BY 1, 2),
        q AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list([a, z] ORDER BY a) AS rs FROM r GROUP BY 1),
        t AS (SELECT h.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                CASE WHEN rs IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(rs) + 1),
                    lambda j: substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * rs[j][2] + 1 END,
                                CASE WHEN j = len(rs) THEN length(x) ELSE 2 * (rs[j + 1][1] - CASE WHEN j = 0 THEN 0 ELSE rs[j][2] END) END)), '') END AS kept
              FROM h LEFT JOIN q USING (doc_id))
        SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t""",
    "op10_url_rules": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC NULLS LAST, length(p) DESC) AS k
              FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
    "op11_license_scan": licenses.scan_sql(),
    "op12_role_repair": rf"""
        WITH RECURSIVE x AS (SELECT row_number() OVER () AS r, coalesce(conv_id::VARCHAR, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
                                    {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
        y AS (SELECT r, k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t,
                     unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(t), r, copy) AS n, row_number() OVER (PARTITION BY k, role, t ORDER BY turn NULLS FIRST, r, copy) AS same,
                     rtrim(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS shown FROM y),
        f AS (SELECT *, left(role, 1) AS i, CASE WHEN shown = '' THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM z),
        g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS can, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, lead(i) OVER (PARTITION BY k ORDER BY n) AS j FROM f),
        d(k, n, a, b, u, v) AS (
            SELECT DISTINCT k, 0::BIGINT, {{'c': 0::BIGINT, 's': ''}}, {{'c': 1000000000::BIGINT, 's': ''}}, {{'c': 1000000000::BIGINT, 's': ''}}, {{'c': 1000000000::BIGINT, 's': ''}} FROM x
            UNION ALL SELECT k, n + 1, {_edit('a', 2, 'D')}, list_min([{_edit('b', 2, 'D')}, {_edit('a', 'more', 'K', "can AND i = 's'")}]),
                list_min([{_edit('p', 2, 'D')}, {_edit('w', 'more', 'K', "can AND i = 'u'")}, {_edit('w', 'more + 1', 'R', 'can')}]),
                list_min([{_edit('q', 2, 'D')}, {_edit('p', 'more', 'K', "can AND i = 'a'")}, {_edit('p', 'more + 1', 'R', 'can')}])
            FROM (SELECT *, list_min([v, {_edit('p', 5, 'I')}]) AS q, list_min([a, b, list_min([v, {_edit('p', 5, 'I')}])]) AS w
                  FROM (SELECT d.*, g.i, g.can, g.more, list_min([u, {_edit('a', 5, 'I')}, {_edit('b', 5, 'I')}, {_edit('v', 5, 'I')}]) AS p FROM d JOIN g ON g.k = d.k AND g.n = d.n + 1))),
        l AS (SELECT k, list_min([a, v, {_edit('b', 10, 'II')}, {_edit('u', 5, 'I')}]) AS best FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1),
        e AS (SELECT k, unnest(range(1, length(best.s) + 1)) AS pos, best.s AS s FROM l),
        h AS (SELECT k, s[pos] AS e, sum(CASE WHEN s[pos] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS n, sum(CASE WHEN s[pos] <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS o FROM e),
        w AS (SELECT h.k, h.e, h.o, CASE WHEN e = 'I' THEN '' ELSE g.role END AS role, CASE WHEN e = 'I' THEN '' ELSE g.t END AS t,
                     max(CASE WHEN h.o = 1 AND e = 'K' AND g.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY h.k) AS sys FROM h LEFT JOIN g ON g.k = h.k AND g.n = h.n WHERE e <> 'D'),
        m AS (SELECT k, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || t, chr(10) ORDER BY o) AS text FROM w GROUP BY k),
        c AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY k)
        SELECT nullif(l.k, '')::BIGINT AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best.c AS cost, best.s AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
        FROM l LEFT JOIN c USING (k) LEFT JOIN m USING (k)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS k, concat({', '.join(_counted(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))}) AS head, text,
                                    CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS given FROM documents),
        d AS (SELECT r, doc_id, k, sha256(head || {_counted('text')}) AS leaf, sha256(head || {_counted('given')}) AS proved FROM t),
        z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        a(l, k, i, h) AS (SELECT 0, k, i, leaf FROM z UNION ALL
            SELECT l + 1, k, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM a) WHERE c > 1 GROUP BY l, k, i // 3),
        s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT k, arg_max(h, l) AS h FROM a GROUP BY k)),
        b(l, i, h) AS (SELECT 0, i, subroot FROM s UNION ALL
            SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM b) WHERE c > 1 GROUP BY l, i // 3),
        e AS (SELECT l, k, i, h FROM a UNION ALL SELECT l, NULL, i, h FROM b),
        n AS (SELECT x.l, x.k, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS p, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS q
              FROM e x JOIN e y ON x.l = y.l AND x.k IS NOT DISTINCT FROM y.k AND x.i // 3 = y.i // 3 GROUP BY 1, 2, 3),
        m AS (SELECT *, max(l) OVER (PARTITION BY k) AS last FROM n),
        w AS (SELECT z.r, m.l, m.p, m.q FROM z JOIN m ON m.k = z.k AND m.l < m.last AND m.i = z.i // (3 ** m.l)::BIGINT
              UNION ALL SELECT z.r, 100 + m.l, m.p, m.q FROM z JOIN s USING (k) JOIN m ON m.k IS NULL AND m.l < m.last AND m.i = s.i // (3 ** m.l)::BIGINT),
        f AS (SELECT r, string_agg(p || q, '' ORDER BY l) AS proof, list({{'p': p, 'q': q}} ORDER BY l) AS steps FROM w GROUP BY r),
        g AS (SELECT z.doc_id, z.leaf, s.subroot, (SELECT arg_max(h, l) FROM b) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                     list_reduce(list_prepend({{'p': proved, 'q': ''}}, coalesce(steps, [])), lambda x, y: {{'p': sha256(y.p || x.p || y.q), 'q': ''}}).p AS folded_root
              FROM z JOIN s USING (k) LEFT JOIN f USING (r))
        SELECT *, folded_root = root AS verified FROM g""",
}
