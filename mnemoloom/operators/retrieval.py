"""Retrieval: similarity search, lexical search, fusion, expansion over graphs and sessions.

Everywhere: score descending, then id ascending. Queries are (query_id, vector), memories (memory_id,
vector); hits are (query_id, memory_id, score, rank).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import cosine, norm, rank_top
from mnemoloom.session import new_folder, stage

BLOCK_ROWS, RUN_ROWS = 16_384, 2_048


def _scores(metric: str, rows: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Scores of each query (a row of the result) with each vector, summed vector by vector, so that equal vectors tie."""
    if metric == "l2":
        return np.stack([-np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in asks])
    dots = np.einsum("ij,kj->ik", asks, rows)
    if metric == "dot":
        return dots
    return dots / np.sqrt((asks * asks).sum(axis=1))[:, None] / np.sqrt((rows * rows).sum(axis=1))


def _matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy()
    return flat.reshape(len(table), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids; those of minus infinity are none."""
    there = np.flatnonzero(scores > -np.inf)
    if len(there) > k:
        there = there[scores[there] >= np.partition(scores[there], len(there) - k)[-k]]
    return there[np.lexsort((ids[there], -scores[there]))[:k]]


def _checked(vector: str = "vector") -> Column:
    """The vector in double precision; an error if it is zero or has NaN."""
    bad = ~F.exists(vector, lambda x: x != 0) | F.exists(vector, lambda x: F.isnan(x))
    return F.when(bad, F.raise_error(F.lit("zero or NaN vector"))).otherwise(F.col(vector).cast("array<double>"))


def _in_blocks(queries: DataFrame, memories: DataFrame, by: list[str], find, schema: str) -> DataFrame:
    """Memories (id, ..) in blocks by a hash of their id, and queries (id, ..) in runs; ``find(block, run)`` answers for each pair of Arrow tables.

    The number of blocks follows the row count, so a task holds BLOCK_ROWS + RUN_ROWS rows about, whatever the table.
    """
    blocks, groups = max(1, -(-memories.count() // BLOCK_ROWS)), max(1, -(-queries.count() // RUN_ROWS))
    at = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = memories.withColumn("block", at(blocks)).withColumn("run", every(groups))
    right = queries.withColumn("run", at(groups)).withColumn("block", every(blocks))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = find(a, b) if len(a) and len(b) else []
        kinds = {"long": np.int64, "double": np.float64, "int": np.int32}
        columns = list(zip(*rows, strict=True)) or [[np.zeros(0, kinds[x.split()[1]])] for x in schema.split(", ")]
        return pa.table({n: np.concatenate(c) for n, c in zip(names, columns, strict=True)})

    keys = [*by, "block", "run"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


HITS = "query_id long, memory_id long, score double"


def vector_topk(queries: DataFrame, memories: DataFrame, k: int, metric: str = "cosine", by: list[str] | None = None, min_score: float | None = None, own: bool = True) -> DataFrame:
    """Exact top ``k`` by cosine, dot product or negative L2 distance, within equal ``by`` columns.

    Queries in runs meet memories in blocks (hash of the id, so no block is hot); a block answers with
    its own top k, and the k best of those are ranked. Without ``own``, a memory whose id is the query's is left out. Null vectors
    and ids take no part; a zero vector or one with NaN raises an error.
    """
    by = by or []
    side = lambda df, ident: df.where(F.col("vector").isNotNull() & F.col(ident).isNotNull()).select(*by, F.col(ident).cast("long").alias("id"), _checked().alias("vector"))

    def find(a: pa.Table, b: pa.Table) -> list[tuple]:
        out, ids, rows, asked, asks = [], a.column("id").to_numpy(), _matrix(a), b.column("id").to_numpy(), _matrix(b)
        for start in range(0, len(asks), 64):
            for me, score in zip(asked[start : start + 64], _scores(metric, rows, asks[start : start + 64]), strict=True):
                if not own:
                    score[ids == me] = -np.inf
                best = _best(ids, score, k)
                best = best if min_score is None else best[score[best] >= min_score]
                out.append((np.full(len(best), me), ids[best], score[best]))
        return out

    found = _in_blocks(side(queries, "query_id"), side(memories, "memory_id"), by, find, HITS)
    return rank_top(found, ["query_id"], k, F.desc("score"), F.asc("memory_id"))


def pair_scores(pairs: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Cosine of the given (query_id, memory_id) pairs alone: two equi-joins, in the JVM."""
    q = queries.select("query_id", F.col("vector").alias("qv"))
    m = memories.select("memory_id", F.col("vector").alias("mv"))
    return pairs.select("query_id", "memory_id").distinct().join(m, "memory_id").join(q, "query_id").select("query_id", "memory_id", cosine(F.col("qv"), F.col("mv")).alias("score"))


def ranked(scores: DataFrame, k: int, by: str = "query_id", ident: str = "memory_id") -> DataFrame:
    return rank_top(scores, [by], k, F.desc("score"), F.asc(ident))


def visual_boost(text: Column, image: Column, category: Column, visual: list[str]) -> Column:
    """The larger of text and image similarity for visual categories where there is an image."""
    return F.when(category.isin(visual) & image.isNotNull(), F.greatest(text, image)).otherwise(text)


def boosted_topk(text_hits: DataFrame, image_hits: DataFrame, text_of, image_of, k: int) -> DataFrame:
    """Top ``k`` by the larger of text and image similarity, from the ``k`` best by either, beyond which none can be.

    ``text_of`` and ``image_of`` score given pairs (query_id, memory_id); pairs without an image, or of queries that are not visual, are in ``image_of``'s result not at all.
    """
    pairs = text_hits.select("query_id", "memory_id").unionByName(image_hits.select("query_id", "memory_id")).distinct()
    x = text_of(pairs).join(image_of(pairs).select("query_id", "memory_id", F.col("score").alias("image")), ["query_id", "memory_id"], "left")
    return ranked(x.select("query_id", "memory_id", F.greatest("score", "image").alias("score")), k)


def eligible(memories: DataFrame, allowed: DataFrame) -> DataFrame:
    """ACTIVE memories of allowed sessions; applied before scoring."""
    return memories.where("status = 'ACTIVE'").join(allowed.select("session_id").distinct(), "session_id", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def graph_append(hits: DataFrame, edges: DataFrame, score_of, m: int = 2, weight: float = 0.2) -> DataFrame:
    """Hits as they are, then up to ``m`` one-hop neighbours by own score + weight * best seed score: (.., via).

    ``score_of`` scores given pairs (query_id, memory_id), see ``pair_scores``: only neighbours of hits are scored.
    """
    seeds = hits.select("query_id", F.col("memory_id").alias("source"), F.col("score").alias("seed"))
    near = seeds.join(both_ways(edges), "source").groupBy("query_id", F.col("target").alias("memory_id")).agg(F.max("seed").alias("seed"))
    fresh = near.join(hits.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    fresh = fresh.join(score_of(fresh), ["query_id", "memory_id"])
    best = ranked(fresh.select("query_id", "memory_id", (F.col("score") + weight * F.col("seed")).alias("score")), m)
    top = hits.groupBy("query_id").agg(F.max("rank").alias("base"))
    added = best.join(top, "query_id").withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    cols = ["query_id", "memory_id", "score", "rank"]
    return hits.select(*cols, F.lit("vector").alias("via")).unionByName(added.select(*cols, F.lit("graph").alias("via")))


def attribute_append(hits: DataFrame, edges: DataFrame, attribute_scores: DataFrame, m: int = 2) -> DataFrame:
    """Neighbours scored by the distinct attributes on all edges from the seeds: edges (source, target, attributes array), attribute_scores (query_id, attribute, score already weighted). A query's own id is no neighbour."""
    two = edges.select("source", "target", "attributes").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "attributes"))
    near = hits.select("query_id", F.col("memory_id").alias("source")).join(two, "source").select("query_id", F.col("target").alias("memory_id"), F.explode("attributes").alias("attribute")).distinct()
    fresh = near.join(hits.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").where("query_id <> memory_id")
    return ranked(fresh.join(attribute_scores, ["query_id", "attribute"]).groupBy("query_id", "memory_id").agg(F.sum("score").alias("score")), m)


def graph_rerank(hits: DataFrame, edges: DataFrame, score_of, k: int, weight: float = 0.2) -> DataFrame:
    """Seeds and neighbours compete for ``k`` places; on ties vector before graph, then id."""
    every = graph_append(hits, edges, score_of, m=1 << 30, weight=weight)
    return rank_top(every.drop("rank"), ["query_id"], k, F.desc("score"), F.desc("via"), F.asc("memory_id"))


def random_append(hits: DataFrame, memories: DataFrame, m: int, seed: str) -> DataFrame:
    """``m`` memories per query that are no hits and not the query's own, the same for each run.

    Each bank is put in the order of sha256(seed|memory) once; a query begins at a place of it that sha256(seed|query) names and takes the
    next ones, round the end. A query so looks at ``m`` + its hits + 1 memories, whatever the bank's size.
    """
    text = lambda ident: F.concat_ws("|", F.lit(seed), F.col(ident).cast("string"))
    order = Window.partitionBy("bank").orderBy(F.sha2(text("memory_id"), 256), "memory_id")
    placed = memories.select("bank", "memory_id", (F.row_number().over(order) - 1).alias("place"))
    sizes = memories.groupBy("bank").agg(F.count("*").alias("size"))
    queries = hits.groupBy("query_id", "bank").agg((F.count("memory_id") + m + 1).alias("wanted")).join(sizes, "bank")
    start = F.conv(F.substring(F.sha2(text("query_id"), 256), 1, 12), 16, 10).cast("long")
    looked = queries.select("query_id", "bank", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.least("wanted", "size") - 1), lambda i: (start + i) % F.col("size"))).alias("step", "place"))
    pool = looked.join(placed, ["bank", "place"]).where("query_id <> memory_id").join(hits.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    return rank_top(pool.select("query_id", "bank", "memory_id", "step"), ["query_id"], m, F.asc("step")).drop("step")


def similarity_join(vectors: DataFrame, t: float, by: str, keep_by: bool = False) -> DataFrame:
    """Pairs (a, b, score), a < b, with cosine >= t inside equal ``by`` blocks, as a blocked matrix product; with ``keep_by`` also the block's ``by``."""
    n = vectors.count()
    parts = max(1, -(-n // BLOCK_ROWS))
    side = vectors.select(by, F.col("memory_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = side.withColumn("p", F.col("part")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("p <= q")
    right = side.select(*(F.col(x).alias(x) for x in side.columns)).withColumn("q", F.col("part")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("p <= q")

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "score": []})
        if not len(a) or not len(b):
            return empty
        unit = lambda x: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.stack(x["vector"].to_list()))
        x, y, left_ids, right_ids, out = unit(a), unit(b), a["id"].to_numpy(), b["id"].to_numpy(), [empty]
        same = a["part"].iloc[0] == b["part"].iloc[0]
        for start in range(0, len(x), 1024):
            s = x[start : start + 1024] @ y.T
            i, j = np.nonzero(s >= t)
            u, v = left_ids[start + i], right_ids[j]
            keep = u < v if same else u != v
            out.append(pd.DataFrame({"a": np.minimum(u, v)[keep], "b": np.maximum(u, v)[keep], "score": s[i, j][keep]}))
        return pd.concat(out)

    def named(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = pairs(a, b)
        return found.assign(**{by: pd.Series([keys[0]] * len(found), found.index, dtype=object)})

    met = left.groupBy(by, "p", "q").cogroup(right.groupBy(by, "p", "q"))
    if keep_by:
        return met.applyInPandas(named, f"a long, b long, score double, {by} {vectors.schema[by].dataType.simpleString()}")
    return met.applyInPandas(pairs, "a long, b long, score double")


def multivector_topk(queries: DataFrame, vectors: DataFrame, k: int, mode: str = "max") -> DataFrame:
    """Documents by the cosines of their vectors with those of a query: queries (query_id, part, vector), vectors (memory_id, vector), several rows an id.

    ``max``, ``mean`` and ``min`` are over all pairs; ``sum`` is the mean over a document's vectors, summed over the query's parts. Blocks are made
    of whole documents and runs of whole queries, and a block answers with its own top k.
    """
    side = lambda df, ident: df.where(F.col("vector").isNotNull()).select(F.col(ident).cast("long").alias("id"), _checked().alias("vector"))

    def find(a: pa.Table, b: pa.Table) -> list[tuple]:
        a, b = a.sort_by("id"), b.sort_by("id")
        ids, rows, asked, asks, out = a.column("id").to_numpy(), _matrix(a), b.column("id").to_numpy(), _matrix(b), []
        heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sizes, bounds = np.diff(np.append(heads, len(ids))), [*np.flatnonzero(np.append(True, asked[1:] != asked[:-1])), len(asked)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            each = _scores("cosine", rows, asks[i:j])
            if mode in ("max", "min"):
                how = np.maximum if mode == "max" else np.minimum
                score = how.reduceat(how.reduce(each, axis=0), heads)
            else:
                score = np.add.reduceat(each.sum(axis=0), heads) / sizes / (j - i if mode == "mean" else 1)
            best = _best(ids[heads], score, k)
            out.append((np.full(len(best), asked[i]), ids[heads][best], score[best]))
        return out

    return ranked(_in_blocks(side(queries, "query_id"), side(vectors, "memory_id"), [], find, HITS), k)


def with_tags(found: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the hits that have one of the tags: tags (id, tag, one row for each tag that is asked for)."""
    return ranked(found.drop("rank").join(tags.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi"), k)


def weighted_topk(queries: DataFrame, memories: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha * cosine with the text + (1 - alpha) * cosine with the best image of the round (the last on ties), and that image's number from 1.

    queries (query_id, vector), memories (memory_id, vector, images array of vectors or null). A block scores both and answers with its own top k.
    """
    flat = F.flatten(F.coalesce(F.col("images").cast("array<array<double>>"), F.array().cast("array<array<double>>")))
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("id"), _checked().alias("vector"))
    held = memories.where("vector is not null").select(F.col("memory_id").cast("long").alias("id"), _checked().alias("vector"), F.greatest(F.size("images"), F.lit(0)).alias("n"), flat.alias("images"))

    def find(a: pa.Table, b: pa.Table) -> list[tuple]:
        ids, rows, n, out = a.column("id").to_numpy(), _matrix(a), np.maximum(a.column("n").fill_null(0).to_numpy(), 0), []
        images = a.column("images").combine_chunks().flatten().to_numpy().reshape(-1, rows.shape[1])
        with_image = np.flatnonzero(n)
        heads, owner = (np.cumsum(n) - n)[with_image], np.repeat(np.arange(len(with_image)), n[with_image])
        for me, q in zip(b.column("id").to_numpy(), _matrix(b), strict=True):
            score, number = alpha * _scores("cosine", rows, q[None])[0], np.zeros(len(ids), np.int64)
            if len(owner):
                each = _scores("cosine", images, q[None])[0]
                best = np.maximum.reduceat(each, heads)
                last = np.flatnonzero(each == best[owner])
                place = np.zeros(len(with_image), np.int64)
                place[owner[last]] = last
                score[with_image] += (1 - alpha) * best
                number[with_image] = place - heads + 1
            score[ids == me] = -np.inf
            top = _best(ids, score, k)
            out.append((np.full(len(top), me), ids[top], score[top], number[top]))
        return out

    found = _in_blocks(asked, held, [], find, HITS + ", image_no long")
    return ranked(found.withColumn("image_no", F.when(F.col("image_no") > 0, F.col("image_no"))), k)


def expand_neighbors(seeds: DataFrame, rounds: DataFrame, w: int = 1) -> DataFrame:
    """Seeds (query_id, conv_id, round) and the rounds up to ``w`` away in their session, once each."""
    wanted = seeds.select("query_id", "conv_id", F.explode(F.sequence(F.col("round") - w, F.col("round") + w)).alias("round")).distinct()
    return wanted.join(rounds, ["conv_id", "round"])


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of hit lists; a single list is returned as it is."""
    if len(lists) == 1:
        return lists[0].select("query_id", "memory_id", "score", "rank")
    every = lists[0].select("query_id", "memory_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "memory_id", "rank"))
    return ranked(every.groupBy("query_id", "memory_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")), 1 << 30)


def hybrid_search(dense: DataFrame, lexical: DataFrame, images: DataFrame, k: int = 60) -> DataFrame:
    """RRF of dense and lexical top 5, then RRF of that with the image top 3."""
    return rrf([rrf([dense.where("rank <= 5"), lexical.where("rank <= 5")], k), images.where("rank <= 3")], k)


def merge_hits(lists: list[DataFrame], how: str) -> DataFrame:
    """One row per (query, memory): its largest score, or its place in the first list that has it."""
    every = None
    for i, x in enumerate(lists):
        x = x.select("query_id", "memory_id", "score", "rank", F.lit(i).alias("list"))
        every = x if every is None else every.unionByName(x)
    if how == "max":
        return ranked(every.groupBy("query_id", "memory_id").agg(F.max("score").alias("score")), 1 << 30)
    first = every.groupBy("query_id", "memory_id").agg(F.min(F.struct("list", "rank", "score")).alias("f"))
    return rank_top(first.select("query_id", "memory_id", "f.score", F.col("f.list").alias("list"), F.col("f.rank").alias("at")), ["query_id"], 1 << 30, F.asc("list"), F.asc("at"), F.asc("memory_id")).drop("list", "at")


def structured_search(df: DataFrame, persons: list[str] | None = None, location: str | None = None, start=None, end=None) -> DataFrame:
    """Rows that meet all given conditions; without a condition, none."""
    conds = []
    if persons:
        conds.append(F.arrays_overlap("persons", F.array(*map(F.lit, persons))))
    if location:
        conds.append(F.lower("location").contains(location.lower()))
    if start is not None and end is not None:
        conds.append(F.col("ts").between(F.lit(start), F.lit(end)))
    out = df.where(F.lit(False)) if not conds else df
    for cond in conds:
        out = out.where(cond)
    return out


def list_memories(df: DataFrame, query: str, field: str = "name", k: int = 10, method: str = "substring", tokens=None, vector: list[float] | None = None) -> DataFrame:
    """The ``k`` memories that fit a query by one field: case-folded ``substring``, ``bm25`` on its words, or cosine of the column ``vector`` (``vector`` of the query).

    A query without words (for ``vector``, one without a vector) gives the first rows in stored order, with a null score.
    """
    from mnemoloom.operators.lexical_index import add_documents, bm25_search  # which needs this module

    spark = df.sparkSession
    first = df.orderBy("memory_id").limit(k).withColumn("score", F.lit(None).cast("double"))
    if method == "vector":
        if not vector:
            return first
        asked = spark.createDataFrame([(0, vector)], "query_id long, vector array<double>")
        hits = vector_topk(asked, df, k)
    elif method == "bm25":
        asked = spark.createDataFrame([(0, query)], "query_id long, text string")
        if not asked.select(F.size(tokens(F.col("text")))).first()[0]:
            return first
        hits = bm25_search(spark, add_documents(spark, new_folder(spark, "listed"), df, tokens, "memory_id", field), asked, tokens, k)
    else:
        rows = df if not query.strip() else df.where(F.lower(field).contains(query.lower()))
        return rows.orderBy("memory_id").limit(k).withColumn("score", F.lit(None).cast("double"))
    return df.join(hits.select("memory_id", "score"), "memory_id")


def recency_topk(df: DataFrame, k: int, mode: str = "decay", decay: float = 0.99, by: str = "bank") -> DataFrame:
    """Newest first; the score is the order itself, the hours since the newest (negative), or decay to that power."""
    newest = F.max("ts").over(Window.partitionBy(by))
    hours = (F.unix_timestamp(newest) - F.unix_timestamp("ts")) / 3600.0
    score = {"raw": F.unix_timestamp("ts").cast("double"), "delta": -hours, "decay": F.pow(F.lit(decay), hours)}[mode]
    return rank_top(df.withColumn("score", score), [by], k, F.desc("ts"), F.asc("memory_id"))


def weighted_recall_search(scored: DataFrame, now: Column, k: int, decay: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """Relevance + recency + importance; returns the hits and the memories' refreshed last access."""
    recency = F.pow(F.lit(decay), (F.unix_timestamp(now) - F.unix_timestamp("last_access")) / 3600.0)
    hits = ranked(scored.withColumn("score", F.col("relevance") + recency + F.col("importance")), k)
    seen = hits.select("memory_id").distinct().withColumn("seen", F.lit(True))
    access = scored.select("memory_id", "last_access").distinct().join(seen, "memory_id", "left").select("memory_id", F.when(F.col("seen"), now).otherwise(F.col("last_access")).alias("last_access"))
    return hits, access


def session_vectors(pages: DataFrame) -> DataFrame:
    """(session_id, vector): the mean of a session's unit page vectors; its dot product with a unit query is the mean of its pages' cosines."""
    unit = F.transform("vector", lambda x: x.cast("double") / norm(F.col("vector")))
    each = pages.select("session_id", F.posexplode(unit).alias("at", "x")).groupBy("session_id", "at").agg(F.avg("x").alias("x"))
    return each.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def two_level_search(sessions: DataFrame, pages: DataFrame, score_of, t2: float) -> DataFrame:
    """Sessions found for each query (query_id, session_id, score, rank), and of their pages (session_id, page_id) alone those that score at least ``t2``, best first.

    ``score_of`` scores given pairs (query_id, memory_id), see ``pair_scores``.
    """
    inside = sessions.join(pages.select("session_id", F.col("page_id").alias("memory_id")), "session_id")
    scored = inside.join(score_of(inside).withColumnRenamed("score", "page_score"), ["query_id", "memory_id"]).where(F.col("page_score") >= t2)
    return scored.groupBy("query_id", "session_id", "rank", "score").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("page_score")).alias("s"), F.col("memory_id").alias("page_id")))), lambda x: x["page_id"]).alias("pages"))


def graph_traverse(seeds: DataFrame, edges: DataFrame, score_of, depth: int, t: float, degree_weight: float = 0.1) -> DataFrame:
    """Breadth-first from the seeds over nodes that score at least ``t``; scores are boosted by 1 + 0.1 * degree: (query_id, memory_id, hop, score).

    ``score_of`` scores given pairs (query_id, memory_id): only nodes that a step reaches are scored, once. A step's frontier is stored before the next.
    """
    two = both_ways(edges)
    degree = two.groupBy(F.col("source").alias("memory_id")).agg(F.count("*").alias("degree"))
    start = seeds.select("query_id", "memory_id").distinct()
    seen = frontier = stage(start.join(score_of(start), ["query_id", "memory_id"]).withColumn("hop", F.lit(0)), "traverse")
    tried = start
    for hop in range(1, depth + 1):
        step = frontier.join(two, frontier["memory_id"] == two["source"]).select("query_id", F.col("target").alias("memory_id")).distinct()
        step = stage(step.join(tried, ["query_id", "memory_id"], "left_anti"), "traverse")
        frontier = stage(step.join(score_of(step), ["query_id", "memory_id"]).where(F.col("score") >= t).withColumn("hop", F.lit(hop)), "traverse")
        seen, tried = seen.unionByName(frontier), tried.unionByName(step)
    boosted = seen.join(degree, "memory_id", "left")
    return boosted.select("query_id", "memory_id", "hop", (F.col("score") * (1 + degree_weight * F.coalesce("degree", F.lit(0)))).alias("score"))


def path_expand(seeds: DataFrame, edges: DataFrame, align_of, hops: int, b: int, t: float) -> DataFrame:
    """Paths from seeds, per hop the best ``b`` continuations by the running product of (alignment + edge weight) / 2; per end the best path at least ``t``.

    ``align_of`` scores given pairs (query_id, memory_id): only ends of paths are scored.
    """
    two = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    now = seeds.select("query_id", F.array("memory_id").alias("path"), F.lit(1.0).alias("score"))
    every = None
    for _ in range(hops):
        x = now.withColumn("source", F.element_at("path", -1)).join(two, "source").where(~F.array_contains("path", F.col("target")))
        align = align_of(x.select("query_id", F.col("target").alias("memory_id"))).select("query_id", F.col("memory_id").alias("target"), F.col("score").alias("align"))
        x = x.join(align, ["query_id", "target"])
        x = x.withColumn("score", F.col("score") * (F.col("align") + F.col("weight")) / 2).withColumn("key", F.array_join("path", ","))
        now = stage(rank_top(x, ["query_id", "key"], b, F.desc("score"), F.asc("target")).select("query_id", F.concat("path", F.array("target")).alias("path"), "score"), "paths")
        every = now if every is None else every.unionByName(now)
    every = every.withColumn("memory_id", F.element_at("path", -1)).where(F.col("score") >= t)
    return every.groupBy("query_id", "memory_id").agg(F.max(F.struct("score", "path")).alias("b")).select("query_id", "memory_id", "b.score", "b.path")


def expand_with_budget(hits: DataFrame, budget: int, cost: Column) -> DataFrame:
    """In rank order each item whose cost still fits is expanded; one that does not fit is passed over."""
    items = F.sort_array(F.collect_list(F.struct("rank", "memory_id", cost.alias("cost"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda a, x: x["cost"] <= a["left"]
    step = lambda a, x: F.struct(F.when(fits(a, x), a["left"] - x["cost"]).otherwise(a["left"]).alias("left"), F.when(fits(a, x), F.concat(a["taken"], F.array(x["memory_id"]))).otherwise(a["taken"]).alias("taken"))
    return hits.groupBy("query_id").agg(items.alias("items")).select("query_id", F.aggregate("items", start, step).alias("r")).select("query_id", "r.taken", "r.left")


def collapse_parts(ident: Column) -> Column:
    return F.regexp_replace(ident, "_part[^_]*$", "")


def fuse_vectors(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b, or b where there is no a."""
    return F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: alpha * x.cast("double") + (1 - alpha) * y.cast("double")))


def route_modalities(raw: Column, allowed: list[str]) -> Column:
    """Modalities named as ``a+b`` or in brackets, those allowed, in order, once each; ``no`` only if nothing else."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace(F.lower(raw), "[\\[\\]'\" ]", ""), "[+,]"), lambda x: F.trim(x)), lambda x: x.isin(allowed)))
    real = F.filter(parts, lambda x: x != "no")
    return F.when(F.size(real) > 0, real).otherwise(F.array(F.lit("no")))


def as_of_bank(memories: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One bank per checkpoint with the memories of sessions visible then: checkpoints (bank, checkpoint, session_id)."""
    return memories.join(checkpoints.select("bank", "checkpoint", "session_id").distinct(), ["bank", "session_id"]).withColumn("bank_at", F.concat_ws("@", F.col("bank").cast("string"), F.col("checkpoint").cast("string")))


def with_zero_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits, and for queries without any a row of rank 0 and no memory."""
    return queries.select("query_id").join(hits, "query_id", "left").withColumn("zero_hit", F.col("memory_id").isNull()).fillna(0, ["rank"])


def filtered_topk(hits: DataFrame, k: int, keep: Column, overfetch: int | None = 2) -> DataFrame:
    """Over-fetch, filter, cut to ``k`` (perhaps fewer); ``overfetch=None`` filters first."""
    wide = hits if overfetch is None else hits.where(F.col("rank") <= k * overfetch)
    return rank_top(wide.where(keep).drop("rank"), ["query_id"], k, F.desc("score"), F.asc("memory_id"))
