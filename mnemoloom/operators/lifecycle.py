"""Importance, decay, consolidation, eviction, confidence and gold states of memories. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import c, ordered_collect, ratio


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600.0


def importance(base: str, created: str, accessed: str, uses: str, links: str, entities: str, now: Column, decay: float = 0.95) -> Column:
    """0.2 base + 0.15 decay^age + 0.15 decay^idle (days) + 0.3 min(ln(1 + uses) / 5, 1) + 0.2 min(links / 3, 1) + 0.2 min(entities / 10, 1)."""
    fade = lambda t: F.pow(F.lit(decay), hours_between(c(t), now) / 24.0)
    part = lambda x, top: F.least(x / top, F.lit(1.0))
    return 0.2 * c(base) + 0.15 * fade(created) + 0.15 * fade(accessed) + 0.3 * part(F.log1p(c(uses).cast("double")), 5.0) + 0.2 * part(c(links), 3.0) + 0.2 * part(c(entities), 10.0)


def consolidate(df: DataFrame, low: float, high: float) -> DataFrame:
    """Archive below ``low``; strengthen above ``high`` by a tenth, 2 at most."""
    action = F.when(F.col("importance") < low, "archive").when(F.col("importance") > high, "strengthen").otherwise("keep")
    strength = F.when(F.col("importance") > high, F.least(F.lit(2.0), F.col("strength") * 1.1)).otherwise(F.col("strength"))
    return df.withColumns({"action": action, "strength": strength, "status": F.when(F.col("importance") < low, "ARCHIVED").otherwise(F.col("status"))})


def forget_candidates(df: DataFrame, low: float) -> DataFrame:
    return df.where((F.col("status") == "ACTIVE") & (F.col("importance") < low))


def top_important(df: DataFrame, n: int) -> DataFrame:
    return df.where("status = 'ACTIVE'").orderBy(F.desc("importance"), "memory_id").limit(n)


def forget_prob(age: Column, strength: Column, coefficient: float) -> Column:
    return F.exp(-age / (coefficient * strength))


def sample_forget(ident: Column, keep: Column, seed: int) -> Column:
    """Whether a memory is forgotten: a uniform draw fixed by its id and the seed, above the probability to keep."""
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), ident.cast("string")), 256), 1, 12), 16, 10)
    return drawn.cast("double") / float(1 << 48) >= keep


def heat(visits: Column, length: Column, last: Column, now: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, tau: float = 24.0) -> Column:
    """alpha visits + beta length + gamma exp(-hours / tau); a time that cannot be read counts 0.1. ``last`` is a string."""
    t = F.try_to_timestamp(last)
    return alpha * visits + beta * length + gamma * F.coalesce(F.exp(-hours_between(t, now) / tau), F.lit(0.1))


def evict_lfu(df: DataFrame, capacity: int) -> DataFrame:
    """Of each bank the rows that leave: the least used beyond capacity, the older first on ties."""
    w = Window.partitionBy("bank")
    x = df.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("uses", "inserted", "memory_id")))
    return x.where(F.col("place") <= F.col("n") - capacity).drop("n", "place")


def assign_sessions(pages: DataFrame, scores: DataFrame, alpha: float = 1.0, t: float = 0.6) -> DataFrame:
    """The best session of a page by similarity + alpha * Jaccard of keywords, if at least ``t``; else a new one: scores (page_id, session_id, similarity, page_words, session_words)."""
    shared = F.size(F.array_intersect("page_words", "session_words"))
    jaccard = F.coalesce(ratio(shared, F.size(F.array_union("page_words", "session_words"))), F.lit(0.0))
    best = scores.withColumn("score", F.col("similarity") + alpha * jaccard).groupBy("page_id").agg(F.max(F.struct("score", (-F.col("session_id")).alias("s"))).alias("b"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.when(F.col("b.score") >= t, -F.col("b.s")).alias("session_id"), F.col("b.score").alias("score"))


def source_score(source: Column, table: list[tuple[str, float]], default: float = 0.6) -> Column:
    """Score of the first name contained in the source."""
    out = F.when(F.lit(False), F.lit(default))
    for name, score in table:
        out = out.when(F.lower(source).contains(name), score)
    return out.otherwise(default)


def time_score(age_days: Column, half_life: float) -> Column:
    return F.when(age_days.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life))


def consensus(links: DataFrame, confidence: DataFrame) -> DataFrame:
    """Per memory the weighted mean of confidence * cosine over its links, within [-1, 1]: links (memory_id, other, weight, cosine)."""
    x = links.join(confidence.select(F.col("memory_id").alias("other"), "confidence"), "other")
    mean = ratio(F.sum(F.col("weight") * F.col("confidence") * F.col("cosine")), F.sum("weight"))
    return x.groupBy("memory_id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("consensus"))


def confidence(mode: str, source: Column, time: Column, agreement: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Mix of source, time and consensus scores in modes tri, st, tc, cs; the weights in use are normalised."""
    use = {"tri": "stc", "st": "st", "tc": "tc", "cs": "cs"}[mode]
    parts = [(w, x) for k, w, x in zip("stc", weights, (source, time, agreement), strict=True) if k in use]
    total = sum(w for w, _ in parts)
    out = parts[0][1] * (parts[0][0] / total)
    for w, x in parts[1:]:
        out = out + x * (w / total)
    return out


def provenance(rows: DataFrame) -> DataFrame:
    """Distinct sessions, dialogues and images of each memory in order of entry: rows (memory_id, seq, sessions, dialogues, images)."""
    return rows.groupBy("memory_id").agg(*(F.array_distinct(F.flatten(ordered_collect(x, "seq"))).alias(x) for x in ("sessions", "dialogues", "images")))


def visible(df: DataFrame, sessions: list) -> DataFrame:
    return df.where(F.arrays_overlap("sessions", F.array(*map(F.lit, sessions))))


def gold_states(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: new, update and interference points, and how many points so far but interference: points (bank, session, memory_id, kind), sessions (bank, session, ord).

    The points themselves are read as of a session by ``gold_at``: no session carries the list of all before it.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind)
    per = sessions.join(points, ["bank", "session"], "left").groupBy("bank", "session", "ord").agg(n("new").alias("n_new"), n("update").alias("n_update"), n("interference").alias("n_interference"), F.count(F.when(F.col("kind") != "interference", F.col("memory_id"))).alias("n"))
    run = Window.partitionBy("bank").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("n_cumulative", F.sum("n").over(run)).drop("n")


def gold_points(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """(bank, memory_id, kind, valid_from): the points but interference, each with the order of the session since which it counts."""
    return points.where("kind <> 'interference'").join(sessions, ["bank", "session"]).select("bank", "memory_id", "kind", F.col("ord").alias("valid_from"))


def gold_at(gold: DataFrame, asks: DataFrame) -> DataFrame:
    """The cumulative points (bank, session, memory_id, kind) as of the asked sessions (bank, session, ord): rows of ``gold_points`` that are valid by then."""
    return asks.join(gold, "bank").where("valid_from <= ord").select("bank", "session", "memory_id", "kind")


def checkpoint_trigger(checkpoints: DataFrame, sessions: DataFrame) -> DataFrame:
    """Where a checkpoint fires: at the latest of its covered sessions, if all of them exist: checkpoints (checkpoint_id, bank, covered), sessions (bank, session, ord)."""
    x = checkpoints.select("checkpoint_id", "bank", F.size(F.array_distinct("covered")).alias("wanted"), F.explode(F.array_distinct("covered")).alias("session")).join(sessions, ["bank", "session"], "left")
    return x.groupBy("checkpoint_id", "bank", "wanted").agg(F.count("ord").alias("known"), F.max("ord").alias("at")).select("checkpoint_id", "bank", F.when(F.col("known") == F.col("wanted"), F.col("at")).alias("fires_at"))
