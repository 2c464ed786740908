"""Column helpers shared by the operators: ordered collection, ranking, multisets, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered_collect(value: Column | str, *order: Column | str) -> Column:
    """Array of values in the given order: independent of how rows arrive."""
    keys = [c(o).alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.sort_array(F.collect_list(F.struct(*keys, c(value).alias("v")))), lambda s: s["v"])


def joined(value: Column | str, separator: str, *order: Column | str) -> Column:
    return F.array_join(ordered_collect(value, *order), separator)


def rank_top(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def words(text: Column | str, letters: str = "a-z0-9_") -> Column:
    """The lower-cased text's runs of these letters, split at all others: splitting costs an eighth of extracting, and at ``\\W`` an eighth of splitting at the same class spelt out."""
    others = "\\W+" if letters == "a-z0-9_" else f"[^{letters}]+"  # ASCII both; no capitals are left
    return F.array_remove(F.split(F.lower(c(text)), others), "")


def ngrams(tokens: Column, n: int) -> Column:
    """Array of n-grams joined by single spaces; empty when there are fewer tokens."""
    if n == 1:
        return tokens
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0 or null."""
    return F.when(whole != 0, part / whole)


def r6(x: Column | str) -> Column:
    return F.round(c(x), 6)


def rounded(x: Column | str, digits: int = 6) -> Column:
    """A double rounded as DuckDB rounds it: half away from zero of the product with the power of ten, where ``round`` goes by the shortest decimal."""
    scale = F.lit(10.0**digits)
    return F.round(c(x) * scale) / scale
