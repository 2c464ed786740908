"""Words of a text: the class that Java knows by name against the same class spelt out."""

import time

from pyspark.sql import functions as F

from mnemoloom.functions.columns import words


def test_words_are_those_of_the_class_spelt_out_and_cheaper(spark):
    """Every character of the basic plane and one beyond it; splitting a long text must not cost what the spelt-out class does."""
    spelt = F.array_remove(F.split(F.lower("text"), "[^a-z0-9_]+"), "")
    every = "".join(f"{chr(i)}A{chr(i)}" for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000) + "\U0001f600B"
    one = spark.createDataFrame([(every,), (None,), ("",), (" _x9 ",)], "text string")
    assert all(r.a == r.b for r in one.select(words("text").alias("a"), spelt.alias("b")).collect())
    long = spark.range(0, 24, 1, 4).select(F.repeat(F.concat(F.lit("Some Words, é 12 "), F.col("id").cast("string")), 20_000).alias("text"))

    def seconds(tokens):
        start = time.perf_counter()
        long.agg(F.sum(F.size(tokens))).collect()
        return time.perf_counter() - start

    assert min(seconds(words("text")) for _ in range(3)) < 0.6 * min(seconds(spelt) for _ in range(2))
