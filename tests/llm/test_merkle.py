"""Merkle proofs against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mnemoloom.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def around(levels, i):
    out = []
    for below in levels[:-1]:
        a = i // 3 * 3
        out.append(("".join(below[a:i]), "".join(below[i + 1 : a + 3])))
        i //= 3
    return out


def by_definition(rows):
    groups = defaultdict(list)
    for doc, source, lang, chars, text, given in rows:
        leaf, other = (h("".join(map(field, (doc, source, lang, chars, t)))) for t in (text, given))
        groups[(source is not None, (source or "").encode())].append((doc is not None, doc or 0, leaf, other if other != leaf else "", doc, other))
    names = sorted(groups)
    trees = {n: climb([x[2] for x in sorted(groups[n], key=lambda x: x[:4])]) for n in names}
    over = climb([trees[n][-1][0] for n in names])
    out = []
    for at, n in enumerate(names):
        for i, (_, _, leaf, _, doc, other) in enumerate(sorted(groups[n], key=lambda x: x[:4])):
            steps = around(trees[n], i) + around(over, at)
            node = other
            for a, b in steps:
                node = h(a + node + b)
            out.append((doc, leaf, trees[n][-1][0], over[-1][0], h("".join(a + b for a, b in steps)), node, node == over[-1][0]))
    return sorted(out, key=str)


DDL = "doc_id long, source string, lang string, n_chars long, text string, given string, key string, idx int, digest string"


@pytest.mark.parametrize("every,partitions", [(1, 1), (2, 7), (4, 5)])
def test_equals_definition(spark, every, partitions):
    rnd = random.Random(every)
    sources = [None, "", "b", "é", "hot", "hot", "hot", "z"]
    rows = []
    for i in range(400):
        text = rnd.choice([None, "", "a\nb", "ü" * 30, f"text {i}"])
        rows.append((rnd.choice([None, rnd.randrange(300), i]), rnd.choice(sources), rnd.choice([None, "en"]), rnd.choice([None, i]), text, text.replace("\n", "") if text and i % 2 else text))
    rows += [rows[7]] * 30 + [(1, f"alone{k}", "de", 3, "x", "y") for k in range(90)]
    df = spark.createDataFrame([(*r, "clash", 5, "z") for r in rows], DDL).repartition(partitions)
    got = sorted((tuple(r) for r in merkle.merkle_proofs(df, candidate=F.col("given"), every=every).collect()), key=str)
    assert got == by_definition(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 10, 27, 28, 81, 82])
def test_sizes_around_powers(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}", f"t{i}") for i in range(n)]
    got = sorted((tuple(r) for r in merkle.merkle_proofs(spark.createDataFrame([(*r, "", 0, "") for r in rows], DDL), every=2).collect()), key=str)
    assert got == by_definition(rows) and all(r[-1] for r in got)


def test_empty_table(spark):
    df = merkle.merkle_proofs(spark.createDataFrame([], DDL))
    assert df.collect() == [] and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    with pytest.raises(ValueError):
        merkle.merkle_proofs(df, every=0)
