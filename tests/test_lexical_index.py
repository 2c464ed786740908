"""The stored lexical index against plain scoring."""

import math
import random
from collections import Counter

import pytest

from mnemoloom.functions.columns import words
from mnemoloom.operators import lexical_index as LI


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=[60 - i for i in range(60)], k=rng.choice([0, 1, 5, 30]))) for _ in range(n)]
    return [(i, t if rng.random() > 0.05 else None) for i, t in enumerate(texts)]


def plain(docs, asks, how, k):
    split = {d: (t or "").split() for d, t in docs}
    n, mean = len(docs), sum(map(len, split.values())) / len(docs)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = {}
    for q, text in asks:
        qs, scores = Counter(text.split()), {}
        for d, ws in split.items():
            tf = Counter(ws)
            shared = [w for w in qs if w in tf]
            if how == "bm25":
                s = sum(qs[w] * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in shared)
            elif shared:
                idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
                norm = lambda c: math.sqrt(sum((v / c.total() * idf(w)) ** 2 for w, v in c.items()))
                s = 0.35 * len(shared) / len(qs) + 0.65 * sum(qs[w] / qs.total() * idf(w) * tf[w] / len(ws) * idf(w) for w in shared) / (norm(qs) * norm(tf))
            if shared:
                scores[d] = round(s, 9)
        out[q] = sorted(((-s, d) for d, s in scores.items() if s > 0))[:k]
    return out


@pytest.mark.parametrize("how", ["bm25", "tfidf"])
def test_increments_score_as_one_corpus(spark, tmp_path, monkeypatch, how):
    """Two increments in blocks of a few documents, null and empty texts, repeated and unknown words in the queries, several runs of queries."""
    monkeypatch.setattr(LI, "BLOCK_DOCS", 40)
    monkeypatch.setattr(LI, "RUN_ROWS", 5)
    docs = corpus(1, 300)
    asks = [(i, t) for i, t in [(j, "w1 w1 w7 w59") for j in range(9)] + [(50, "nothing known"), (51, "w3 unknown w3"), (52, "w58"), (53, " ".join(f"w{i}" for i in range(40)))]]
    frame = lambda rows, ident: spark.createDataFrame(rows, f"{ident} long, text string")
    path = str(tmp_path / "index")
    search = LI.bm25_search if how == "bm25" else LI.tfidf_search
    for some in (docs[:110], docs[110:]):
        LI.add_documents(spark, path, frame([*some, (None, "w1")], "doc_id").repartition(3), words)
        so_far = docs[: some[-1][0] + 1]
        found = {}
        for r in search(spark, path, frame(asks, "query_id"), words, 7).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.memory_id, r.score))
        want = plain(so_far, asks, how, 7)
        assert {q: [d for _, d, _ in sorted(rows)] for q, rows in found.items()} == {q: [d for _, d in rows] for q, rows in want.items() if rows}
        assert all(s == pytest.approx(-want[q][r - 1][0], abs=2e-9) for q, rows in found.items() for r, _, s in rows)
    assert LI._documents(spark, path).count() >= 8


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    path = LI.add_documents(spark, str(tmp_path / "index"), docs, words)
    asks = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert LI.bm25_search(spark, path, asks, words, 5).collect() == [] and LI.tfidf_search(spark, path, asks, words, 5).collect() == []
