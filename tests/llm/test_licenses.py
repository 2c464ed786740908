"""License scan against the definition in plain Python."""

import math
import random
import re

import pytest

from mnemoloom.llm import licenses

LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def by_definition(text, phrases, notices, percent):
    ws = re.findall(licenses.WORD, (text or "").translate(LOWER))
    phrases = [(x, re.findall(licenses.WORD, p.translate(LOWER))) for x, p in phrases]
    notices = [(x, re.findall(licenses.WORD, p.translate(LOWER))) for x, p in notices]
    span = max(len(p) for _, p in phrases + notices)
    places = [(i, x) for x, p in phrases for i in range(len(ws)) if ws[i : i + len(p)] == p]
    base, labels, score = {x for _, x in places}, {x for _, x in places}, float(bool(places))
    for at in range(0, max(1, math.ceil(len(ws) / span) - 1)):
        block = set(ws[at * span : at * span + 2 * span])
        for x, p in notices:
            n, m = len(block & set(p)), len(set(p))
            if n >= max(1, math.ceil(percent * m / 100)):
                labels.add(x)
                score = max(score, n / m)
    starts = [i for i, _ in places]
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scanned(df, **how):
    return [tuple(r) for r in licenses.scan_licenses(df, **how).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()]


def test_defined_cases(spark):
    mit = licenses.NOTICES[0][1]
    rows = [(1, None), (2, ""), (3, " \n.,"), (4, "MIT License"), (4, "MIT License"), (5, "mit LICENSE mit license, Apache-License; cc\nby nc"), (None, "the GNU General\tPublic (License)"),
            (6, mit), (7, "wörd " * 30_000 + mit.upper() + " x" * 77 + " cc by"), (8, "mit licenses é mit élicense amit license"), (9, " ".join(mit.split()[::-1]) + " gnu general public"), (10, "KK İ mit license")]
    got = scanned(spark.createDataFrame([(a, t, "x", 1) for a, t in rows], "doc_id long, text string, row string, n_words int"))
    want = [(a, *by_definition(t, licenses.PHRASES, licenses.NOTICES, 80)) for a, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [x[-2] for x in want if x[0] == 6] == ["mit"] and [x[5] for x in want if x[0] == 6] == [""]
    assert scanned(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("percent,limit", [(80, 2000), (60, 4), (100, 3)])
def test_random_texts(spark, percent, limit):
    rnd = random.Random(percent)
    letters = "abcdefgh"
    phrases = [("p", "a b"), ("q", "c c"), ("p", "h")]
    notices = [("n", "a b c d e"), ("m", "f g h a a b"), ("n", "e"), ("o", "g f")]
    rows = [(i, " ".join(rnd.choices(letters, weights=[9, 9, 5, 5, 1, 1, 1, 1], k=rnd.choice([0, 1, 2, 5, 7, 13, 40])))) for i in range(300)]
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), phrases=phrases, notices=notices, percent=percent, pass_words=limit)
    assert sorted(got) == sorted((a, *by_definition(t, phrases, notices, percent)) for a, t in rows)


def test_native_plan(spark, sf_dir):
    from mnemoloom.llm.queries import op11_license_scan

    plan = op11_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and plan.count("Exchange hashpartitioning") == 1
