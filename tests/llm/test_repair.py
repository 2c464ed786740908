"""Repair of role structure against an exhaustive search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from mnemoloom.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """(conv, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            mine += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text, turn)] * (2 if kind == 3 else 1)
    return {c: [(x[5], x[2], x[4]) for x in sorted(v, key=lambda x: x[:4])] for c, v in out.items()}


def by_search(rows):
    """Counts, and the cheapest audit by trying every edit at every place."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(None)
    def best(i, made):
        """(cost, audit, repaired) of rows from i on, after role initials ``made``, which only their pattern's state matters of."""
        found = []
        if i == len(rows):
            if PATTERN.fullmatch(made):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, r = best(i + 1, made)
            found.append((c + 2, "D" + a, r))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                for to, cost, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if to[:1] and ok(made + to[:1]):
                        c, a, r = best(i + 1, shorter(made + to[:1]))
                        found.append((c + cost + more, e + a, (f"{to}:{text}", *r)))
        for to in ("user", "assistant"):
            if ok(made + to[0]):
                c, a, r = inserted(i, shorter(made + to[0]), 2)
                found.append((c + 5, "I" + a, (f"{to}:", *r)))
        return min(found, default=(10**9, "", ()))

    @lru_cache(None)
    def inserted(i, made, left):
        """As ``best``, with ``left`` insertions more at most before the next row."""
        found = []
        if i == len(rows):
            if PATTERN.fullmatch(made):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, r = best_no_insert(i, made)
            found.append((c, a, r))
        if left:
            for to in ("user", "assistant"):
                if ok(made + to[0]):
                    c, a, r = inserted(i, shorter(made + to[0]), left - 1)
                    found.append((c + 5, "I" + a, (f"{to}:", *r)))
        return min(found, default=(10**9, "", ()))

    @lru_cache(None)
    def best_no_insert(i, made):
        _, role, text = rows[i]
        c, a, r = best(i + 1, made)
        found = [(c + 2, "D" + a, r)]
        if faults[i] in ("", "truncated"):
            more = 5 if faults[i] else 0
            for to, cost, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                if to[:1] and ok(made + to[:1]):
                    c, a, r = best(i + 1, shorter(made + to[:1]))
                    found.append((c + cost + more, e + a, (f"{to}:{text}", *r)))
        return min(found)

    def ok(made):
        return made[-1:] in ("s", "u", "a") and any(PATTERN.fullmatch(made + rest) for rest in ("", "a", "ua"))

    def shorter(made):
        """What matters of initials so far: nothing, s, or an open or closed pair."""
        return made if len(made) < 2 else "u" if made[-1] == "u" else "ua"

    cost, audit, lines = best(0, "")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, convs, most):
    rnd, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for turn in range(rnd.randrange(most)):
            text = rnd.choice(["Yes.", "No", "  ", None, f"Text {rnd.randrange(4)}.", "é!\n", "a?b", "Sure."])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn // 2]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent"]), text))
    rnd.shuffle(rows)
    return rows


DDL = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,convs,most,size,parts", [(1, 60, 9, 4096, 3), (2, 25, 14, 2, 5), (3, 3, 60, 3, 4), (4, 1, 40, 1, 2)])
def test_equals_search(spark, seed, convs, most, size, parts):
    rows = conversations(seed, convs, most)
    rows += [(0, 1, "user", "hot.")] * 25
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], DDL + ", seg int, symbols string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damage(df), most_rows=size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {c: by_search(v) for c, v in damaged(rows).items()}
    assert got == want


def test_defined_cases(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], DDL))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.repair(repair.damage(spark.createDataFrame([(gone, 0, "user", "x")], DDL))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_runs():
    """Runs of a million rows go through powers; audits of halves are those of single steps."""
    for symbols, cost in (("x" * 1_000_000, 2_000_000), ("u" * 100_000, None), ("ua" * 50 + "o" * 70_001, None)):
        ((audit, q),) = repair.audits(symbols, repair.END, [repair.START])
        assert len(audit.replace("I", "")) == len(symbols)
        total = repair.cost_of(audit, symbols) + repair.END[q]
        v = repair.END
        for s, n in repair.runs_of(symbols)[::-1]:
            v = repair.before(s, n, v)
        assert total == v[0] and total == (cost or total)
        m = repair.matrix(symbols)
        assert min(m[x] + repair.END[x] for x in range(4)) == total
