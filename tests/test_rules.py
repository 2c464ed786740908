"""Rules that SQL does not express, held against plain Python or stated by example."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoloom.functions.words import lcs_length, porter_stem
from mnemoloom.operators import chunking as C
from mnemoloom.operators import graph as G
from mnemoloom.operators import metrics as M
from mnemoloom.operators import splits as D
from mnemoloom.operators import text as T
from mnemoloom.operators.components import connected_components
from mnemoloom.sources import tables as S
from mnemoloom.streaming import rules as X


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(40)], "star": [(50, i) for i in range(40)], "empty": []}[shape]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == components(pairs)


def test_cap_degree_equals_greedy(spark):
    rng = random.Random(5)
    rows = [(b, s, t, rng.randrange(4)) for b in range(3) for s in range(12) for t in range(s + 1, 12) if rng.random() < 0.5]
    edges = spark.createDataFrame(rows, "bank long, source long, target long, weight long")
    for rounds in (1, 12):
        got = {tuple(r) for r in G.cap_degree(edges, [-F.col("weight")], cap=2, rounds=rounds).select("bank", "source", "target").collect()}
        want = set()
        for b in range(3):
            mine = pd.DataFrame(sorted((-w, s, t) for x, s, t, w in rows if x == b), columns=["w", "source", "target"])
            want |= {(b, s, t) for s, t in mine[np.array(G.greedy_cap(mine, 2, {}))][["source", "target"]].itertuples(index=False)}
        assert got == want


def test_near_dedup_finds_copies_and_keeps_short_texts(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t.replace(t.split()[60], "changed", 1)) for i, t in enumerate(base)] + [(100, "short text"), (101, "short text"), (102, None)]
    got = {r.id: r.class_id for r in T.near_dedup(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert all(got[10 + i] == i for i in range(5)) and got[100] == 100 and got[101] == 101 and got[102] == 102


def test_near_dedup_recall(spark):
    rng = random.Random(2)
    rows, pairs = [], []
    for i in range(400):
        w = [f"x{rng.randrange(10000)}" for _ in range(100)]
        v = list(w)
        for _ in range(2):
            v[rng.randrange(100)] = "y"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        a, b = ({tuple(z[k : k + 5]) for k in range(96)} for z in (w, v))
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
    got = {r.id: r.class_id for r in T.near_dedup(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


def in_sequence(rows, pack):
    """{(conv, place): number} by a rule that gets a conversation's values one after another."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == conv)
        out |= {(conv, r[0]): number for r, number in zip(mine, pack([r[1] for r in mine]), strict=True)}
    return out


@pytest.mark.parametrize("segment", [5, 23, 20_000])
def test_balanced_packing_by_the_rule(spark, segment):
    rng = random.Random(segment)
    rows = [(c, r, rng.choice([0, 0, 1, 3, 60, 200, 399, 512, 1300])) for c in (None, 1, 2, 3) for r in range(rng.randrange(1, 90))] + [(7, r, 1) for r in range(1500)] + [(8, r, 0) for r in range(40)]

    def pack(sizes):
        number, total, out = 0, 0, []
        for n in sizes:
            if total and abs(total + n - 512) > abs(total - 512):
                number, total = number + 1, 0
            total += n
            out.append(number)
        return out

    got = C.balance_chunks(spark.createDataFrame(rows, "conv_id long, round long, tokens long").repartition(5), 512, segment=segment).collect()
    assert {(r.conv_id, r["round"]): r.chunk for r in got} == in_sequence(rows, pack) and len(got) == len(rows)


def test_a_million_rounds_of_one_conversation(spark):
    """Many tasks and the same chunks as one after another."""
    rows = spark.range(1_000_000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("round"), (F.pmod(F.xxhash64("id"), F.lit(400)) + 1).alias("tokens"))
    got = C.balance_chunks(rows, 512).select("round", "tokens", "chunk").toPandas().sort_values("round")
    number, total, want = 0, 0, []
    for n in got.tokens.tolist():
        if total and abs(total + n - 512) > abs(total - 512):
            number, total = number + 1, 0
        total += n
        want.append(number)
    assert got.chunk.tolist() == want and number > 300_000


@pytest.mark.parametrize("segment", [6, 29, 20_000])
def test_force_segments_by_the_rule(spark, segment):
    rng = random.Random(segment)
    rows = [(c, t, rng.choice([4, 40, 200, 399, 1200, 2000])) for c in (None, 1, 2, 3, 4) for t in range(rng.randrange(1, 80))]

    def cut(lengths):
        sizes, out, number, at = [max(1, x // 4) for x in lengths], [], 0, 0
        while at < len(sizes):
            left = sizes[at:]
            if len(left) < 6 and sum(left) < 350 or len(left) == 1:
                take = len(left)
            else:
                take = min(5, len(left) - 1)
                while take > 1 and sum(left[:take]) >= 350:
                    take //= 2
            out += [number] * take
            number, at = number + 1, at + take
        return out

    df = spark.createDataFrame([(c, t, "user", "x" * n) for c, t, n in rows], "conv_id long, turn long, role string, text string")
    got = C.force_segments(df, 6, 350, segment=segment).collect()
    assert {(r.conv_id, r.turn): r.segment for r in got} == in_sequence(rows, cut) and len(got) == len(rows)


def test_trim_lines():
    text = "assistant: " + "a" * 600 + "\nuser: hi"
    got = C.trim_lines(text, 100, ("assistant:",))
    assert len(got) <= 400 and got.endswith("user: hi")
    assert len(C.trim_lines("b" * 900, 100, ("assistant:",))) == 400


def test_porter_and_lcs():
    for word, stem in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "agreed": "agre", "electricity": "electr", "adjustable": "adjust", "controll": "control"}.items():
        assert porter_stem(word) == stem
    assert lcs_length(list("abcbdab"), list("bdcaba")) == 4


def test_token_f1_and_choice(spark):
    df = spark.createDataFrame([("The cats are running", "a cat runs"), ("", "x"), (None, "x")], "p string, g string")
    got = [r.f1 for r in M.token_f1(df, "p", "g").collect()]
    assert got[0] == pytest.approx(2 * 2 / (3 + 2)) and got[1] == 0
    forms = spark.createDataFrame([("b",), ("C) x",), ("answer: D",), ("",), (None,)], "t string")
    assert [r[0] for r in forms.select(T.extract_choice("t")).collect()][:4] == ["B", "C", "D", "INVALID"]


def test_box_rules(spark):
    rows = [(1, 1, 0, 0, 100, 100), (1, 2, 0, 0, 100, 99), (1, 3, 500, 500, 600, 600)]
    boxes = spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long")
    assert {r.box_id for r in D.dedup_boxes(boxes).collect()} == {1, 3}


def test_gae(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0.5), (1, 1, 0.0, 0.2), (1, 2, 2.0, 0.1)], "episode long, step long, reward double, value double")
    got = {r.step: r.advantage for r in D.gae(df, 0.9, 0.8).collect()}
    a2 = 2.0 - 0.1
    a1 = 0.0 + 0.9 * 0.1 - 0.2 + 0.72 * a2
    assert got[2] == pytest.approx(a2) and got[1] == pytest.approx(a1) and got[0] == pytest.approx(1 + 0.9 * 0.2 - 0.5 + 0.72 * a1)


@pytest.mark.parametrize("iou,most", [(0.3, 20), (0.6, 20), (0.95, 20), (0.3, 5000)])
def test_box_suppression_by_the_rule(spark, iou, most):
    rng = random.Random(int(iou * 100))
    rows = []
    for image in (None, 1, 2):
        for box in range(rng.choice([12, 150])):
            x, y = rng.randrange(0, 300), rng.randrange(0, 300)
            rows.append((image, box, x, y, x + rng.choice([0, 1, 40, 100, 104, 300]), y + rng.choice([1, 40, 100, 97, 300])))
        rows += [(image, 1000 + i, *rows[-1 - i][2:]) for i in range(0, 12, 2)] + [(image, 2000 + i, 50, 50, 150, 150) for i in range(30)]
    want = set()
    for image in (None, 1, 2):
        kept = []
        for b in sorted((r for r in rows if r[0] == image), key=lambda r: (-(r[4] - r[2]) * (r[5] - r[3]), r[1])):
            size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
            shared = lambda r: max(0, min(r[4], b[4]) - max(r[2], b[2])) * max(0, min(r[5], b[5]) - max(r[3], b[3]))  # noqa: B023, E731
            if not any(shared(r) / max(size(r) + size(b) - shared(r), 1e-9) >= iou for r in kept):
                kept.append(b)
        want |= set(kept)
    df = spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long").repartition(3)
    assert {tuple(r) for r in D.dedup_boxes(df, iou, most).collect()} == want and len(want) < len(rows)


@pytest.mark.parametrize("gamma,lam,segment", [(0.99, 0.95, 7), (0.9, 1.0, 20_000), (1.0, 1.0, 10)])
def test_gae_by_the_loop(spark, gamma, lam, segment):
    rng = random.Random(segment)
    rows = [(e, t, rng.random(), rng.random()) for e in range(4) for t in range(rng.randrange(1, 60))]
    want = {}
    for e in range(4):
        mine, a, after = [r for r in rows if r[0] == e], 0.0, 0.0
        for _, t, reward, value in reversed(mine):
            a, after = reward + gamma * after - value + gamma * lam * a, value
            want[e, t] = pytest.approx(a, rel=1e-9, abs=1e-9)
    got = D.gae(spark.createDataFrame(rows, "episode long, step long, reward double, value double").repartition(3), gamma, lam, segment=segment).collect()
    assert {(r.episode, r.step): r.advantage for r in got} == want


def test_sliding_normalize_of_segments(spark):
    """A series in segments is as in one, nulls among its values, a short series inactive."""
    rng = random.Random(1)
    rows = [("a", i, None if i % 17 == 3 else rng.random() * (1 + i / 50), rng.random()) for i in range(400)] + [("b", i, rng.random(), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "series string, seq long, cost double, quality double").repartition(5)
    run = lambda n: {(r.series, r.seq): (r.normalized, r.scale) for r in D.sliding_normalize(df, window=48, warm=16, batch=8, segment=n).collect()}
    whole, cut = run(20_000), run(56)
    assert len(whole) == 409 and whole == {k: (None if a is None else pytest.approx(a), None if b is None else pytest.approx(b)) for k, (a, b) in cut.items()}
    assert all(whole["b", i] == (None, None) for i in range(9)) and sum(a is not None for a, _ in whole.values()) > 300


def test_sliding_normalize_takes_all_events(spark, tmp_path):
    """Two series of 11,300 events together, in batches of 32, against the rule."""
    from mnemoloom.plans import QUERIES

    n, batch, window, warm = 11_300, 32, 512, 128
    value = np.random.default_rng(1).normal(size=n) * (1 + np.arange(n) / 1000)
    kind = np.where(np.arange(n) % 3 == 0, "b", "a")
    spark.createDataFrame([(i, str(kind[i]), float(value[i])) for i in range(n)], "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.series, r.seq): (r.normalized, r.scale) for r in QUERIES["w1_sliding_normalize"](spark, str(tmp_path)).collect()}
    assert len(got) == n
    for series in "ab":
        at = np.flatnonzero(kind == series)
        root, quality = np.sqrt(np.abs(value[at])), at % 7
        initial = np.subtract(*np.quantile(root[:warm], [0.95, 0.05]))
        assert all(got[series, i] == (None, None) for i in range(warm))
        for start in range(warm, len(at), batch):
            seen = slice(max(0, start - window), start)
            low, high = np.quantile(root[seen], [0.05, 0.95])
            unit = lambda x: np.clip((x - low) / max(high - low, 0.25 * initial), 0, 1)  # noqa: B023, E731
            scale = quality[seen].std() / (unit(root[seen]).std() + 1e-8)
            for i in range(start, min(len(at), start + batch)):
                assert got[series, i] == (pytest.approx(unit(root[i]), abs=2e-6), pytest.approx(scale, abs=2e-6))


def test_link_similar_deals_a_bank_to_many_tasks(spark, monkeypatch):
    from mnemoloom.operators import graph as G

    monkeypatch.setattr(G, "LINK_ROWS", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [("hot" if i % 3 else f"b{i % 2}", i, base[rng.integers(30)].tolist() if i % 4 else rng.normal(size=8).tolist()) for i in range(240)]
    rows += [("b0" if i % 3 else "other", i, rng.normal(size=8).tolist()) for i in range(0, 240, 5)]
    df = spark.createDataFrame(rows, "bank string, memory_id long, vector array<float>")
    want = []
    for bank, i, v in rows:
        unit = lambda x: (lambda y: y / np.sqrt((y * y).sum()))(np.array(x, np.float32).astype(float))
        best = sorted((-float((unit(w) * unit(v)).sum()), j) for b, j, w in rows if b == bank and j < i)[:4]
        want += [(i, j, round(-s, 9)) for s, j in best if -s >= 0.4]
    got = G.link_similar(df, 4, 0.4)
    assert sorted((r.source, r.target, round(r.score, 9)) for r in got.collect()) == sorted(want)
    assert G.link_similar(df.limit(0), 4, 0.4).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas [bank" in plan and "FlatMapGroupsInPandas" not in plan


def test_haystack_error(spark):
    df = spark.createDataFrame([(1, ["a"], ["x", "y"])], "id long, p array<string>, q array<string>")
    with pytest.raises(Exception, match="unequal"):
        S.explode_haystack(df, ["p", "q"], ["id"]).collect()


def test_conversation_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"character_profile": {"name": "N"}, "multi_session_dialogues": [{"session_id": "S1", "date": "d", "dialogues": [{"round": "r1", "user": "u", "assistant": "a", "input_image": ["i.png"]}, {"round": "r2", "user": "v"}]}]}')
    got = S.read_conversations(spark, str(tmp_path)).orderBy("round_no").collect()
    assert [(r.character, r.session_id, r.round, r.user, r.assistant) for r in got] == [("N", "S1", "r1", "u", "a"), ("N", "S1", "r2", "v", None)]


def test_bank_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [0.5]), ("b", 2, None)], "bank string, memory_id long, vector array<float>")
    assert S.save_bank(df, str(tmp_path / "bank")) == 2
    S.write_report(df.groupBy("bank").count(), str(tmp_path / "r"), "markdown")
    assert spark.read.text(str(tmp_path / "r")).count() == 4


def test_embedding_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    made = {"a": [1.0, 2.0], "b": [1.0], "c": [1.0, float("nan")]}
    got = {r.id: r.error for r in S.with_embedding(df, "t", lambda x: [made[t] for t in x], 2).collect()}
    assert got == {1: None, 2: "dimension", 3: "not a number"}


def drain(query):
    query.awaitTermination(120)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, files, schema, tmp_path, run, restart_at):
    """Feed lists of rows as one file a trigger; the stream ends before file ``restart_at`` and is started anew from its checkpoint."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for some in (range(restart_at), range(restart_at, len(files))):
        for i in some:
            spark.createDataFrame(files[i], schema).coalesce(1).write.parquet(f"{src}/f={i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/f=*")
        drain(run(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


@pytest.mark.parametrize("rule", ["novelty", "clusters", "alarms"])
def test_stream_equals_batch(spark, tmp_path, rocksdb, rule):
    """Rows come out of order within the watermark, one too late, the stream restarts, and a key falls idle; the batch twin sees all but the late row."""
    rng = np.random.default_rng(4)
    rows = [(int(i % 3), int(i), float(1000 + i * 60 + (200_000 if i >= 40 else 0)), rng.normal(size=3).tolist(), bool(i % 3 == 1 or rng.random() < 0.6)) for i in range(80)]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 500))
    files = [shuffled[i : i + 16] for i in range(0, 80, 16)]
    files[-1].append((0, -5, 30.0, [1.0, 0.0, 0.0], True))  # hours late
    files.append([(99, 999, 9e6, [1.0, 0.0, 0.0], False)])  # brings the watermark on; waits itself
    schema = "source long, seq long, at double, vector array<double>, failed boolean"
    batch, stream, args, columns = {
        "novelty": (X.novelty, X.stream_novelty, (0.2, 0.7, 3600.0), ["source", "seq", "verdict", "similarity"]),
        "clusters": (X.online_clusters, X.stream_clusters, (0.5, 900.0), ["source", "seq", "cluster"]),
        "alarms": (X.failure_alarms, X.stream_failure_alarms, (3,), ["key", "start", "seq", "length"]),
    }[rule]
    mine = lambda df: (df.select(F.col("source").alias("key"), "seq", "at", "failed") if rule == "alarms" else df.select("source", "seq", "at", "vector"))
    got = streamed(spark, files, schema, tmp_path, lambda s: stream(mine(s), *args), 3)
    want = batch(mine(spark.createDataFrame(rows, schema)), *args)
    key = lambda x: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(*columns).collect())
    assert key(got) == key(want) and len(key(want)) >= (80 if rule != "alarms" else 3)
    state = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "ck"))
    held = state.select("key").distinct().count()
    assert held <= (0 if rule != "alarms" else 3)


def test_upsert_stream(spark, tmp_path):
    """Bases and parts that the micro-batches leave add up to the merge of all rows, also when a batch comes twice."""
    rows = [("s", "p", i % 3, 1, float(i), [f"x{i % 4}"]) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, p string, o long, mentions long, confidence double, sources array<string>")
    for i in range(6):
        df.where(f"confidence >= {2 * i} and confidence < {2 * i + 2}").coalesce(1).write.parquet(str(tmp_path / f"in/f={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/f=*"))
    target = str(tmp_path / "t")
    drain(X.upsert_stream(stream, target, G.merge_relations, str(tmp_path / "ck"), keep=4))
    names = sorted(x.name for x in (tmp_path / "t").iterdir())
    assert names == ["base-000000003", "part-000000004", "part-000000005"]
    want = sorted(map(tuple, G.merge_relations(df).collect()))
    assert sorted(map(tuple, X.read_upserted(spark, target, G.merge_relations).collect())) == want
    assert [r[3] for r in want] == [4, 4, 4]


def test_upsert_survives_a_kill_at_every_step(spark, tmp_path, monkeypatch):
    """Each call that writes, renames or deletes fails once; the batch comes again, and the table is the same as without failures."""
    rows = [("s", "p", i % 3, 1, float(i), [f"x{i % 4}"]) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, p string, o long, mentions long, confidence double, sources array<string>")
    want = sorted(map(tuple, G.merge_relations(df).collect()))
    batches = [df.where(f"confidence >= {2 * i} and confidence < {2 * i + 2}") for i in range(6)]
    real = {n: getattr(X, n) for n in ("rename_folder", "drop_folder")}
    for step in range(1, 14):
        target, calls = str(tmp_path / f"t{step}"), [0]

        def broken(name):
            def call(*args):
                calls[0] += 1
                if calls[0] == step:
                    if name == "rename_folder":  # a folder half written: data, but never its final name
                        (tmp_path / f"t{step}" / "tmp-base-000000001" / "junk").mkdir(parents=True, exist_ok=True)
                    raise RuntimeError("killed")
                return real[name](*args)

            return call

        for n in real:
            monkeypatch.setattr(X, n, broken(n))
        for number, batch in enumerate(batches):
            try:
                X.apply_batch(batch, number, target, G.merge_relations, 2)
            except RuntimeError:
                X.apply_batch(batch, number, target, G.merge_relations, 2)
            if number == 3:
                X.apply_batch(batch, number, target, G.merge_relations, 2)  # a batch that was whole comes again
        for n in real:
            monkeypatch.setattr(X, n, real[n])
        assert sorted(map(tuple, X.read_upserted(spark, target, G.merge_relations).collect())) == want
    assert calls[0] >= 12
    empty = X.read_upserted(spark, str(tmp_path / "none"), G.merge_relations, df.schema)
    assert empty.collect() == []
    with pytest.raises(ValueError):
        X.read_upserted(spark, str(tmp_path / "none"), G.merge_relations)


def test_novelty_and_clusters_by_the_rules(spark):
    """The two online rules against their definitions, written anew."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i % 2, i, 100.0 * i, v[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "source long, seq long, at double, vector array<double>")
    accepted, want = {}, set()
    for source, seq, _, _ in rows:
        likeness = 0.0 if source not in accepted else float(unit[seq] @ unit[accepted[source]])
        verdict = "accept" if source not in accepted or likeness < 0.1 else "reject" if likeness > 0.6 else "uncertain"
        if verdict == "accept":
            accepted[source] = seq
        want.add((source, seq, verdict, round(likeness, 9)))
    assert {(r.source, r.seq, r.verdict, round(r.similarity, 9)) for r in X.novelty(df, 0.1, 0.6).collect()} == want
    members, want = {0: [], 1: []}, set()  # clusters of a source: lists of rows
    for source, seq, at, _ in rows:
        best = None
        for number, mine in enumerate(members[source]):
            if at - 100.0 * mine[-1] <= 900.0:
                centre = v[mine].mean(axis=0)
                likeness = float(v[seq] @ centre / np.linalg.norm(v[seq]) / np.linalg.norm(centre))
                if best is None or likeness > best[0]:
                    best = (likeness, number)
        if best and best[0] >= 0.5:
            number = best[1]
            members[source][number].append(seq)
        else:
            number = len(members[source])
            members[source].append([seq])
        want.add((source, seq, members[source][number][0]))
    assert {tuple(r) for r in X.online_clusters(df, 0.5, 900.0).select("source", "seq", "cluster").collect()} == want


@pytest.mark.parametrize("a,b,low", [(0.7, 0.3, 0.4), (0.4, 0.6, 0.5), (0.2, 0.8, 0.9)])
def test_similarity_links_by_the_rule(spark, a, b, low):
    """Also where every positive cosine may do, and where the texts decide."""
    rng = random.Random(int(10 * a))
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 2, "".join(rng.choices("abc", k=rng.choice([0, 2, 6, 9])))) for i in range(40)]
    cosine = lambda u, v: sum(x * y for x, y in zip(u, v)) / sum(x * x for x in u) ** 0.5 / sum(y * y for y in v) ** 0.5

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = set()
    for i, v, label, text in rows:
        found = [(a * cosine(v, w) + b * (1 - distance(text, t) / max(len(text), len(t), 1)), j) for j, w, other, t in rows if j != i and other == label and cosine(v, w) > 1e-9]
        want |= {(i, j, round(s, 6)) for s, j in sorted((x for x in found if x[0] >= low), key=lambda x: (-x[0], x[1]))[:3]}
    got = G.similarity_links(spark.createDataFrame(rows, "memory_id long, vector array<double>, label int, text string"), a, b, 3, low, "label")
    assert {(r.source, r.target, round(r.weight, 6)) for r in got.collect()} == want and want


def test_drop_redundant_by_the_rule(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 3))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    edges = [(s, t, int(rng.integers(3))) for s in range(4) for t in range(30) if rng.random() < 0.6]
    left = set(edges)
    while True:
        gone = {b for a in left for b in left if a[0] == b[0] and a[1] != b[1] and (a[2], -a[1]) > (b[2], -b[1]) and unit[a[1]] @ unit[b[1]] > 0.7}
        if not gone:
            break
        left -= gone
    got = G.drop_redundant(spark.createDataFrame(edges, "source long, target long, weight long"), spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "memory_id long, vector array<double>"), 0.7)
    assert {(r.source, r.target, r.weight) for r in got.collect()} == left and len(left) < len(edges)


@pytest.mark.parametrize("segment", [7, 20_000])
def test_batches_close_before_a_second_image(spark, segment):
    rng = random.Random(2)
    rows = [(c, r, int(rng.random() < 0.3)) for c in range(5) for r in range(40)]
    want, state = {}, {}
    for c, r, has in rows:
        number, size, images = state.get(c, (0, 0, 0))
        if size == 4 or (has and images):
            number, size, images = number + 1, 0, 0
        state[c] = (number, size + 1, images + has)
        want[c, r] = number
    got = C.batch_rounds(spark.createDataFrame(rows, "conv_id long, round long, images long"), 4, "images", segment=segment)
    assert {(r.conv_id, r["round"]): r.batch for r in got.collect()} == want


def test_truncation_by_score(spark):
    import re

    token = re.compile(r"[\u4e00-\u9fff\u3040-\u30ff]|[0-9]+|[^\W\d_]+|\s+|.", re.S)

    def cut(text, limit):
        total, out = 0.0, ""
        for t in token.findall(text):
            score = 1.0 if re.fullmatch(r"[\u4e00-\u9fff\u3040-\u30ff]", t) else 0.8 if re.fullmatch("[0-9]+", t) else 0.0 if t.isspace() else 1.3 if t.isalpha() else 0.3
            if total + score > (limit * 1.05 if score == 1.3 else limit):
                break
            total, out = total + score, out + t
        return out

    texts = ["", "one two three four five six seven", "中文字符很多很多很多", "a1b22 333, 4444; 55 !!! ééé", "word " * 3000, "x\n\ny  z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for limit in (1.0, 5.0, 1000.0):
        assert {r.id: r.cut for r in C.truncate_by_score(df, "text", limit).collect()} == {i: cut(t, limit) for i, t in enumerate(texts)}


def test_missing_vectors_are_an_error(spark):
    q, v = spark.createDataFrame([("a",), ("b",)], "query_id string"), spark.createDataFrame([("a", [1.0])], "query_id string, vector array<double>")
    found, missing = S.attach_vectors(q, v)
    assert [r.query_id for r in found.collect()] == ["a"] and [r.query_id for r in missing.collect()] == ["b"]
    with pytest.raises(Exception, match="no cached vector for b"):
        S.attach_vectors(q, v, strict=True)[0].collect()


def test_strings_at_any_depth(spark):
    x = spark.createDataFrame([(1,)], "id long").select("id", F.struct(F.lit("a").alias("p"), F.array(F.struct(F.lit(2).alias("n"), F.array(F.lit("b"), F.lit(None).cast("string")).alias("q"))).alias("r"), F.create_map(F.lit("key"), F.array(F.lit("c"))).alias("m"), F.lit(None).cast("array<string>").alias("z")).alias("v"))
    assert C.collect_strings(x, "v").first().strings == ["a", "b", "c"]
    assert C.collect_strings(x, "id").first().strings == []


def test_search_leaves_out_null_vectors_and_the_own_row(spark):
    from mnemoloom.operators import retrieval as R

    m = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])], "memory_id long, vector array<double>")
    q = m.withColumnRenamed("memory_id", "query_id").where("query_id < 2")
    assert [(r.query_id, r.memory_id, r["rank"]) for r in R.vector_topk(q, m, 3, own=False).orderBy("rank").collect()] == [(0, 2, 1), (0, 3, 2), (0, 4, 3)]
    assert R.vector_topk(q, m, 1).first().memory_id == 0
    with pytest.raises(Exception, match="zero or NaN"):
        R.vector_topk(q, m.unionByName(spark.createDataFrame([(9, [0.0, 0.0])], m.schema)), 3).collect()


def test_as_of_never_shows_later_sessions(spark):
    from mnemoloom.operators.retrieval import as_of_bank

    m = spark.createDataFrame([(1, s, 10 * s) for s in range(5)], "bank long, session_id long, memory_id long")
    c = spark.createDataFrame([(1, t, s) for t in range(5) for s in range(t + 1)], "bank long, checkpoint long, session_id long")
    assert as_of_bank(m, c).where("session_id > checkpoint").count() == 0


def test_short_sequences_come_many_to_a_call(spark):
    """Segments reach Python in batches and not one by one: thousands of short conversations need no group each, and a batch may end inside one."""
    rows = spark.range(12_000).selectExpr("id div 4 as conv_id", "id % 4 as round", "id % 7 * 100 as tokens", "cast(id % 3 = 0 as long) as images")
    for made in (C.balance_chunks(rows, 512), C.batch_rounds(rows, 4, "images")):
        assert "FlatMapGroupsInPandas" not in made.where("conv_id < 0").select("conv_id")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = C.balance_chunks(rows, 512, segment=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for conv in range(3000):
        number, total = 0, 0
        for r in range(4):
            n = (conv * 4 + r) % 7 * 100
            if total and abs(total + n - 512) > abs(total - 512):
                number, total = number + 1, 0
            total += n
            want[conv, r] = number
    assert {(r.conv_id, r["round"]): r.chunk for r in got} == want and len(got) == 12_000
