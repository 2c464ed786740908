"""The ten operators against brute force, round trips and held-out data, and their edge cases."""

import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoloom.llm import ann, bpe, chunks, common, jaccard, langid, media, packing, suffix, urlfilter, warc
from mnemoloom.llm.queries import QUERIES, RULES, tokenizer_path
from mnemoloom.llm.common import merged_spans

CLASHING = ["label", "text_hash", "bucket", "answers", "carried", "score", "digest", "n", "token", "part", "row"]


def docs_frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string") if rows else spark.createDataFrame([], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def edge_rows():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, one = prose(6000), prose(80)
    return [(1, one), (2, one), (3, one + " tail of its own"), (4, None), (5, ""), (6, "  \t\n"), (7, long), (8, long[:20000]), (9, "word"), (9, "word"), (None, one), (None, None), (10, "é" * 300), (11, "é" * 300 + one), (12, "\U0001f600 ünï " + prose(60))]


# 1 WARC


def warc_expected(rows):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[digest(h)] = min(p, first.get(digest(h), p))
    seen, out = set(), []
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        f = first.get(digest(h))
        main = f is None or (p == f and (p, digest(h)) not in seen)
        seen.add((p, digest(h)))
        out.append((p, len((h or "").encode()), digest(h), "response" if main else "revisit", None if main else f))
    return sorted(out, key=str)


def test_warc(spark):
    a, b = "<html>" + "a" * 200, "é" * 80
    rows = [(5, "http://x/", a), (2, None, a), (9, "http://y/ z\r\n", a), (1, "http://z/", b), (3, "u", b), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", a), (None, "u", "only null " * 20), (5, "http://x/", a), (11, "u", "q" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("kind", F.lit(2))
    root, manifest = warc.write_warc(df, roll_bytes=300, shard_rows=4)
    got = warc.read_warc(root, manifest)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == warc_expected(rows)
    assert all(r.payload.decode() == (dict((p, h) for p, _, h in rows)[r.page_id] or "") for r in got.where("record_type = 'response' and page_id > 5").collect())
    names = [r.name for r in manifest.collect()]
    assert len(names) > 3 and len(set(names)) == len(names)
    root2, manifest2 = warc.write_warc(df, roll_bytes=300, shard_rows=4)
    assert {(r.name, r.sha256) for r in manifest.collect()} == {(r.name, r.sha256) for r in manifest2.collect()}


def test_warc_reader_finds_damage(spark):
    """A shard that is cut (within a record or between two), changed or missing is an error, never fewer rows."""
    rows = [(i, "u", f"{i} " * 60) for i in range(20)]
    root, manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert warc.read_warc(root, manifest).count() == 20
    path = root.removeprefix("file:").replace("//", "/") + "/" + manifest.first().name
    with open(path, "rb") as f:
        whole = f.read()
    second = whole.index(b"\x1f\x8b\x08", 10)
    for damaged in (whole[:-40], whole[:second], whole[:second] + whole[second:][::-1], b""):
        with open(path, "wb") as f:
            f.write(damaged)
        with pytest.raises(Exception, match="record|manifest|decompress|digest|match"):
            warc.read_warc(root, manifest).count()
    os.remove(path)
    with pytest.raises(Exception, match="(?i)no such file|not found|FileNotFound"):
        warc.read_warc(root, manifest).count()


def test_warc_shards_do_not_depend_on_the_session(spark):
    """Equal tables give equal files, whatever the input's partitions, order and the session's number of shuffle partitions."""
    rows = [(i * i * 7 - 50, "u", f"{i % 90} page " * 30) for i in range(300)] + [(None, "u", "without an id"), (None, None, None)]
    made = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffles in ((1, "3"), (7, "5")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            df = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "page_id long, url string, html string").repartition(parts)
            root, manifest = warc.write_warc(df, shard_rows=40)
            made.append({(r.name, r.sha256, r.records) for r in manifest.collect()})
            assert warc.read_warc(root, manifest).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] and len(made[0]) >= 8


def test_warc_empty(spark):
    root, manifest = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(root, manifest).count() == 0


# 2 packing


def check_pack(rows, got, size=2048):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[d].append([*code.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        left = collections.Counter()
        for seq in ids[d]:
            left.update((i, len(seq)) for i in range(len(seq)))
        for p in pieces:
            seq = next(s for s in ids[d] if len(s) == p.doc_tokens)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *seq[p.start : p.start + p.length]))
            left.subtract((i, p.doc_tokens) for i in range(p.start, p.start + p.length))
        assert not any(left.values())
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and pieces[0].sequence_tokens == (at if at & (at - 1) == 0 else size)
    return sequences


def test_packing_edges(spark):
    rows = [*edge_rows(), (20, "a <|endoftext|> b")]
    got = packing.pack(docs_frame(spark, rows).repartition(3), tokenizer_path("byte_bpe_50k.json"), keep=3).collect()
    check_pack(rows, got)
    assert packing.pack(docs_frame(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_takes_long_runs_of_one_kind(spark):
    """A million spaces, newlines, tabs between letters, letters or symbols: ids as the tokenizers library gives them."""
    n = 10**6
    rows = [(1, "x" + " " * n + "y"), (2, "\n" * n), (3, "a" * n), (4, "-" * n), (5, "x\t" * (n // 2)), (6, " \n" * (n // 2))]
    check_pack(rows, packing.pack(docs_frame(spark, rows), tokenizer_path("byte_bpe_50k.json")).collect())


def test_packing_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op2_packing"](spark, sf_dir).collect()
    check_pack(rows, got)
    stored = {r.sequence_id: r.sequence_tokens for r in got}
    assert sum(r.length for r in got) >= 0.97 * sum(stored.values())


# 3 media


def test_media_round_trip():
    rng = random.Random(1)
    for n in [1, 100, 170, 171, 184, 576, 9216, 9217, 200_000]:
        payload = rng.randbytes(n)
        stream = media.mux(payload)
        got = media.demux(stream)
        assert got["payload"] == payload and not got["continuity_errors"] and len(stream) % 188 == 0
        assert sum(p["length"] for p in got["points"]) == n
        assert [p["random_access"] for p in got["points"]] == [i % 8 == 0 for i in range(len(got["points"]))]


def test_media_damage():
    stream = media.mux(random.Random(2).randbytes(30_000))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert media.demux(b"".join(packets[:10] + packets[11:]))["continuity_errors"] == 1
    assert media.demux(b"".join(packets[:10] + packets[9:]))["payload"] == media.demux(stream)["payload"]
    with pytest.raises(ValueError):
        media.demux(b"\x00" + stream[1:])
    table = bytearray(stream)
    table[10] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(table))


def read_stream(stream):
    """A plain transport stream reader, packet by packet, that knows nothing of the operator: (payload, timestamps, random-access units)."""
    pmt_pid = es_pid = None
    pes, units = None, []
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert packet[0] == 0x47
        pid, begins, kind = (packet[1] & 31) << 8 | packet[2], bool(packet[1] & 64), packet[3] >> 4 & 3
        jump, body = False, packet[4:]
        if kind & 2:
            jump, body = packet[4] > 0 and bool(packet[5] & 64), packet[5 + packet[4] :]
        if pid == 0:
            section = body[1 + body[0] :]
            pmt_pid = (section[10] & 31) << 8 | section[11]
        elif pid == pmt_pid:
            section = body[1 + body[0] :]
            first = 12 + ((section[10] & 15) << 8 | section[11])
            es_pid = (section[first + 1] & 31) << 8 | section[first + 2]
        elif pid == es_pid:
            if begins:
                units.append([jump, b""])
            units[-1][1] += body
    payload, stamps = b"", []
    for _, pes in units:
        assert pes[:3] == b"\0\0\1" and len(pes) == 6 + int.from_bytes(pes[4:6], "big")
        a, b, c, d, e = pes[9:14]
        stamps.append((a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1)
        payload += pes[9 + pes[8] :]
    return payload, stamps, [i for i, (jump, _) in enumerate(units) if jump]


def test_media_by_another_reader():
    rng = random.Random(5)
    for n in (576, 1152, 9216, 9792, 576 * 400):
        payload = rng.randbytes(n)
        stream = media.mux(payload)
        got, stamps, jumps = read_stream(stream)
        mine = media.demux(stream)
        assert got == payload == mine["payload"]
        assert stamps == [p["pts"] for p in mine["points"]] == [3600 * i for i in range(-(-n // 9216))]
        assert jumps == [i for i, p in enumerate(mine["points"]) if p["random_access"]] == list(range(0, len(stamps), 8))


def test_media_that_is_null_damaged_or_long_in_its_tables(spark):
    payload = random.Random(6).randbytes(9216 * 3)
    stream = media.mux(payload)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    cut = media.demux(b"".join(packets[:10] + packets[11:]))
    assert cut["continuity_errors"] == 1 and [p["complete"] for p in cut["points"]] == [False, True, True] and cut["payload"] == payload[9216:]
    body = (1).to_bytes(2, "big") + (0xE000 | media.PMT_PID).to_bytes(2, "big") + b"".join((100 + i).to_bytes(2, "big") + (0xE000 | 300 + i).to_bytes(2, "big") for i in range(60))
    section = media._section(0, 1, body)  # a table of 61 programs goes over two packets
    first = (bytes([0x47, 0x40, 0, 0x10, 0]) + section[:183], bytes([0x47, 0, 0, 0x11]) + section[183:].ljust(184, b"\xff"))
    assert media.demux(b"".join(first) + stream[188:])["payload"] == payload
    rows = [(1, 5, stream), (2, 5, None), (3, 5, b""), (4, 5, stream[:-1]), (5, 5, b"\0" + stream[1:]), (6, 5, b"".join(packets[1:])), (7, 5, stream)]
    df = spark.createDataFrame([(i, n, None if m is None else bytearray(m)) for i, n, m in rows], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.demux_media(df).collect()}
    assert {i for i, r in got.items() if r.error is None} == {1, 7} and bytes(got[1].payload) == payload and got[2].error == "no media" and len(got) == 7
    digests = {r.doc_id: r for r in media.media_digests(df).collect()}
    assert digests[1].timestamps == [0, 3600, 7200] and digests[1].random_access == [0] and digests[5].feature == "error=lost sync" and digests[2].media_bytes is None


def test_media_query(spark, sf_dir):
    rows = edge_rows()
    got = media.media_digests(media.to_media(docs_frame(spark, rows))).collect()
    want = collections.Counter()
    for d, t in rows:
        u = (t or "").encode()
        p = u.ljust(max(1, -(-len(u) // 576)) * 576, b"\xff")
        want[(d, len(u), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(media.mux(p)).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == want
    points = media.demux_media(media.to_media(docs_frame(spark, rows))).where("doc_id = 7").first().points
    assert points[0].random_access and points[1].pts == 3600
    assert media.media_digests(media.to_media(docs_frame(spark, []))).count() == 0


# 4 chunks


def cuts_by_definition(text, low=10, high=128):
    """Chunk ends place by place: a place is a candidate if its hash of the last 8 bytes is the least of the 9 places on either side."""
    n, w = len(text), low - 1
    h = [sum(int(chunks.GEAR[text[i - k]]) << k for k in range(8) if i >= k) % (1 << 32) for i in range(n)]
    out, start = [], 0
    for i in range(w, n - w):
        if all(h[i] <= h[j] for j in range(i - w, i + w + 1)):
            while i + 1 - start > high:
                start += high
                out.append(start)
            if i + 1 - start >= low:
                start = i + 1
                out.append(start)
    while n - start > high:
        start += high
        out.append(start)
    return out + [n] * (start < n)


def test_chunk_cuts_by_definition():
    rng = random.Random(12)
    for n in (0, 1, 9, 18, 19, 20, 50, 127, 128, 129, 400, 1500):
        for letters in (b"ab", b"abcdefghijklmnopqrstuvwxyz .,", bytes(range(256)), b"x"):
            text = bytes(rng.choice(letters) for _ in range(n))
            assert chunks.boundaries(text) == cuts_by_definition(text)


def chunk_expected(rows, min_run):
    least = {}
    cut = {}
    for d, t in rows:
        u, start, parts = (t or "").encode(), 0, []
        for end in chunks.boundaries(u):
            parts.append((start, end, u[start:end]))
            start = end
        cut[(d, t)] = parts
        if d is not None:
            for _, _, x in parts:
                least[x] = min(d, least.get(x, d))
    out = []
    for d, t in rows:
        copied = [(a, b) for a, b, x in cut[(d, t)] if d is not None and least[x] < d]
        spans = [(a, b) for a, b in merged_spans(np.array([a for a, _ in copied]), np.array([b for _, b in copied])) if b - a >= min_run]
        u, kept, at = (t or "").encode(), b"", 0
        for a, b in spans:
            kept, at = kept + u[at:a], b
        out.append((d, len(u), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + u[at:]).hexdigest()))
    return sorted(out, key=str)


def test_chunks_equal_brute_force(spark, sf_dir):
    for rows, run in ((edge_rows(), 64), ([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], 128)):
        got = chunks.dedup_substrings(docs_frame(spark, rows), min_run=run, carried=["label"])
        assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == chunk_expected(rows, run)
        assert got.where("carried.label <> 'x'").count() == 0
    assert chunks.dedup_substrings(docs_frame(spark, [])).count() == 0


def test_chunks_resist_shifts(spark):
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    own = [" ".join("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(100)) for _ in range(4)]
    rows = [(1, own[0] + passage), (2, own[1] + " x" + passage + own[2]), (3, own[3])]
    got = {r.doc_id: r for r in chunks.dedup_substrings(docs_frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0 and got[2].n_removed > 0.6 * len(passage)
    assert all(10 <= b - a <= 128 for a, b in zip([0, *chunks.boundaries(passage.encode() * 9)[:-2]], chunks.boundaries(passage.encode() * 9)[:-1], strict=False))


def test_chunks_catch_passages_of_51_words(spark):
    rng = random.Random(51)
    words = lambda n, low, high: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high))) for _ in range(n))
    for low, high in ((2, 5), (3, 9)):
        passages = [words(51, low, high) for _ in range(300)]
        rows = [(2 * i + j, f"{words(rng.randint(1, 80), low, high)} {p} {words(rng.randint(1, 80), low, high)}") for i, p in enumerate(passages) for j in (0, 1)]
        got = {r.doc_id: r.n_removed for r in chunks.dedup_substrings(docs_frame(spark, rows)).collect()}
        shares = [got[2 * i + 1] / len(p) for i, p in enumerate(passages)]
        assert not any(got[2 * i] for i in range(300)) and max(shares) <= 1
        assert sum(x > 0 for x in shares) >= 0.99 * 300 and sum(shares) >= 0.75 * 300
    for word in ("ouing", "onou", "euxauxe"):
        periodic = " ".join([word] * 51)
        got = {r.doc_id: r.n_removed for r in chunks.dedup_substrings(docs_frame(spark, [(1, f"{words(9, 2, 9)} {periodic} {words(9, 2, 9)}"), (2, f"{words(7, 2, 9)} {periodic} {words(9, 2, 9)}")])).collect()}
        assert got[1] == 0 and got[2] > 0.6 * len(periodic)


# 5 Jaccard join


def jaccard_expected(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[(d, t)] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    keys = [(k, s) for k, s in sets.items() if k[0] is not None and s]
    parent = {k[0]: k[0] for k in sets if k[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, ((a, _), s) in enumerate(keys):
        for (b, _), t in keys[i + 1 :]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return collections.Counter((d, len(sets[(d, t)]), None if d is None else find(d)) for d, t in rows)


def near_rows(n=60, seed=3):
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.75:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        else:
            w = [f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 12, 60, 90]))]
        texts.append(" ".join(w))
        rows.append((n - i, texts[-1]))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, words, percent):
    rows = [*near_rows(), *[(d and d + 200, t) for d, t in edge_rows()]]
    got = jaccard.jaccard_components(docs_frame(spark, rows).repartition(3), words, percent)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == jaccard_expected(rows, words, percent)


def test_jaccard_one_id_with_several_texts(spark):
    """A doc_id that comes with several texts links by each of them, whatever the order of rows."""
    rng = random.Random(1)
    a, b, c = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(3))
    rows = [(9, a), (9, b), (5, a + " end"), (12, b + " end"), (20, c), (9, ""), (12, None), (20, ""), (30, ""), (9, a), (31, c + " tail"), (None, a)]
    for seed in (0, 1):
        shuffled = random.Random(seed).sample(rows, len(rows))
        got = jaccard.jaccard_components(docs_frame(spark, shuffled).repartition(3), 3, 90).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_expected(rows, 3, 90)


def test_jaccard_rest_without_stars(spark, monkeypatch):
    """Links that no star finds come from the second pass."""
    real = jaccard._verified
    calls = []

    def skip_first(pairs, *args):
        calls.append(1)
        return real(pairs.limit(0) if len(calls) == 1 else pairs, *args)

    monkeypatch.setattr(jaccard, "_verified", skip_first)
    rows = near_rows(40, 9)
    got = jaccard.jaccard_components(docs_frame(spark, rows), 3, 90)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == jaccard_expected(rows, 3, 90)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(docs_frame(spark, [])).count() == 0


# 6 suffix dedup


def suffix_expected(rows, length):
    least = {}
    for d, t in rows:
        u = (t or "").encode()
        if d is not None:
            for i in range(len(u) - length + 1):
                least[u[i : i + length]] = min(d, least.get(u[i : i + length], d))
    out = []
    for d, t in rows:
        u = (t or "").encode()
        gone = np.zeros(len(u) + 1, bool)
        for i in range(len(u) - length + 1):
            if d is not None and least[u[i : i + length]] < d:
                gone[i : i + length] = True
        out.append((d, len(u), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(bytes(b for b, g in zip(u, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def tangled_rows(n=40, seed=5):
    """Texts made of shared pieces cut anywhere, so that matches of about the length abound."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc ") for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 8)):
            p, a = rng.choice(pool), rng.randrange(150)
            parts.append(p[a : a + rng.randrange(20, 90)])
        rows.append((rng.randrange(30) if i % 3 else i, "".join(parts)))
    return rows


@pytest.mark.parametrize("length", [24, 50, 77])
def test_suffix_equals_brute_force(spark, length):
    for rows in (tangled_rows(), edge_rows()):
        got = suffix.dedup_repeats(docs_frame(spark, rows).repartition(3), length)
        assert sorted((tuple(r) for r in got.collect()), key=str) == suffix_expected(rows, length)


def test_suffix_empty_texts_in_tasks_of_their_own(spark):
    suffix._POWERS.clear()
    assert len(suffix.powers(suffix.INVERSE, 0)) == 0 and len(suffix.powers(suffix.INVERSE, 3)) == 3
    text = "a passage of more than fifty bytes that two of the documents have in common. "
    for rows in ([(1, None), (2, ""), (2, ""), (None, text), (3, text), (4, text)], [(1, None), (2, None)], [(1, ""), (2, "")]):
        got = suffix.dedup_repeats(docs_frame(spark, rows).repartition(4), 50)
        found = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got.collect()), key=str)
        assert found == sorted(((d, len(t or ""), len(t) if d == 4 else 0) for d, t in rows), key=str)


def test_rows_between_stages_grow_as_the_input():
    """Runs x buckets, with few shuffle partitions: 4 and 16 times the input, about 4 and 16 times the rows."""
    for total in (10**9, 4 * 10**9, 16 * 10**9, 10**12):
        size, buckets = common.dealt(total, common.RUN, common.PAIR, 4)
        assert 0.9 < (total / size) * buckets / (total / common.PAIR) < 1.1 and size < 1.1 * (common.PAIR * total) ** 0.5


def test_suffix_splits_hot_anchors_and_long_texts(spark):
    """Anchors with more than two contexts are dealt by content, and texts are cut into pieces of 100 bytes: same results."""
    line = "every page of this site ends with the same long line of words, "
    rng = random.Random(4)
    rows = [*tangled_rows(30, 6), *[(100 + i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(90))) + line + "".join(rng.choice("xyz ") for _ in range(90))) for i in range(40)], *edge_rows()]
    got = suffix.dedup_repeats(docs_frame(spark, rows).repartition(3), 50, buckets=7, hot=2, piece=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == suffix_expected(rows, 50)


def test_suffix_verifies_equal_hashes_by_bytes(monkeypatch):
    """Contexts of which every hash is equal are still told apart: only equal bytes, keys and sizes share a stand-in."""
    monkeypatch.setattr(suffix, "prefix_hashes", lambda b: np.zeros(len(b) + 1, np.uint64))
    monkeypatch.setattr(suffix, "mixed", lambda x: x * np.uint64(0))
    pool = [b"a" * 50, b"a" * 49 + b"b", b"c" * 60, b"a" * 51]
    rng = random.Random(2)
    drawn = [rng.choice(pool) for _ in range(200)]
    size = np.array([len(x) for x in drawn])
    key, own = np.array([rng.randrange(2) for _ in drawn]).astype(np.uint64), np.array([rng.randrange(50) for _ in drawn])
    stands = suffix._copies(np.frombuffer(b"".join(drawn), np.uint8), np.cumsum(size) - size, size, key, own)
    assert all(drawn[i] == drawn[j] and key[i] == key[j] and own[j] <= own[i] for i, j in enumerate(stands))


def test_suffix_empty_and_periodic(spark):
    assert suffix.dedup_repeats(docs_frame(spark, [])).count() == 0
    rows = [(1, "ab" * 200), (2, "ba" * 100 + "x" + "ab" * 30), (3, "a" * 500), (4, "a" * 49), (5, "a" * 51)]
    assert sorted((tuple(r) for r in suffix.dedup_repeats(docs_frame(spark, rows), 50).collect()), key=str) == suffix_expected(rows, 50)


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_sort(collide, monkeypatch):
    rng = np.random.default_rng(1)
    buffer = rng.integers(97, 99, 3000).astype(np.uint8)
    buffer[1500:1700] = buffer[100:300]
    if collide:  # a hash that knows nothing of the bytes: verification must find it out
        monkeypatch.setattr(suffix, "prefix_hashes", lambda b: np.zeros(len(b) + 1, np.uint64))
    start = rng.integers(0, 3000 - 50, 400)
    group = rng.integers(0, 3, 400)
    got = suffix.SuffixSort(buffer, 50).classes(start, group)
    want = {}
    for c, s, g in zip(got, start, group, strict=True):
        want.setdefault((g, buffer[s : s + 50].tobytes()), set()).add(c)
    assert all(len(x) == 1 for x in want.values()) and len({min(x) for x in want.values()}) == len(want)
    if not collide:
        order = suffix.SuffixSort(buffer, 50).sort(start, group)
        keys = [(group[i], buffer[start[i] : start[i] + 50].tobytes()) for i in order]
        assert keys == sorted(keys)


# 7 byte-pair encoding


def test_bpe_equals_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rng = random.Random(0)
    odd = ["Hello's DON'T 12½ <|endoftext|>a<|startoftext|>", "ΣΑΣ é é \x85y\x1cz İ ǅ 中文 🙂🙂 ﬁ ⅷ", " 　\t", "</w> a</w>", "''s 's'so !!'s", "a" * 400, "x-" * 300]
    odd += ["".join(rng.choice("abcdefghijklmnop'<>|é中 \n1½!") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [*edge_rows(), *[(100 + i, t) for i, t in enumerate(odd)], *[(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]]
    got = bpe.round_trip_digests(docs_frame(spark, rows), path).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    encoded = bpe.encode(docs_frame(spark, rows[:12]), path)
    assert {(r.doc_id, r.text) for r in bpe.decode(encoded, path).collect()} == {(d, tk.decode(tk.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in rows[:12]}
    assert bpe.round_trip_digests(docs_frame(spark, []), path).count() == 0


def merged(word, merges):
    """Textbook merging: the earliest rule, leftmost first."""
    parts = list(word)
    for a, b in merges:
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_automaton_on_small_merges():
    rng = random.Random(7)
    for _ in range(40):
        merges, tokens = [], list("ab")
        for _ in range(8):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens and any(pair in zip(p, p[1:], strict=False) for p in ([*merged("".join(rng.choice("ab") for _ in range(40)), merges)],)):
                merges.append(pair)
                tokens.append("".join(pair))
        a = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges, {}, "")
        for _ in range(60):
            word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
            assert [tokens[i] for i in a.encode(word)] == merged(word, merges)


# 8 nearest neighbours


def test_ann_recall_and_ties(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = df.toPandas()
    v, ids = np.stack(x.embedding).astype(float), x.vec_id.to_numpy()
    got = QUERIES["op8_multi_index"](spark, sf_dir).toPandas()
    found = 0
    for q, g in got.groupby("query_id"):
        s = (v * v[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        assert np.allclose(g.score, [s[ids == i][0] for i in g.vec_id], atol=0, rtol=1e-12)
        assert sorted(g["rank"]) == list(range(1, 21)) and g.sort_values("rank").score.is_monotonic_decreasing
        found += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert found >= 0.9 * len(got)


def test_ann_edges(spark):
    rng = np.random.default_rng(0)
    same = rng.normal(size=6).tolist()
    rows = [(i, same) for i in range(40)] + [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("inf")] * 6), (None, same), (105, [1.0]), (106, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=5, block_rows=7)
    assert {r.query_id: [x.vec_id for x in got.where(f"query_id = {r.query_id}").orderBy("rank").collect()] for r in got.select("query_id").distinct().collect()} == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4]}
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [1, 2]
    none = df.limit(0)
    assert ann.search(none, none).count() == 0


def test_ann_few_vectors_and_repeated_ids(spark):
    """No, one or two usable vectors; ids that repeat; columns named as the operator's own."""
    for rows, want in (
        ([], []),
        ([(0, None)], []),
        ([(0, [1.0, 2.0])], []),
        ([(0, [1.0, 2.0]), (1, [2.0, 1.0])], [(0, 1, 1)]),
        ([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0])], [(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2)]),
        ([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])], [(0, 1, 1), (0, 2, 1)]),
    ):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("block", "run", "number", "rank", "distance")})
        got = ann.search(df, df.where("vec_id = 0"), k=2).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want


def test_ann_in_many_blocks(spark):
    """Vectors in clusters, in 14 blocks: recall, and how many vectors the index touches and reranks."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    v = centres[rng.integers(0, 60, 4000)] + 0.4 * rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=20, block_rows=300).toPandas()
    found = 0
    for q, g in got.groupby("query_id"):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        assert np.allclose(g.score, s[g.vec_id], atol=0, rtol=1e-12)
        found += len(set(np.lexsort((np.arange(4000), -s))[:20]) & set(g.vec_id))
    assert len(got) == 200 * 20 and found >= 0.9 * len(got)
    codes = ann.fit(v)
    index = ann.MultiIndex(codes(v))
    reranked = sum(len(index.within(c, 18)) for c in codes(v[::20]))
    assert index.probed < 0.6 * 200 * 4000 and reranked < 0.1 * 200 * 4000


def test_pigeonhole():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8), np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 7, 8, 20, 33, 64):
        q = codes[rng.integers(500)] ^ (rng.random(8) < 0.3).astype(np.uint8)
        want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
        assert index.within(q, radius).tolist() == want.tolist()


# 9 language


def test_language(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language"](spark, d).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def language_expected(rows, dims, seed):
    """Labels and scores of texts by the definition, letter by letter, one trigram at a time."""
    letters = langid.letter_vectors(dims, seed).astype(float)

    def symbol(c):
        if not c.isalpha():
            return 0
        if "a" <= c <= "z":
            return ord(c) - 96
        return 27 + (ord(c) - 0xDF) % 31 if 0xDF <= ord(c) <= 0xFF else 58 + ord(c) % 6

    def bundle(text):
        codes, total = [0, *map(symbol, text.lower()), 0], np.zeros(dims)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            if b:
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    sums = {}
    for _, text, lang in rows:
        if text is not None and lang is not None and (v := bundle(text)).any():
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    protos = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    out = {}
    for i, text, _ in rows:
        v = bundle(text or "")
        cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in protos.items()} if v.any() else {}
        best = max(cosines, key=cosines.get) if cosines else "und"
        out[i] = (best, min(1.0, max(0.0, cosines.get(best, 0.0))), sorted(cosines.values())[-2:])
    return out


def test_language_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000").limit(60).collect()
    rows = [*map(tuple, docs), (9001, "Straße ÜBER Œuvre čeština", "de"), (9002, "中文 mixed ß", None), (9003, "ab", "xx"), (9004, None, "en"), (9005, "12 3", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = language_expected(rows, 1024, 7)
    for r in langid.predict(df, langid.train(df)).collect():
        label, score, top = want[r.doc_id]
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == label or top[-1] - top[0] < 1e-5)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "the dog", None), (None, "die katze", None), (6, "", "de"), (7, "the " * 50_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit(0)).withColumn("score", F.lit("old"))
    got = langid.predict(df, langid.train(df)).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (None, "de"), (6, "und"), (7, "en")}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    empty = df.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0


# 10 URL rules


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark, monkeypatch):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.b.www.EXAMPLE.com", "net", "x.net", "notexample.com", "Ünï.net", "", "com.", ".com", "a..com", "x." * 5000 + "com", "user@host.net:80", "org"]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/es/", "/fr/a/b", "/en", "//es/", "/es/\n?q", "/p" * 5000]
    urls = [f"{rng.choice(['http', 'https', '', 'HTTP'])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?a=://b/", "#x")]
    urls += [None, "", "no scheme", "://", "http:/x", "a://b://c/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, urls[1]), (None, urls[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "row", "digest")})
    got = urlfilter.judge_urls(df, RULES).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, *judge(u)) for i, u in rows)
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 2)  # a list too long to broadcast
    got = urlfilter.judge_urls(df, RULES).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, *judge(u)) for i, u in rows)
    assert urlfilter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(df, [], default="block").collect()} == {"block"}
