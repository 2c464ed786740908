"""Jaccard self-join on word shingles by a grouped prefix join, and its connected components.

Equal shingle sets are one class. A class's shingles are ordered rare first; classes with one size and
one prefix form a group, and groups that share a prefix shingle are candidates. Each class is first tried
against the most similar centre of its shingles (a star: a pair per class at most); only members that are still in
different components are then paired, so that a large set of near copies does not yield all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.common import arrays, blobs, dealt, runs, whole_buckets
from mnemoloom.operators.components import connected_components
from mnemoloom.session import TEXT_BATCH, stage

#: Cells of the frequency sketch that orders shingles; its size bounds what is collected and broadcast.
CELLS = 1 << 20
MAPS = 4
#: Groups whose postings are packed together, at least; packed rows number one for each PAIR groups.
GROUPS, PAIR = 10_000, 100
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a text in UTF-8: A-Z lower-cased, words split at
    ASCII white space (bytes 9 to 13 and 32). Fewer words are one shingle; no words, none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(_ODD[i % len(_ODD)]) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(hashes: np.ndarray, words: int = MAPS) -> np.ndarray:
    """``words`` (a power of two) 64-bit words in which each shingle flips one bit: the bits in which two sets differ are
    at most their symmetric difference. Halves of a map, combined by exclusive or, are the map of half the size."""
    bits = np.bincount((hashes >> np.uint64(17) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def map_words(n: int) -> int:
    """Words of the map of a set of ``n``: half a bit to a bit per shingle, MAPS at least."""
    return max(MAPS, 1 << max(0, (n - 1).bit_length() - 7))


COUNTS = "doc_id long, text_hash long, n int, digest binary, cell int, count long"
PREFIXES = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("rare", pa.int32()), ("key", pa.int64()), ("map", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64()))]
PREFIXES_DDL = "doc_id long, text_hash long, n int, prefix array<long>, rare int, key long, map array<long>, wide array<long>"
GROUP = np.dtype([("gid", "<i8"), ("n", "<i4"), ("items", "<i4")])
PACKED = [("bucket", pa.int32()), ("groups", pa.binary()), ("tokens", pa.binary()), ("places", pa.binary())]
POSTED = [("token", pa.int64()), ("gid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]
POSTED_DDL = "token long, gid long, n int, pos int"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _survey(texts: DataFrame, words: int) -> DataFrame:
    """One row per document (size and digest of its set), and rows for cells of shingles that are frequent in a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, pending = np.zeros(CELLS, np.int64), 0, []
        names = [x.split()[0] for x in COUNTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]

        def count() -> None:
            nonlocal held, pending
            if pending:
                counts.__iadd__(np.bincount(np.concatenate(pending), minlength=CELLS))
            held, pending = 0, []

        for batch in runs(batches, "text"):
            sizes, digests = [], []
            for text in blobs(batch.column("text")):
                s = shingles(text, words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                pending.append((s & np.uint64(CELLS - 1)).astype(np.int64))
                held += len(s)
            if held > CELLS:
                count()
            empty = [None] * len(sizes)
            yield arrays(list(zip(names, types, strict=True)), [batch.column("doc_id"), batch.column("text_hash"), sizes, digests, empty, empty])
        count()
        often = np.flatnonzero(counts >= 4 + 4 * counts.mean())
        empty = [None] * len(often)
        yield arrays(list(zip(names, types, strict=True)), [empty, empty, empty, empty, often.astype(np.int32), counts[often]])

    return texts.mapInArrow(run, COUNTS)


def _levels(survey: DataFrame) -> np.ndarray:
    """Frequency level (a logarithm) of each cell, 0 for all that are frequent in no task: CELLS bytes, whatever the corpus.

    It only sets the order of shingles; any order gives the same links, this one keeps frequent shingles out of prefixes.
    """
    rows = survey.where("cell is not null").groupBy("cell").agg(F.sum("count").alias("count")).toPandas()
    out = np.zeros(CELLS, np.uint8)
    if len(rows):
        out[rows["cell"].to_numpy()] = np.log2(rows["count"].to_numpy()).astype(np.uint8) + 1
    return out


def _prefixes(texts: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in runs(batches, "text"):
            out: list[list] = [[] for _ in PREFIXES]
            for doc, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), blobs(batch.column("text")), strict=True):
                s = shingles(text, words)
                if doc is None or not len(s):
                    continue
                level = order[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                rank = np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]
                prefix = s[rank]
                key = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=len(s)) - (1 << 63)
                for column, v in zip(out, (doc, text_hash, len(s), prefix.view(np.int64), int((level[rank] == 0).sum()), key, parity(s), parity(s, map_words(len(s)))), strict=True):
                    column.append(v)
            yield arrays(PREFIXES, out)

    return texts.mapInArrow(run, PREFIXES_DDL)


def _shared_postings(groups: DataFrame) -> DataFrame:
    """(token, gid, n, pos) of the prefix shingles that two groups may share.

    Shingles that are frequent in some task are posted as they are. The others, most of which no other
    group has, travel packed to buckets by hash, where those seen once are left out; as none of them is
    frequent anywhere, no bucket can hold a hot one.
    """

    some, buckets = dealt(groups.count(), GROUPS, PAIR, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= some:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            rare = batch.column("rare").to_numpy()
            tokens = np.concatenate([p.values.to_numpy()[:k] for p, k in zip(batch.column("prefix"), rare, strict=True)] or [np.zeros(0, np.int64)])
            if not len(tokens):
                continue
            owner = np.repeat(np.arange(len(rare), dtype=np.int32), rare)
            place = np.arange(len(tokens), dtype=np.int32) - np.repeat(np.cumsum(rare) - rare, rare).astype(np.int32)
            bucket = (tokens.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, place, bucket = tokens[order], owner[order], place[order], bucket[order]
            heads = np.concatenate([[0], np.flatnonzero((np.diff(owner) != 0) | (np.diff(bucket) != 0)) + 1])
            each = np.empty(len(heads), GROUP)
            each["gid"], each["n"] = batch.column("gid").to_numpy()[owner[heads]], batch.column("n").to_numpy()[owner[heads]]
            each["items"] = np.diff(np.append(heads, len(order)))
            out: list[list] = [[] for _ in PACKED]
            for k in np.unique(bucket):
                i, j = np.searchsorted(bucket, (k, k + 1))
                u, v = np.searchsorted(heads, (i, j))
                for column, x in zip(out, (int(k), each[u:v].tobytes(), tokens[i:j].tobytes(), place[i:j].tobytes()), strict=True):
                    column.append(x)
            yield arrays(PACKED, out)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole_buckets(batches):
            group = np.frombuffer(b"".join(r["groups"] for r in rows), GROUP)
            token, place = np.frombuffer(b"".join(r["tokens"] for r in rows), np.int64), np.frombuffer(b"".join(r["places"] for r in rows), np.int32)
            row = np.repeat(np.arange(len(group), dtype=np.int32), group["items"])
            order = np.argsort(token, kind="stable")
            same = token[order][1:] == token[order][:-1]
            twice = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
            yield arrays(POSTED, [token[twice], group["gid"][row[twice]], group["n"][row[twice]], place[twice]])

    packed = groups.select("gid", "n", "prefix", "rare").mapInArrow(pack, "bucket int, groups binary, tokens binary, places binary")
    seldom = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(keep, POSTED_DDL)
    often = groups.select("gid", "n", "rare", F.posexplode("prefix").alias("pos", "token")).where("pos >= rare").select("token", "gid", "n", "pos")
    return seldom.unionByName(often)


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b).cast("long") / F.lit(100 + percent) - F.lit(1e-9))


def _differing(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}.map")[i].bitwiseXOR(F.col(f"{y}.map")[i])) for i in range(MAPS)), F.lit(0))


def _differing_wide(x: str, y: str) -> Column:
    """Bits in which the wide maps differ, the longer folded to the length of the shorter."""
    a, b = F.col(f"{x}.wide"), F.col(f"{y}.wide")
    length = F.least(F.size(a), F.size(b))

    def word(m: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), (F.size(m) / length).cast("int") - 1), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.element_at(m, (i + k * length + 1).cast("int"))))

    return F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda acc, i: acc + F.bit_count(word(a, i).bitwiseXOR(word(b, i))))


def _maps_agree(x: str, y: str, percent: int, wide: bool = True) -> Column:
    """False only for pairs whose parity maps differ in more bits than the sets of a linked pair can."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (_differing_wide(x, y) if wide else _differing(x, y)) <= n - 2 * _least_overlap(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


ZIPPED = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("z", pa.binary())]


def _zipped(texts: DataFrame) -> DataFrame:
    """Texts in UTF-8 and zstd: a third of the bytes of their shingle hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text"):
            raw = blobs(batch.column("text"))
            yield arrays(ZIPPED, [batch.column("doc_id"), batch.column("text_hash"), [len(t) for t in raw], [pa.compress(t, "zstd", asbytes=True) for t in raw]])

    return texts.mapInArrow(run, "doc_id long, text_hash long, n_bytes long, z binary")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of (a, b) pairs those whose sets link. The text of b travels once per pair, in zstd, to that of a."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = texts.join(asked, "doc_id", "left_semi")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in runs(batches, "zb"):
            keep = []
            for a, na, za, nb, zb in zip(*(batch.column(c).to_pylist() for c in ("a", "na", "za", "nb", "zb")), strict=True):
                if a != last:
                    last, x = a, shingles(pa.decompress(za, na, "zstd", asbytes=True), words)
                y = shingles(pa.decompress(zb, nb, "zstd", asbytes=True), words)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("n_bytes").alias(f"n{x}"), F.col("z").alias(f"z{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "za", "nb", "zb").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id.

    Two documents link when their sets of distinct ``words``-word shingles have 100 * intersection >=
    ``percent`` * union. class_id is the smallest doc_id with an equal set; component_id the smallest
    doc_id that links reach, itself included. Exact up to equal 64-bit hashes of different shingles.

    Defined cases: null, empty or blank text has an empty set and is linked with nothing; a null doc_id
    is linked with nothing and has null ids; rows that repeat a doc_id are one document with a set a row: it
    links by each of them, and all its rows are in one component; extra columns are ignored; an empty table gives no rows.

    Scale: whole texts are shuffled only where their document has a candidate. Postings are slim rows;
    a shingle's centre is a minimum combined before the shuffle, and joins on hot shingles are plain
    equi-joins that AQE can split. The only thing broadcast is the frequency sketch of CELLS bytes.
    """
    texts = _texts(docs, id_col, text_col)
    survey = stage(_survey(texts, words), "jaccard-survey", TEXT_BATCH)
    each = survey.where("cell is null").select("doc_id", "text_hash", "n", "digest")
    sets = each.where("doc_id is not null and n > 0")
    # A class is known by a number of its own (below it is the doc_id of nodes, members and pairs) and by one row, its least (doc_id, text_hash).
    classes = stage(sets.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("digest", "r.*", F.monotonically_increasing_id().alias("class")), "jaccard-classes")
    row = ["doc_id", "text_hash"]
    prefixes = stage(_prefixes(texts, words, percent, _levels(survey)), "jaccard-prefixes", TEXT_BATCH)
    made = prefixes.select(*row, "n", "key").join(classes.select(*row, "class"), row).dropDuplicates(row)
    groups = made.groupBy("n", "key").agg(F.min("class").alias("gid"))
    assigned = made.join(groups, ["n", "key"]).select("gid", "class", *row)
    members = stage(prefixes.join(assigned, row).dropDuplicates(row).drop(*row).withColumnRenamed("class", "doc_id"), "jaccard-members")

    # Postings of groups: one row per prefix shingle that two groups may share.
    shared = stage(_shared_postings(members.where("gid = doc_id")), "jaccard-postings")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    shared = shared.withColumn("band", band)
    centres = shared.groupBy("token", "band").agg(F.min(F.struct("pos", "gid")).alias("c"), F.count("*").alias("k"))
    stars = shared.join(centres.where("k > 1").select("token", "band", F.col("c.gid").alias("centre")), ["token", "band"]).where("gid <> centre").select("gid", "centre").distinct()
    m, c = members.alias("m"), members.select("doc_id", "n", "wide").alias("c")
    star_pairs = stars.alias("s").join(m, F.col("s.gid") == F.col("m.gid")).join(c, (F.col("s.centre") == F.col("c.doc_id")) & _maps_agree("m", "c", percent)).select(F.col("c.doc_id").alias("a"), F.col("m.doc_id").alias("b"), _differing_wide("m", "c").alias("bits"))
    own = m.join(c, (F.col("m.gid") == F.col("c.doc_id")) & (F.col("m.doc_id") != F.col("c.doc_id")) & _maps_agree("m", "c", percent)).select(F.col("c.doc_id").alias("a"), F.col("m.doc_id").alias("b"), _differing_wide("m", "c").alias("bits"))
    nearest = star_pairs.unionByName(own).groupBy("b").agg(F.min(F.struct("bits", "a")).alias("c")).select(F.col("c.a").alias("a"), "b")
    in_reach = shared.select("gid").distinct().unionByName(members.where("gid <> doc_id").select("gid").distinct()).distinct()
    asked = classes.join(members.join(in_reach, "gid", "left_semi").select(F.col("doc_id").alias("class")), "class", "left_semi").select(*row, "class")
    near = stage(_zipped(texts).join(asked, row).dropDuplicates(row).drop(*row).withColumnRenamed("class", "doc_id"), "jaccard-texts", TEXT_BATCH)
    links = stage(_verified(stage(nearest, "jaccard-candidates"), near, words, percent), "jaccard-stars", TEXT_BATCH)
    labels = connected_components(links)

    # What the stars left apart: pairs of groups not yet in one component, then of their members.
    known = stage(members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).join(in_reach, "gid", "left_semi").select("gid", "doc_id", "n", "map", "wide", "component"), "jaccard-known")
    whole = known.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.first("map").alias("map"))
    side = shared.join(whole, "gid")
    x, y = side.alias("x"), side.alias("y")
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    reach = 1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1 >= _least_overlap(F.col("x.n"), F.col("y.n"), percent)
    alike = (F.col("x.size") > 1) | (F.col("y.size") > 1) | _maps_agree("x", "y", percent, wide=False)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & apart & sizes & reach & alike).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct()
    inner = whole.where("size > 1 and low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    p, q = known.alias("p"), known.alias("q")
    differ = (F.col("p.component") != F.col("q.component")) & _maps_agree("p", "q", percent)
    rest = pairs.unionByName(inner).alias("r").join(p, F.col("r.g") == F.col("p.gid")).join(q, (F.col("r.h") == F.col("q.gid")) & differ).select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()
    links = links.unionByName(stage(_verified(stage(rest, "jaccard-candidates"), near, words, percent), "jaccard-rest", TEXT_BATCH))
    # A doc_id with several sets is one document: its classes are linked too.
    several = sets.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    own_sets = sets.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "class"), "digest")
    least = own_sets.groupBy("doc_id").agg(F.min("class").alias("a"))
    labels = connected_components(links.unionByName(own_sets.join(least, "doc_id").where("class <> a").select("a", F.col("class").alias("b"))))

    every = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = every.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = every.join(lowest, "component").select("digest", F.col("doc_id").alias("class_id"), "component_id")
    # Rows without words follow their document's other rows, if it has any.
    blank = each.where("n = 0 and doc_id is not null").select("doc_id").distinct()
    followed = sets.join(blank, "doc_id", "left_semi").select("doc_id", "digest").join(named, "digest").groupBy(F.lit(0).alias("n"), "doc_id").agg(F.min("component_id").alias("followed"))
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    linked = F.col("doc_id").isNotNull()
    found = each.join(named, "digest", "left").join(followed, ["n", "doc_id"], "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(linked, F.coalesce("class_id", alone)).alias("class_id"), F.when(linked, F.coalesce("component_id", "followed", alone)).alias("component_id"))
