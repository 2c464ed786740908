"""Text and attribute normalisation, payload and answer extraction, duplicate collapse, calendar ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from mnemoloom.functions.columns import c
from mnemoloom.operators.components import connected_components
from mnemoloom.session import stage

# ASCII punctuation, and the character families that fold_unicode maps.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CONTROL_CLASS = "[\\u0001-\\u0008\\u000E\\u000F\\u0011-\\u001B]"
SPACE_LIKE = "\u000b\u000c\u0085"
HYPHENS = "‐‑⁃‒–—―−－⁻"
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "’՚Ꞌꞌ＇‘‚‛`´′‵"
SLASHES = "⁄∕"
# Attribute keys, aliases and irregular singulars.
VISUAL_KEYS = ["color", "appearance", "shape", "material", "texture", "pattern", "count", "visible_state", "action", "pose", "position", "spatial_relation", "ocr_text"]
ENTITY_KEYS = {
    "PERSON": ["relation", "preference", "occupation", "trait", "age"],
    "ANIMAL": ["species", "breed", "owner", "trait", "appearance", "skill", "status"],
    "OBJECT": ["category", "color", "style", "material", "owner", "status", "use"],
    "PLACE": ["kind", "location", "feature"],
    "ORGANIZATION": ["kind", "location", "role"],
    "EVENT": ["date", "location", "participants", "status"],
}
TEXT_KEYS = sorted({k for keys in ENTITY_KEYS.values() for k in keys} | set(VISUAL_KEYS))
KEY_ALIASES = {"coat-color": "color", "coat_color": "color"}
VALUE_ALIASES = {"seated": "sitting"}
EMPTY_VALUES = ["n/a", "none", "not applicable", "not specified", "unknown", ""]
IRREGULAR = {"children": "child", "feet": "foot", "geese": "goose", "men": "man", "mice": "mouse", "people": "person", "teeth": "tooth", "women": "woman"}
PRONOUNS = ["it", "they", "them", "he", "she", "him", "her", "this", "that", "there", "user", "the user", "assistant", "the assistant", "someone", "something", "它", "他", "她", "他们", "她们", "它们", "这", "那", "这里", "那里", "用户", "助手", "某人", "有人"]
MAX_VALUES, MAX_RECORDS = 8, 16


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def normalize_answer(text: Column | str) -> Column:
    """Lower case; dots between digits and underscores stay, other ASCII punctuation becomes a space; articles and "and" go; squeezed."""
    marks = "".join(p for p in PUNCTUATION if p not in "._")
    x = F.lower(c(text))
    x = F.regexp_replace(x, "(?U)(?=[at])(?<![\\w])(a|an|the|and)(?![\\w])", " ")  # the first letter is looked at before its surroundings
    x = F.regexp_replace(x, "\\.(?:(?<![0-9]\\.)|(?![0-9]))", " ")
    return squeeze(F.translate(x, marks, " " * len(marks)))


def normalize_alnum(text: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(c(text)), "[^a-z0-9\\s]", ""))


def fold_unicode(text: Column | str) -> Column:
    """Controls removed; hyphen, quote, prime and slash families folded to ASCII; the ellipsis sign spelled out."""
    source = SPACE_LIKE + HYPHENS + DOUBLE_QUOTES + SINGLE_QUOTES + SLASHES
    target = " " * len(SPACE_LIKE) + "-" * len(HYPHENS) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "/" * len(SLASHES)
    x = F.translate(F.regexp_replace(c(text), CONTROL_CLASS, ""), source + "­", target)
    for signs, n in (("[″‶]", 2), ("[‴‷]", 3), ("⁗", 4)):
        x = F.regexp_replace(x, signs, "'" * n)
    return F.replace(F.replace(x, F.lit("…"), F.lit("...")), F.lit(" . . . "), F.lit(" ... "))


def _mapped(x: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), x)
    for k, v in table.items():
        out = out.when(x == k, v)
    return out.otherwise(x)


def singular_last_word(x: Column) -> Column:
    word = F.regexp_extract(x, "([a-z]+)$", 1)
    n = F.length(word)
    irregular = _mapped(word, IRREGULAR)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    one = (
        F.when(irregular != word, irregular)
        .when((n > 3) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & word.rlike("(sses|shes|ches|xes|zes)$"), cut(2))
        .when((n > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), cut(1))
        .otherwise(word)
    )
    return F.concat(F.substring(x, F.lit(1), F.length(x) - n), one)


def normalize_attribute(key: Column | str, value: Column | str) -> tuple[Column, Column]:
    """Canonical (attribute, value); both null where the pair is rejected."""
    k = _mapped(F.replace(squeeze(F.lower(F.trim(c(key)))), F.lit(" "), F.lit("_")), KEY_ALIASES)
    v = singular_last_word(_mapped(squeeze(F.lower(F.trim(c(value)))), VALUE_ALIASES))
    good = (k != "") & ~v.isin(EMPTY_VALUES)
    return F.when(good, k), F.when(good, v)


def normalize_attributes(rows: DataFrame, visual: bool = False) -> DataFrame:
    """Records (memory_id, entity, attribute, values) from rows (memory_id, pos, entity, attribute, values array).

    Pairs are normalised and kept if the key is allowed; a record holds its first 8 distinct values in
    order, a memory its first 16 records.
    """
    x = rows.select("memory_id", "pos", F.coalesce(F.trim("entity"), F.lit("")).alias("entity"), "attribute", F.posexplode("values").alias("vpos", "value"))
    k, v = normalize_attribute("attribute", "value")
    x = x.withColumns({"attribute": k, "value": v}).where(F.col("attribute").isin(VISUAL_KEYS if visual else TEXT_KEYS))
    first = x.groupBy("memory_id", "entity", "attribute", "value").agg(F.min(F.struct("pos", "vpos")).alias("at"))
    w = Window.partitionBy("memory_id", "entity", "attribute").orderBy("at")
    kept = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_VALUES)
    records = kept.groupBy("memory_id", "entity", "attribute").agg(F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("values"))
    m = Window.partitionBy("memory_id").orderBy("at")
    return records.withColumn("record", F.row_number().over(m)).where(F.col("record") <= MAX_RECORDS).drop("at")


def normalize_entities(rows: DataFrame) -> DataFrame:
    """Entities (memory_id, pos, name, type, attributes map) with known type, a concrete name, and allowed keys; the first of each (lower name, type) per memory."""
    name, kind = F.trim("name"), F.upper(F.trim("type"))
    x = rows.withColumns({"name": name, "type": kind}).where(F.col("type").isin(*ENTITY_KEYS) & (F.length("name") >= 2) & ~F.lower("name").isin(PRONOUNS))
    w = Window.partitionBy("memory_id", F.lower("name"), "type").orderBy("pos")
    x = x.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    allowed = F.when(F.lit(False), F.array().cast("array<string>"))
    for t, keys in ENTITY_KEYS.items():
        allowed = allowed.when(F.col("type") == t, F.array(*map(F.lit, keys)))
    fine = F.map_filter(F.transform_keys("attributes", lambda k, _: F.lower(F.trim(k))), lambda k, v: F.array_contains(allowed, k) & (F.trim(v) != ""))
    return x.withColumn("attributes", fine)


def parse_model_json(text: Column | str, labels: dict[str, str], default: str = "PARSE_ERROR") -> Column:
    """Struct (label, score, error) from model text: what lies between the first { and the last }, fences aside; unknown labels and bad JSON become ``default``."""
    body = F.regexp_extract(F.regexp_replace(c(text), "```(json)?", ""), "(?s)(\\{.*\\})", 1)
    label = F.lower(F.trim(F.get_json_object(body, "$.label")))
    known = F.when(F.lit(False), F.lit(default))
    for k, v in labels.items():
        known = known.when(label == k, v)
    known = known.otherwise(default)
    score = F.get_json_object(body, "$.score").try_cast("double")
    return F.struct(known.alias("label"), F.when(score.between(0, 1), score).alias("score"), (known == default).alias("error"))


def extract_answer(text: Column | str) -> tuple[Column, Column]:
    """(strict, recovered): the text is one non-empty <answer> block; or it holds exactly one."""
    strict = F.trim(F.regexp_extract(c(text), "(?s)^\\s*<answer>(.*)</answer>\\s*$", 1))
    found = F.regexp_extract_all(c(text), F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1))
    one = F.when(F.size(found) == 1, F.trim(found[0]))
    good = lambda x: F.when((x != "") & ~x.contains("<answer>") & ~x.contains("</answer>"), x)
    return good(strict), good(one)


def extract_choice(text: Column | str, keys: str = "ABCD") -> Column:
    """Option letter: the whole text, else a leading letter and a mark, else the first letter standing alone, else INVALID."""
    t = F.upper(F.trim(c(text)))
    got = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    return F.coalesce(F.when(t.rlike(f"^[{keys}]$"), t), got(f"^([{keys}])[.):\\s,]"), got(f"(?U)\\b([{keys}])\\b"), F.lit("INVALID"))


def collapse_by_key(df: DataFrame, key: str, source: str) -> DataFrame:
    """One row per key with its sorted set of sources and count."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(source)).alias("sources"), F.count("*").alias("n"))


def calendar_range(ref: Column, unit: str, offset: int = 0) -> tuple[Column, Column]:
    """Half-open [start, end) of a day, Monday week or 30-day month around ``ref``, ``offset`` units away."""
    days = {"day": 1, "week": 7, "month": 30}[unit]
    start = F.date_trunc(unit, ref) + F.make_dt_interval(F.lit(days * offset))
    return start, start + F.make_dt_interval(F.lit(days))


def _area(f, a: float, b: float, steps: int = 200) -> float:
    """Simpson's rule."""
    h = (b - a) / steps
    return h / 3 * sum(f(a + i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))


def best_bands(threshold: float, permutations: int) -> tuple[int, int]:
    """(bands, rows) with the least equally weighted area of false positives below and false negatives above the threshold."""
    best = (float("inf"), 1, 1)
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            p = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            best = min(best, (0.5 * _area(p, 0, threshold) + 0.5 * _area(lambda s, p=p: 1 - p(s), threshold, 1), b, r))
    return best[1], best[2]


WORD = re.compile("[A-Za-z_0-9]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word shingles of a text; none for fewer words."""
    words = WORD.findall(text)
    if len(words) < n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ each[i : len(each) - n + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(bands: int, rows: int, n: int, seed: int = 1):
    """For ``mapInArrow`` over (id, text): (id, keys), one key per band of the min-hash signature (odd multipliers modulo 2**64).

    A signature is taken over 1,024 shingles at a time, so a long text needs no more room than a short one. Texts of fewer than ``n`` words are left out.
    """
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 63, bands * rows, np.uint64) for _ in range(2))
    a = a * np.uint64(2) + np.uint64(1)

    def keys(s: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, np.uint64(2**64 - 1))
        for start in range(0, len(s), 1024):
            x = s[start : start + 1024, None] * a + b
            x ^= x >> np.uint64(29)
            low = np.minimum(low, x.min(axis=0))
        low, key = low.reshape(bands, rows), np.zeros(bands, np.uint64)
        for j in range(rows):
            key = (key ^ low[:, j]) * MIX
            key ^= key >> np.uint64(32)
        return key.view(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [(i, s) for i, t in enumerate(part.column(1).to_pylist()) if t is not None and len(s := shingle_hashes(t, n))]
                ids = part.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([keys(s) for _, s in found], pa.list_(pa.int64()))], names=["id", "keys"])

    return run


def near_dedup(df: DataFrame, ident: str, text: str, threshold: float = 0.7, permutations: int = 256, n: int = 5) -> DataFrame:
    """MinHash-LSH classes on n-word shingles: (id, class_id), the class being its smallest id.

    Rows of one band value are joined to its smallest id, so a band of any size gives as many edges as
    rows. Texts with fewer than ``n`` tokens stay alone. Signatures are made in one pass over the texts and stored.
    """
    b, r = best_bands(threshold, permutations)
    signed = df.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    schema = StructType([signed.schema["id"], StructField("keys", ArrayType(LongType()))])
    stored = stage(signed.mapInArrow(band_keys(b, r, n), schema), "band-keys")
    keys = stored.select("id", F.posexplode("keys").alias("band", "key"))
    heads = keys.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("k")).where("k > 1")
    edges = keys.join(heads, ["band", "key"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    labels = connected_components(edges)
    return df.select(F.col(ident).alias("id")).join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("class_id"))
