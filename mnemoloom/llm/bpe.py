"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, one gadget per merge, into a deterministic automaton whose arcs are tokens
and whose paths are exactly the correct token sequences. After the merge (u, v) -> w no u may be
followed by v: the state that u leads to is split off, without its v arc; w is allowed wherever u was
and leads where v led. So a state is settled by the last token, and is kept as a link to the state it
was split from plus the one arc that it lost: the arcs' table holds for each token the ranges of states that have no such arc.

A word is read letter by letter through a second compiled table, of the arcs' labels: ``goto`` and ``fail`` lead from one state to the next,
``longest`` names the longest label that ends at the letter just read and ``shorter`` the next one. The only label that may follow the path
of what lies before it is the one that the arcs' table allows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.common import arrays, runs

#: Words, and arcs, that a worker remembers; at this many the memory starts anew.
WORDS_KEPT, ARCS_KEPT = 400_000, 400_000
#: The letters of the tables: all bytes, and the end of a word.
END, SYMBOLS = 256, 257
WHITE = "\t-\r \x85\xa0  -     　"
SPACES = re.compile(f"[{WHITE}]+")
# The pre-tokenizer's alternatives, in its order.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_WORD = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
_LETTERS, _NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORD = re.compile(f"{CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{WHITE[:8]}{_LETTERS}{_NUMBERS}]+")


class Automaton:
    """Compiled merges. ``follows(s, t)``: whether token t may follow token s; ``encode(word)``: the only path that spells a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], end: str) -> None:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.table = str.maketrans({b: c for b, c in self.char.items()})
        self.vocab, self.end, self.special = vocab, end, special
        size = max([*vocab.values(), *special.values()]) + 1
        self.labels = np.full(size, "", dtype=object)
        for text, i in chain(vocab.items(), special.items()):
            self.labels[i] = text
        self.left, self.made, self.arrives = [-1] * size, [-1] * size, [0] * size
        self.parent, self.lost, self.since = [-1], [-1], [-1]
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self._settle()
        self._compile_labels()

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        q = self.arrives[u]
        self.left[w], self.made[w], self.arrives[w] = u, rank, self.arrives[v]
        self.parent.append(q)
        self.lost.append(v)
        self.since.append(rank)
        self.arrives[u] = len(self.parent) - 1

    def _settle(self) -> None:
        """Number the tree of split-off states so that a state's descendants are a range; note for each arc which ranges lost it.

        An arc that a state and its ancestor both lost counts from the ancestor on, so the ranges of one arc are disjoint.
        """
        n = len(self.parent)
        span, first, free = [1] * n, [0] * n, [1] * n
        for s in range(n - 1, 0, -1):
            span[self.parent[s]] += span[s]
        self.gone: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for s in range(1, n):
            first[s] = free[self.parent[s]]
            free[self.parent[s]] += span[s]
            free[s] = first[s] + 1
        for s in sorted(range(1, n), key=first.__getitem__):
            starts, ends, since = self.gone.setdefault(self.lost[s], ([], [], []))
            if not ends or ends[-1] <= first[s]:
                starts.append(first[s])
                ends.append(first[s] + span[s])
                since.append(self.since[s])
        self.place = [first[s] for s in self.arrives]

    def _compile_labels(self) -> None:
        """Tables that read letters: the labels' prefixes are the states. A label is a token that is made by a merge or is one letter."""
        byte_of = {c: b for b, c in self.char.items()}
        self.goto: dict[int, int] = {}
        self.longest, self.fail, self.shorter, self.length = [-1], [0], [-1] * len(self.labels), [0] * len(self.labels)
        above, depth = [(0, 0)], [0]
        for text, t in self.vocab.items():
            ends = bool(self.end) and text.endswith(self.end)
            letters = text[: -len(self.end)] if ends else text
            if t in self.special.values() or not letters or not (self.made[t] >= 0 or len(letters) == 1) or any(c not in byte_of for c in letters):
                continue
            symbols = [*(byte_of[c] for c in letters), *([END] if ends else [])]
            node = 0
            for c in symbols:
                key = node * SYMBOLS + c
                if key not in self.goto:
                    self.goto[key] = len(above)
                    above.append((node, c))
                    depth.append(depth[node] + 1)
                    self.longest.append(-1)
                    self.fail.append(0)
                node = self.goto[key]
            self.longest[node], self.length[t] = t, len(symbols)
        for node in sorted(range(1, len(above)), key=depth.__getitem__):
            up, c = above[node]
            at = up
            while at:
                at = self.fail[at]
                if at * SYMBOLS + c in self.goto:
                    self.fail[node] = self.goto[at * SYMBOLS + c]
                    break
            rest = self.longest[self.fail[node]]
            if self.longest[node] < 0:
                self.longest[node] = rest
            else:
                self.shorter[self.longest[node]] = rest

    def follows(self, s: int, t: int) -> bool:
        key = (s, t)
        known = self.arcs.get(key)
        if known is None:
            at, z, above, known = self.place[s], t, None, True
            while z >= 0:
                lost = self.gone.get(z)
                if lost is not None:
                    i = bisect_right(lost[0], at) - 1
                    if i >= 0 and at < lost[1][i] and (above is None or above >= lost[2][i]):
                        known = False
                        break
                above, z = self.made[z], self.left[z]
            if len(self.arcs) > ARCS_KEPT:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-split word, by the tables: each prefix has one correct path, an arc longer than that of a shorter prefix."""
        known = self.words.get(word)
        if known is not None:
            return known
        goto, fail, longest, shorter, length, follows = self.goto.get, self.fail, self.longest, self.shorter, self.length, self.follows
        symbols = [*word.encode(), *([END] if self.end else [])]
        n, node = len(symbols), 0
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i, c in enumerate(symbols, 1):
            to = goto(node * SYMBOLS + c)
            while to is None and node:
                node = fail[node]
                to = goto(node * SYMBOLS + c)
            node = to or 0
            t = longest[node]
            while t >= 0:
                j = i - length[t]
                if j == 0 or (last[j] >= 0 and follows(last[j], t)):
                    last[i], back[i] = t, j
                    break
                t = shorter[t]
        out, i = [], n
        while i:
            out.append(last[i])
            i = back[i]
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        found = self.words[word] = tuple(out[::-1])
        return found

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of a whole text: special tokens are taken out of the raw text, the rest is normalized, split and encoded."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return np.concatenate([np.array([self.special[p]], np.int32) if i % 2 else self._plain(p) for i, p in enumerate(parts)])

    def _plain(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            words = LATIN_WORD.findall(text.lower())
        except UnicodeEncodeError:
            text = SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
            words = ANY_WORD.findall(text)
        known, encode = self.words.get, self.encode
        found = [known(w) or encode(w) for w in words]
        return np.fromiter(chain.from_iterable(found), np.int32)

    def decode_ids(self, ids: np.ndarray) -> str:
        """Labels of the path's arcs; the vocabulary has no decoder, so they are joined by single spaces."""
        return " ".join(self.labels[ids].tolist())


COMPILED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compile a tokenizers file of this kind (word-end BPE), once a worker."""
    if path not in COMPILED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        COMPILED[path] = Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, model["end_of_word_suffix"] or "")
    return COMPILED[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): whole texts encoded as the file's tokenizer does, without added special tokens.

    Null text is empty and has no ids; ids may be null or repeated; extra columns are ignored; no shuffle.
    A text is one row of one task; the worker keeps a bounded memory of words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(tokenizer)
        for batch in runs(batches, "text"):
            yield arrays([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))], [batch.column("doc_id"), [a.encode_text(t or "") for t in batch.column("text").to_pylist()]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(tokenizer)
        for batch in batches:
            texts = [a.decode_ids(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield arrays([("doc_id", pa.int64()), ("text", pa.string())], [batch.column("doc_id"), texts])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and return what identifies both: ids in decimal joined by spaces, and the decoded text, as SHA-256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(tokenizer)
        decimal = np.array([str(i) for i in range(len(a.labels))], dtype=object)
        for batch in runs(batches, "text"):
            ids = [a.encode_text(t or "") for t in batch.column("text").to_pylist()]
            yield arrays(DIGESTS, [
                batch.column("doc_id"),
                [len(x) for x in ids],
                [hashlib.sha256(" ".join(decimal[x].tolist()).encode()).hexdigest() for x in ids],
                [hashlib.sha256(a.decode_ids(x).encode()).hexdigest() for x in ids],
            ])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
