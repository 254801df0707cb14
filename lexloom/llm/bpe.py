"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in two short contiguous arrays. The lowest rank is found by a
scan, its boundary is deleted, and only the two neighbouring ranks are looked up again. The words that a batch of texts
needs and the worker does not know yet are merged together, one row of a matrix each, so every scan is one numpy call.
Words over LONG bytes, where scans would cost the square of the length, take the same merges from a heap.

Defined results: null text is the empty text (no ids, empty decoded text); the strings of added tokens inside a text
become their ids, as the vocabulary file says; whole texts are encoded, whatever their length; repeated rows give
repeated results. Extra columns pass by untouched, as only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .runtime import ship, task

#: The pre-tokenisation pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 128
NONE = np.int32(2**31 - 1)
KNOWN = 250_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files: itself if printable, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder for one vocabulary file's JSON."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.rank: dict[int, int] = {}
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 32 | vocab[right], n)
            self.made[n] = vocab[left + right]
        self._hash_table()
        top = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.pieces = [b""] * (top + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.loose = re.compile(r" [\s\x85]|[\s\x85] ")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _hash_table(self) -> None:
        """Open addressing, as arrays, of the pairs that have a rank."""
        self.bits = max(4, (4 * len(self.rank)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        for key, n in self.rank.items():
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE without one."""
        keys = left << 32 | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 6), (6, 12), (12, 24), (24, 48), (48, LONG)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(rows, len(rows) // 20_000 + 1):
                if len(part):
                    self._merge_rows([words[i] for i in part], sizes[part], high, part, out)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = np.array(self._merge_long(words[i]), "<u4").tobytes()
        return out

    def _merge_rows(self, words, sizes, width, places, out) -> None:
        n = len(words)
        parts = self.byte_ids[np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(n, width + 1)]
        ranks = self.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width)
        ranks[np.arange(width) >= (sizes - 1)[:, None]] = NONE
        column = np.arange(width)
        while True:
            i = ranks.argmin(axis=1)
            low = ranks[np.arange(len(ranks)), i]
            done = low == NONE
            if done.any():
                packed = parts[done].astype("<u4")
                for place, size, row in zip(places[done], sizes[done], packed):
                    out[place] = row[:size].tobytes()
                keep = ~done
                parts, ranks, sizes, places, i, low = parts[keep], ranks[keep], sizes[keep], places[keep], i[keep], low[keep]
                if not len(parts):
                    return
            row = np.arange(len(parts))
            parts[row, i] = self.made[low]
            parts[:, :-1] = np.take_along_axis(parts, column + (column > i[:, None]), 1)
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= i[:, None]), width - 1), 1)
            sizes = sizes - 1
            ranks[:, -1] = NONE
            has = i < sizes - 1
            ranks[row, i] = NONE
            ranks[row[has], i[has]] = self.find(parts[row[has], i[has]], parts[row[has], i[has] + 1])
            has = i > 0
            ranks[row[has], i[has] - 1] = self.find(parts[row[has], i[has] - 1], parts[row[has], i[has]])

    def _merge_long(self, word: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue  # one of the two parts has changed since
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (s := find(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (s, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed as little-endian unsigned 32-bit integers."""
        spans: list[list[str | bytes]] = []
        for text in texts:
            parts, at = [], 0
            for m in self.split_added.finditer(text) if self.split_added else ():
                parts += [text[at : m.start()], struct.pack("<I", self.added[m[0]])]
                at = m.end()
            spans.append([*parts, text[at:]])
        chunks = [[self._chunks(x) if isinstance(x, str) else x for x in parts] for parts in spans]
        table = self._learn({c for parts in chunks for x in parts if isinstance(x, list) for c in x})
        return [b"".join(b"".join(map(table.__getitem__, x)) if isinstance(x, list) else x for x in parts) for parts in chunks]

    def _chunks(self, text: str) -> list[str]:
        """What can be encoded on its own. A pre-token never crosses a lone space, so these are the pieces between
        lone spaces, each with its space; where more white space touches a space, they are the pre-tokens."""
        first, *rest = text.split(" ")
        if "" in rest or self.loose.search(text):
            return self.words.findall(text)
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """chunk -> packed ids, for these chunks. What is known is kept in two generations of bounded size."""
        known, older, table, new = self.known, self.older, {}, []
        for c in chunks:
            x = known.get(c)
            if x is None:
                x = older.get(c)
                if x is None:
                    new.append(c)
                    continue
                known[c] = x
            table[c] = x
        split = [(c,) if c[1:].isalpha() and c[0] == " " else (c[:-1], c[-1]) if c[0] == " " and c[-1] in ",.;:!?" and c[1:-1].isalpha() else self.words.findall(c) for c in new]
        tokens = list({t for ts in split for t in ts})
        ids = dict(zip(tokens, self.merge([t.encode() for t in tokens])))
        for c, ts in zip(new, split):
            table[c] = known[c] = ids[ts[0]] if len(ts) == 1 else b"".join(map(ids.__getitem__, ts))
        if len(known) > KNOWN:
            self.known, self.older = {}, known
        return table

    def decode(self, packed: bytes) -> str:
        ids = array("I", packed)
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: (id, n_tokens, ids_sha256, decoded_sha256), and with ids=True also
    token_ids array<int> and decoded. The vocabulary file is read once on the driver and broadcast; its size is fixed."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    @task
    def run(batches):
        c = Codec(raw.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                packed = c.encode([x or "" for x in part.column(1).to_pylist()])
                texts = [c.decode(x) for x in packed]
                out = [
                    part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in texts], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out += [pa.array([list(array("I", x)) for x in packed], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
