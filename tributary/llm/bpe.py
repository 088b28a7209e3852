"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer file.

A piece of text is a doubly linked list of symbols.  A priority queue holds
(rank, position) of every adjacent pair that has a merge; the lowest rank at
the leftmost place is merged first, its neighbours' pairs are queued, and
entries whose symbols have changed since are skipped as stale.  Decoding
concatenates vocabulary strings.

Each Python worker loads the vocabulary once and keeps a bounded cache of
pieces; the file's path is a parameter and must be readable on executors.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

CACHE_PIECES = 300_000
#: White space of the Unicode property, as the tokenizer's normaliser folds it.
_SPACE = r"\t-\r \u0085   -     　"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself where printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Encoder and decoder of one tokenizer file (byte-level BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split.replace(r"\s", _SPACE), regex.V0)
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.marked = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.final = [self.ids[s + self.suffix] for s in symbols]
        self.fresh: dict[str, tuple[list[int], str]] = {}
        self.aged: dict[str, tuple[list[int], str]] = {}

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece."""
        raw = piece.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        # The suffix goes on the last character's last byte symbol.
        symbols[-1] = self.final[raw[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = self.merges
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, whole = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get((symbols[i], symbols[j]))
            if found is None or found[0] != rank:
                continue
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((whole, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], whole))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def coded(self, piece: str) -> tuple[list[int], str]:
        """Ids of one piece, and the same in decimal, space-joined."""
        known = self.fresh.get(piece)
        if known is None:
            known = self.aged.get(piece)
            if known is None:
                ids = self.merge(piece)
                known = (ids, " ".join(map(str, ids)))
            if len(piece) <= 64:
                if len(self.fresh) >= CACHE_PIECES // 2:
                    self.aged, self.fresh = self.fresh, {}
                self.fresh[piece] = known
        return known

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased character by character, so never to the final form
                text = text.replace("Σ", "σ")
        return self.spaces.sub(" ", text).lower()

    def coded_pieces(self, text: str | None) -> list[tuple[list[int], str]]:
        """One entry for each piece of a whole text; special tokens stand for themselves."""
        text = text or ""
        out: list[tuple[list[int], str]] = []
        parts = self.marked.split(text) if any(s in text for s in self.special) else [text]
        coded = self.coded
        for part in parts:
            if part in self.special:
                out.append(([self.special[part]], str(self.special[part])))
            elif part:
                out += [coded(p) for p in self.piece.findall(self.normalised(part))]
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable([c[0] for c in self.coded_pieces(text)]))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, space-joined as the file names no decoder; unknown ids are skipped."""
        strings = self.strings
        try:
            return " ".join([strings[i] for i in ids])
        except KeyError:
            return " ".join([strings[i] for i in ids if i in strings])


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row.

    Null texts encode as empty texts do: no tokens, digests of the empty
    string.  Repeated rows stay repeated; other columns are not read.
    """
    path = path or default_vocabulary()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                counts, ids, decoded, lists = [], [], [], []
                for text in part.column(1).to_pylist():
                    coded = own.coded_pieces(text)
                    found = list(chain.from_iterable([c[0] for c in coded]))
                    counts.append(len(found))
                    ids.append(_digest(" ".join([c[1] for c in coded])))
                    decoded.append(_digest(own.decode(found)))
                    if with_ids:
                        lists.append(np.array(found, np.int32))
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from rows with doc_id and ids; null ids decode to the empty text."""
    path = path or default_vocabulary()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs)
