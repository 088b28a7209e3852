"""Token ids in files of directly addressable codes, as a Spark data source.

An id is split into chunks of eight bits, lowest first.  Level 0 holds the first
chunk of every token, level k the k-th chunk of those tokens that have one.  A
bitmap at each level marks the tokens that continue, and a directory holds the
number of marks before every 512th token, so the place of a token at the next
level is one directory entry plus a count within 64 bytes.  Any token is read
by a few small reads; nothing before it is decoded.

A data set is a folder of such files and a list of them in order
(``_files.json``).  Writing tasks use names of their own and the list is written
once all have ended: files of lost or repeated attempts are on no list, are
never read and go with the next write.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .bpe import default_vocabulary
from .common import pieces, shared_folder, text_bytes, unused

FORMAT = "token_codes"
MAGIC = b"TRIBDAC1"
#: Tokens between two entries of a rank directory.
STRIDE = 512
#: A file is closed at the first document's end beyond this number of tokens.
FILE_TOKENS = 1 << 23
#: Tokens decoded at a time when documents are read (one document at least).
READ_TOKENS = 1 << 20
LIST = "_files.json"


# One file -------------------------------------------------------------------


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level for unsigned 32-bit ids."""
    rest, out = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STRIDE // 8), np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, STRIDE // 8).sum(1, dtype=np.uint64)
        out.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])))
        if not more.any():
            return out
        rest = rest[more] >> 8


def write_file(sink, doc_ids: list[int | None], documents: list[np.ndarray]) -> dict:
    """Write one file to a binary sink; returns what the list of files says of it."""
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64) if documents else np.zeros(0, np.uint64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    at = sink.write(MAGIC)

    def section(values: np.ndarray) -> list[int]:
        nonlocal at
        raw = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes()
        sink.write(raw)
        at += len(raw)
        return [at - len(raw), len(raw), zlib.crc32(raw)]

    footer = {
        "n_tokens": len(ids),
        "n_docs": len(doc_ids),
        "doc_ids": section(np.array([i or 0 for i in doc_ids], np.int64)),
        "nulls": section(np.array([i is None for i in doc_ids], np.uint8)),
        "ends": section(ends),
        "levels": [{"n": len(c), "chunks": section(c), "bitmap": section(b), "directory": section(d)} for c, b, d in levels_of(ids)],
    }
    raw = json.dumps(footer).encode()
    sink.write(raw + struct.pack("<I", len(raw)) + MAGIC)
    return {"n_docs": len(doc_ids), "n_tokens": len(ids), "bytes": at + len(raw) + 12}


class TokenFile:
    """Reader of one file: single tokens by small reads, ranges by their part of each level."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(12, size - 12) if size >= 20 else b""
        if tail[4:] != MAGIC:
            raise ValueError("not a complete file of token codes")
        length = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(source.read_at(length, size - 12 - length))
        self.n_tokens, self.n_docs, self.levels = self.footer["n_tokens"], self.footer["n_docs"], self.footer["levels"]

    def _part(self, section: list[int], start: int, stop: int, kind) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at((stop - start) * size, section[0] + start * size), kind)

    def check(self) -> None:
        """Read every section and compare its checksum."""
        sections = [self.footer[k] for k in ("doc_ids", "nulls", "ends")] + [level[k] for level in self.levels for k in ("chunks", "bitmap", "directory")]
        if any(zlib.crc32(self.source.read_at(n, at)) != crc for at, n, crc in sections):
            raise ValueError("a section of token codes is damaged")

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, null marks and first tokens (with the end of the last) of the documents."""
        n = self.n_docs
        ends = self._part(self.footer["ends"], 0, n, "<u8").astype(np.int64)
        return self._part(self.footer["doc_ids"], 0, n, "<i8"), self._part(self.footer["nulls"], 0, n, np.uint8) > 0, np.concatenate([np.zeros(1, np.int64), ends])

    def rank(self, level: dict, i: int) -> int:
        """Continuing tokens before the i-th of a level."""
        entry, inner = divmod(i, STRIDE)
        before = int(self._part(level["directory"], entry, entry + 1, "<u8")[0])
        if not inner:
            return before
        block = np.unpackbits(self._part(level["bitmap"], entry * STRIDE // 8, entry * STRIDE // 8 + (inner + 7) // 8, np.uint8), count=inner, bitorder="little")
        return before + int(block.sum())

    def token(self, i: int) -> int:
        """The i-th id, read from its own chunks alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(self._part(level["chunks"], i, i + 1, np.uint8)[0]) << (8 * k)
            if not self._part(level["bitmap"], i // 8, i // 8 + 1, np.uint8)[0] >> (i % 8) & 1:
                return value
            i = self.rank(level, i)
        raise ValueError("a token continues beyond the last level")

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range; of each level only the range's own part is read."""
        out = np.zeros(max(0, stop - start), np.uint32)
        places, a, b = np.arange(len(out)), start, stop
        for k, level in enumerate(self.levels):
            if a == b:
                break
            out[places] |= self._part(level["chunks"], a, b, np.uint8).astype(np.uint32) << np.uint32(8 * k)
            first = a // 8
            bits = np.unpackbits(self._part(level["bitmap"], first, (b + 7) // 8, np.uint8), bitorder="little")[a - 8 * first : b - 8 * first]
            places = places[bits > 0]
            a = self.rank(level, a)
            b = a + len(places)
        return out


# The data source ------------------------------------------------------------


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; ``scheme:/x`` and plain paths are taken as Spark takes them."""
    if re.match(r"file:/[^/]", path):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def file_list(path: str) -> list[dict]:
    """Files of a data set in order, each with the tokens of all files before it (``base``)."""
    store, folder = _place(path)
    with store.open_input_file(f"{folder}/{LIST}") as f:
        return json.loads(f.read())


def open_file(path: str, name: str) -> TokenFile:
    store, folder = _place(path)
    return TokenFile(store.open_input_file(f"{folder}/{name}"))


@dataclass
class _Written(WriterCommitMessage):
    files: list


@dataclass
class _OneFile(InputPartition):
    name: str
    base: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_tokens: int, overwrite: bool):
        self.path, self.file_tokens, self.overwrite = path, file_tokens, overwrite
        store, folder = _place(path)
        if not overwrite and store.get_file_info(f"{folder}/{LIST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} holds a data set; only mode('overwrite') replaces it")
        store.create_dir(folder, recursive=True)

    def write(self, iterator):
        store, folder = _place(self.path)
        part, files, ids, documents, held = TaskContext.get().partitionId(), [], [], [], 0

        def close():
            nonlocal held
            name = f"part-{part:06d}-{len(files):06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{folder}/{name}") as sink:
                files.append({"part": part, "name": name, **write_file(sink, ids, documents)})
            ids.clear()
            documents.clear()
            held = 0

        for batch in iterator:
            lists = batch.column(batch.schema.get_field_index("ids"))
            lists = lists.fill_null([]) if lists.null_count else lists
            bounds = np.asarray(lists.offsets)
            # Ids of 32 bits are taken as they stand, without copies of the whole batch.
            short = lists.type.value_type in (pa.int32(), pa.uint32()) and not lists.values.null_count
            values = np.asarray(lists.values).view(np.uint32) if short else np.asarray(lists.values.cast(pa.int64())).astype(np.uint32)
            for row, doc_id in enumerate(batch.column(batch.schema.get_field_index("doc_id")).to_pylist()):
                ids.append(doc_id)
                documents.append(values[bounds[row] : bounds[row + 1]].copy())
                held += len(documents[-1])
                if held >= self.file_tokens:
                    close()
        if ids:
            close()
        return _Written(files)

    def commit(self, messages):
        store, folder = _place(self.path)
        files, base = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"]), 0
        for f in files:
            f["base"] = base
            base += f["n_tokens"]
        with store.open_output_stream(f"{folder}/{LIST}.new") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{folder}/{LIST}.new", f"{folder}/{LIST}")
        self._sweep({f["name"] for f in files})

    def abort(self, messages):
        store, folder = _place(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{f['name']}")

    def _sweep(self, keep: set[str]) -> None:
        store, folder = _place(self.path)
        for info in store.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.endswith(".dac") and info.base_name not in keep:
                store.delete_file(info.path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_OneFile(f["name"], f["base"]) for f in file_list(self.path)] or [_OneFile("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        file = open_file(self.path, partition.name)
        ids, nulls, first = file.documents()
        row = 0
        while row < file.n_docs:
            stop = min(file.n_docs, max(row + 1, int(np.searchsorted(first, first[row] + READ_TOKENS, side="right")) - 1), row + 8192)
            values = file.tokens(int(first[row]), int(first[stop]))
            lists = pa.ListArray.from_arrays(pa.array((first[row : stop + 1] - first[row]).astype(np.int32)), pa.array(values.astype(np.int64)))
            columns = [pa.array(ids[row:stop], mask=nulls[row:stop]), pa.array(first[row:stop] + partition.base), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])
            row = stop


class TokenCodes(DataSource):
    """``spark.read.format("token_codes").load(path)`` gives (doc_id, start, ids); writing takes (doc_id, ids).

    ``start`` counts the ids of all documents before, in the order of the
    rows as they were written (partition by partition).  Null id lists are
    empty; ids are unsigned 32-bit numbers.  Option ``file_tokens``: size at
    which a file is closed.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "doc_id long, start long, ids array<long>"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("file_tokens", FILE_TOKENS)), overwrite)


# Encoding -------------------------------------------------------------------

#: Most runs that the library is asked for at once.
LEARNT = 4096
#: A-Z lower-cased and line breaks and tabs as spaces: nothing else that the library folds is touched.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 13) else b for b in range(256)], np.uint8)
#: Kind of a folded byte: 1 a-z, 2 digit, 3 ASCII mark but the apostrophe (which may belong to the word beside it), 0 anything else.
_KIND = np.array([1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if 33 <= b < 127 and b != 39 and not chr(b).isalnum() else 0 for b in range(256)], np.uint8)
#: Whether bytes of two kinds side by side (4 x left + right) are sure to be in different pieces: letter and mark, or a digit and any of the three.
_APART = np.array([bool(a and b and (2 in (a, b) or a != b)) for a in range(4) for b in range(4)])


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes end to end, folded, with a space between ASCII bytes of different pieces; and the rows' offsets in them."""
    data = _FOLD[data]
    kind = _KIND[data]
    at = np.flatnonzero(_APART[(kind[:-1] << 2) | kind[1:]]) + 1
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets, side="left")


class _Codes(dict):
    """Numbers of white-space free runs; new ones are listed in ``fresh``."""

    def __init__(self, known=()):
        super().__init__(known)
        self.fresh = []

    def __missing__(self, run: bytes) -> int:
        self[run] = code = len(self)
        self.fresh.append(run)
        return code


class LibraryEncoder:
    """Ids of whole texts from the tokenizers library, which sees each run of ``parted`` once.

    Exact for files whose pipeline folds and drops white space, lower-cases, and
    whose pieces are single digits and runs of letters or of marks; for others
    whole texts go to the library, as do texts with a special token.  Beyond
    ``limit`` runs those met in one call alone are forgotten, and half at least.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        folds = any(n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in steps) and any(n["type"] == "Lowercase" for n in steps)
        parted = len(splits) == 1 and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and splits[0]["pattern"]["Regex"].endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        self.by_runs = bool(folds and parted and plain)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.limit = limit
        self.codes, self.used = _Codes(), 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.flat = np.zeros(1 << 18, np.uint32)

    def _forget(self) -> None:
        """Keep the runs met in several calls, those met most where they are many."""
        n, most = len(self.codes), self.limit // 2
        kept = np.flatnonzero(self.met[:n] > 1)
        kept = kept[self.sizes[kept] <= 16]
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[:most]])
        runs, sizes = list(self.codes), self.sizes[kept]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        self.codes = _Codes((runs[k], code) for code, k in enumerate(kept.tolist()))
        self.used = int(sizes.sum())
        flat = self.flat[np.repeat(self.starts[kept] - starts, sizes) + np.arange(self.used)]
        met = self.met[kept] // 2
        self.starts, self.sizes, self.met = (np.zeros(max(1 << 16, len(kept)), np.int32) for _ in range(3))
        self.flat = np.zeros(max(1 << 18, self.used), np.uint32)
        self.starts[: len(kept)], self.sizes[: len(kept)], self.met[: len(kept)], self.flat[: self.used] = starts, sizes, met, flat

    def _learn(self) -> None:
        """Ids of the fresh runs."""
        fresh, first = self.codes.fresh, len(self.codes) - len(self.codes.fresh)
        if not fresh:
            return
        for at in range(0, len(fresh), LEARNT):
            self._note(fresh[at : at + LEARNT], first + at)
        fresh.clear()

    def _note(self, runs: list[bytes], first: int) -> None:
        """Ids of some runs, numbered from ``first``: few at a time, as the library's answers are large."""
        # A word of a to z is one piece as it stands, so it needs the model alone.
        tokenize = self.library.model.tokenize
        ids = [[t.id for t in tokenize(run.decode())] if run.isalpha() else None for run in runs]
        rest = [k for k, found in enumerate(ids) if found is None]
        for k, found in zip(rest, self.library.encode_batch_fast([runs[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)):
            ids[k] = found.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while first + len(ids) > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.met))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[first : first + len(ids)] = sizes
        self.starts[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text as unsigned 32-bit numbers."""
        return self.encode_bytes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of UTF-8 bytes end to end."""
        if len(self.codes) > self.limit or self.used > 16 * self.limit:
            self._forget()
        out: list = [None] * (len(offsets) - 1)
        whole = range(0)
        if not self.by_runs:
            whole = range(len(out))
        elif any(s in data.tobytes() for s in self.special):
            whole = [r for r in range(len(out)) if any(s in data[offsets[r] : offsets[r + 1]].tobytes() for s in self.special)]
        folded, bounds = parted(data, offsets)
        # Distinct runs are found by the columns' own kernels; only those are looked up one by one.
        texts = pa.Array.from_buffers(pa.large_binary(), len(out), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(folded)])
        split = pc.split_pattern(texts, b" ")
        runs = split.values.dictionary_encode()
        raw, places = text_bytes(runs.dictionary)
        raw, places = raw.tobytes(), places.tolist()
        codes = np.fromiter(map(self.codes.__getitem__, [raw[a:b] for a, b in zip(places, places[1:])]), np.int64, len(runs.dictionary))
        self._learn()
        self.met[codes] += 1
        at, ends = codes[np.asarray(runs.indices)], np.asarray(split.offsets)
        sizes = self.sizes[at]
        places = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        flat = self.flat[np.repeat(self.starts[at] - places[:-1], sizes) + np.arange(places[-1])]
        cuts = places[ends]
        for row in range(len(out)):
            out[row] = flat[cuts[row] : cuts[row + 1]]
        for row in whole:
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            out[row] = np.array(self.library.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encoded(docs: DataFrame, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """(doc_id, ids) in ascending doc_id order, null ids first; rows that repeat an id keep the table's order.

    Null texts are empty; ``end_id`` closes every document.  Rows are dealt by
    ranges of (doc_id, place in the table), so no repeated id makes a hot range.
    """
    path = path or default_vocabulary()

    def run(batches):
        own = _encoder(path)
        close = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                data, offsets = text_bytes(part.column(1))
                found = own.encode_bytes(data, offsets)
                bounds = np.cumsum([0] + [len(f) + len(close) for f in found]).astype(np.int32)
                values = np.concatenate([x for f in found for x in (f, close)]).view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))], ["doc_id", "ids"])

    place = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place.alias("place"))
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(tokens: DataFrame, path: str, file_tokens: int = FILE_TOKENS) -> None:
    """Write (doc_id, ids) in the order of its partitions, replacing the data set at ``path``."""
    tokens.sparkSession.dataSource.register(TokenCodes)
    tokens.select("doc_id", "ids").write.format(FORMAT).mode("overwrite").option("file_tokens", file_tokens).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a data set, a task for each file."""
    spark.dataSource.register(TokenCodes)
    return spark.read.format(FORMAT).load(path)


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """The rows of ``positions`` (position long, ...) with the id at that place of the whole data set.

    Each row reads its own few bytes.  Places outside the data set, and null
    ones, give null.  The list of files goes to tasks with the function (one
    short entry for a file, not for a document).
    """
    files = [f for f in file_list(path) if f["n_tokens"]]
    bases = np.array([f["base"] for f in files] + [sum(f["n_tokens"] for f in files)], np.int64)
    (name,) = unused(positions, "token_id")

    def run(batches):
        opened = lru_cache(maxsize=16)(lambda k: open_file(path, files[k]["name"]))
        for batch in batches:
            found = []
            for position in batch.column(batch.schema.get_field_index("position")).to_pylist():
                inside = position is not None and 0 <= position < bases[-1]
                k = int(np.searchsorted(bases, position, side="right")) - 1 if inside else 0
                found.append(opened(k).token(int(position - bases[k])) if inside else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])

    return positions.mapInArrow(run, StructType([*positions.schema.fields]).add(name, "long"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            bounds = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    write_tokens(encoded(docs), path)
    return digests(read_tokens(spark, path))
