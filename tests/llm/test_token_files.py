"""Token files: encoder against the library, codes against the ids, files against failures."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "don't, it's (we'll) I'M", "a<|endoftext|>b", "x́, ́ .̸ ≮a ≯", "é, ñ. ß! …. .… ,“a”,", "ΑΣ ΣΑΣ, İI", "a b c\x0bd\x1ce\x85f",
    "12,3 a1.b2 _x_ 中文,字。 🙂!🙂", "", ",", "  \n", "'s 't'", "word'.", "word.'s word.'", "<|start of|>", "xﬁ. K. ſ. ſ", "K, Å.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return tf.LibraryEncoder(PATH)


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_as_the_library(encoder, library):
    assert encoder.by_runs
    assert [e.tolist() for e in encoder.encode([t.encode() for t in ODD])] == [plain(library, t) for t in ODD]
    small = tf.LibraryEncoder(PATH, limit=3)
    for t in ODD * 2:
        assert small.encode([t.encode()])[0].tolist() == plain(library, t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB'.,<|>!19 \t\ń̸é…ΣİßK中🙂 ", max_size=30))
def test_runs_as_the_library(text):
    own, lib = test_runs_as_the_library.pair
    assert own.encode([text.encode()])[0].tolist() == plain(lib, text)


test_runs_as_the_library.pair = (tf.LibraryEncoder(PATH), Tokenizer.from_file(PATH))


def test_runs_are_learnt_in_parts_and_forgotten_but_for_the_frequent(library, monkeypatch):
    monkeypatch.setattr(tf, "LEARNT", 7)
    own = tf.LibraryEncoder(PATH, limit=60)
    asked, batch = [], own.library.encode_batch_fast

    class Watched:
        model = own.library.model

        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return batch(texts, **options)

    own.library = Watched()
    rng = random.Random(5)
    for _ in range(60):
        texts = ["the é a1 " + " ".join("".join(rng.choices("abcé,;", k=5)) for _ in range(20)) for _ in range(2)]
        assert [e.tolist() for e in own.encode([t.encode() for t in texts])] == [plain(library, t) for t in texts]
        assert len(own.codes) <= 60 + 2 * 40
    assert max(asked) <= 7
    assert {b"the", "é".encode()} <= set(own.codes)  # met in every call, so never forgotten


def stored(doc_ids, documents):
    sink = pa.BufferOutputStream()
    tf.write_file(sink, doc_ids, [np.array(d, np.uint32) for d in documents])
    return sink.getvalue()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=700), max_size=5))
def test_every_token_and_range(documents):
    file = tf.TokenFile(pa.BufferReader(stored(list(range(len(documents))), documents)))
    flat = [i for d in documents for i in d]
    assert file.tokens(0, len(flat)).tolist() == flat
    rng = random.Random(len(flat))
    for i in rng.sample(range(len(flat)), min(12, len(flat))):
        assert file.token(i) == flat[i]
        j = rng.randint(i, len(flat))
        assert file.tokens(i, j).tolist() == flat[i:j]
    with pytest.raises(IndexError):
        file.token(len(flat))
    file.check()


class Counting:
    """A source that counts the bytes read."""

    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


def test_one_token_reads_a_few_bytes():
    ids = np.random.default_rng(1).integers(0, 2**32, 500_000, dtype=np.uint64).astype(np.uint32)
    file = tf.TokenFile(Counting(stored([1], [ids]).to_pybytes()))
    for i in (0, 511, 512, 499_999, 123_456):
        file.source.read = 0
        assert file.token(i) == ids[i]
        assert file.source.read <= 4 * (1 + 1 + 8 + 64)


def test_torn_and_damaged_files():
    raw = stored([1, None], [[1, 2, 70_000], [5]]).to_pybytes()
    for cut in (0, 5, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError):
            tf.TokenFile(pa.BufferReader(raw[:cut]))
    broken = bytearray(raw)
    broken[30] ^= 1
    with pytest.raises(ValueError):
        tf.TokenFile(pa.BufferReader(bytes(broken))).check()


def by_hand(library, docs):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*plain(library, text), 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = tf.op12_token_files(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == by_hand(library, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_files_and_places(spark, library, tmp_path):
    docs = [(i if i % 5 else 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again " * 20_000), (-7, "x" * 100_000), (40, "same"), (40, "same")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, ids int, start int")
    path = str(tmp_path / "tokens")
    tf.write_tokens(tf.encoded(df.repartition(3)), path, file_tokens=20)
    assert len(tf.file_list(path)) > 3
    # Rows that repeat an id may stand in any order here; the ids and the places they fill are the same.
    rows = tf.digests(tf.read_tokens(spark, path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(d), n, c) for d, _, n, c in by_hand(library, docs))
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted([d[0] for d in docs], key=lambda d: (d is not None, d or 0))
    flat = [i for r in tf.read_tokens(spark, path).orderBy("start").collect() for i in r.ids]
    places = [0, 5, len(flat) - 1, len(flat), -1, None, *range(0, len(flat), 997)]
    got = tf.tokens_at(spark.createDataFrame([(p, "t") for p in places], "position long, token_id string"), path).collect()
    assert [r[2] for r in got] == [flat[p] if p is not None and 0 <= p < len(flat) else None for p in places]


def test_rewriting_replaces_and_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    one = spark.createDataFrame([(1, [5, 6]), (2, None)], "doc_id long, ids array<long>")
    tf.write_tokens(one, path)
    stray = os.path.join(path, "part-000000-000000-lost.dac")
    open(stray, "wb").write(b"torn")
    assert tf.read_tokens(spark, path).count() == 2  # a lost attempt's file is on no list
    tf.write_tokens(one.where("doc_id = 1"), path)
    assert [tuple(r) for r in tf.read_tokens(spark, path).collect()] == [(1, 0, [5, 6])]
    assert not os.path.exists(stray) and len([f for f in os.listdir(path) if f.endswith(".dac")]) == 1
    with pytest.raises(Exception, match="overwrite"):
        one.write.format(tf.FORMAT).mode("append").save(path)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_tokens(tf.encoded(docs), str(tmp_path / "none"))
    assert tf.digests(tf.read_tokens(spark, str(tmp_path / "none"))).count() == 0
    assert tf.tokens_at(spark.createDataFrame([(0,)], "position long"), str(tmp_path / "none")).first()[1] is None
