"""Encoding by distinct stretches, and the token files, against whole-text encoding."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from hypothesis import example, given, settings
from hypothesis import strategies as st

from ledgerlens.llm import tokenfile, tokens

ALPHABET = list("ab Z09.,'-|$%\n\t\r  éüßñ") + ["'s", " 't", " ", " ", "́", "　", "中", "😀", "\x1c", "\x85",
                                                "<|endoftext|>", "×", "÷", "=\u0338", ".", "!", "'", "s", "Σ", "İ", "​", "ſ", "K", "\x00", " "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@example(texts=["İ|", "a×.", "é.b", "x=\u0338", "don't.'s"])
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), st.text(max_size=30)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_stretches_give_the_ids_of_whole_texts(name, texts):
    path = public_tokenizers.path(name)
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = tokens.encode(pa.array(texts, pa.string()), path, 5)
    tokenizer = tokens.load(path)
    for i, t in enumerate(texts):
        assert got.row(i).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [5]


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_files_round_trip_and_open_only_asked_frames():
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 49_000, n).astype(np.uint32)) for i, n in
            enumerate([0, 5, 70_000, 1, 65_535, 65_536, 300_000, *rng.integers(1, 3000, 200)])]
    sink = io.BytesIO()
    writer = tokenfile.Writer(sink, 2)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    reader = tokenfile.Reader(_Source(sink.getvalue()))
    for n in (150, 3, 6, 0):
        assert reader.document(n).tolist() == docs[n][1].tolist()
    assert reader.decompressed < len(reader.checks)
    assert not reader.known[0] and reader.ids[1:].tolist() == [d for d, _ in docs[1:]]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == np.concatenate([d for _, d in docs]).tolist()


def test_damage_is_noticed():
    sink = io.BytesIO()
    writer = tokenfile.Writer(sink, 4)
    writer.add(1, np.arange(1000, dtype=np.uint32))
    writer.close()
    raw = bytearray(sink.getvalue())
    raw[len(raw) - 10] ^= 1  # the checksum of the last frame in the seek table
    with pytest.raises(ValueError):
        tokenfile.Reader(_Source(bytes(raw))).document(0)


def test_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 4000)
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    rows = [(1000 - i, " ".join(rng.choice(["The", "quick", "übrigens", "x1."]) for _ in range(rng.randrange(60))), "a", 1) for i in range(150)]
    rows += [(5000, None, None, 1), (5001, "", None, 1), (5001, "twice", None, 1), (None, "no id", None, 1), (5002, "long " * 5000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, tokens int").repartition(3)
    manifest = tokenfile.write_token_files(df, path, 1)
    assert manifest.count() > 1
    got = tokenfile.read_token_files(manifest).collect()
    tokenizer = tokens.load(path)
    expected = sorted(((d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")) for d, t, *_ in rows),
                      key=lambda x: (x[0] is not None, x[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in expected]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(ids.tobytes()) for _, ids in expected)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    asked = spark.createDataFrame([(900,), (5002,), (-1,)], "doc_id long")
    found = {r.doc_id: r.ids for r in tokenfile.fetch(spark, manifest, asked).collect()}
    whole = dict(expected)
    assert set(found) == {900, 5002} and all(found[d] == whole[d].tolist() for d in found)
    assert tokenfile.read_token_files(tokenfile.write_token_files(df.limit(0), path, 1)).count() == 0
