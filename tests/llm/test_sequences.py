"""Round trips of token files and the equality of cached and plain encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plinth.llm import sequences as S
from plinth.llm.queries import byte_bpe

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\nb c", "\n", "don't can't 'll x", "x y z", "x   y", "tab\t x y", "a　b c",
    "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b", "é ü 日本 語 🙂 🙂x", "12 345 x1y2", "á b", "... --- !!", "word " * 5000 + "end", "\x00 \x1c x", "naïve Ærø, Ÿp! (x) don't, Straße. œuvre;: A.b x×y", "a \x1c b", "a\x85 b",
]


def plain(texts):
    tokenizer = Tokenizer.from_file(byte_bpe())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_cached_pieces_equal_whole_texts(monkeypatch):
    rng = random.Random(1)
    letters = ["a", "b", "é", " ", " ", " ", "\n", "\t", " ", "1", "!", "'", "s", "日", " "]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(3000)]
    for remembered in (S.REMEMBERED, 10):
        monkeypatch.setattr(S, "REMEMBERED", remembered)
        encoder = S.Encoder(byte_bpe())
        assert encoder.cuts and encoder.dtype == np.uint16
        for first in range(0, len(texts), 50):
            some = texts[first : first + 50]
            for text, found, want in zip(some, encoder.batch(some), plain(some), strict=True):
                assert np.frombuffer(found, np.uint16).tolist() + [0] == want, repr(text)


@pytest.mark.parametrize("length", [7, S.SEQUENCE])
def test_documents_round_trip(spark, tmp_path, length):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD)] + [(7000, "twice"), (7000, "twice"), (None, "no id")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    manifest = S.write_sequences(frame, str(tmp_path / "out"), byte_bpe, length)
    got = [tuple(r) for r in S.read_documents(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for (doc_id, _), ids in zip(ordered, plain([t for _, t in ordered])):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_random_access_is_zero_copy(spark, tmp_path):
    texts = [(i, f"text number {i} " * 40) for i in range(200)]
    manifest = S.write_sequences(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), str(tmp_path / "out"), byte_bpe, 16)
    flat = [i for ids in plain([t for _, t in texts]) for i in ids]
    at = 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        file = S.Sequences(row.ids_path)
        assert len(file) == -(-row.n_tokens // 16)
        own = flat[at : at + row.n_tokens]
        for i in (0, len(file) // 2, len(file) - 1):
            ids, mask = file[i]
            valid = sum(mask.to_pylist())
            assert ids[:valid].tolist() == own[i * 16 : i * 16 + 16] and not ids.flags.owndata
        at += row.n_tokens
    assert at == len(flat)
    assert pa.types.is_fixed_size_list(file.batches[0].schema.field("mask").type)


def test_empty_table(spark, tmp_path):
    manifest = S.write_sequences(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"), byte_bpe)
    assert S.read_documents(manifest).count() == 0
