import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm.token_counts import token_counts
from cadenza.llm import token_records as records
from cadenza.llm.token_records import frame, token_records, unframe
from tests.llm.common import table

TEXTS = [None, "", "  a  b \n\n c", "<|endoftext|>x <|endoftext|>", "é" * 50, " \x1c a\x1f\x1fb", "don't 'S 12 34", "日本語テキスト ok", "  x", "a b　C", "é É՘b", "word " * 20000, "z" * 5000]


def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null id")]


def test_counts_are_the_library_s(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    got = sorted(map(tuple, token_counts(table(spark, rows()), file).collect()), key=str)
    want = []
    for i, t in rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert token_counts(table(spark, []), file).collect() == []


def test_records_round_trip(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    got = [tuple(r) for r in token_records(table(spark, rows()), file).collect()]
    start, want = 0, []
    for i, t in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_records(table(spark, []), file).collect() == []


def test_damaged_record_is_refused():
    data = frame(b"abcdef") + frame(b"")
    payload, after = unframe(data)
    assert bytes(payload) == b"abcdef" and bytes(unframe(data, after)[0]) == b""
    for k in range(len(data)):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            _, after = unframe(bytes(broken))
            unframe(bytes(broken), after)


def test_common_words_are_kept_when_others_are_forgotten(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encoder, tok, learned = records.WordEncoder(spec), Tokenizer.from_str(spec), []
    monkeypatch.setattr(records, "REMEMBERED_BYTES", 40 * records.ENTRY)
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda known, fresh, together: (learned.extend(fresh), learn(known, fresh, together)))
    for k in range(30):
        text = f"the common words of all texts w{k}x q{k}y"
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert learned.count("common") == 1 and len(encoder.pieces) < 60
