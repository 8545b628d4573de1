"""Batched Viterbi against the library, and exact round trips."""

import os
import random
import struct

import pytest
import sentencepiece

from sitelens.llm.sentencepiece_viterbi import DEFAULT_MODEL, decode, encode, encode_checked

TEXTS = ["Hello  world\nfoo\tbar ▁x 　é 😀", "", " ", "  lead", "a", "a" * 60, " " * 100, "日本語のテキスト ゼ梦벨",
         "\x00\x01 <s> <0x0A> </s>", "ababab" * 30, "x\r\ny", "the the the", "ñandú schöße"]


def texts(seed):
    rnd = random.Random(seed)
    return TEXTS + ["".join(rnd.choice("abcdefghijklmnoprstuvw      etheé öß.,|0123456789\n▁") for _ in range(rnd.randrange(300)))
                    for _ in range(200)]


def unigram_model(path):
    """The public pieces with scores of a unigram model: the model type and scores rewritten."""
    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    def field(n, payload):
        return varint(n << 3 | 2) + varint(len(payload)) + payload

    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    rnd, out = random.Random(1), b""
    for i in range(sp.get_piece_size()):
        kind = 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 6 if sp.is_byte(i) else 1
        p = sp.id_to_piece(i)
        out += field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", 0.0 if kind != 1 else -6 - rnd.random() * 6 - 0.1 * len(p))
                     + b"\x18" + bytes([kind]))
    out += field(2, b"\x18\x01" + varint(35 << 3) + b"\x01")
    out += field(3, field(1, b"identity") + b"\x18\x01\x20\x00")
    with open(path, "wb") as f:
        f.write(out)
    return path


@pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="needs the public model file")
@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_equal_the_library(spark, tmp_dir, kind):
    model = DEFAULT_MODEL if kind == "bpe" else unigram_model(os.path.join(tmp_dir, "u.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = list(enumerate(texts(3)))
    df = spark.createDataFrame([(i, t, None) for i, t in rows] + [(None, "null id", 1), (9999, None, 2)],
                               "doc_id long, text string, ids int").repartition(3)
    got = encode(df, model=model)
    by_id = {r.doc_id: r.ids for r in got.collect()}
    assert by_id.pop(9999) == [] and by_id.pop(None) == sp.encode("null id")
    if kind == "bpe":
        assert by_id == {i: sp.encode(t) for i, t in rows}
    else:   # ties between segmentations of equal score may be broken either way: scores are equal
        score = [sp.get_score(i) for i in range(sp.get_piece_size())]
        known = [(i, t) for i, t in rows if 0 not in by_id[i] and not any(sp.is_byte(x) for x in by_id[i])]
        assert len(known) > 20
        for i, t in known:
            assert abs(sum(score[x] for x in by_id[i]) - sum(score[x] for x in sp.encode(t))) < 1e-3, t
    back = {r.doc_id: r.text for r in decode(got, model=model).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in rows)


@pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="needs the public model file")
def test_round_trip_column_and_empty_table(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = encode_checked(df).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert encode_checked(df.limit(0)).count() == 0
