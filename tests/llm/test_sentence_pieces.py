import random
import struct

import pytest
import sentencepiece
from helpers import documents, words

from tidepool.llm import sentence_pieces as sp

ODD = ["", " ", "a", "  a  b ", "日本ẞ☃\x00é", "a" * 3000, "ab" * 2000 + "  " * 40, "\n\n\t x", "▁x", "<s> </s> <0x41>", "\U0001f600" * 9]


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("abcde teh ▁\né") for _ in range(rng.randrange(300))) for _ in range(200)]
    return ODD + made + [" ".join(words(rng, rng.randrange(500))) for _ in range(20)]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def test_ids_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = {r.doc_id: r.ids for r in sp.encode(documents(spark, rows)).collect()}
    assert [found[i] for i, _ in rows] == library().encode([t for _, t in rows])


@pytest.mark.parametrize("remembered, indexed", [(0, 50), (10, 1 << 20)])
def test_batches_share_what_they_know(monkeypatch, remembered, indexed):
    monkeypatch.setattr(sp, "REMEMBERED", remembered)
    monkeypatch.setattr(sp, "INDEXED", indexed)
    encoder, whole = sp.Encoder(sp.Model(sp.load_model(None, sp.MODEL))), library()
    for k in range(0, len(texts()), 50):
        ids, ends = encoder.encode(texts()[k : k + 50])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == whole.encode(texts()[k : k + 50])


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(999, None), (999, None)]
    found = sp.round_trip(documents(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.round_trip == ("▁" not in (rows[r.doc_id][1] if r.doc_id != 999 else "")) and r.n_ids == len(r.ids) for r in found)
    assert sp.round_trip(documents(spark, [])).collect() == []


def test_long_segments_equal_the_library():
    rng, whole = random.Random(5), library()
    made = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "ab" * 6000, "x" * 9000, "".join(rng.choices("ethé日☃", k=5000)), "a" * 257 + " " + "is" * 200]
    encoder = sp.Encoder(sp.Model(sp.load_model(None, sp.MODEL)))
    ids, ends = encoder.encode(made)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == whole.encode(made)


def test_the_vocabulary_file_is_a_setting(spark, tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(unigram([("a", -1.0), ("b", -2.0), ("▁", -3.0)]))
    spark.conf.set(sp.MODEL_SETTING, str(path))
    try:
        assert sp.round_trip(documents(spark, [(1, "ab")])).first().n_ids == 2
    finally:
        spark.conf.unset(sp.MODEL_SETTING)


def test_decoding_equals_the_library():
    encoder, whole, rng = sp.Encoder(sp.Model(sp.load_model(None, sp.MODEL))), library(), random.Random(2)
    for ids in [whole.encode(t) for t in texts()] + [[rng.randrange(259, 32000) for _ in range(50)] for _ in range(20)]:
        assert encoder.decode(ids) == whole.decode(ids)


def unigram(pieces):
    """A small unigram model file."""

    def field(number, data, kind=2):
        size = len(data)
        return bytes([number << 3 | kind]) + (bytes([size & 127 | 128, size >> 7]) if kind == 2 else b"") + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + field(2, struct.pack("<f", score), 5) + bytes([3 << 3, kind]))

    body = piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in pieces)
    return body + field(2, bytes([3 << 3, 1])) + field(3, field(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0]))


def test_best_path_of_a_unigram_model():
    rng = random.Random(3)
    pieces = {c: -rng.uniform(4, 6) for c in "abc▁"}
    for _ in range(40):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 7)))
        pieces[p] = -rng.uniform(3, 12)
    model = sp.Model(unigram(list(pieces.items())))
    encoder = sp.Encoder(model)

    def best(text):
        scores = [0.0]
        for j in range(1, len(text) + 1):
            scores.append(max(scores[i] + pieces.get(text[i:j], -1e9 if j - i > 1 else min(pieces.values()) - 10) for i in range(j)))
        return scores[-1]

    for _ in range(50):
        text = "".join(rng.choice("abcabcx ") for _ in range(rng.randrange(30)))
        ids, _ = encoder.encode([text])
        got = sum(min(pieces.values()) - 10 if i == 0 else pieces[model.pieces[i]] for i in ids)
        assert abs(got - best(text.replace(" ", "▁"))) < 1e-4
