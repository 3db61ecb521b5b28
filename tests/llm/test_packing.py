import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llmdata import awkward, rows, spark_docs
from tokenizers import Tokenizer

from emberscope.llm import packing
from emberscope.llm.kernels import bytes_of

ODD = [
    "a  b", " lead", "trail ", "x  y", "x  y", "é ñ", "日本 語 ", "tab\t x", "it's  we'll 've", "a\n b \n\nc", "<|endoftext|> mid <|endoftext|>",
    "1 2 33", "  q", "q  ", "z \x1f y", "\x85 x", "end<|endoftext|>", "“q” ‘r’ —s", "a 's b 'll", "mixed é\u0085 ü",
]


def whole():
    return Tokenizer.from_file(packing.TOKENIZER)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_tokenizers():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\t'aéñ日1.,!’   stdl ") for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, counts = packing.encoder(packing.RANKS, packing.TOKENIZER).encode(bytes_of(pa.array(texts)))
    ends = np.cumsum(counts)
    tokenizer = whole()
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kept", [1, 3, 50])
def test_encoder_forgets_parts_without_losing_any(monkeypatch, kept):
    monkeypatch.setattr(packing, "_CACHED", kept)
    encoder, tokenizer, rng = packing.Encoder(packing.RANKS, packing.TOKENIZER), whole(), random.Random(5)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "cat", "naïve", "x.", "日本", f"n{rng.randrange(99)}", "\n"]) for _ in range(rng.randrange(40))) for _ in range(4)]
        ids, counts = encoder.encode(bytes_of(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_sequences_follow_the_curve(spark):
    rng = random.Random(8)
    themes = [[f"{c}{i}" for i in range(30)] for c in ("alpha", "beta ", "x", "日")]
    texts = [" ".join(rng.choices(themes[i % 4], k=rng.randrange(20, 900))) for i in range(160)]
    encoder = packing.encoder(packing.RANKS, packing.TOKENIZER)
    keys = []
    for t in texts:
        ids = np.append(encoder.encode(bytes_of(pa.array([t])))[0], 0)
        keys.append(int(packing._keys(ids, np.array([len(ids)]), encoder.size)[0]))
    pieces = packing.packed(spark_docs(spark, rows(texts)).repartition(5)).collect()
    along = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))]
    assert [keys[d] for d in along] == sorted(keys[d] for d in along)
    alike = sum(a % 4 == b % 4 for a, b in zip(along, along[1:])) / (len(along) - 1)
    assert alike > 0.8  # a quarter would be chance


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_pieces(pieces, texts, first=0):
    tokenizer = whole()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == {first + i for i in range(len(texts))}
    for i, text in enumerate(texts):
        ids, at = ids_of(tokenizer, text), 0
        for p in sorted(by_doc[first + i], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_pieces_hold_every_id_once_without_padding(spark):
    texts = [*awkward(), *ODD]
    assert check_pieces(packing.packed(spark_docs(spark, rows(texts)).repartition(4)).collect(), texts) == 0


def test_empty_table_and_repeated_rows(spark):
    assert packing.packed(spark_docs(spark, [])).count() == 0
    got = packing.packed(spark_docs(spark, rows(["a b"]) * 3)).collect()
    assert len(got) >= 3 and sum(p["length"] for p in got) == 3 * got[0]["doc_tokens"]
