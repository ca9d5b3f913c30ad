"""Token ids: the cut-up encoders against the libraries on whole texts, and every level of the store's manifests."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import token_store
from cairn.llm.chunks import PATTERN, ChunkEncoder, ColumnEncoder, file_tokenizer, rank_encoding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def same_as_the_libraries(texts: list[str | None]) -> None:
    own, fast = rank_encoding(RANKS, public_tokenizers.PATTERN)
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    a, b = fast.encode(pa.array(texts)), file_tokenizer(TOKENIZER).encode(pa.array(texts))
    assert [x.tolist() for x in a] == [own.encode_ordinary(t or "") for t in texts]
    assert [x.tolist() for x in b] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_that_polynomial_hashes_confuse():
    """A Thue-Morse word and its complement have the same polynomial hash mod 2**64 for every odd base."""
    for n in (1024, 2048, 4096):
        one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        same_as_the_libraries([f"x {one} {two}", two, one, f" {two} {one}"])


def test_cuts_at_marks_and_line_ends():
    rnd = random.Random(8)
    bits = ["\n", "\r\n", "\n\n", " ", "  ", " ", " ", "​", "᠎", "﻿", "\x1f", "word", "É", "ñandú", "×", "÷", "ß", "ŉ", "'", "'s", "'re", "don't", ".", ",", "...", "%%%", "12", "½", "中", "—", "«", "»", "ª", "_", "a.b", "a_b", "x'll", "I'", "\t"]
    same_as_the_libraries(["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12))) for _ in range(4000)])


def test_parts_survive_a_full_cache():
    own = rank_encoding(RANKS, PATTERN)[0]
    small = ChunkEncoder(lambda parts: [__import__("numpy").array(own.encode_ordinary(x), "<u4").tobytes() for x in parts], limit=5, longest=6)
    for text in ("one two three four five six seven", "one two eight nine ten eleven twelve", "one extraordinarily one", ""):
        assert small.encode(pa.array([text, text]))[1].tolist() == own.encode_ordinary(text)


def test_parts_survive_a_full_array():
    own = rank_encoding(RANKS, PATTERN)[0]
    small = ColumnEncoder(lambda parts: [__import__("numpy").array(own.encode_ordinary(x), "<u4").tobytes() for x in parts], limit=5, longest=6)
    for text in ("one two three four five six seven", "one two eight nine ten eleven twelve", "one extraordinarily one", "", "one two 中文字中文字中文字 three") * 2:
        assert [x.tolist() for x in small.encode(pa.array([text, None, text]))] == [own.encode_ordinary(text), [], own.encode_ordinary(text)]


def test_frequent_parts_stay_through_rare_ones():
    asked = []
    small = ColumnEncoder(lambda parts: (asked.extend(parts), [b"\0\0\0\0"] * len(parts))[1], limit=100)
    for _ in range(16):
        small.encode(pa.array(["the common words"]))
    for step in range(6):
        small.encode(pa.array([" ".join(f"w{step}x{i}" for i in range(90))]))
    before = len(asked)
    small.encode(pa.array(["the common words"]))
    assert asked[before:] == []


def test_latin_words_go_to_the_model_together(monkeypatch):
    encoder, plain = file_tokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    asked, many, letters = [], encoder.many, str.maketrans("0123456789", "abcdeéxyzŵ")
    monkeypatch.setattr(encoder, "many", lambda parts: (asked.extend(parts), many(parts))[1])
    text = "Lorem zwqaxo zwqéxo ŵqaxơ zw×qaxo zwªqaxo 7zwq " + " ".join(f"zw{i:04d}".translate(letters) for i in range(9000))
    assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not [x for x in asked if x[:1] == " " and x[1:].isalpha() and "ª" not in x]


def test_every_letter_in_a_word():
    same_as_the_libraries([f"x a{chr(c)}b {chr(c)} {chr(c)}b{chr(c)}" for c in range(0x80, 0x300)])


def test_another_pattern_gets_whole_texts():
    own, fast = rank_encoding(RANKS, r"[\s\S]{1,7}")
    texts = ["several words, in a row\n and more", "", None]
    assert [x.tolist() for x in fast.encode(pa.array(texts))] == [own.encode_ordinary(t or "") for t in texts]


def test_long_streams_are_cut_as_short_ones():
    import numpy as np

    ids = np.random.default_rng(2).integers(0, 50000, 200_000).astype("<u2")
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    later = token_store.cuts(ids[70_000:])  # the same places, once both have a cut in common
    assert {e + 70_000 for e in later[8:]} <= set(ends)


def test_streams_end_to_end_are_cut_as_by_themselves():
    import numpy as np

    rnd = np.random.default_rng(3)
    sizes = [0, 1, 15, 16, 63, 64, 65, 80, 0, 3000, *rnd.integers(0, 900, 300).tolist(), 70_000, 5]
    streams = [rnd.integers(0, 50000, n).astype("<u2") for n in sizes]
    streams += [np.zeros(9000, "<u2"), streams[-2][:5000], streams[-2][17:5000]]
    bounds = [0, *np.cumsum([len(x) for x in streams]).tolist()]
    assert token_store.cuts_of_each(np.concatenate(streams), bounds) == [token_store.cuts(x) for x in streams]


@pytest.fixture(scope="module")
def handle(make):
    texts = [(i, f"document {i} " + " ".join(f"w{(i * 7 + j) % 900}" for j in range(400))) for i in range(12)]
    return token_store.write(make(*texts, (12, None)), TOKENIZER, 2)


def test_store_reads_back(handle):
    assert token_store.read(handle).count() == 13


def test_damage_at_each_level(handle):
    recipes, told = handle["recipes"], handle["manifests"]
    flipped = F.concat(F.substring("root", 1, 15), F.unhex(F.lpad(F.hex((F.ascii(F.substring(F.hex("root"), 31, 1)) + 1) % 256), 2, "0")))
    first = F.col("k") == 3
    cases = {
        "damaged chunk": dict(handle, chunks=handle["chunks"].withColumn("inner", F.lit(0).cast("long"))),
        "doesn't give": dict(handle, recipes=recipes.withColumn("root", F.when(first, flipped).otherwise(F.col("root")))),
        "aren't those of its manifest": dict(handle, recipes=recipes.filter(~first)),
        "aren't the store's": dict(handle, manifests=told.withColumn("root", flipped)),
    }
    for message, wrong in cases.items():
        with pytest.raises(Exception, match=message):
            token_store.read(wrong).collect()
