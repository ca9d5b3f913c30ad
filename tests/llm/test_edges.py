"""Nulls, empty and long texts, repeated rows, ties, empty tables, clashing columns: every operator on the same odd rows."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, licenses, lsh_forest, media, mixing, quality, secret_scan, simhash, token_store, url_filter
from cairn.llm.graph import components

from .conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "empty"])
def docs(request, make):
    return make(*ODD) if request.param == "odd" else make(*ODD).limit(0)


def test_rows_stay(spark, docs):
    n = docs.count()
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (4, 0), (99, 1)], "doc_id bigint, quality int")
    assert simhash.edited_fingerprints(docs).count() == n and simhash.fingerprint(docs).count() == n
    assert mixing.taken(docs).count() == n
    assert secret_scan.scan(docs).count() == n and secret_scan.redact(docs).columns == docs.columns
    stored = media.store(docs)
    assert stored.rows.count() == n and media.contents(stored.addresses).count() == media.headers(stored.addresses).count() == stored.addresses.count()
    assert licenses.scan(docs).count() == n
    assert quality.score(docs, quality.fit(docs, labels)).count() == n
    handle = token_store.write(docs, TOKENIZER, 2)
    assert token_store.read(handle).count() == n and (token_store.manifests(handle).count() > 0) == (n > 0)
    assert lsh_forest.links(docs).count() == n
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert [bytes(r.raw).decode() for r in bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()] == [r.text or "" for r in docs.collect()]
    assert mixing.mix(docs).columns == [*docs.columns, "out_shards"]


def test_simhash_of_single_and_tied_rows(make):
    one = simhash.edited_fingerprints(make((7, "abcdef"))).first()
    assert (one.n_chars, one.near_next) == (6, 1.0) and one.edited_fingerprint == simhash.fingerprint(make((0, "abcdab"))).first().fingerprint
    same = simhash.edited_fingerprints(make((1, "x y z"), (1, "x y z"), (0, None)), parts=3)
    assert sorted(r.n_chars for r in same.collect()) == [0, 5, 5]


def test_block_tables_find_all(spark):
    rnd = random.Random(3)
    prints = [rnd.getrandbits(128) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(1, 6))) for p in prints]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,), (f"{prints[0]:032x}",)], "fingerprint string")
    for radius, agree in ((3, 1), (4, 2)):
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= radius}
        assert {tuple(r) for r in simhash.within(df, df, radius, agree).collect()} == want


def test_lists_hold_all_near_prints(spark):
    rnd = random.Random(6)
    prints = [rnd.getrandbits(128) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(10, 34))) for p in prints]
    df = spark.createDataFrame([(f"{p:032x}", i) for i, p in enumerate(prints)] + [(None, 900), (f"{prints[0]:032x}", 901), (f"{prints[50]:032x}", None)], "fingerprint string, doc_id bigint")
    want = {f"{a:032x}": x for a in prints[:9] if (x := [i for i, b in enumerate(prints) if a != b and (a ^ b).bit_count() <= 28])}
    for most in (7, 1000):
        assert want and {r.a: r.near for r in simhash.near_lists(df.limit(9), df, 28, most).collect()} == want
    assert simhash.near_lists(df.limit(0), df, 28).count() == simhash.near_lists(df, df.limit(0), 28).count() == 0


def test_near_docs(corpus, result):
    """Edited copies are found with their doc_ids, by the distance of the fingerprints; equal fingerprints count once."""
    got = result("op1_simhash")
    first = {}
    for k in sorted(got):
        first.setdefault(got[k].fingerprint, k)
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for k, x in got.items():
        want = sorted(j for y, j in first.items() if 0 < apart(x.fingerprint, y) <= 28) if k % 20 == 0 else None
        assert x.near_docs == want
    assert any(x.near_docs for x in got.values())


def test_near_copies_in_tiles(make):
    """A group larger than a tile, copies, and the threshold itself."""
    from .test_contracts import brute_links

    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 999)}" for _ in range(60)]
    texts = {}
    for k in range(24):
        words = base[:]
        words[rnd.randrange(60)] = f"edit{k}"
        texts[k] = " ".join(words)
    texts |= {100: texts[3], 101: texts[3], 102: "a b c d", 103: "A b, c d!", 104: "", 105: "a b c d e f g h i", 106: "a b c d e f g h"}
    links, classes = brute_links(texts)
    got = {r.doc_id: r for r in lsh_forest.links(make(*texts.items()), tile=5).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: links[k] for k in texts}
    assert {k: r.class_id for k, r in got.items()} == classes
    assert got[103].set_id == 102 and got[105].class_id == 105


def test_all_members_of_a_node_are_compared(spark):
    """Members that share every prefix but not the sketch stand between a near pair; it is found whichever way a node is worked on."""
    import numpy as np

    least = lsh_forest.shortest_prefix(0.8, 24, 0.999999)
    same, rng = lsh_forest.tree_order(24, least).ravel(), np.random.default_rng(8)
    assert least == 3 and len(set(same.tolist())) == 72
    sigs = rng.integers(0, 1 << 16, (40, lsh_forest.HASHES), np.uint16)
    sigs[:, same] = sigs[0, same]
    sigs[39] = sigs[0]
    sigs[39, np.setdiff1d(np.arange(lsh_forest.HASHES), same)[:30]] += 1
    sizes = [100] * 38 + [10, 100]
    members = spark.createDataFrame([(i, n, bytearray(x.tobytes())) for i, (n, x) in enumerate(zip(sizes, sigs, strict=True))], "id bigint, size bigint, sig binary")
    for few, crowd in ((8, 2048), (8, 6), (64, 2048)):
        found = lsh_forest.candidates(members, 0.8, 24, 0.999999, few, crowd)
        assert {tuple(sorted(r)) for r in found.collect()} == {(0, 39)}


def test_near_pair_in_a_crowd_is_found(spark):
    """Two members of mostly a common passage, and thousands that hold half of it: between the two in every sorted trie."""
    import numpy as np

    rng = np.random.default_rng(9)
    base, sigs = rng.integers(0, 1 << 16, lsh_forest.HASHES, np.uint16), rng.integers(0, 1 << 16, (4000, lsh_forest.HASHES), np.uint16)
    own = rng.random(sigs.shape) < 0.5
    own[[0, 3999]] = False
    own[0, (other := rng.permutation(lsh_forest.HASHES))[:13]] = own[3999, other[13:26]] = True
    sigs = np.where(own, sigs, base)
    members = spark.createDataFrame([(i, 100, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "id bigint, size bigint, sig binary")
    root = {r.id: r.root for r in components(lsh_forest.candidates(members, 0.8, 24, 0.999999, 2)).collect()}
    assert root.get(0, -1) == root.get(3999, -2)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (5, 5)]
    assert rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))) == sorted([(1, 1), (2, 1), (3, 1), *((i, 6) for i in range(6, 11))], key=repr)


def test_trigram_queries():
    from cairn.llm.trigrams import trigram_query

    assert trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert trigram_query("(abc|xyz)q*") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert trigram_query("[a-z]+x") == [] and trigram_query("ab?c") == [] and trigram_query("(abc)?") == []
    assert trigram_query("ab[cd]e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]


def test_secret_spans(make):
    text = "é👍 PassWord = 'abcdefgh' token:short token: " + "a" * 40 + " AKIA" + "Z" * 12 + " ghp_" + "b" * 40
    found = secret_scan.scan(make((1, text))).first().spans
    assert [(s.kind, text[s.start : s.end]) for s in found] == [
        ("assign", "PassWord = 'abcdefgh"), ("assign", "token: " + "a" * 40), ("hex", "a" * 40), ("access", "AKIA" + "Z" * 12), ("git", "ghp_" + "b" * 40), ("hex", "b" * 40),
    ]
    clean = secret_scan.redact(make((1, text), (2, None), (3, "fine"))).collect()
    assert [r.text for r in sorted(clean, key=lambda r: r.doc_id)] == ["é👍 [SECRET]' token:short [SECRET] [SECRET] [SECRET]", None, "fine"]


def test_licence_places(make):
    text = "Under the MIT-License, under the mit license. " + "filler " * 50 + "cc by nc cc by nc"
    r = licenses.scan(make((1, text))).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (4, 0, 61, "cc-by-nc,mit", 1.0)
    part = licenses.scan(make((1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing"), (2, "free of charge"), (3, "under the \u212ait mit"))).collect()
    assert [r.labels for r in sorted(part, key=lambda r: r.doc_id)] == ["mit", "", ""]


def test_mixture(make):
    docs = make(*((i, f"w{i} " * (10 + i), f"s{i % 3}" if i % 7 else None) for i in range(60)))
    first, again = rows(mixing.taken(docs)), rows(mixing.taken(docs))
    assert first == again
    by_id = {r[0]: r for r in first}
    mixed = {}
    for r in mixing.mix(docs, block=4).collect():
        mixed.setdefault(r.doc_id, []).append(len(r.text.split()))
    exact = {r.doc_id: r.taken for r in mixing.taken(docs, block=4).collect()}
    assert {k: sum(v) for k, v in mixed.items()} == {k: n for k, n in exact.items() if n}
    assert all(r[4] <= 2 * r[1] for r in by_id.values())


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 100, 1023):
        df = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("n"), F.lit(5).cast("long").alias("seed"))
        assert sorted(r.i for r in mixing._permute(df, "i", "n", "seed").collect()) == list(range(n))


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7x?q#f"), (4, "x://com/en/"), (5, "x://notcom/en/"), (6, "a://b://net/de/"), (None, "x://h.net/de/9"), (3, "x://é.org")], "page_id bigint, url string")
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(pages.withColumn("host", F.lit("mine"))).collect()}
    assert got == {
        (1, "", "", None), (2, "", "", None), (3, "a.example.com", "/en/7x", "example.com/en/7"), (4, "com", "/en/", "com/en/"), (5, "notcom", "/en/", None), (6, "b:", "//net/de/", None),
        (None, "h.net", "/de/9", "net/de/"), (3, "é.org", "", None),
    }
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_chunked_encoding_is_the_library_s():
    from tokenizers import Tokenizer

    from cairn.llm.chunks import file_tokenizer, rank_encoding

    own, fast = rank_encoding(RANKS, public_tokenizers.PATTERN)
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "Foo", "'s", "'ll", "12", "٣", "é", "中文", "!", ".,", ",", ".", "<|endoftext|>", "👍🏽", "²", "x" * 70, "“hi”", " the", " a,"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(600)] + ["", " ", "  ", " a", "a ", None, "long " * 20000]
    for _ in range(2):  # with an empty and a filled cache
        a, b = fast.encode(pa.array(texts)), file_tokenizer(TOKENIZER).encode(pa.array(texts))
        assert [x.tolist() for x in a] == [own.encode_ordinary(t or "") for t in texts]
        assert [x.tolist() for x in b] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_store_detects_damage(make, tmp_path):
    handle = token_store.write(make((1, "some words here"), (2, "more words there")), TOKENIZER, 2, folder=str(tmp_path / "store"))
    pack = next((tmp_path / "store" / "packs").iterdir())
    raw = pack.read_bytes()
    wrong = dict(handle, chunks=handle["chunks"].withColumn("inner", F.col("inner") + 2).withColumn("size", F.col("size") - 2))
    assert token_store.read(handle).count() == 2 and raw
    with pytest.raises(Exception, match="damaged chunk|doesn't give"):
        token_store.read(wrong).collect()


def test_media_round_trip():
    for raw in (b"", b"x", b"y" * 64, bytes(range(256)) * 5):
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        media.png_size(b"GIF89a" + bytes(40))


def test_tar_shards_are_tar(make, tmp_path):
    import tarfile

    docs = make(*((i, f"copied {i % 3}") for i in range(40)), (50, "alone"), (51, "a"), (52, "a\0"), (None, None), (None, "")).repartition(5)
    for name, most in (("few", 100), ("many", 0)):  # whether or not the copied payloads are told to all tasks
        kept = media.store(docs, folder=str(tmp_path / name), broadcast_rows=most)
        addresses = kept.addresses.collect()
        names = [m.name for shard in (tmp_path / name).iterdir() for m in tarfile.open(shard).getmembers()]
        assert sorted(names) == sorted(f"{r.digest.hex()}.png" for r in addresses)  # each content once in the whole store
        assert len(names) == len({bytes(r.payload) for r in kept.rows.collect()}) == 6


def test_media_columns(make, tmp_path):
    kept = media.store(make((1, "x" * 200), (2, None)), folder=str(tmp_path / "m"))
    assert sorted((r.media_width, r.media_height) for r in media.headers(kept.addresses).collect()) == [(64, 1), (64, 4)]
    wrong = kept.addresses.withColumn("digest", F.unhex(F.lit("00" * 32)))
    with pytest.raises(Exception, match="damaged payload"):
        media.contents(wrong).collect()


def test_chunks_share_passages():
    """A passage of 500 ids inside documents of usual length (some 650 ids) is mostly stored once."""
    import numpy as np

    rng = np.random.default_rng(11)
    total, stored = 0, {}
    for _ in range(40):
        passage = rng.integers(0, 50000, 500)
        for _ in range(2):
            ids = np.concatenate([rng.integers(0, 50000, rng.integers(50, 100)), passage, rng.integers(0, 50000, rng.integers(50, 100))]).astype("<u2")
            bounds = [0, *token_store.cuts(ids)]
            total += len(ids)
            stored |= {ids[a:b].tobytes(): b - a for a, b in zip(bounds, bounds[1:])}
    assert sum(stored.values()) < 0.95 * total


def test_sketch_floor_and_trees_meet_the_recall():
    from math import comb

    least = lsh_forest.shortest_prefix(0.8, 24, 0.999999)
    floor = lsh_forest.sketch_floor(0.8, 24, least, 0.999999)
    under = lambda n: sum(comb(128, k) * 0.8**k * 0.2 ** (128 - k) for k in range(n))
    missed = (1 - 0.8**least) ** 24
    assert floor == 79 and missed + under(floor) <= 1e-6 < missed + under(floor + 1)


def test_licence_without_its_rarest_words(make):
    assert licenses.scan(make((1, "this is now granted free of charge to any person getting a copy of this software"))).first().labels == "mit"


def test_whole_licence_texts(make):
    """Each text is found as itself, with a few words changed too, and only where its phrase is whole."""
    from cairn.llm.licenses import TEXTS, Template

    rnd, docs, want = random.Random(7), [], {}
    for i, t in enumerate(TEXTS):
        words = t.words.split(" ")
        docs.append((3 * i, f"Copyright somebody.\n\n{t.words}\n"))
        keep = {w.lower().strip('.,;"') for w in t.phrase.split()}
        changed = [w if w.lower().strip('.,;"') in keep or "\n" in w or rnd.random() > 0.1 else "changed" for w in words]
        docs.append((3 * i + 1, " ".join(changed)))
        want |= {3 * i: t.label, 3 * i + 1: t.label}
    got = {r.doc_id: r for r in licenses.scan(make(*docs)).collect()}
    assert all(label in got[k].labels.split(",") for k, label in want.items())
    assert all(got[3 * i].score == 1.0 for i in range(len(TEXTS)))
    one = make((1, TEXTS[0].words.replace("without restriction", "without any restriction").replace("free of charge", "free")))
    assert licenses.scan(one, notices=TEXTS).first().labels == ""
    with pytest.raises(ValueError, match="isn't in the template"):
        licenses.scan(one, notices=(Template("some words", "other words", "x"),))


def test_pipeline_decodes_what_it_encoded(make, monkeypatch):
    import corpus_pipeline

    own, asked = bpe.encode, []
    monkeypatch.setattr(bpe, "encode", lambda *a, **b: asked.append(b.get("verify")) or own(*a, **b))
    assert corpus_pipeline.encode_tokens(None, make(*ODD), "").count() == len(ODD) and asked == [True]
    ranks, encoder = bpe.rank_encoding(RANKS, public_tokenizers.PATTERN)
    texts = pa.array(["one two", None, "é"])
    coded = encoder.encode(texts)
    bpe.verify_decoded(ranks, coded, texts)
    with pytest.raises(ValueError, match="decode"):
        bpe.verify_decoded(ranks, coded[::-1], texts)
