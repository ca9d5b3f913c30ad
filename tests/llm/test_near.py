"""Fingerprints and likeness of long, repeated and crowded texts against plain Python."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from cairn.llm import lsh_forest, shingles, simhash

from .test_contracts import brute_links, shingle_sets


def edited(rnd, words, share):
    return [f"x{rnd.getrandbits(40):x}" if rnd.random() < share else w for w in words]


def check(docs, texts):
    """texts: (key, text) rows; each row is a document of its own."""
    links, classes = brute_links({i: t for i, (_, t) in enumerate(texts)})
    least = {}
    for i, (k, _) in enumerate(texts):
        least[classes[i]] = min(k, least.get(classes[i], k))
    want = sorted((k, least[classes[i]], links[i]) for i, (k, _) in enumerate(texts))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in docs.collect()) == want
    return links


def test_texts_that_share_a_key(make):
    rnd = random.Random(1)
    a, b = ([f"w{rnd.randint(0, 500)}" for _ in range(80)] for _ in range(2))
    plus = lambda w, n: " ".join([*w, *(f"end{n}" for _ in range(2))])
    texts = [(1, " ".join(a)), (1, " ".join(b)), (2, plus(a, 1)), (3, plus(b, 2)), (4, plus(b, 3)), (1, " ".join(b)), (3, plus(b, 2))]
    links = check(lsh_forest.links(make(*texts)), texts)
    assert links[1] == 4 and lsh_forest.firsts(make(*texts)).count() == 3  # (1, a), and (1, b) twice


def test_crowd_below_the_threshold(make):
    """300 texts of likeness about 0.75 to each other, and pairs of 0.8 and more among them."""
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(300)]
    crowd = [[*base, *(f"own{i}x{j}" for j in range(50))] for i in range(300)]
    sets = shingle_sets({i: " ".join(w) for i, w in enumerate(crowd[:2])})
    assert 0.7 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    texts = [(i, " ".join(w)) for i, w in enumerate(crowd)]
    texts += [(1000 + i, " ".join(edited(rnd, crowd[i], 0.01))) for i in range(0, 300, 10)]
    links = check(lsh_forest.links(make(*texts), tile=64, weight=1 << 14), texts)
    assert sum(links.values()) > 30


def test_recall_at_the_threshold(make):
    """Pairs whose likeness is just 0.8 and up to 0.85, by themselves in the table."""
    rnd = random.Random(3)
    texts, pairs = [], 0
    while pairs < 400:
        words = [f"v{rnd.getrandbits(30):x}" for _ in range(rnd.randint(40, 200))]
        other = edited(rnd, words, 0.02)
        x, y = shingle_sets({0: " ".join(words), 1: " ".join(other)}).values()
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            texts += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    found = {r.doc_id: r.n_links for r in lsh_forest.links(make(*texts)).collect()}
    assert sum(found[2 * i] == 1 for i in range(pairs)) >= 0.99 * pairs


def test_long_words_are_told_apart():
    words = ["".join(x if i.bit_count() % 2 else y for i in range(2048)) for x, y in ("ab", "ba")]
    data, at = np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, 4097])
    hashes, _ = shingles.words(data, at)
    assert len(set(hashes.tolist())) == 2
    same, _ = shingles.words(np.frombuffer(words[0].upper().encode(), np.uint8), np.array([0, 2048]))
    assert same[0] == hashes[0]


def test_blocks_don_t_change_hashes(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, 1000, len(text)])
    before = shingles.words(data, at)[0]
    monkeypatch.setattr(shingles, "BLOCK", 300)
    assert (shingles.words(data, at)[0] == before).all()
    column = pa.array([text.decode(), "", "one two", text.decode()[:5000]])
    assert (simhash.fingerprints(column, parts=3) == simhash.fingerprints(column)).all()


def test_memory_of_a_long_text():
    """A text of 20 MB takes a few times its size, not a hundred bytes for each word and bit."""
    column = pa.array([" ".join(f"w{i % 99991}" for i in range(3_000_000))])
    size = column.nbytes
    assert size > 19e6
    tracemalloc.start()
    simhash.fingerprints(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * size
