"""Every registered query against a plain Python version on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

TRANS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def shingle_sets(texts):
    out = {}
    for k, text in texts.items():
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(TRANS).encode())
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_links(texts, threshold=0.8):
    """Links by document and class by document."""
    sets, links, parent = shingle_sets(texts), Counter(), {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            posted[x].append(k)
    for k, s in sets.items():
        for other, n in Counter(j for x in s for j in posted[x]).items():
            if other != k and n / (len(s) + len(sets[other]) - n) >= threshold:
                links[k] += 1
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return links, {k: root(k) for k in texts}


def test_op1(corpus, result):
    got = result("op1_simhash")
    order = sorted(corpus.values(), key=lambda r: -r.doc_id)
    prints = {}
    for r, nxt in zip(order, order[1:] + order[:1]):
        n, x = len(r.text) // 3, got[r.doc_id]
        assert x.n_chars == len(r.text)
        assert x.edited_sha256 == sha(r.text[: len(r.text) - n] + nxt.text[:n])
        assert prints.setdefault(r.text, x.fingerprint) == x.fingerprint
        apart = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert x.near_edited == pytest.approx(apart(x.fingerprint, x.edited_fingerprint))
        assert x.near_next == pytest.approx(apart(x.fingerprint, got[nxt.doc_id].fingerprint))
    every = {int(x.fingerprint, 16) for x in got.values()}
    for k, x in got.items():
        mine = int(x.fingerprint, 16)
        assert x.near_prints == (sum(1 for y in every if y != mine and (y ^ mine).bit_count() <= 3) if k % 20 == 0 else None)
    long = [x for x in got.values() if x.n_chars > 500]
    assert np.mean([x.near_edited for x in long]) > 0.68 and np.mean([x.near_next for x in long]) < 0.56


def test_op2(corpus, result):
    got = result("op2_mixing")
    size = {k: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for k, r in corpus.items()}
    source = Counter()
    for k, r in corpus.items():
        source[r.source] += size[k]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(source))}
    target, free, left = {}, set(source), 1.5 * sum(source.values())
    while over := [s for s in free if left / sum(weight[x] for x in free) * weight[s] > 2 * source[s]]:
        for s in over:
            free.discard(s)
            target[s] = 2 * source[s]
            left -= target[s]
    target |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    taken = Counter()
    for k, r in corpus.items():
        x = got[k]
        assert (x["size"], x.source_size) == (size[k], source[r.source]) and x.target == pytest.approx(target[r.source])
        assert 0 <= x.taken <= 2 * size[k]
        taken[r.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= max(64, 0.03 * target[s]) for s in source)


def test_op3(corpus, result):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    got = result("op3_secret_scan")
    for k, r in corpus.items():
        spans = sorted((m.start(), i, kind, m.end()) for i, (kind, p, g, n) in enumerate(rules) for m in p.finditer(r.text) if len(m[g]) >= n)
        assert got[k].base_sha256 == sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans))
        assert [got[k][f"n_{kind}"] for kind, *_ in rules] == [sum(s[2] == kind for s in spans) for kind, *_ in rules]


def test_op4(corpus, result):
    got = result("op4_media")
    stored = defaultdict(set)
    for k, r in corpus.items():
        raw, x = r.text.encode(), got[k]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert x.media_width * x.media_height == len(payload)
        stored[r.text].add(tuple(x)[2:])
    assert all(len(x) == 1 for x in stored.values())  # equal texts, one address


def test_op5(corpus, result):
    got = result("op5_license_scan")
    base = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for k, r in corpus.items():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r.text.translate(TRANS))
        at = [(i, label) for label, p in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0])
        assert x.base_labels == ",".join(sorted({label for _, label in at})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
        assert 0 <= x.score <= 1 and (x.score == 1 or not at)
        assert ("gpl-3" in x.labels) == ("GNU General Public License, version 3" in r.text)


def test_op6(spark, tiny, result):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    pages, got = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url").collect(), result("op6_url_filter")
    for r in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(TRANS), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x[1] or host.endswith(f".{x[1]}")) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        x = got[r.page_id]
        assert (x.host, x.path, x.rule) == (host, path, best[1] + best[2] if best else None)
        assert x.verdict == best[0] if best else x.verdict in ("allow", "block")


def test_op7(spark, tiny, corpus, result):
    got = result("op7_quality")
    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and x.predicted == (x.score >= 0.5) and 0 <= x.score <= 1 for k, x in got.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    held = [(got[k].predicted, y) for k, y in labels.items() if got[k].held_out]
    assert len(got) == len(corpus) and np.mean([a == b for a, b in held]) >= 0.9


def test_op8(corpus, result):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    got, start = result("op8_token_store"), 0
    for k in sorted(corpus):
        ids = np.array([*own.encode(corpus[k].text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9(corpus, result):
    links, classes = brute_links({k: r.text for k, r in corpus.items()})
    got = result("op9_ngram_jaccard")
    assert {k: x.n_links for k, x in got.items()} == {k: links[k] for k in corpus}
    assert {k: x.class_id for k, x in got.items()} == classes


def test_op10(corpus, result):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result("op10_byte_bpe")
    for k, r in corpus.items():
        ids = np.array(own.encode_ordinary(r.text), "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(r.text))
