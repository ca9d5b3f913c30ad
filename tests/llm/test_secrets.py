"""The trigram index against plain Python, and rules that aren't the base ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import secret_scan
from cairn.llm.secret_scan import BASE, EXTRA, Rule

from .conftest import ODD


def test_a_rule_by_any_name(make):
    """What a rule's texts must hold belongs to the rule, not to its name."""
    docs = make((1, "id 0123456789ABCDEF0123 end"), (2, "0123456789abcdef0123"), (3, None))
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.scan(docs, (Rule("hex", "[0-9A-F]+", 16),)).collect()}
    assert got == {1: [(3, "hex", 23)], 2: [], 3: []}


def test_index_holds_every_trigram(make):
    rnd = random.Random(1)
    texts = {i: "".join(rnd.choice("abAB é中👍\n") for _ in range(rnd.randint(0, 40))) for i in range(150)}
    for piece in (4, 7, 1 << 16):  # long texts are cut into pieces that overlap
        index = secret_scan.postings(make(*texts.items()).repartition(3), piece=piece)
        index = index.withColumn("trigram", F.hex(F.col("trigram").cast("binary"))).collect()  # parts of a character, too
        names = {r.block: r.kh for r in index if r.trigram == ""}
        assert len(names) == len(texts) and len(set(names.values())) == len(texts)
        held = {(r.trigram, r.block * 64 + i) for r in index if r.trigram for i in range(64) if r.bits >> i & 1}
        want = sum(len({(raw := t.lower().encode())[i : i + 3] for i in range(len(t.lower().encode()) - 2)}) for t in texts.values())
        assert len(held) == want and {n for _, n in held} <= set(names)


def brute(text, rules):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_candidates_lose_nothing(make, broadcast_rows):
    rnd = random.Random(2)
    bits = ["password", "token: ", "API_KEY=", "AKIA", "ABCDEFGH1234", "abcdef01" * 5, " ", '"', "=", "hunter22!", "ghp_" + "a1" * 20, "xoxb-", "1" * 20, "sk_live_", "é", "-----BEGIN RSA PRIVATE KEY-----", "toKen", "eyJabc.eyJdef.", "x" * 30]
    texts = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))) for i in range(200)] + [(5, "secret=abcdefgh"), (5, "nothing"), (None, "passwd: 12345678"), (None, None)]
    rules = BASE + EXTRA
    found = secret_scan.scan(make(*texts), rules, broadcast_rows=broadcast_rows).collect()
    got = sorted((repr(r.doc_id), [tuple(s) for s in r.spans]) for r in found)
    assert got == sorted((repr(k), brute(t or "", rules)) for k, t in texts) and any(s for _, s in got)


def test_rules_without_trigrams(make):
    docs = make(*ODD)
    assert secret_scan.scan(docs, (Rule("digit", r"\d+"),)).count() == docs.count()


def test_secret_across_pieces(make):
    """A text longer than a piece, with its secrets at and after the cuts."""
    text = "é" * 32760 + " password=abcdefghij " + "z" * 70000 + " AKIA" + "A" * 16 + " " + "w " * 200000
    r = secret_scan.scan(make((1, text))).first()
    assert [(s.kind, text[s.start : s.end]) for s in r.spans] == [("assign", "password=abcdefghij"), ("access", "AKIA" + "A" * 16)]
