"""The mixture's draws: they decide what is taken, come near the targets, and hold the limits."""

import random
from collections import Counter

import pytest

from cairn.llm import mixing


@pytest.fixture(scope="module")
def docs(make):
    rnd = random.Random(1)
    return make(*((i, " ".join(["w"] * rnd.randint(0, 900)), "s0" if i % 3 == 0 else f"s{i % 7}") for i in range(300)))


def totals(rows):
    out = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        out[r.source_size, r.target] += r.taken
    return out


def test_draws_decide_what_is_taken(docs):
    """Another number of shards, or seed, draws anew; the totals stay near the targets; reruns agree."""
    seen = []
    for how in ({}, {}, {"shards": 7}, {"seed": 5}):
        rows = mixing.taken(docs, **how).collect()
        seen.append(sorted((r.doc_id, r.taken) for r in rows))
        for (_, target), n in totals(rows).items():
            assert abs(n - target) <= max(128, 0.03 * target)
        assert all((r.n_shards > 0) == (r.taken > 0) and r.n_shards <= how.get("shards", 32) for r in rows)
    assert seen[0] == seen[1] and len({str(x) for x in seen}) == 3


def test_draws_are_a_shard_s_own(spark):
    """Shards have the same number of slots, give or take one, and their counts vary as multinomial draws do."""
    counts = mixing.drawn(spark, [4000, 2000, 2000], 16, 3, 0.5).collect()
    per = Counter()
    for r in counts:
        per[r.shard] += r.n
    assert sum(per.values()) == 8000 and max(per.values()) - min(per.values()) <= 1 and len(per) == 16
    first = [r.n for r in counts if r.sid == 1]
    mean = sum(first) / len(first)
    assert 4 < (sum((x - mean) ** 2 for x in first) / len(first)) ** 0.5 < 25  # 11 for 500 draws at 1/2


def test_waves_cover_all_slots():
    for slots in ([], [0], [1], [5, 0, 3], [10**9, 10**6]):
        got = mixing.waves(slots, 0.005)
        assert [x for low, high in got for x in (low, high)][1:-1:2] == [low for low, _ in got][1:]
        assert (got[0][0], got[-1][1]) == (0, sum(slots)) if got else sum(slots) == 0
        assert len(got) < 40


def test_shards_of_the_mixture(make):
    docs = make(*((i, " ".join(f"w{i}x{j}" for j in range(100)), "s") for i in range(40)))
    rows = mixing.mix(docs, block=16, shards=5).collect()
    assert all(r.out_shards == sorted(set(r.out_shards)) and set(r.out_shards) <= set(range(5)) for r in rows)
    assert {x for r in rows for x in r.out_shards} == set(range(5))
    clash = mixing.mix(docs.withColumnRenamed("lang", "out_shards"), block=16)
    assert "_out_shards" in clash.columns and clash.first().out_shards == "en"


def test_no_words_at_all(make):
    docs = make((1, None), (2, ""), (None, " "))
    assert mixing.mix(docs).count() == 0 and sorted(r.taken for r in mixing.taken(docs).collect()) == [0, 0, 0]
