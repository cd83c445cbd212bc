"""What the hub rounds of min-max hashing leave open, against comparing all pairs."""

import random

import pytest
from plain_versions import near_duplicates

from lastro.llm import jaccard, minhash
from lastro.llm.minhash import linked


def families(seed):
    """Templates in families that share most words, so that buckets hold several components."""
    rng, texts = random.Random(seed), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    for _ in range(8):
        own = list(base)
        for _ in range(rng.randint(2, 8)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        for _ in range(12):
            words = list(own)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7000, ""), (7001, None)]


@pytest.mark.parametrize("hubs, percent", [(0, 85), (1, 85), (3, 80)])
def test_open_buckets(docs, monkeypatch, hubs, percent):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(jaccard, "TILE", 8)
    texts = families(hubs)
    got = sorted((tuple(r) for r in linked(docs(texts), percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    want = sorted((tuple(r[:3]) for r in near_duplicates(texts, percent, 5)), key=repr)
    assert got == want and len({c for _, _, c in got}) > 4
