"""Near-dedup leaves out no pair of a band: many graded variants of one text against brute force."""

import random
from collections import defaultdict

import numpy as np

from cartulary.llm.dartminhash import _sets, _shared, near_classes, signatures

WORDS, VARIANTS, WIDTH = 150, 1_000, 5


def _variant(changed):
    return " ".join(f"other{i}" if i in changed else f"word{i}" for i in range(WORDS))


def test_op8_graded_variants_of_one_text(spark):
    dice = random.Random(3)
    texts = [_variant(set(dice.sample(range(WORDS), dice.choice((0, 3, 4, 5, 6, 7, 8))))) for _ in range(VARIANTS)]
    words = [t.split() for t in texts]
    sets = [frozenset(tuple(w[i : i + WIDTH]) for i in range(WORDS - WIDTH + 1)) for w in words]
    label = list(range(VARIANTS))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same >= 0.8 * (len(a) + len(sets[j]) - same):
                label[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i in range(VARIANTS):
        members[root(i)].append(i)
    want = {i: (min(m), len(m)) for m in members.values() for i in m}
    found = near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert 10 < len(members) < VARIANTS - 10
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in found} == want


def test_op8_unlike_texts_round_one_passage(spark):
    """Thousands of texts that share half their words are no pairs, and are told apart without being compared."""
    dice = random.Random(8)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = [f"{passage} {' '.join(f'own{dice.randrange(10**9)}' for _ in range(60))}" for _ in range(3_000)]
    texts += [texts[0] + " tail"]
    found = near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in found}
    assert sizes == {i: (i, 1) for i in range(1, 3_000)} | {0: (0, 2), 3_000: (0, 2)}


def test_shared_counts_every_candidate(spark):
    texts = [(i, f"a b c d e f g x{i}") for i in range(3)] + [(9, "quite other words stand in this one")]
    got = {r["size"]: r["shared"] for r in _shared(_sets(spark.createDataFrame(texts, "id int, text string"), WIDTH)).collect() if r["shared"]}
    assert got == {4: 3}


def test_signatures_agree_by_weighted_likeness():
    draw = np.random.default_rng(4)
    names = draw.integers(1, 1 << 62, 400)
    a, b = (np.where(draw.random(400) < 0.7, draw.gamma(2.0, 1.5, 400), 0) for _ in range(2))
    b[:250] = a[:250]
    found = signatures([names[a > 0], names[b > 0]], 4_000, [a[a > 0], b[b > 0]])
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - want) < 0.03
    plain = signatures([names[a > 0], names[b > 0]], 4_000)
    assert abs((plain[0] == plain[1]).mean() - ((a > 0) & (b > 0)).sum() / ((a > 0) | (b > 0)).sum()) < 0.03
