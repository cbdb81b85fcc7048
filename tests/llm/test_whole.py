"""Nothing that belongs together is left out: lines against brute force."""

import random

from cartulary.llm.lines import SIMILAR, line_groups

WORDS = "the of and inder ortion shat blened er onthing haes wher Lyti res toun that is by from".lower().split()


def _within(a, b, most):
    if abs(len(a) - len(b)) > most:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
        if min(now) > most:
            return False
    return before[-1] <= most


def _components(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in linked:
        label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in range(n)}


def _edited(line, n, dice):
    """``line`` with n edits spread over all of it, so that few words stay whole."""
    out = list(line)
    for i in sorted((len(out) * (2 * i + 1) // (2 * n) for i in range(n)), reverse=True):
        kind = dice.randrange(3)
        out[i : i + 1] = [[dice.choice("qxz")], [], [out[i], dice.choice("qxz")]][kind]
    return " ".join("".join(out).split())


def test_op4_finds_every_near_pair(spark):
    dice = random.Random(7)
    texts = []
    for size in (2, 3, 5, 8, 12, 20, 40):
        for _ in range(5):
            line = " ".join(dice.choice(WORDS) for _ in range(size))
            texts += [line] + [_edited(line, max(1, len(line) * n // 100), dice) for n in (3, 6, 9, 10)]
    texts = sorted(set(texts))
    linked = [
        (i, j)
        for j, b in enumerate(texts)
        for i, a in enumerate(texts[:j])
        if _within(a, b, int(max(len(a), len(b)) * (1 - SIMILAR) + 1e-9))
    ]
    want = _components(len(texts), linked)
    sizes = {c: sum(x == c for x in want.values()) for c in set(want.values())}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    found = {r["id"]: r["class"] for r in line_groups(rows).collect()}
    assert len(linked) > 50
    assert found == {i: c for i, c in want.items() if sizes[c] > 1}
