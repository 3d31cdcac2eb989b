import random

import numpy as np
import pytest

from sedimenta.llm import leakage as lk

RNG = random.Random(4)
PLACES = [f"{a}{b}" for a in ("nor", "sel", "kes", "tam", "wy") for b in ("ford", "holt", "mere", "dale")]
THINGS = ["kilns", "looms", "maps", "bells", "tiles", "crates", "pumps", "sails"]


def sentence():
    p, q, t, n = RNG.choice(PLACES), RNG.choice(PLACES), RNG.choice(THINGS), RNG.randint(100, 999)
    return RNG.choice([
        f"From {p} to {q} the keeper counted {n} {t} in May.",
        f"Nobody in {p} ever sold {t} until the {n}th day, except {q}'s printer.",
        f"A pale flag over {p} meant {n} {t} for the mill at {q}.",
    ])


def prose():
    return " ".join(f"{RNG.choice(['team', 'report', 'index', 'queue'])} {RNG.choice(['grew', 'fell', 'ran'])} {RNG.randint(1, 9)} times." for _ in range(30))


STOCK = "Answer from the notes below."
ITEMS = [(i, (STOCK + " " if i % 2 else "") + " ".join(sentence() for _ in range(6)), RNG.choice(PLACES)) for i in range(12)]


def docs():
    out, want = [(0, None), (1, ""), (2, STOCK + " " + prose())], set()
    for i, text, _ in ITEMS:
        body = text.removeprefix(STOCK + " ")
        words = body.split()
        out.append((100 + i, prose() + "\n\n" + body + "\n" + prose()))
        out.append((200 + i, prose() + " " + body.upper().replace(".", "").replace("'", "") + " " + prose()))
        out.append((300 + i, "> " + "**" + "** **".join(words) + "**<br>" + prose()))
        out.append((400 + i, prose() + " " + " ".join(words[: len(words) * 6 // 10]) + " " + prose()))
        want |= {(k + i, i) for k in (100, 200, 300, 400)}
        out.append((500 + i, prose() + " " + " ".join(words[: len(words) // 5]) + " " + prose()))  # too little
        mixed = words[:]
        RNG.shuffle(mixed)
        out.append((600 + i, " ".join(mixed)))  # the words without their order
    return out, want


def test_leaks(spark):
    rows, want = docs()
    d = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    t = spark.createDataFrame(ITEMS + [(90, None, None), (91, STOCK, "x"), (92, "", "")], "item_id long, item_text string, answer string")
    found = lk.find_leaks(d, t)
    assert {(r.doc_id, r.item_id) for r in lk.leaks(found).collect()} == want
    assert lk.find_leaks(d.limit(0), t).count() == 0 and lk.find_leaks(d, t.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    rows, want = docs()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame(ITEMS, "item_id long, item_text string, answer string")
    monkeypatch.setattr(lk, "ITEM_BLOCK", 5)
    assert {(r.doc_id, r.item_id) for r in lk.leaks(lk.find_leaks(d, t)).collect()} == want


@pytest.mark.parametrize("seed", range(30))
def test_chain_against_brute_force(seed):
    """The best chain of stretches, against dynamic programming over all words."""
    rng = random.Random(seed)
    a = [rng.randint(0, 3) for _ in range(40)]
    b = a[:]
    for _ in range(rng.randint(1, 4)):
        k = rng.randrange(len(b))
        b[k : k + rng.randint(0, 3)] = [rng.randint(0, 3) for _ in range(rng.randint(0, 5))]
    n, m, s = len(a), len(b), lk.STRETCH
    best = [[0] * (m + 1) for _ in range(n + 1)]
    run = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            run[i][j] = run[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], *(best[i - k][j - k] + k for k in range(s, run[i][j] + 1)))
    ii, jj, size = [], [], []
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if run[i][j] >= s and (i == n or j == m or run[i + 1][j + 1] == 0):
                ii.append(i - run[i][j])
                jj.append(j - run[i][j])
                size.append(run[i][j])
    got = lk.chain(np.array(ii), np.array(jj), np.array(size)) if ii else 0
    assert got <= best[n][m] and got >= 0.9 * best[n][m]


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lk, "FAN", 3)
    rows = [(t, b, np.full(4, t + 10 * b, np.float32).tobytes()) for t in range(11) for b in range(2)]
    parts = spark.createDataFrame(rows, "task int, block int, part binary")
    got = {r.block: np.frombuffer(r.part, np.float32).tolist() for r in lk._tree_sum(parts, 11).collect()}
    assert got == {b: [float(sum(t + 10 * b for t in range(11)))] * 4 for b in range(2)}
