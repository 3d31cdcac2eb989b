import random

import numpy as np
import pytest

from sedimenta.llm import pii, spam

from labelled_pii import COMMON, LABELLED

RNG = random.Random(8)
WORDS = "team report index queue grew fell after before with slow morning review notes about their small plan river keeper found another question because people".split()


def prose(n=12):
    return " ".join(" ".join(RNG.choices(WORDS + [f"x{RNG.randint(0, 900)}" for _ in range(9)], k=11)).capitalize() + "." for _ in range(n))


SPAM = [
    "\n".join(f"- https://{RNG.randint(1, 999)}-deals.example/{RNG.choice(WORDS)}-{RNG.randint(1, 99)}?id={RNG.randint(1, 9999)}" for _ in range(30)),
    " ".join(f"#{RNG.choice(WORDS[:8])}" for _ in range(160)),
    "Tags: " + ", ".join(RNG.choice(["buy maps", "cheap maps", "best maps", "maps"]) for _ in range(120)),
    " ".join(f"Best Xylo maps are the {RNG.choice(['new', 'top'])} Xylo maps for Xylo maps users of Xylo maps." for _ in range(25)),
    "\n".join(f"{i}. [Xylo maps](http://h{RNG.randint(1, 999)}.test/p{RNG.randint(1, 999)}.html)" for i in range(1, 30)),
]
HAM = [prose(20), "# List\n" + "\n".join(f"- {prose(1)}" for _ in range(20)), prose(10) + "\n\nTags: one, two, three", "**Q?** " + prose(3) + "\n\n**Another Q?** " + prose(3), "Short note."]


def test_stuffed_pages(spark):
    rows = [(i, prose(RNG.randint(2, 30)), "en") for i in range(1000, 1400)]
    rows += [(i, t, "en") for i, t in enumerate(SPAM)] + [(100 + i, t, RNG.choice(["en", "EN", None])) for i, t in enumerate(HAM)]
    rows += [(200, None, None), (201, "", "en"), (202, "... !!!", "??"), (203, SPAM[1] + "\n\n" + prose(60), "en"), (0, SPAM[0], "en"), (204, "a" * 300_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flagged = {r.doc_id for r in spam.score_documents(spam.score_blocks(df)).where("flagged").collect()}
    assert flagged >= set(range(len(SPAM)))
    assert not flagged & {*range(100, 110), *range(200, 204)}
    assert len([x for x in flagged if x >= 1000]) == 0
    assert spam.score_documents(spam.score_blocks(df.limit(0))).count() == 0


def test_blocks_keep_every_character():
    for t in [prose(30), "\n\n".join(prose(3) for _ in range(9)), "x" * 5000, "\n" * 50, "a\nb"]:
        assert "".join(spam.blocks(t)).strip() == t.strip()


TEXT = [
    ("who replaced Lucia Minyarow for it", {("name", "Lucia Minyarow")}),
    ("call with Holström, Ivan on 01.99.00.16.64 today", {("name", "Holström, Ivan"), ("phone", "01.99.00.16.64")}),
    ("write to j-min.71 at halfal dot example dot org or A.B@Mail.TEST", {("email", "j-min.71 at halfal dot example dot org"), ("email", "A.B@Mail.TEST")}),
    ("shipped to 185 Gwen Street, Wendan or PO Box 40, Stowick SX4 7ZZ", {("address", "185 Gwen Street, Wendan"), ("address", "PO Box 40, Stowick SX4 7ZZ")}),
    ("lookup driving licence RULST480732X9 and SSN 916 45 4766", {("id_number", "RULST480732X9"), ("id_number", "916 45 4766")}),
    ("Run 20250310-2073 of build 2730.77.4625 at 192.0.2.7 on 2024-01-05", set()),
    ("Clara is only the code name of it; Felson & Sons came; Maria left", set()),
    ("mail <EMAIL_1> about @pkg/core@1.7.1", set()),
]
PEOPLE = [("Jo Wu", True)] * 3 + [("Ng Li", False), ("Wu", True), (None, True), ("", True), ("Jo Wu", None)]


def people(spark):
    return spark.createDataFrame(PEOPLE, "title string, person boolean")


def model_of(spark, df, key="rid"):
    spans = pii.propose(df, [key], "value", pii.names(people(spark), "title", "person"), COMMON)
    return spans, pii.fit(spans)


def test_spans_and_redaction(spark):
    rows = [(i, t) for i, (t, _) in enumerate(TEXT)] * 30 + [(90, None), (91, ""), (92, "word " * 100_000), (None, TEXT[0][0]), (93, "with Jo Wu now"), (93, "was met by Jo Wu")]
    rows += [(100 + i, t) for i, (t, _) in enumerate(LABELLED)]
    df = spark.createDataFrame(rows, "start long, value string").withColumnRenamed("start", "rid")
    spans, model = model_of(spark, df)
    assert min(model.values()) < pii.ACCEPT < max(model.values())
    taken = pii.accept(spans, model)
    got, texts = {}, {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in taken.collect():
        got.setdefault(r.rid, set()).update((r.kind, t[r.start : r.end]) for t in texts[r.rid][-1:])
    assert {k: v for k, v in got.items() if k is not None and k < 90} == {i: want for i, (_, want) in enumerate(TEXT) if want}
    assert got[None] == TEXT[0][1] and ("name", "Jo Wu") in got[93]
    out = {}
    for r in pii.redact(df, ["rid"], "value", taken).collect():
        out.setdefault(r.rid, set()).add(r.redacted)
    assert out[0] == {"who replaced [NAME] for it"} and out[None] == out[0] and out[5] == {TEXT[5][0]} and out[90] == {None} and out[91] == {""} and out[92] == {"word " * 100_000}
    assert out[93] == {"with [NAME] now", "was met by [NAME]"}
    empty, none = model_of(spark, df.limit(0))
    assert pii.accept(empty, none).count() == 0 and pii.redact(df.limit(0), ["rid"], "value", pii.accept(empty, none)).count() == 0


def test_labelled_texts(spark):
    """What the model is worth: precision and recall over texts labelled by hand, against taking every proposal."""
    df = spark.createDataFrame(list(enumerate(t for t, _ in LABELLED)), "rid long, value string")
    spans, model = model_of(spark, df)
    truth = {(i, k, s) for i, (_, want) in enumerate(LABELLED) for k, s in want}
    found = lambda rows: {(r.rid, r.kind, LABELLED[r.rid][0][r.start : r.end]) for r in rows}
    every, taken = found(spans.collect()), found(pii.accept(spans, model).collect())
    share = lambda a, b: len(a & b) / len(b)
    print("proposals", len(every), "precision", share(truth, every), "taken", len(taken), "precision", share(truth, taken), "recall", share(taken, truth), "of proposals", share(every, truth))
    print(sorted(taken - truth), sorted(truth - taken))
    assert share(truth, taken) > share(truth, every) + 0.2
    assert share(truth, taken) >= 0.85 and share(taken, truth) >= 0.8


def test_overlaps_are_decided_alike():
    rng = random.Random(4)
    for _ in range(200):
        spans = sorted(((round(rng.random(), 1), a := rng.randint(0, 40), a + rng.randint(1, 12), rng.choice(pii.KINDS)) for _ in range(rng.randint(1, 14))), key=lambda s: (s[1], s[2]))
        taken = []
        for s in sorted(spans, key=lambda s: (-s[0], s[1] - s[2], s[1], pii.KINDS.index(s[3]))):
            if all(s[2] <= t[1] or t[2] <= s[1] for t in taken):
                taken.append(s)
        assert sorted(spans[k] for k in pii.choose(spans)) == sorted(taken)


def test_bloom_filter_and_names(spark):
    known = pii.names(people(spark), "title", "person")
    rows = {(r.hash, r.role) for r in known.collect()}
    h = lambda w: int(pii.word_hashes([w])[0].astype(np.int64))
    assert {(h("jo"), "given"), (h("wu"), "family"), (h("clara"), "given")} <= rows and (h("ng"), "given") not in rows
    f = pii.bloom(known)
    given = np.array([x for x, role in rows if role == "given"], np.int64).view(np.uint64)
    assert pii.in_bloom(f, given).all()
    assert pii.in_bloom(f, np.arange(1, 20000, dtype=np.uint64)).mean() < 0.01


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(2)
    n = 6000
    y = rng.random(n) < 0.5
    acc = [0.95, 0.9, 0.85, 0.55]
    votes = ["".join("0" if rng.random() < 0.2 else "+" if (rng.random() < p) == t else "-" for p in acc) for t in y]
    keys = sorted(set(votes))
    p = dict(zip(keys, pii.em_reliabilities(keys, np.array([votes.count(k) for k in keys], float))))
    hit = np.mean([(p[v] > 0.5) == t for v, t in zip(votes, y)])
    assert hit > 0.9
