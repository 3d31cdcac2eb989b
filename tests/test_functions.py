import random

import pytest
from pyspark.sql import functions as F

from sedimenta.config import EngineConfig, model_width
from sedimenta.functions import conversation_file as cf
from sedimenta.functions import markdown as md
from sedimenta.functions import porter, redaction
from sedimenta.functions import text as tx
from sedimenta.functions.arrow import column_function
from sedimenta.sources import vault

#: Words and stems of the published algorithm's own examples.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electriciti": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_stems():
    assert {w: porter.stem(w) for w in STEMS} == STEMS
    assert porter.tokens("Crème Brûlée, 2x!") == ["creme", "brule", "2x"]


def test_scalar_functions(spark):
    rows = [(" Foo Bar//x/ ", "people/ann", "## \n## My Head!\nx"), ("/", "flat", "no head"), (None, "/lead", None)]
    df = spark.createDataFrame(rows, "a string, slug string, t string")
    out = df.select(tx.resolve_slug(F.col("a")), tx.derive_wing(F.col("slug")), tx.derive_room(F.col("t")), tx.extract_summary(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("foo-bar/x", "people", "my-head", "x"), ("", "general", "", "no head"), (None, "general", "", None)]
    p = spark.createDataFrame([("01. Projects/x.md",), ("2_people/y.MD",), ("zzz/a",), ("flat.md",)], "p string")
    assert [r[0] for r in p.select(tx.type_from_folder(F.col("p"))).collect()] == ["project", "person", None, None]
    bad = spark.createDataFrame([("a/b.md", True), ("", False), ("/a", False), ("a//b", False), ("../x", False), ("c:/x", False), ("a/..", False)], "p string, ok boolean")
    assert bad.where(tx.relative_path_ok(F.col("p")) != F.col("ok")).count() == 0


def test_pages_round_trip():
    raw = "---\ntags:\n- a\n- b\ntitle: T\n---\nTruth\n\nmore\n---\n- e1\n"
    p = md.parse_page(raw)
    assert (p["truth"], p["timeline"]) == ("Truth\n\nmore", "- e1\n")
    assert md.render_page(p["frontmatter"], p["truth"], p["timeline"]) == raw
    broken = "---\n: : [\n---\nbody"
    assert md.parse_page(broken) == {"frontmatter": "{}", "truth": "", "timeline": ": : [\n---\nbody"}  # nothing is lost
    assert md.parse_page(None) is None and md.parse_page("")["truth"] == ""


@pytest.mark.parametrize("seed", range(20))
def test_chunk_windows(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice([f"word{i} ", f"{i}" + "ü" * 30 + " ", "\n", "\n\n", f"{i}" + "x" * 400]) for i in range(rng.randint(50, 600)))
    parts = md.windows(text)
    if len(text.encode()) <= md.LIMIT:
        assert parts == [text]
        return
    assert all(len(p.encode()) <= md.WINDOW for p in parts)
    at = 0
    for p in parts:  # each window begins within what was seen so far, or after blanks only
        k = text.find(p, max(0, at - len(p)))
        assert k >= 0 and (k <= at or not text[at:k].strip())
        at = k + len(p)
    assert not text[at:].strip()


def test_turns_round_trip():
    rng = random.Random(2)
    for _ in range(60):
        turns = [
            {
                "ordinal": i + 1, "role": rng.choice(["user", "tool"]), "ts": "2024-01-01T00:00:00Z",
                "content": "\n".join(rng.choice(["a", cf.BOUNDARY, cf.META, cf.ESCAPE + "z", "## Turn 1 · user · x", "```"]) for _ in range(rng.randint(1, 5))),
                "metadata": rng.choice([None, '{"k": 1}']),
            }
            for i in range(rng.randint(1, 4))
        ]
        assert cf.parse_turns(cf.render_turns(turns)) == turns


def test_facts():
    ok = '{"facts": [{"kind": "decision", "chose": "a", "summary": "s"}]}'
    assert len(cf.parse_facts(ok)["facts"]) == 1
    assert len(cf.parse_facts("Sure:\n```json\n" + ok + "\n```\nDone")["facts"]) == 1
    assert cf.parse_facts("no json")["errors"] and cf.parse_facts(None)["errors"]
    assert cf.parse_facts('{"facts": [{"kind": "fact", "about": " ", "summary": "s"}, {"kind": "zzz"}]}')["errors"] == ["0: fact needs about", "1: unknown kind zzz"]


def test_secrets():
    s = redaction.Session(["Project Zed", "Zed"])
    text = "mail a@b.com, a@b.com; key sk-abcdefghijklmnop1234; card 4111 1111 1111 1111; project zed and zed"
    out = s.scrub(text)
    assert out == "mail <EMAIL_1>, <EMAIL_1>; key <SECRET_3>; card <ACCOUNT_1>; <SECRET_1> and <SECRET_2>"
    assert s.rehydrate(out) == text and s.rehydrate("<EMAIL_9>") == "<EMAIL_9>"


def test_globs_and_vault(spark, tmp_path):
    assert vault.parse_ignore_file("# c\n\n*.tmp\n")[0] == ["*.tmp"]
    globs, errors = vault.parse_ignore_file("*.tmp\n[x\n")
    assert not globs and len(errors) == 1
    for p in ("a.md", "sub/B.MD", "sub/c.txt", ".git/d.md", "skip/e.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(f"# {p}")
    got = vault.read_vault(spark, str(tmp_path), ["skip/**"])
    assert {(r.rel_path, r.slug, r.text) for r in got.collect()} == {("a.md", "a", "# a.md"), ("sub/B.MD", "sub/B", "# sub/B.MD")}
    vault.write_files(got.withColumnRenamed("rel_path", "out_path"), str(tmp_path / "out"))
    assert (tmp_path / "out/sub/B.MD").read_text() == "# sub/B.MD"


def test_arrow_columns(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, n int")
    out = df.select(column_function(df, lambda s, n: None if s is None else s * n, "string", F.col("s"), F.col("n")).alias("x"))
    assert [r.x for r in out.collect()] == ["a", None]


def test_config():
    assert EngineConfig.from_rows({"graph_depth": "2", "relevance_floor": "x", "zzz": "1"}) == EngineConfig(graph_depth=2)
    assert model_width("base") == 768 and model_width("own", 7) == 7
    with pytest.raises(ValueError):
        model_width("own")
