"""Lexical retrieval: query clean-up, numeric aliases, BM25 and the tiered search.

Statistics (number of pages, average length, pages per phrase) cover the whole index, before any scope filter. The plain mode tokenizes with
built-in expressions; the porter mode uses an Arrow function. Only pages that hold a phrase of the query are scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import porter
from ..session import materialize, measured, ship

COLUMNS = ("title", "slug", "compiled_truth", "timeline")
K1, B = 1.2, 0.75
_OPERATORS = {"AND", "OR", "NOT", "NEAR"}
_MAGNITUDES = {"k": 10**3, "m": 10**6, "b": 10**9}


def sanitize(query: str) -> str:
    """Letters, digits and blanks only; upper-case operator words are quoted so that they are words."""
    words = "".join(c if c.isalnum() else " " for c in query).split()
    return " ".join(f'"{w}"' if w in _OPERATORS else w for w in words)


def only_operators(sanitized: str) -> bool:
    words = sanitized.split()
    return bool(words) and all(w.strip('"') in _OPERATORS and w.startswith('"') for w in words)


def is_only_operators(query: Column) -> Column:
    """Whether a query has words and all of them are operators in upper case."""
    words = F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}]+", " "))
    one = "(" + "|".join(sorted(_OPERATORS)) + ")"
    return words.rlike(f"^{one}( {one})*$")


def _grouped(digits: str) -> str | None:
    """Digits in groups of three from the right, if there are more than three."""
    return f"{int(digits):,}".replace(",", " ") if len(digits) > 3 and digits[0] != "0" else None if len(digits) <= 3 else re.sub(r"(?<=\d)(?=(?:\d{3})+$)", " ", digits)


def _fits(n: int) -> bool:
    return n < 2**64


def numeric_aliases(token: str) -> list[str]:
    """Other spellings of a number: 75k, 75000, '75 000'; 1500000 and '1 5m'."""
    if m := re.fullmatch(r"([0-9]+)([kKmMbB])", token):
        value = int(m[1]) * _MAGNITUDES[m[2].lower()]
        if not _fits(int(m[1])) or not _fits(value):
            return [token]
        return [token, str(value), *([g] if (g := _grouped(str(value))) else [])]
    if not re.fullmatch(r"[0-9]+", token):
        return [token]
    out = [token, *([g] if (g := _grouped(token)) else [])]
    value = int(token)
    if _fits(value * 10):
        for suffix, unit in (("b", 10**9), ("m", 10**6), ("k", 10**3)):
            if value >= unit:
                if value % unit == 0:
                    out.append(f"{value // unit}{suffix}")
                elif value * 10 % unit == 0:
                    out.append(f"{value // unit} {value % unit // (unit // 10)}{suffix}")
    return out


def fuse_numbers(words: list[str]) -> list[str]:
    """'75 000' becomes 75000 and '1 5m' 1500000; everything else stays."""
    out, i = [], 0
    while i < len(words):
        w, n = words[i], 1
        if re.fullmatch(r"[0-9]+", w):
            if len(w) <= 3:
                while i + n < len(words) and re.fullmatch(r"[0-9]{3}", words[i + n]):
                    n += 1
            if n > 1:
                w = "".join(words[i : i + n])
            elif i + 1 < len(words) and (m := re.fullmatch(r"([0-9])([kKmMbB])", words[i + 1])) and int(w) > 0:
                unit = _MAGNITUDES[m[2].lower()]
                value = int(w) * unit + int(m[1]) * (unit // 10)
                if _fits(int(w)) and _fits(value):
                    w, n = str(value), 2
        out.append(w)
        i += n
    return out


def clauses(sanitized: str) -> list[list[list[str]]]:
    """The query's clauses; each is a list of phrases that may stand for it, each phrase a list of words in lower case."""
    words = [w.strip('"') for w in sanitized.split()]
    return [[a.lower().split() for a in numeric_aliases(w)] for w in fuse_numbers(words)]


@dataclass(frozen=True)
class Raw:
    """A node of an expert query: op is phrase, prefix, and, or, not, near."""

    op: str
    parts: tuple = ()
    words: tuple[str, ...] = ()
    column: str | None = None


def parse_raw(query: str, stemmed: bool = False) -> Raw:
    """Expert syntax: "phrases", prefix*, AND, OR, NOT, NEAR(a b, n), column filters and parentheses. Bad syntax raises ValueError.

    stemmed: for an index in porter mode.
    """
    toks = re.findall(r'"(?:[^"]|"")*"\s*\*?|[()]|NEAR\s*\(|[\w]+\s*:|[\w]+\*?|,|\S', query)
    pos = 0

    def peek() -> str | None:
        return toks[pos] if pos < len(toks) else None

    def take() -> str:
        nonlocal pos
        if pos >= len(toks):
            raise ValueError("the query ends too early")
        pos += 1
        return toks[pos - 1]

    def primary(column: str | None) -> Raw:
        t = take()
        if t == "(":
            inner = either(column)
            if take() != ")":
                raise ValueError("a parenthesis is open")
            return inner
        if re.fullmatch(r"NEAR\s*\(", t):
            parts = []
            while peek() not in (")", ",", None):
                parts.append(primary(column))
            far = "10"
            if peek() == ",":
                take()
                far = take()
            if take() != ")" or not far.isdigit() or not parts:
                raise ValueError("NEAR is malformed")
            return Raw("near", tuple(parts), (far,))
        if t.rstrip().endswith(":") and len(t.strip()) > 1:
            name = t.rstrip()[:-1].strip()
            if name not in COLUMNS:
                raise ValueError(f"there is no column {name}")
            return primary(name)
        if t in _OPERATORS or not (t[0] == '"' or re.fullmatch(r"\w+\*?", t)):
            raise ValueError(f"syntax error near {t}")
        star = t.rstrip().endswith("*")
        words = tuple(porter.tokens(t.strip().rstrip("*").strip().strip('"'), stemmed))
        return Raw("prefix" if star else "phrase", words=words, column=column)

    def both(column: str | None) -> Raw:
        out = primary(column)
        while (t := peek()) not in (None, ")", "OR", ","):
            if t in ("AND", "NOT"):
                take()
            out = Raw("not" if t == "NOT" else "and", (out, primary(column)))
        return out

    def either(column: str | None) -> Raw:
        out = both(column)
        while peek() == "OR":
            take()
            out = Raw("or", (out, both(column)))
        return out

    if not toks:
        raise ValueError("the query is empty")
    tree = either(None)
    if peek() is not None:
        raise ValueError(f"syntax error near {peek()}")
    return tree


def raw_words(node: Raw) -> list[str]:
    """The words that a match may hold, for its score; those under NOT on the right don't count."""
    if node.op in ("phrase", "prefix"):
        return list(node.words)
    parts = node.parts[:1] if node.op == "not" else node.parts
    return [w for p in parts for w in raw_words(p)]


def index(pages: DataFrame, mode: str = "plain") -> DataFrame:
    """page_id, one token array per indexed column (t_title, ...), and dl; quarantined pages are left out. Other columns stay."""
    seen = pages.where(F.col("quarantined_at").isNull())
    if mode == "plain":
        cols = {f"t_{c}": F.coalesce(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>")) for c in COLUMNS}
    else:
        ship(pages.sparkSession)

        def cut(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in it:
                yield pa.array([porter.tokens(x) for x in a.to_pylist()], pa.list_(pa.string()))

        cut.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
        f = F.arrow_udf(cut, "array<string>")
        cols = {f"t_{c}": f(F.col(c)) for c in COLUMNS}
    out = seen.withColumns(cols)
    return out.withColumn("dl", sum((F.size(f"t_{c}") for c in COLUMNS), F.lit(0)))


def _count(phrase: list[str], column: str, prefix: bool = False) -> Column:
    """How often the phrase occurs in a column. The token array is only ever an argument, never used within a lambda: there it would be
    made anew for every position."""
    toks = F.col(f"t_{column}")

    def is_word(x: Column, k: int) -> Column:
        return x.startswith(phrase[k]) if prefix and k == len(phrase) - 1 else x == phrase[k]

    def before(k: int):
        return lambda x, rest: is_word(x, k) & F.coalesce(rest, F.lit(False))

    hit = F.transform(toks, lambda x: is_word(x, len(phrase) - 1))
    for k in range(len(phrase) - 2, -1, -1):  # a word counts where the rest of the phrase begins right after it
        hit = F.zip_with(toks, F.slice(hit, 2, 1 << 30), before(k))
    return F.size(F.filter(hit, lambda x: x))


def phrase_count(phrase: list[str], column: str | None = None, prefix: bool = False) -> Column:
    return sum((_count(phrase, c, prefix) for c in ((column,) if column else COLUMNS)), F.lit(0))


def _places(column: str, word: str) -> Column:
    return F.transform(F.col(f"t_{column}"), lambda x, i: F.when(x == word, i).otherwise(F.lit(-1)))


def _close(n: int, far: int):
    """Whether some place of the first part has a place of every other part at most `far` words between."""

    def near(i: Column, others: Column) -> Column:
        return F.exists(others, lambda j: F.abs(i - j) <= far + 1)

    def check(s: Column) -> Column:
        def all_near(i: Column) -> Column:
            ok = F.lit(True)
            for k in range(1, n):
                ok = ok & near(i, s[f"p{k}"])
            return ok

        return F.exists(s["p0"], all_near)

    return check


def raw_match(node: Raw) -> Column:
    """Whether a page of the index matches an expert query (NEAR as all of its parts within one column)."""
    if node.op in ("phrase", "prefix"):
        return phrase_count(list(node.words), node.column, node.op == "prefix") > 0 if node.words else F.lit(False)
    a = raw_match(node.parts[0])
    if node.op == "and":
        return a & raw_match(node.parts[1])
    if node.op == "or":
        return a | raw_match(node.parts[1])
    if node.op == "not":
        return a & ~raw_match(node.parts[1])
    far = int(node.words[0])
    found = F.lit(False)
    for c in COLUMNS:
        # The places of each part's first word, made once: the inner functions see them through a structure's fields.
        places = [
            F.filter(_places(c, p.words[0]), lambda i: i >= 0).alias(f"p{k}")
            for k, p in enumerate(node.parts)
        ]
        found = found | F.exists(F.array(F.struct(*places)), _close(len(places), far))
    return found


@dataclass(frozen=True)
class Postings:
    """An inverted index: postings (bucket, term, page_id, dl, places), sorted by term within buckets; docs: the pages' narrow columns; the
    number of pages and their mean length. A query reads the buckets and row groups of its words only."""

    postings: DataFrame
    docs: DataFrame
    n: int
    mean: float
    buckets: int


#: Places in one column; the column's number is above them, so that no phrase runs from one column into the next.
_COLUMN_STEP = 1 << 40
PAGES_A_BUCKET, MOST_BUCKETS = 50_000, 4096


def build(indexed: DataFrame) -> Postings:
    """The postings of an index(), written once."""
    wide = [f"t_{c}" for c in COLUMNS] + [c for c in ("compiled_truth", "timeline", "frontmatter") if c in indexed.columns]
    docs, row = measured(indexed.drop(*wide), "pages", n=F.count("*"), mean=F.avg("dl"))
    buckets = min(MOST_BUCKETS, max(8, row["n"] // PAGES_A_BUCKET))

    def placed(column: str, base: int) -> Column:
        return F.transform(f"t_{column}", lambda x, i: F.struct(x.alias("term"), (F.lit(base) + i).alias("at")))

    each = indexed.select("page_id", "dl", F.explode(F.concat(*(placed(c, k * _COLUMN_STEP) for k, c in enumerate(COLUMNS)))).alias("t")).select("page_id", "dl", "t.term", "t.at")
    rows = each.groupBy("term", "page_id", "dl").agg(F.sort_array(F.collect_list("at")).alias("places"))  # the places in one page
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).select("term", "page_id", "dl", "places", "bucket")
    # A word that most pages have is spread over several files of its bucket.
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(4))).sortWithinPartitions("bucket", "term")
    return Postings(materialize(rows, "postings", ["bucket"]), docs, row["n"], row["mean"] or 1.0, buckets)


def _counted(ix: Postings, query: list[list[list[str]]]) -> tuple[DataFrame, dict]:
    """(page_id, dl, f0, f1, ...) of the pages that hold a word of the query; and how many pages hold each phrase."""
    flat = [p for clause in query for p in clause]
    words = sorted({w for p in flat for w in p})
    at = [F.pmod(F.xxhash64(F.lit(w)), F.lit(ix.buckets)).cast("int") for w in words]
    hits = ix.postings.where(F.col("bucket").isin(*at) & F.col("term").isin(words))
    pages = hits.groupBy("page_id", "dl").agg(*(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{k}") for k, w in enumerate(words)))

    def begins(word: str, k: int) -> Column:
        return F.transform(f"p{words.index(word)}", lambda x: x - k)

    def times(phrase: list[str]) -> Column:
        starts = F.col(f"p{words.index(phrase[0])}")
        for k, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, begins(w, k))
        return F.coalesce(F.size(starts), F.lit(0))

    narrow = pages.select("page_id", "dl", *(F.greatest(times(p), F.lit(0)).alias(f"f{i}") for i, p in enumerate(flat)))
    return measured(narrow, "counted", **{f"n{i}": F.count_if(F.col(f"f{i}") > 0) for i in range(len(flat))})


def _score(counted: DataFrame, query: list[list[list[str]]], every: bool, n: int, mean: float, held: dict) -> DataFrame:
    score, at, hits = F.lit(0.0), 0, []
    for clause in query:
        hit = F.lit(False)
        for _ in clause:
            f, m = F.col(f"f{at}"), held[f"n{at}"]
            idf = max(math.log((n - m + 0.5) / (m + 0.5)), 0.0) or 1e-6
            score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / mean))).otherwise(0.0)
            hit = hit | (f > 0)
            at += 1
        hits.append(hit)
    keep = hits[0]
    for h in hits[1:]:
        keep = keep & h if every else keep | h
    return counted.where(keep).withColumn("score", score).drop(*(f"f{i}" for i in range(at)))


def _scored(ix: Postings, met: tuple[DataFrame, dict], query: list[list[list[str]]], every: bool, scope=None) -> DataFrame:
    out = _score(met[0], query, every, ix.n, ix.mean, met[1]).select("page_id", "score").join(ix.docs, "page_id")
    return scope(out) if scope else out


def postings_of(indexed: DataFrame | Postings) -> Postings:
    return indexed if isinstance(indexed, Postings) else build(indexed)


def bm25(indexed: DataFrame | Postings, query: list[list[list[str]]], every: bool, scope=None) -> DataFrame:
    """The pages' narrow columns with score, for those that match one (or every) clause. scope: a function of the matched pages.

    Phrases occurring in a query twice count twice. A phrase in half of the pages or more weighs 1e-6.
    """
    ix = postings_of(indexed)
    if not any(query):
        return ix.docs.where("false").withColumn("score", F.lit(0.0))
    return _scored(ix, _counted(ix, query), query, every, scope)


def top(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col("page_id")).limit(limit)


def tiered(indexed: DataFrame | Postings, sanitized: str, limit: int, scope=None, columns: tuple[str, ...] = ("page_id", "slug", "title", "summary", "wing")) -> DataFrame:
    """(columns, score, tier): pages with every clause first; if they are fewer than limit, pages with any clause below them."""
    ix, q = postings_of(indexed), clauses(sanitized)
    if not q:
        return ix.docs.where("false").select(*columns, F.lit(0.0).alias("score"), F.lit(0).alias("tier"))
    met = _counted(ix, q)
    first = top(_scored(ix, met, q, True, scope), limit).select(*columns, "score").withColumn("tier", F.lit(0))
    if len(q) <= 1:
        return first
    rest = top(_scored(ix, met, q, False, scope), 2 * limit).select(*columns, "score").withColumn("tier", F.lit(1))
    both = first.unionByName(rest.join(first.select("page_id"), "page_id", "left_anti").select(*first.columns))
    # At most three times `limit` rows from here on.
    w = Window.partitionBy("tier").orderBy(F.col("score").desc(), "page_id")
    all_ = Window.partitionBy(F.lit(1))
    ranked = both.withColumn("rn", F.row_number().over(w)).withColumn("low", F.min(F.when(F.col("tier") == 0, F.col("score"))).over(all_))
    step = F.greatest(F.abs("low"), F.lit(1.0)) * 1e-6
    score = F.when((F.col("tier") == 1) & F.col("low").isNotNull(), F.col("low") - F.col("rn") * step).otherwise(F.col("score"))
    return ranked.withColumn("score", score).orderBy(F.col("score").desc(), "page_id").limit(limit).select(*columns, "score", "tier")
