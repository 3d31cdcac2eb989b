"""Keyword-stuffed pages, link lists and tag lists, by how far blocks of text compress.

A text is cut into blocks of about a kilobyte at blank lines and lines. A block is compressed over the alphabet of its words: every word,
link and number becomes a code of four bytes, so that what compresses is repetition of words and phrases, however odd the words are
spelled. The ratio is normalized by length and language: it is divided by the usual ratio, the median over all texts of the corpus in
the same language, script and length class. A block is stuffed if it is redundant (below REDUNDANT of the usual ratio) and this
is confirmed by a low density of sentences (fewer than SENTENCES ends of telling sentences in a hundred words). A sentence tells
something if it has LEAST_SENTENCE words or more and half of them aren't said again and again in the block, so that stuffing in the shape of
sentences has none. A text is flagged if more than half of its words are in stuffed blocks.

Defined results
* null and empty texts, and texts without words, are not flagged and have no blocks.
* language is compared in lower case; a missing or odd language counts with all texts of the same script.
* the usual ratio of a small class is drawn towards that of the next wider one (script and length, script and octave of length, script, all texts), by PRIOR texts.
* repeated rows of one id are one text's blocks repeated, which changes no share; ties are not stuffed; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

BLOCK, LONG = 512, 1024
REDUNDANT, SENTENCES, LEAST_SENTENCE, SHARE = 0.85, 1.6, 4, 0.5
#: How many texts' worth of the wider class's median is mixed into a class's own.
PRIOR = 50
_OWN_SCRIPT = {"ja", "zh", "ko"}

_END = re.compile(r"""[.!?](?<=\S.)[.!?]*+["')\]*_`]*(?=\s|$|\\n|["'<|])|[。！？]""")
_MARK = re.compile(r"(?m)^[ \t]*(?:\d{1,4}[.)]|[-*•+])[ \t]+")
_FIELDS = re.compile(r"\A---\r?\n(?:(?:[\w-]+:.*|[ \t]+.*|- .*|[ \t]*)\r?\n)*?---[ \t]*(?:\r?\n|\Z)")
_FOLD = re.compile(r"""\[\[[^\]\n]*+\]\]|\]\([^)\s]*+\)|href=["'][^"'\n]*+["']|(?:https?://|www\.)\S++|(?<![\w-])[\w-]++(?:\.[\w-]*[a-z][\w-]*+)++(?:/\S*+)?|\d++""")
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|\x01")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def blocks(text: str) -> list[str]:
    """The text in blocks; long lines are cut at blanks, and where there are none at LONG characters."""
    out, held, size = [], [], 0

    def emit() -> None:
        nonlocal held, size
        if size:
            out.append("".join(held))
        held, size = [], 0

    front = _FIELDS.match(text)  # fields before a page's text are no part of it; a front that isn't all fields is
    for line in (text[front.end() :] if front and front.end() < len(text) else text).splitlines(keepends=True):
        while len(line) > LONG + BLOCK:
            cut = line.rfind(" ", BLOCK, LONG) + 1 or LONG
            emit()
            out.append(line[:cut])
            line = line[cut:]
        blank = not line.strip()
        if size + len(line) > LONG or (blank and size >= BLOCK):
            emit()
        held.append(line)
        size += len(line) if not blank or size else 0
    if size and size < BLOCK // 2 and out:  # a short rest goes with the block before
        out[-1] += "".join(held)
    else:
        emit()
    return out


def length_class(n: int) -> int:
    """Quarter steps of the length's binary logarithm."""
    return int(4 * np.log2(max(n, 1)))


def tokens(text: str, folded: bool = False) -> list[str]:
    """Words in lower case, scripts without blanks in pairs of characters. folded: links and numbers as one sign."""
    found = _TOKEN.findall(_FOLD.sub("\x01", text).lower()) if folded else _WORD.findall(text.lower())
    if not _CJK.search(text):
        return found
    return [x for t in found for x in ([t[k : k + 2] for k in range(max(1, len(t) - 1))] if _CJK.search(t) else (t,))]


def ratio(found: list[str]) -> float:
    """The compressed size of a block over the alphabet of its words, as a part of its size."""
    codes = b"".join(zlib.crc32(t.encode("utf-8", "surrogatepass")).to_bytes(4, "little") for t in found)
    return max(0, len(zlib.compress(codes, 6)) - 11) / max(1, len(codes))


def telling(part: str, often: set[str]) -> int:
    """How many sentences of a block end that have words enough of their own."""
    body, at, n = _MARK.sub("", part), 0, 0
    for m in _END.finditer(body):
        said = tokens(body[at : m.end()])
        n += len(said) >= LEAST_SENTENCE and 2 * sum(t in often for t in said) < len(said)
        at = m.end()
    return n


def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids, langs, rows = b["doc_id"], b["lang"].to_pylist(), []
        for i, text in enumerate(b["text"].to_pylist()):
            lang = (langs[i] or "").strip().lower()
            lang = lang if re.fullmatch("[a-z]{2,3}", lang) else ""
            for no, part in enumerate(blocks(text) if text else ()):
                n = len(_WORD.findall(part))
                if not n:
                    continue
                cjk = len(_CJK.findall(part))
                if cjk:  # such scripts leave no blanks between words: two characters count as one
                    n += cjk // 2
                found = tokens(part, folded=True)
                often = {t for t, k in Counter(tokens(part)).items() if k > 2}
                script = "cjk" if 3 * cjk > len(part) else "other"
                named = "" if lang in _OWN_SCRIPT and script == "other" else lang  # the text isn't in the language it is said to be in
                rows.append((i, no, n, length_class(len(found)), ratio(found), telling(part, often), named, script))
        if rows:
            at, no, n, size, r, ends, lang, script = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array(no, pa.int32()), pa.array(n, pa.int32()), pa.array(size, pa.int32())]
                + [pa.array(r, pa.float64()), pa.array(ends, pa.int32()), pa.array(lang), pa.array(script)],
                ["doc_id", "block_no", "n_words", "length_class", "ratio", "ends", "lang", "script"],
            )


_SCHEMA = "doc_id long, block_no int, n_words int, length_class int, ratio double, ends int, lang string, script string"


def score_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every block with its ratio as a part of the usual one (relative), its telling sentences per hundred words, and whether it is stuffed."""
    ship(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = materialize(rows.mapInArrow(measure, _SCHEMA), "blocks")
    # Medians by language, script and length: one small row each, however large the corpus.
    # A text counts once in a class, however many blocks or repeated rows it has there.
    each = found.groupBy("doc_id", "lang", "script", "length_class").agg(F.avg("ratio").alias("ratio"))
    all_ = each.agg(F.percentile_approx("ratio", 0.5, 1000)).first()[0] or 1.0
    octave, each = F.floor(F.col("length_class") / 4).alias("octave"), each.withColumn("octave", F.floor(F.col("length_class") / 4))
    out = found.withColumn("usual", F.lit(float(all_))).withColumn("octave", octave)
    for keys in (["script"], ["script", "octave"], ["script", "length_class"], ["lang", "script", "length_class"]):
        m = each.groupBy(*keys).agg(F.percentile_approx("ratio", 0.5, 1000).alias("m"), F.count("*").alias("m_n"))
        out = out.join(F.broadcast(m), keys)  # at most 26^3 languages times two scripts times about a hundred lengths
        out = out.withColumn("usual", (F.col("m") * F.col("m_n") + PRIOR * F.col("usual")) / (F.col("m_n") + PRIOR)).drop("m", "m_n")
    out = out.drop("octave")
    out = out.withColumn("relative", F.col("ratio") / F.col("usual")).withColumn("sentences", 100 * F.col("ends") / F.col("n_words"))
    return out.withColumn("stuffed", (F.col("relative") < REDUNDANT) & (F.col("sentences") < SENTENCES))


def score_documents(scored: DataFrame) -> DataFrame:
    """(doc_id, n_words, stuffed_share, relative, sentences, flagged) from score_blocks()."""
    w = F.col("n_words")
    out = scored.groupBy("doc_id").agg(
        F.sum(w).alias("n_words"),
        (F.sum(F.when(F.col("stuffed"), w).otherwise(0)) / F.sum(w)).alias("stuffed_share"),
        (F.sum(w * F.col("relative")) / F.sum(w)).alias("relative"),
        (100 * F.sum("ends") / F.sum(w)).alias("sentences"),
    )
    return out.withColumn("flagged", F.col("stuffed_share") > SHARE)
