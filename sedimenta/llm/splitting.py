"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

Every place where a text may be cut is a boundary with a level (heading, entry, paragraph, line, sentence, word, character). For
each boundary e that ends a piece, the next piece begins about `overlap` bytes earlier and ends at the farthest legal boundary of
the best level in reach: that is e's successor. The successors of all boundaries of all texts in a batch are found by sorted
look-ups (a merge join of boundaries with boundaries). The successor table is then squared again and again; round k adds to the
cuts known so far their 2^k-th successors, so all cuts of all texts are known after log2(pieces) rounds, without a loop over
texts or pieces. A text is one value of one row, so nothing is shuffled.

Defined results
* a piece has at most `limit` bytes of UTF-8 and never breaks a character; combining marks, joiners, variation selectors and a
  line feed after a carriage return stay with what they follow, where a piece can hold that.
* pieces in order, each without the bytes it repeats, give back the text exactly; each piece after the first repeats `overlap`
  to `overlap` + SLACK bytes of the one before (less only where `limit` leaves no room).
* texts of at most `limit` bytes are left out, or come as one piece with keep_small; null texts give nothing.
* repeated rows give repeated pieces; empty tables an empty result; the key's columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import words as wd

LIMIT, OVERLAP = 1920, 240
#: Bytes of one text whose boundaries are held at once; boundaries take about a hundred bytes of memory each.
SEGMENT = 1 << 22
#: How much more than `overlap` a piece may repeat so as to begin at a sentence or word.
SLACK = 40
HEADING, ENTRY, PARAGRAPH, LINE, SENTENCE, WORD, CHAR, BYTE = 7, 6, 5, 4, 3, 2, 1, 0
#: A natural cut is taken if the piece is at least so full; of the levels that are, the best is taken.
FILL = 0.5

_BREAK = rb"(?:\r\n|\n|\r|\xe2\x80[\xa8\xa9])"
_MARKS = [
    (LINE, re.compile(_BREAK)),
    (PARAGRAPH, re.compile(_BREAK + rb"(?:[ \t]*" + _BREAK + rb")+")),
    (ENTRY, re.compile(_BREAK + rb"(?=(?:---[ \t]*(?:\r|\n|$)|[-*+] |[0-9]{1,3}[.)] ))")),
    (HEADING, re.compile(_BREAK + rb"(?=#{1,6}[ \t])")),
    (SENTENCE, re.compile(rb"(?:[.!?]+[\"')\]]*[ \t]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+)")),
]


def boundary_levels(raw: bytes) -> np.ndarray:
    """For each byte position 0..len: the level at which the text may be cut before it, or -1 for none."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    level = np.full(n + 1, -1, np.int8)
    level[:n][(b & 0xC0) != 0x80] = CHAR
    blank = np.flatnonzero((b[:-1] == 32) | (b[:-1] == 9)) + 1
    level[blank] = np.maximum(level[blank], WORD)
    for rank, pattern in (_MARKS[4], *_MARKS[:4]):
        for m in pattern.finditer(raw):
            if level[m.end()] < rank:
                level[m.end()] = rank
    # What belongs to the character before it is cut off only where nothing else fits.
    if n > 1:
        two = (b[:-1].astype(np.int32) << 8) | b[1:]
        tied = np.zeros(n + 1, bool)
        tied[: n - 1] |= (two >= 0xCC80) & (two <= 0xCDAF)  # combining marks
        tied[: n - 1] |= (two == 0xEFB8) & (np.append(b[2:], 0)[: n - 1] >= 0x80) & (np.append(b[2:], 0)[: n - 1] <= 0x8F)  # variation selectors
        tied[1:n] |= two == 0x0D0A
        if n > 2:
            three = (two[:-1] << 8) | b[2:]
            join = np.flatnonzero(three == 0xE2808D)  # zero-width joiner
            tied[join] = True
            tied[join + 3] = True
            if n > 3:
                tied[np.flatnonzero((three[:-1] == 0xF09F8F) & (b[3:] >= 0xBB) & (b[3:] <= 0xBF))] = True  # skin tones
        level[tied & (level >= 0)] = BYTE
    level[0] = level[n] = HEADING
    return level


def _last(sorted_at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest entry of sorted_at that is at most each of `most`, or -1."""
    i = np.searchsorted(sorted_at, most, side="right") - 1
    return np.where(i >= 0, sorted_at[np.maximum(i, 0)] if len(sorted_at) else -1, -1)


def cuts(texts: list[bytes], limit: int = LIMIT, overlap: int = OVERLAP, begin: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of all pieces of all texts, in order. Every text must be longer than `limit` bytes.

    begin: the cut (a boundary) from which the texts are gone through.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    # One axis for all texts: positions of different texts are more than `limit` apart, so no look-up strays.
    base = np.concatenate([[0], np.cumsum(sizes + 2 * limit)])[:-1]
    at, lv = [], []
    for t, off in zip(texts, base):
        level = boundary_levels(t)
        keep = np.flatnonzero(level >= 0)
        at.append(keep + off)
        lv.append(level[keep])
    at, lv = np.concatenate(at), np.concatenate(lv)
    end_of = np.repeat(base + sizes, [len(x) for x in np.split(at, np.searchsorted(at, base[1:]))])
    begin_of = np.repeat(base, [len(x) for x in np.split(at, np.searchsorted(at, base[1:]))])
    by_level = {k: at[lv >= k] for k in range(BYTE, HEADING + 1)}

    # Where the piece after a cut at `at` begins: a sentence, word or character start that repeats `overlap` bytes or a bit more.
    start = np.full(len(at), -1, np.int64)
    for k in (SENTENCE, WORD, CHAR, BYTE):
        found = _last(by_level[k], at - overlap)
        room = overlap + (SLACK if k > CHAR else 8 if k == CHAR else limit)
        start = np.where((start < 0) & (found >= at - room), found, start)
    start = np.maximum(start, begin_of)
    start[at == begin_of] = at[at == begin_of]  # the beginning of a text repeats nothing

    # Where it ends: the best level that fills the piece and goes on beyond the cut; else the farthest boundary of any level.
    succ = np.full(len(at), -1, np.int64)
    reach = np.minimum(start + limit, end_of)
    succ[reach == end_of] = end_of[reach == end_of]
    least = np.maximum(at + 1, start + int(limit * FILL))
    for k in (HEADING, ENTRY, PARAGRAPH, LINE, SENTENCE, WORD, CHAR, BYTE):
        found = _last(by_level[k], reach)
        succ = np.where((succ < 0) & (found >= (least if k > WORD else at + 1)), found, succ)
    stuck = (succ < 0) | (succ <= at)  # a repeat that leaves no room to go on: begin at the cut itself
    stuck &= at < end_of
    if stuck.any():
        start[stuck] = at[stuck]
        found = _last(by_level[BYTE], np.minimum(at + limit, end_of))
        succ = np.where(stuck, found, succ)
    nxt = np.searchsorted(at, np.where(at == end_of, at, succ))

    # Doubling: reached is closed under the first 2^k successors after round k.
    reached = np.zeros(len(at), bool)
    reached[np.searchsorted(at, base + begin)] = True
    jump = nxt
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    cut = np.flatnonzero(reached & (at < end_of))
    text = np.searchsorted(base, at[cut], side="right") - 1
    return text, start[cut] - base[text], at[nxt[cut]] - base[text]


def long_cuts(text: bytes, limit: int = LIMIT, overlap: int = OVERLAP, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces of a text of any length, as cuts() gives them, in segments of bounded size.

    A piece depends on what lies within `limit` and `overlap` of the cut it begins after. So each segment begins well before the last cut,
    and of its pieces those near its end are left to the next one.
    """
    lo, hi, cut = [], [], 0
    while True:
        a, z = max(0, cut - 4 * limit), min(len(text), cut + segment)
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        _, s, e = cuts([text[a:z]], limit, overlap, cut - a)
        keep = len(s) if z == len(text) else int(np.searchsorted(e, z - a - 2 * limit))
        lo.append(s[:keep] + a)
        hi.append(e[:keep] + a)
        if z == len(text):
            return np.concatenate(lo), np.concatenate(hi)
        cut = int(hi[-1][-1])


def split_oversized(
    items: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, keep_small: bool = False
) -> DataFrame:
    """keys + (piece_no, n_pieces, byte_from, byte_until, repeats, piece) of every text longer than `limit` bytes."""
    if not 0 <= overlap <= limit // 2 - SLACK:
        raise ValueError("the overlap must leave half a piece to go on")
    ship(items.sparkSession)
    rows = items.select(*keys, F.col(text_col).alias("__text"))
    rows = rows.where(F.col("__text").isNotNull() if keep_small else F.octet_length("__text") > limit)
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces")]
        + [T.StructField(n, T.LongType()) for n in ("byte_from", "byte_until", "repeats")]
        + [T.StructField("piece", T.StringType())]
    )

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            raw = [x.as_py().encode("utf-8", "surrogatepass") for x in b["__text"]]
            sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw))
            large = np.flatnonzero(sizes > limit)
            row, lo, hi = [np.flatnonzero(sizes <= limit)], [np.zeros(len(raw) - len(large), np.int64)], [sizes[sizes <= limit]]
            usual = large[sizes[large] <= SEGMENT]
            for part in (usual[x] for x in wd.chunks(sizes[usual].tolist())):
                t, s, e = cuts([raw[i] for i in part], limit, overlap)
                row.append(part[t])
                lo.append(s)
                hi.append(e)
            for i in large[sizes[large] > SEGMENT]:
                s, e = long_cuts(raw[i], limit, overlap)
                row.append(np.full(len(s), i))
                lo.append(s)
                hi.append(e)
            row, lo, hi = (np.concatenate(x) for x in (row, lo, hi))
            order = np.lexsort((lo, row))
            row, lo, hi = row[order], lo[order], hi[order]
            first = np.searchsorted(row, row)
            no = np.arange(len(row)) - first
            repeats = np.zeros(len(row), np.int64)
            if len(row) > 1:
                repeats[1:] = np.where(row[1:] == row[:-1], hi[:-1] - lo[1:], 0)
            take = pa.array(row)
            pieces = pa.array([raw[r][a:z].decode("utf-8", "surrogatepass") for r, a, z in zip(row, lo, hi)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b[k].take(take) for k in keys]
                + [pa.array(no, pa.int32()), pa.array(np.bincount(row, minlength=len(raw))[row], pa.int32())]
                + [pa.array(x, pa.int64()) for x in (lo, hi, repeats)]
                + [pieces],
                [*keys, "piece_no", "n_pieces", "byte_from", "byte_until", "repeats", "piece"],
            )

    return rows.mapInArrow(split, schema)


def join_pieces(pieces: list[tuple[bytes, int]]) -> bytes:
    """The text again, from (piece, bytes it repeats) in order."""
    return b"".join(p[r:] for p, r in pieces)
