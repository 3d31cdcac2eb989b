"""Personal information in free text, by weak supervision.

Labelers (patterns, gazetteers, context words, the case and the commonness of words) look at widely proposed spans and vote on each: for,
against, or not at all. Proposals are wide on purpose: every run of seven digits or more, everything around an @, every number before a
word for a street, every word beside a given name; most labelers disagree on many of them. How reliable a labeler is isn't given:
expectation-maximisation estimates it, per kind of span, from the counts of all vote patterns over the whole corpus. The estimated
probabilities then train a span classifier (logistic regression on the votes and the span's shape), and what it gives 0.5 or more is
taken. Votes and shapes are few, so what reaches the driver is a table of counts whose size doesn't grow with the corpus; nothing
is sampled.

Gazetteers. Given and family names are a list of fixed values and the names of person pages. They may be any number: the executors hold a
Bloom filter of at most BLOOM_BITS bits, which only limits what is proposed, and an exact join with the table of names decides. Common
words are those that make up COMMON_PART of all words in lower case, so there are 1 / COMMON_PART of them at most.

Defined results
* null and empty texts hold nothing; repeated rows give the same finding once; an empty table gives an empty result.
* of spans that overlap, the likelier one counts, then the longer, then the one that begins first, then the kind first in KINDS.
* redaction replaces exactly the accepted spans and leaves every other character as it was; a null text stays null.
* other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship
from . import words as wd

KINDS = ("email", "phone", "id_number", "address", "name")
ACCEPT = 0.5
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 4
COMMON_PART = 1e-5
#: A word is a given name if this many person pages begin with it and at least half of all pages that begin with it are person pages.
LEAST_PEOPLE = 3

#: Given names (fixed values), besides those the person pages show.
GIVEN = (
    "Adam Aisha Alice Amara Ana Andre Andrea Anna Anne Antonio Astrid Ben Carlos Carmen Chen Clara Claire Daniel David Elena Emily Emma Eric "
    "Fatima Felix George Greta Hannah Hans Helen Hugo Ingrid Ivan James Jan Jane Javier Jean John Jonas Jose Juan Julia Karim Karl Kwame Laura Leila "
    "Linda Lucas Lucia Lukas Luis Maria Marie Mark Martin Mateo Mei Michael Miguel Miriam Mohammed Nadia Nina Noor Olga Omar Oscar Paul Paulo Pedro "
    "Peter Pierre Priya Rafael Robert Rosa Samuel Sara Sarah Simon Sofia Stefan Sven Thomas Tomas Viktor William Yuki Zainab"
).split()
#: Titles before a family name (fixed values).
_TITLES = "mr mrs ms miss mx dr prof professor doctor sir dame herr frau señor señora sra sr mme mlle monsieur madame rev".split()
_W = r"[^\W\d_]+(?:(?:[-‐]|[’'](?!s\b))[^\W\d_]+)*"
_GAP = r"[\s*_`]{1,4}"
_FORWARD = re.compile(rf"(?:{_GAP}[^\W\d_]\.?(?=[\s*_`])){{0,2}}{_GAP}({_W})")
_BACKWARD = re.compile(rf"({_W})(,?){_GAP}$")
_TITLED = re.compile(rf"([^\W\d_]+)(\.?){_GAP}(?:[^\W\d_]\.{_GAP}?){{0,2}}({_W}(?=[ ]+[^\Wa-z\d_][^\W\d_]))?(?(3)[ ]+)({_W})")
#: Endings of the names of firms and places (legal forms, kinds of streets, buildings and landscapes).
_FIRM = r"(?:Inc|Ltd|LLC|GmbH|AG|SA|Corp|Co|PLC|Sons|Daughters|Brothers|Partners|Holdings|Foundry|Works|Systems|Labs|Press|Freight|Analytics|Collective|Health|Group|Bank|Studio|Software)"
_SPOT = r"(?:Street|Str|Road|Avenue|Ave|Lane|Court|Drive|Square|Place|Terrace|Station|Bridge|River|Park|Hall|House|School|Hill|Bay|Island|Valley)"
_FIRM_AFTER = re.compile(rf"\s*(?:,?\s*{_FIRM}\b|,?\s*{_SPOT}\b|&|and\s+(?:Sons|Daughters|Brothers|Partners)\b)")
_FIRM_IS = re.compile(rf"(?:{_FIRM}|{_SPOT})$", re.I)
_PERSON_BEFORE = re.compile(r"(?:\b(?:by|with|from|contact|author|ask|met|cc|attn|dear|hi|hello|signed|owner|name|to|for|and|of|is|who)|[:|(,]|^)\s*[*_`]*$", re.I)
_THING_AFTER = re.compile(r"\s*(?:\w+\s+){0,2}(?:is|was)\s+(?:only\s+|just\s+)?(?:the|a|an|our)\s+(?:\w+\s+)?(?:name|project|product|server|cluster|release|tool|service)\b", re.I)
_CAPITAL_AFTER = re.compile(r"[ ]+[A-ZÀ-Þ][a-zß-ÿ]")

_MAIL = re.compile(r"(?:mailto:)?[\w+%][\w.+%'-]{0,63} ?[@＠] ?[\w-]{1,63}(?: ?[.．] ?[\w-]{1,63})*", re.I)
_MAIL_STRICT = re.compile(r"(?:mailto:)?[\w+%][\w.+%'-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}", re.I)
_AT = re.compile(r"\s{0,2}[\[({<]\s?at\s?[\])}>]|\s(?:at|@)\s", re.I)
_SPELT_BEFORE = re.compile(r"(?<![\w@/.+%-])[\w+%][\w.+%-]{0,63}(?:\s{0,2}(?:[\[({<]\s?dot\s?[\])}>]|\bdot\b)\s{0,2}[\w+%-]{1,40}){0,3}$", re.I)
_SPELT_AFTER = re.compile(r"\s{0,2}[\w-]{1,63}(?:\s{0,2}(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s|\.(?=\w))\s{0,2}[\w-]{2,63})+", re.I)
#: Common and reserved top-level domains (fixed values).
_TOP = re.compile(r"(?:com|org|net|edu|gov|info|example|test|invalid|local|localhost|io|co|uk|de|fr|es|it|nl|se|pl|jp|eu|us|ca|au)$", re.I)
_MAIL_NEAR = re.compile(r"\b(?:e-?mails?|mail(?:ed|box)?|invite|bounced|repl(?:y|ies)|sent|send|account|contact|write|cc|asked|address)\b", re.I)

_B = " \u00a0\u2009\u202f"  # blanks within numbers
_DIGITS = re.compile(rf"(?<![\w@])(?:\+ ?)?\(?\+?\d(?:[\d().–/-]|[{_B}](?=[\d(+])){{4,}}\d(?:\s{{0,2}}(?:ext\.?|extension|x)\s?\d{{1,5}})?(?![\w])", re.I)
_EXT = re.compile(r"\s{0,2}(?:ext\.?|extension|x)\s?\d{1,5}$", re.I)
_S = f"[{_B}.–-]?"
_PHONE = re.compile(
    rf"(?:\+|00){_S}\d{{1,3}}{_S}(?:\(0\))?{_S}\d[\d(){_B}./–-]{{5,16}}|(?:\+?1{_S})?\(?[2-9]\d\d\)?{_S}[2-9]\d\d{_S}\d{{4}}"
    rf"|\(?0\d{{1,4}}\)?{_S}(?:\d{{2,4}}{_S}){{1,3}}\d{{2,4}}|0\d(?:{_S}\d\d){{4}}|0\d{{2,4}}[ /-]\d{{3,}}[ -]?\d+"
)
_PHONE_SURE = re.compile(rf"(?:\+|00)|\(?\d{{3}}\)?[{_B}.-]\d{{3}}[{_B}.-]\d{{4}}$|0\d{{1,4}}[{_B}.-]\d|\(0?\d{{2,4}}\)")
_ID_DIGITS = re.compile(rf"\d{{3}}[{_B}-]\d{{2}}[{_B}-]\d{{4}}|\d{{6}}[-/]\d{{4}}|\d{{2}}[{_B}]\d{{3}}[{_B}]\d{{3}}[{_B}]\d{{3}}")
_ID_SURE = re.compile(r"\d{3}-\d{2}-\d{4}")
_ID_BARE = re.compile(rf"[\d{_B}.-]{{8,16}}")
_OTHER_NUMBER = re.compile(
    r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}.*|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)?\d\d|(?:19|20)\d{6}(?:[-.]?\d+)?|\d{1,3}(?:\.\d{1,3}){3}|\d+(?:\.\d+){2,}"
    r"|(?:19|20)\d\d[–-](?:19|20)\d\d|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.,]\d+|\d+(?::\d+)+.*|\d+/\d+"
)
_PHONE_NEAR = re.compile(r"\b(?:call(?:ed|back)?|phone|tele?(?:phone)?|mobile|cell|fax|sms|ring|reach|text|dial|whatsapp|hotline|evenings|handy|tél)\b", re.I)
_NUMBER_NEAR = re.compile(r"\bnumber\b", re.I)
_ID_NEAR = re.compile(r"\b(?:ssn|social (?:security|insurance)|national (?:insurance|id)|ni (?:number|no)|passport|licen[cs]e|driving|tax|personal id|identity|id card|id(?:entity)? (?:number|no)|dni|nie|steuer|nino|insurance)", re.I)
_THING_NEAR = re.compile(r"\b(?:run|build|order|version|ticket|sku|invoice|session|commit|issue|port|isbn|serial|batch|part|release|error|rows|pages|took|v)\W{0,3}$", re.I)
_ID_WORD = re.compile(rf"(?<![\w+/=-])(?:[A-Za-z]{{2}}[{_B}]?\d{{2}}[{_B}]?\d{{2}}[{_B}]?\d{{2}}[{_B}]?[A-Da-d]|[A-Za-z]{{1,5}}[{_B}-]?\d{{5,9}}[A-Za-z\d]{{0,3}}|\d{{8}}[A-Za-z])(?![\w+/=-])")
_ID_RUN = re.compile(rf"\d{{5,9}}|\d{{2}}(?:[{_B}]\d{{2}}){{2}}")
_ID_LETTERS = re.compile(rf"(?<![\w+/=-])[A-Za-z]{{1,5}}[{_B}-]?$")
_ID_STRICT = re.compile(rf"[A-Z]{{2}}[{_B}]?\d{{2}}[{_B}]?\d{{2}}[{_B}]?\d{{2}}[{_B}]?[A-D]|[A-Z]{{5}}9?\d{{6}}[A-Z\d]{{2,3}}", re.I)
_ID_SHAPE = re.compile(rf"[A-Z]{{1,3}}[{_B}]?\d{{6,9}}[A-Z]?|\d{{8}}[A-Z]", re.I)

_HOUSE = re.compile(r"(?<![\w.\-/:$€£])(?<!\d,)\d{1,4}(?: ?[a-dA-D](?=[\s,]))?(?!\w|[.,:/-]\d)")
_TYPES = r"(?:Street|Str|St|Road|Rd|Avenue|Ave|Av|Lane|Ln|Court|Ct|Drive|Dr|Close|Way|Place|Pl|Square|Sq|Terrace|Ter|Boulevard|Blvd|Crescent|Cres|Gardens|Row|Hill|Mews|Parade|Highway|Walk|Quay|Alley)"
_NEAR_NO = 120
_AFTER_NO = re.compile(rf",?[ \n]((?:[^\W\d_][\w'’-]* |[A-Z][a-z]{{0,2}}\. ){{1,3}}?)({_TYPES})(?:\b\.?)(?!\w)", re.I)
#: Kinds of streets that are plain words too.
_PLAIN = {"row", "way", "place", "close", "hill", "walk", "drive", "square", "parade", "gardens", "quay", "ter", "pl", "dr", "av"}
_AFTER_FR = re.compile(r",? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\b(?: (?:de|la|le|du|des|l['’])){0,2} ?[^\W\d_][\w'’-]*(?: [A-ZÀ-Þ][\w'’-]*){0,2}", re.I)
_BEFORE_NO = re.compile(r"\b(?:calle|c/|rue|via|avenida|avda\.?|av\.?|plaza|paseo|carrer|camino|viale|piazza|avenue|boulevard|chemin|allée|place|quai)\s+(?:(?:de|la|las|los|el|del|du|des|le)\s+){0,2}[^\W\d_][\w'’-]*(?:\s[A-ZÀ-Þ][\w'’-]*){0,2},?\s*(?:n[°º.]?\s*)?$", re.I)
_WAY = re.compile(r"[Cc](?:alle|/|arrer|amino|hemin)|[Rr]ue|[Vv]ia|[Aa]ve?|[Pp](?:la|ase|iaz)|[Bb]oul|[Aa]ll[ée]|[Qq]uai|[A-Z]{3}")
_BEFORE_DE = re.compile(r"[^\W\d_]{3,}(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm)\s+(?:nr\.?\s*)?$", re.I)
_BEFORE_BOX = re.compile(r"(?:\bp\.? ?o\.? ?box|\bpost(?:al)? (?:office )?box|\bpostfach|\bapartado(?: de correos)?|\bbo[iî]te postale|\bcasella postale|\bbox)\s*(?:no\.?|number|nr\.?|#)?\s*$", re.I)
_TOWN = re.compile(r"(?:,\s(?:[Aa]pt|[Uu]nit|[Ss]uite|[Ff]lat|[Rr]oom)\.?\s\d{1,4})?,?\s{1,2}(?:\d{4,5}\s+)?[A-ZÀ-Þ][^\W\d_]+(?!\w)(?:[ '’-][A-ZÀ-Þ][^\W\d_]+(?!\w))?(?:,?\s+[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}|,\s[A-Z]{2}\s\d{5})?|,?\s+[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b")
_CODE = re.compile(r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b|\b\d{5}\b", re.I)
_UNIT = re.compile(r"(?:(?:flat|apt\.?|apartment|unit|suite|room|floor)\s*\d{1,4}[a-z]?|[A-ZÀ-Þ][\w'’-]+ House),?\s{1,2}$", re.I)
_ADDRESS_NEAR = re.compile(r"\b(?:shipped to|lives? (?:at|in)|courier|visit|address(?:ed)?|deliver(?:ed|y)?|office|send to|sent to|moved to|based at|ship to|mail to|at|to|from)\b|:\s*$|\A\W*\Z", re.I)
_COUNT_NEAR = re.compile(r"\b(?:after|took|with|for|of|counted|asked for|version|page|step|turn|build|order|on|in|least|about|until|than|all|over)\s*$", re.I)
_SIGN = {-1: "-", 0: "0", 1: "+"}


def _near(p: re.Pattern, text: str, a: int, z: int, back: int = 40, on: int = 24) -> bool:
    return bool(p.search(text, max(0, a - back), a) or p.search(text, z, z + on))


def _mails(text: str) -> Iterator[tuple]:
    low = -1
    while (low := min((k for k in (text.find("@", low + 1), text.find("＠", low + 1)) if k >= 0), default=-1)) >= 0:
        for m in _MAIL.finditer(text, max(0, low - 70), min(len(text), low + 200)):
            if m.start() <= low < m.end():
                yield *m.span(), True
    for m in _AT.finditer(text):
        if (after := _SPELT_AFTER.match(text, m.end())) and "@" not in m.group() and (before := _SPELT_BEFORE.search(text[max(0, m.start() - 65) : m.start()])):
            yield m.start() - len(before.group()), after.end(), False


def _email_votes(text: str, common) -> Iterator[tuple]:
    for a, z, sign in _mails(text):
        s = text[a:z]
        top = re.split(r"[\W_]+", s)[-1]
        local = re.split(r"\s*(?:[@＠]|[\[({<]\s?at\s?[\])}>]|\sat\s)", s, maxsplit=1, flags=re.I)[0].removeprefix("mailto:")
        path = (a > 0 and text[a - 1] in "@/") or z < len(text) and text[z] in "/@" or re.search(r"[@＠]\d", s)
        marks = len(re.findall(r"[\[({<]\s?(?:at|dot|\.)\s?[\])}>]|\sdot\s", s, re.I))
        votes = (
            1 if sign and _MAIL_STRICT.fullmatch(s) else 0 if sign or marks else -1,
            1 if _TOP.search(top) else -1 if not re.fullmatch(r"[^\W\d_]{2,}", top) else 0,
            1 if _near(_MAIL_NEAR, text, a, z) else 0,
            -1 if path else 1,
            1 if marks or (sign and "." in s) else -1,
            1 if re.search(r"[\d._+%-]", local) else -1 if not sign and common(local) else 0,
        )
        yield a, z, "email", votes, "token" if sign and " " not in s else "signed" if sign else "spelt", 0, 0


def _number_votes(text: str) -> Iterator[tuple]:
    for m in _DIGITS.finditer(text):
        a, z = m.span()
        whole = m.group()
        if whole.count("(") > whole.count(")"):
            a += 1 if whole[0] == "(" else 0
            whole = text[a:z]
        s = _EXT.sub("", whole)
        d = re.sub(r"\D", "", s)
        if not 7 <= len(d) <= 17:
            continue
        other = -1 if _OTHER_NUMBER.fullmatch(s) else 0
        thing = -1 if _THING_NEAR.search(text, max(0, a - 20), a) else 0
        glued = -1 if a > 0 and text[a - 1] in "/.,:-" or z < len(text) and text[z] in "/-" else 0
        id_near = _near(_ID_NEAR, text, a, z, 44, 24)
        phone_near = _near(_PHONE_NEAR, text, a, z) or (not id_near and _near(_NUMBER_NEAR, text, a, z))
        phone, ident = bool(_PHONE.fullmatch(s)) and 9 <= len(d) <= 15, bool(_ID_DIGITS.fullmatch(s))
        bare = not other and bool(_ID_BARE.fullmatch(s)) and 8 <= len(d) <= 12
        shape = f"{min(len(d), 14)}{'+' if s[0] == '+' else ''}"
        yield a, z, "phone", (1 if phone else -1, 1 if _PHONE_SURE.match(s) and phone else 0, 1 if phone_near else 0, -1 if id_near and not phone_near else 0, other, thing, glued, -1 if ident else 0), shape, 0, 0
        yield a, a + len(s), "id_number", (1 if ident else 0 if bare else -1, 1 if _ID_SURE.fullmatch(s) else 0, 1 if id_near else 0, -1 if phone_near and not id_near else 0, other, thing, glued, -1 if phone and not ident and _PHONE_SURE.match(s) else 0), shape, 0, 0


def _word_id_votes(text: str) -> Iterator[tuple]:
    done = 0
    for run in _ID_RUN.finditer(text):
        before = _ID_LETTERS.search(text[max(0, run.start() - 7) : run.start()])
        m = _ID_WORD.match(text, run.start() - len(before.group()) if before else run.start())
        if not m or m.start() < done:
            continue
        a, done = m.span()
        z, s = done, m.group()
        near = _near(_ID_NEAR, text, a, z, 44, 24)
        strict = bool(_ID_STRICT.fullmatch(s))
        thing = -1 if _THING_NEAR.search(text, max(0, a - 20), a) else 0
        yield a, z, "id_number", (1 if strict or _ID_SHAPE.fullmatch(s) else -1, 1 if strict else 0, 1 if near else 0, 0, 0, thing, 0, 0 if s[0].isupper() else -1), "word", 0, 0


def _address_votes(text: str, common) -> Iterator[tuple]:
    for m in _HOUSE.finditer(text):
        a, z = m.span()
        lo = max(0, a - _NEAR_NO)
        before = text[lo:a]
        how, sure = None, 1
        if k := _AFTER_NO.match(text, z, z + _NEAR_NO):
            how, z, named = "no", k.end(), k.group(1)
            sure = -1 if k.group(2) in _PLAIN else 1
        elif k := _AFTER_FR.match(text, z, z + _NEAR_NO):
            how, z, named = "fr", k.end(), k.group().split()[-1]
        elif before[-1:] in " \n\u00a0#." and (k := _BEFORE_BOX.search(before, max(0, len(before) - 48)) or _BEFORE_DE.search(before, max(0, len(before) - 64)) or (_WAY.search(before) and _BEFORE_NO.search(before))):
            how, a, named = "box" if "o" in k.group().lower()[:4] and "b" in k.group().lower() else "name first", lo + k.start(), k.group()
            sure = 0 if k.group().strip().lower() == "box" else 1
        if not how:
            continue
        words = named.split()
        cap = words[0][:1].isupper() or words[0][:2].lower() in ("po", "p.", "c/")
        town = _TOWN.match(text, z, z + _NEAR_NO)
        unit = _UNIT.search(text, max(0, a - 40), a)
        start = unit.start() if unit else a
        end = town.end() if town else z
        near = 1 if _ADDRESS_NEAR.search(text, max(0, start - 30), start) else 0
        known = how == "no" and all(common(w) for w in words)
        votes = (sure, 1 if cap else 0, 1 if town else 0, near, 1 if unit or _CODE.search(text, z, end + 24) else 0, -1 if how == "no" and _COUNT_NEAR.search(text, max(0, a - 16), a) else 0, -1 if known else 1)
        yield start, end, "address", votes, how, 0, 0


def _name_votes(text: str, given: list[tuple[int, int, int]], titles: list[int], common) -> Iterator[tuple]:
    for a, z, h in given:
        name = text[a:z]
        if len(name) < 2:
            continue
        f, b = _FORWARD.match(text, z, z + 60), _BACKWARD.search(text, max(0, a - 40), a)
        options = []
        if f and "\n\n" not in f.group():
            options.append((a, f.end(), f.group(1), "given first"))
        if b and "\n" not in b.group() and (b.group(2) or b.group(1)[0].isupper() or not name[0].isupper()):
            options.append((a - len(b.group()), z, b.group(1), "comma" if b.group(2) else "family first"))
        glued = -1 if a and text[a - 1] in "@/._-+=" or z < len(text) and text[z] in "@._+=/" and z + 1 < len(text) and text[z + 1].isalnum() else 0
        for s, e, family, how in options:
            if len(family) < 2:
                continue
            capital = family[0].isupper()
            firm = bool(_FIRM_AFTER.match(text, e, e + 24)) or bool(_FIRM_IS.search(family))
            more = how == "given first" and capital and not family.isupper() and _CAPITAL_AFTER.match(text, e, e + 4)
            mail = e < len(text) and text[e] in "@_" or s and text[s - 1] in "@/_."
            votes = (
                1 if name[0].isupper() else 0,
                1 if capital else -1 if name[0].isupper() else 0,
                -1 if any(common(w) for w in re.split(r"[-’'‐]", family)) else 1,
                1 if _PERSON_BEFORE.search(text, max(0, s - 24), s) else 0,
                -1 if firm else 0,
                -1 if _THING_AFTER.match(text, z, z + 60) or _THING_AFTER.match(text, e, e + 60) else 0,
                -1 if mail or glued else 0,
                -1 if more else 0,
            )
            yield s, e, "name", votes, how, h, (f if how == "given first" else b).end(1)
    for a in titles:
        m = _TITLED.match(text, a)
        if not m or (a and text[a - 1] in "@/.-_") or len(m.group(4)) < 2:
            continue
        family, title = m.group(4), m.group(1)
        firm = bool(_FIRM_AFTER.match(text, m.end(), m.end() + 24)) or bool(_FIRM_IS.search(family))
        before = 1 if _PERSON_BEFORE.search(text, max(0, m.start() - 24), m.start()) else 0
        votes = (1 if title[0].isupper() or m.group(2) else -1, 1 if family[0].isupper() else -1, -1 if common(family) else 1, before, -1 if firm else 0, 0, 0, 0)
        yield m.start(), m.end(), "name", votes, "title", 0, m.end(4)


def word_hashes(names: list[str]) -> np.ndarray:
    return np.unique(wd.words([" ".join(names)]).hash)


def candidates(texts: list[str | None], given, is_common) -> Iterator[tuple[int, int, int, str, str, str, int, int]]:
    """(text number, start, end, kind, votes, shape, given, family) of every span proposed. votes: a sign for each labeler; given and family:
    hashes of a name's words (0 for none). given: which hashes may be given names; is_common: whether a word is common."""
    w = wd.words(texts)
    bounds = w.bounds()
    hit = np.flatnonzero(given(w.hash))
    anchors, titles = defaultdict(list), defaultdict(list)
    for k in hit:
        anchors[int(w.doc[k])].append((int(w.start[k]), int(w.end[k]), int(w.hash[k].astype(np.int64))))
    named = word_hashes(_TITLES)
    for k in np.flatnonzero(named[np.minimum(np.searchsorted(named, w.hash), len(named) - 1)] == w.hash):
        titles[int(w.doc[k])].append(int(w.start[k]))
    for i, text in enumerate(texts):
        if not text:
            continue
        mails: list[tuple[int, int]] = []
        for a, z, kind, votes, shape, g, f in _email_votes(text, is_common):
            if votes[0] > 0:
                mails.append((a, z))
            yield i, a, z, kind, "".join(map(_SIGN.get, votes)), shape, g, f
        at = np.array(sorted(mails)).reshape(-1, 2)
        for found in (_number_votes(text), _word_id_votes(text), _address_votes(text, is_common), _name_votes(text, anchors.get(i, []), titles.get(i, []), is_common)):
            for a, z, kind, votes, shape, g, f in found:
                k = int(np.searchsorted(at[:, 0], z)) - 1 if len(at) else -1
                if k >= 0 and at[k, 1] > a:  # strict addresses are long enough apart: the last that begins before the end is the one
                    continue
                if f:  # where the family name ends: the hash of its last word
                    lo = int(bounds[i])
                    f = int(w.hash[lo + int(np.searchsorted(w.end[lo : int(bounds[i + 1])], f))].astype(np.int64))
                yield i, a, z, kind, "".join(map(_SIGN.get, votes)), shape, g, f


def em_reliabilities(votes: list[str], counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability that a span with each vote pattern is one, by EM over the patterns' counts.

    Each labeler has its own probability of voting for, not, or against, given the truth. Weak prior knowledge (labelers are right more often
    than not) weighs as much as a tenth of each side's spans and keeps the two sides from changing places.
    """
    code = np.array([["+0-".index(c) for c in v] for v in votes])
    n, n_labelers = counts.sum(), code.shape[1]
    prior = np.array([[0.62, 0.35, 0.03], [0.12, 0.48, 0.40]])  # true, false
    share = 0.5
    like = np.repeat(prior[None], n_labelers, axis=0)  # labeler x truth x vote
    for _ in range(rounds):
        score = np.log([share, 1 - share]) + sum(np.log(like[k, :, code[:, k]]) for k in range(n_labelers))
        p = 1 / (1 + np.exp(np.clip(score[:, 1] - score[:, 0], -50, 50)))
        share = (counts @ p + 5) / (n + 10)
        for k in range(n_labelers):
            for y, q in enumerate((p, 1 - p)):
                seen = np.bincount(code[:, k], counts * q, minlength=3) + (0.1 * (counts @ q) + 10) * prior[y]
                like[k, y] = seen / seen.sum()
    return p


def train(rows: list[tuple[str, str, str, int]]) -> dict[tuple[str, str, str], float]:
    """rows: (kind, votes, shape, count) over the whole corpus -> the classifier's probability for each."""
    out: dict[tuple[str, str, str], float] = {}
    for kind in KINDS:
        mine = sorted(r for r in rows if r[0] == kind)
        if not mine:
            continue
        by = defaultdict(int)
        for _, v, _, n in mine:
            by[v] += n
        patterns = sorted(by)
        soft = dict(zip(patterns, em_reliabilities(patterns, np.array([by[v] for v in patterns], float))))
        shapes = sorted({r[2] for r in mine})
        x = np.array([[1.0, *(float(c == "+") for c in v), *(float(c == "-") for c in v), *(float(s == t) for t in shapes)] for _, v, s, _ in mine])
        y, n = np.array([soft[r[1]] for r in mine]), np.array([r[3] for r in mine], float)
        beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.5
        for _ in range(40):  # Newton
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
            beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        for r, q in zip(mine, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))):
            out[r[0], r[1], r[2]] = float(q)
    return out


# --- gazetteers --------------------------------------------------------------------------------------------------------------


def common_words(texts: DataFrame, text_col: str) -> frozenset[str]:
    """The words in lower case that make up COMMON_PART of all such words of all texts (and occur five times): 1 / COMMON_PART at most."""
    each = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?<![\p{L}\p{N}])\p{Ll}+(?![\p{L}\p{N}])"), F.lit(0))).alias("word"))
    counts = materialize(each.groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["word"] for r in counts.where(F.col("n") >= max(5.0, total * COMMON_PART)).select("word").collect())


def _title_ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Titles of two words or more -> the hashes of their first and last words."""
    for b in it:
        titles = b["title"].to_pylist()
        for part in wd.chunks([len(t or "") for t in titles]):
            w = wd.words(titles[part])
            lo, hi = w.bounds()[:-1], w.bounds()[1:]
            ok = np.flatnonzero(hi - lo >= 2)
            if len(ok):
                first, last = w.hash[lo[ok]].astype(np.int64), w.hash[hi[ok] - 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(last), b["person"].take(pa.array(ok + part.start))], ["first", "last", "person"])


def names(pages: DataFrame, title_col: str = "title", person: str = "true") -> DataFrame:
    """(hash, role): the given and family names that titles of person pages show, and the fixed list; written once. person: an SQL condition."""
    spark = pages.sparkSession
    ship(spark)
    titles = pages.select(F.col(title_col).alias("title"), F.coalesce(F.expr(person), F.lit(False)).alias("person")).where("title is not null")
    ends = materialize(titles.mapInArrow(_title_ends, "first long, last long, person boolean"), "titles")
    shown = ends.groupBy(F.col("first").alias("hash")).agg(F.count("*").alias("n"), F.count_if("person").alias("p"))
    given = shown.where(f"p >= {LEAST_PEOPLE} and 2 * p >= n").select("hash")
    fixed = spark.createDataFrame([(int(h),) for h in word_hashes(list(GIVEN)).astype(np.int64)], "hash long")
    family = ends.where("person").select(F.col("last").alias("hash")).distinct()
    return materialize(given.unionByName(fixed).distinct().withColumn("role", F.lit("given")).unionByName(family.withColumn("role", F.lit("family"))), "names")


def _bits(h: np.ndarray, n_bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [wd.mix(h + np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(n_bits - 1) for k in range(BLOOM_HASHES)]


def bloom(known: DataFrame) -> np.ndarray:
    """A Bloom filter of the given names, 16 bits a name and BLOOM_BITS at most: of its words, those that aren't zero reach the driver."""
    given = known.where("role = 'given'").select("hash")
    n = given.count()
    n_bits = min(BLOOM_BITS, max(1024, 1 << (16 * max(n, 1) - 1).bit_length()))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = np.concatenate(_bits(b["hash"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), n_bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    out = np.zeros(n_bits // 64, np.uint64)
    for r in given.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def in_bloom(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    with np.errstate(over="ignore"):
        for at in _bits(h, 64 * len(filter_)):
            ok &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


# --- spans -------------------------------------------------------------------------------------------------------------------

_FIELDS = [("start", T.IntegerType()), ("end", T.IntegerType()), ("kind", T.StringType()), ("votes", T.StringType()), ("shape", T.StringType()), ("given", T.LongType()), ("family", T.LongType())]
#: Names up to which the table of names is sent to every executor; a larger one is joined like any table.
BROADCAST_NAMES = 200_000


def _hashed(texts: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """keys, text_hash and __text: offsets belong to a text, so a record delivered with two texts is two texts."""
    return texts.select(*keys, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("__text"))


def propose(texts: DataFrame, keys: list[str], text_col: str, known: DataFrame, common: frozenset[str]) -> DataFrame:
    """keys + (text_hash, start, end, kind, votes, shape): the candidate spans of all texts with their votes, written once."""
    spark = texts.sparkSession
    ship(spark)
    rows = _hashed(texts, text_col, keys).where("__text is not null")
    held = spark.sparkContext.broadcast((bloom(known), common))
    ids = [*keys, "text_hash"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, words = held.value
        given = lambda h: in_bloom(filter_, h)
        is_common = lambda w: w.lower() in words
        for b in it:
            texts_ = b["__text"].to_pylist()
            for part in wd.chunks([len(t or "") for t in texts_]):
                found = list(candidates(texts_[part], given, is_common))
                if found:
                    i, *cols = zip(*found)
                    take = pa.array(np.array(i) + part.start)
                    typed = [pa.array(c, pa.int32() if n in ("start", "end") else pa.int64() if n in ("given", "family") else pa.string()) for c, (n, _) in zip(cols, _FIELDS)]
                    yield pa.RecordBatch.from_arrays([*(b[k].take(take) for k in ids), *typed], [*ids, *(n for n, _ in _FIELDS)])

    schema = T.StructType([*(rows.schema[k] for k in ids), *(T.StructField(n, t) for n, t in _FIELDS)])
    raw = materialize(rows.mapInArrow(run, schema), "proposed")
    # What the filter let through by chance goes; a family name that person pages show is one more vote.
    small = F.broadcast if known.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else (lambda df: df)
    role = lambda name: small(known.where(F.col("role") == name).select(F.col("hash").alias(name), F.lit(True).alias(f"is_{name}")))
    named = raw.where("kind = 'name'").join(role("given"), "given", "left").join(role("family"), "family", "left").where("is_given or shape = 'title'")
    named = named.withColumn("votes", F.concat("votes", F.when(F.col("is_family"), "+").otherwise("0")))
    columns = [*ids, "start", "end", "kind", "votes", "shape"]
    return materialize(raw.where("kind <> 'name'").select(*columns).unionByName(named.select(*columns)), "spans")


def fit(spans: DataFrame) -> dict[tuple[str, str, str], float]:
    """The span classifier, from the counts of every kind, vote pattern and shape over all spans (a few hundred rows)."""
    rows = spans.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).collect()
    return train([(r["kind"], r["votes"], r["shape"], r["n"]) for r in rows])


def choose(spans: list[tuple[float, int, int, str]]) -> list[int]:
    """Which of the overlapping spans (p, start, end, kind) of a text count: the likelier, then the longer, the earlier, the kind first in KINDS."""
    taken: list[int] = []
    starts: list[int] = []  # of the spans taken, in order
    ends: list[int] = []
    for k in sorted(range(len(spans)), key=lambda k: (-spans[k][0], spans[k][1] - spans[k][2], spans[k][1], KINDS.index(spans[k][3]))):
        _, a, z, _ = spans[k]
        at = bisect_right(starts, a)
        if (at == 0 or ends[at - 1] <= a) and (at == len(starts) or z <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, z)
            taken.append(k)
    return sorted(taken)


def _changes(col: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; null equals null."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))])


def _resolve(ids: list[str]):
    """Spans in order of their texts and starts -> those that count. Only runs of overlapping spans are looked at one by one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in [*it, None]:
            t = held if b is None else b if held is None else pa.concat_batches([held, b])
            if t is None or not t.num_rows:
                held = t
                continue
            start, end = t["start"].to_numpy(), t["end"].to_numpy().astype(np.int64)
            new = np.zeros(t.num_rows, bool)
            for k in ids:
                new |= _changes(t[k])
            text = np.cumsum(new)
            reach = np.maximum.accumulate(text * (1 << 32) + end) - text * (1 << 32)  # the farthest end so far within the text
            new[1:] |= start[1:] >= reach[:-1]
            run_no = np.cumsum(new)
            cut = t.num_rows if b is None else int(np.searchsorted(run_no, run_no[-1]))  # the last run may go on
            held = t.slice(cut)
            if not cut:
                continue
            first = np.flatnonzero(new[:cut])
            size = np.diff(np.append(first, cut))
            keep = np.zeros(cut, bool)
            keep[first[size == 1]] = True
            p, kind = t["p"].to_numpy(), t["kind"]
            for a, n in zip(first[size > 1], size[size > 1]):
                for k in choose([(p[i], int(start[i]), int(end[i]), kind[i].as_py()) for i in range(a, a + n)]):
                    keep[a + k] = True
            yield t.slice(0, cut).filter(pa.array(keep))

    return run


def accept(spans: DataFrame, model: dict[tuple[str, str, str], float]) -> DataFrame:
    """keys + (text_hash, start, end, kind, p): the spans the classifier takes, none overlapping another."""
    spark = spans.sparkSession
    ship(spark)
    table = spark.createDataFrame([(*k, p) for k, p in model.items() if p >= ACCEPT], "kind string, votes string, shape string, p double")
    ids = [c for c in spans.columns if c not in ("start", "end", "kind", "votes", "shape")]
    taken = spans.join(F.broadcast(table), ["kind", "votes", "shape"]).select(*ids, "start", "end", "kind", "p")
    return taken.repartition(*ids).sortWithinPartitions(*ids, "start", "end").mapInArrow(_resolve(ids), taken.schema)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with the spans (start, end, kind), which don't overlap, replaced by [KIND]."""
    out, at = [], 0
    for a, z, kind in sorted(spans):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def redact(texts: DataFrame, keys: list[str], text_col: str, accepted: DataFrame) -> DataFrame:
    """keys + (redacted, n_spans): every text with the spans of accept() replaced."""
    ship(texts.sparkSession)
    ids = [*keys, "text_hash"]
    held = accepted.groupBy(*ids).agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))  # the spans of one text
    rows, other = _hashed(texts, text_col, keys).alias("t"), held.alias("h")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"h.{k}")) for k in ids]
    met = rows.join(other, reduce(and_, same), "left").select(*(F.col(f"t.{k}") for k in keys), F.col("t.__text").alias("__text"), F.col("h.spans").alias("spans"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("redacted", T.StringType()), T.StructField("n_spans", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans = [s or [] for s in b["spans"].to_pylist()]
            out = [t if not s else redact_text(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(b["__text"].to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int32())], [*keys, "redacted", "n_spans"])

    return met.mapInArrow(run, schema)
