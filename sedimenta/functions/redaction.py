"""Secrets in outgoing text: numbered tokens per session that can be turned back."""

from __future__ import annotations

import re

#: Classes in order, with the shape of each (fixed values).
CLASSES = (
    ("EMAIL", r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"),
    ("SECRET", r"\b(?:sk-(?:proj-)?[A-Za-z0-9_\-]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[posru]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,})\b"),
    ("ACCOUNT", r"\b(?:\d[ \-]?){12,18}\d\b"),
    ("PHONE", r"\+?\d{1,3}[\s.\-](?:\(\d{1,4}\)[\s.\-]?)?\d{2,4}(?:[\s.\-]\d{2,4}){1,3}\b"),
    ("TOKEN", r"\b[A-Za-z0-9+/_]{32,}={0,2}\b"),
)
_COMPILED = [(name, re.compile(p)) for name, p in CLASSES]
_MARK = re.compile(r"<[A-Z]+_\d+>")


class Session:
    """The tokens of one session: a secret keeps its token, tokens are numbered by class."""

    def __init__(self, blocklist: list[str] | None = None) -> None:
        self.tokens: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.blocked = [re.compile(re.escape(b), re.I) for b in sorted(blocklist or [], key=len, reverse=True)]

    def _token(self, name: str, secret: str) -> str:
        if secret not in self.tokens:
            self.counts[name] = self.counts.get(name, 0) + 1
            self.tokens[secret] = f"<{name}_{self.counts[name]}>"
        return self.tokens[secret]

    def scrub(self, text: str) -> str:
        for name, p in [("SECRET", b) for b in self.blocked] + _COMPILED:
            text = p.sub(lambda m, name=name: self._token(name, m.group()), text)
        return text

    def rehydrate(self, text: str) -> str:
        back = {t: s for s, t in self.tokens.items()}
        return _MARK.sub(lambda m: back.get(m.group(), m.group()), text)


def scrub_list(texts: list[str | None], blocklist: list[str] | None = None) -> list[dict]:
    """The texts of one session in order, scrubbed, and rehydrated again as a check."""
    s = Session(blocklist)
    out = [None if t is None else s.scrub(t) for t in texts]
    return [{"scrubbed": o, "restored": None if o is None else s.rehydrate(o)} for o in out]
