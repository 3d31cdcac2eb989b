"""Markdown pages: fields at the top, truth and timeline, chunks, assertion sections, and writing a page back."""

from __future__ import annotations

import json
import re
from typing import Any

try:
    import yaml
except ImportError:  # fields are then read line by line
    yaml = None

#: Bytes: a chunk may have LIMIT; a larger one is cut into windows of about WINDOW that repeat about OVERLAP (fixed values).
LIMIT, WINDOW, OVERLAP = 1920, 1760, 240
_FENCE = re.compile(r"---\r?(?:\n|\Z)")


def _scalar(text: str) -> Any:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else float(text) if re.fullmatch(r"-?[0-9]+\.[0-9]+", text) else text


def _fields(text: str) -> dict[str, Any]:
    """A mapping of text keys; ValueError if the text is none."""
    if yaml is not None:
        try:
            got = yaml.load(text, Loader=yaml.BaseLoader)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
        if got in (None, ""):
            return {}
        if not isinstance(got, dict):
            raise ValueError("the fields are no mapping")
        return {k: v for k, v in got.items() if isinstance(k, str)}
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if (m := re.match(r"\s+-\s+(.*)", line) or re.match(r"-\s+(.*)", line)) and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), _scalar(m[1])]
        elif m := re.match(r"([^\s:#][^:]*):(?:\s+(.*))?$", line):
            key = m[1].strip()
            out[key] = _scalar(m[2] or "")
        else:
            raise ValueError(f"not a field: {line}")
    return out


def parse_page(raw: str | None) -> dict | None:
    """frontmatter (JSON text), truth and timeline. Fields that can't be read leave everything in the body."""
    if raw is None:
        return None
    fields, body = {}, raw
    if first := _FENCE.match(raw):
        close = next((m for m in re.finditer(r"(?m)^---\r?$\n?", raw[first.end() :])), None)
        if close:
            try:
                fields = _fields(raw[first.end() : first.end() + close.start()])
                body = raw[first.end() + close.end() :]
            except ValueError:
                fields, body = {}, raw
    truth, timeline = split_body(body)
    return {"frontmatter": json.dumps(fields, sort_keys=True, ensure_ascii=False, default=str), "truth": truth, "timeline": timeline}


def split_body(body: str) -> tuple[str, str]:
    """At the first bare --- line; the line break before it belongs to neither part."""
    m = re.search(r"(?m)^---\r?$", body)
    if not m:
        return re.sub(r"\r?\n\Z", "", body), ""
    return re.sub(r"\r?\n\Z", "", body[: m.start()]), re.sub(r"\A\r?\n", "", body[m.end() :])


def render_page(frontmatter: str | None, truth: str | None, timeline: str | None) -> str:
    """The page as text: fields in order of their names, truth, and the timeline if there is one."""
    fields = json.loads(frontmatter) if frontmatter else {}
    lines = []
    for k in sorted(fields):
        v = fields[k]
        if isinstance(v, list):
            lines += [f"{k}:"] + [f"- {_plain(x)}" for x in v] if v else [f"{k}: []"]
        else:
            lines.append(f"{k}: {_plain(v)}")
    head = "---\n" + "".join(x + "\n" for x in lines) + "---\n" if lines else ""
    return head + (truth or "") + "\n" + ("---\n" + timeline if timeline else "")


def _plain(v: Any) -> str:
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False) if v == "" or re.search(r"^[\s\"'\[{>|*&!%#`@-]|: |:$| #|\s$|^(?:null|true|false|~)$|^-?[0-9.]+$", v) or "\n" in v else v
    return json.dumps(v, ensure_ascii=False)


def _atoms(text: str) -> list[tuple[int, int]]:
    """Byte ranges of paragraphs; of lines where a paragraph is larger than a window; of cut lines where a line is."""
    raw, out, at = text.encode(), [], 0
    ranges: list[list[int]] = []
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        b = line.encode()
        if line.strip():
            end = at + len(line.rstrip().encode())
            if ranges and ranges[-1][2] == at:
                ranges[-1][1:] = [end, at + len(b)]
            else:
                ranges.append([at, end, at + len(b)])
        at += len(b)
    for lo, hi, _ in ranges:
        if hi - lo <= WINDOW:
            out.append((lo, hi))
            continue
        for m in re.finditer(rb"[^\n]+", raw[lo:hi]):
            a, z = lo + m.start(), lo + m.start() + len(m.group().rstrip())
            while z - a > WINDOW:
                cut = a + WINDOW
                while raw[cut] & 0xC0 == 0x80:
                    cut -= 1
                out.append((a, cut))
                a = cut
            if z > a:
                out.append((a, z))
    return out


def windows(text: str) -> list[str]:
    """The text whole if it has LIMIT bytes or fewer, else in windows of whole atoms."""
    raw = text.encode()
    if len(raw) <= LIMIT:
        return [text]
    atoms, out, start = _atoms(text), [], 0
    while atoms:
        lo = atoms[start][0]
        last = max([start] + [k for k in range(start, len(atoms)) if atoms[k][1] - lo <= WINDOW])
        end = atoms[last][1]
        out.append(raw[lo:end].decode())
        if last + 1 == len(atoms):
            return out
        # The next window begins with the first atom that lies within the overlap; failing that with the last one, if it is short.
        fit = [k for k in range(start + 1, last + 1) if atoms[k][0] >= end - OVERLAP]
        if fit:
            start = fit[0]
        elif last > start and end - atoms[last][0] <= 2 * OVERLAP:
            start = last
        else:
            start = last + 1
    return [text]


def chunks(truth: str | None, timeline: str | None) -> list[dict]:
    """Chunks of a page: truth by level-2 headings, the timeline by --- lines; oversized ones in numbered parts."""
    out: list[dict] = []

    def add(kind: str, heading: str, content: str) -> None:
        parts = windows(content)
        for n, p in enumerate(parts, 1):
            name = heading if len(parts) == 1 else f"{heading} [{n}/{len(parts)}]".strip()
            out.append({"chunk_index": len(out), "chunk_type": kind, "heading_path": name, "content": p})

    text = (truth or "").strip()
    if text:
        for part in re.split(r"(?m)^(?=## )", text):
            if part:
                part = re.sub(r"\r?\n\Z", "", part)
                head = re.match(r"## ([^\n]*)", part)
                add("truth_section", head[1].strip() if head else "", part)
    if (timeline or "").strip():
        for entry in re.split(r"(?m)^---[ \t]*\r?$\n?", timeline):
            if entry.strip():
                entry = re.sub(r"\r?\n\Z", "", entry)
                add("timeline_entry", next(x.strip() for x in entry.splitlines() if x.strip()), entry)
    return out


CHUNK_SCHEMA = "array<struct<chunk_index:int,chunk_type:string,heading_path:string,content:string>>"
PAGE_SCHEMA = "struct<frontmatter:string,truth:string,timeline:string>"


def assertions_section(text: str | None) -> str:
    """What stands under '## Assertions' up to the next level-2 heading; headings in code fences don't count."""
    out, inside, fenced = [], False, False
    for line in (text or "").splitlines(keepends=True):
        if re.match(r" {0,3}(```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r" {0,3}##(?!#)\s*(.*?)\s*#*\s*$", line)):
            if inside:
                break
            if m[1].lower() == "assertions":
                inside = True
                continue
        if inside:
            out.append(line)
    return "".join(out)
