"""Conversation day files: parsing turns, writing them, prompts, and facts in a model's answer."""

from __future__ import annotations

import json
import re

#: The line between two turns and the prefix of escaped lines are parameters of a vault's files.
BOUNDARY, ESCAPE, META = "<!-- turn-boundary -->", "<!-- escaped -->", "```json turn-metadata"
_TURN = re.compile(r"## Turn (\d+) · (user|assistant|system|tool) · (\S+)\s*$")
TURN_SCHEMA = "array<struct<ordinal:int,role:string,ts:string,content:string,metadata:string>>"
REQUIRED = {"decision": ("chose", "summary"), "preference": ("about", "summary"), "fact": ("about", "summary"), "action_item": ("what", "summary")}


def parse_turns(raw: str | None, boundary: str = BOUNDARY, escape: str = ESCAPE) -> list[dict] | None:
    """The turns of a file; None for a null text, an empty list where there are none."""
    if raw is None:
        return None
    turns: list[dict] = []
    held: list[str] = []
    meta: list[str] | None = None

    def close() -> None:
        if turns:
            turns[-1]["content"] = "\n".join(held).strip("\n")
        held.clear()

    for line in raw.replace("\r\n", "\n").split("\n"):
        if meta is not None:
            if line.strip() == "```":
                turns[-1]["metadata"] = "\n".join(meta)
                meta = None
            else:
                meta.append(line)
        elif m := _TURN.match(line):
            close()
            turns.append({"ordinal": int(m[1]), "role": m[2], "ts": m[3], "content": "", "metadata": None})
        elif line.strip() == META and turns:
            meta = []
        elif line.rstrip() != boundary and turns:
            held.append(line.removeprefix(escape))
    close()
    return turns


def render_turns(turns: list[dict], boundary: str = BOUNDARY, escape: str = ESCAPE) -> str:
    parts = []
    for t in turns:
        lines = [escape + x if x.rstrip() == boundary or x.strip() == META or x.startswith(escape) or _TURN.match(x) else x for x in t["content"].split("\n")]
        text = f"## Turn {t['ordinal']} · {t['role']} · {t['ts']}\n\n" + "\n".join(lines) + "\n"
        if t.get("metadata"):
            text += f"\n{META}\n{t['metadata']}\n```\n"
        parts.append(text)
    return f"\n{boundary}\n\n".join(parts)


def prompt(session: str, new: list[dict], before: list[dict]) -> str:
    """What a model is asked about a window of turns. The labels are a fixed format, which a model was tuned to."""
    show = lambda ts: "\n".join(f"  [turn {t['ordinal']}, {t['role']}, {t['ts']}]\n    " + t["content"].replace("\n", "\n    ") for t in ts) or "  (none)"
    span = f"turns {new[0]['ordinal']}..{new[-1]['ordinal']}" if new else "turns none"
    return f"Session: {session}\nNew turns to extract from ({span}):\n{show(new)}\nLookback context (do not extract from these — for reference only):\n{show(before)}"


def parse_facts(answer: str | None) -> dict:
    """facts (JSON texts) and errors (with the fact's place) in a model's answer: strict JSON, or the one object within commentary."""
    text = (answer or "").strip()
    got = None
    try:
        got = json.loads(text)
    except ValueError:
        fenced = re.findall(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
        tries = fenced if len(fenced) == 1 else [text[text.find("{") : text.rfind("}") + 1]] if "{" in text else []
        for t in tries:
            try:
                got = json.loads(t)
            except ValueError:
                got = None
    if not isinstance(got, dict) or not isinstance(got.get("facts"), list):
        return {"facts": [], "errors": ["the answer holds no list of facts"]}
    facts, errors = [], []
    for i, f in enumerate(got["facts"]):
        kind = f.get("kind") if isinstance(f, dict) else None
        if kind not in REQUIRED:
            errors.append(f"{i}: unknown kind {kind}")
            continue
        empty = [k for k in REQUIRED[kind] if not isinstance(f.get(k), str) or not f[k].strip()]
        if empty:
            errors.append(f"{i}: {kind} needs {empty[0]}")
        else:
            facts.append(json.dumps(f, sort_keys=True, ensure_ascii=False))
    return {"facts": facts, "errors": errors}
