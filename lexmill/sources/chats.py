"""Chat exports as messages: sender, time, text."""

from __future__ import annotations

import json
import re
from collections import Counter
from datetime import datetime, timezone
from html.parser import HTMLParser

Message = tuple[str, str, str]
LINE = re.compile(r"^(?:\[(\d{1,2}[./]\d{1,2}[./]\d{2,4},? \d{1,2}:\d{2}(?::\d{2})?)\] |(\d{1,2}[./]\d{1,2}[./]\d{2,4},? \d{1,2}:\d{2}(?::\d{2})?) - )(.*)$")
NAMED = re.compile(r"^([^\s:][^:]{0,39}): (.*)$")


def phone_export(text: str) -> list[Message] | None:
    """Text export with dated lines; lines without a date continue a message, system lines end it."""
    lines = text.split("\n")
    if sum(LINE.match(x) is not None for x in lines[:80]) < 4:
        return None
    out: list[Message] = []
    open_message = False
    for x in lines:
        m = LINE.match(x)
        if m is None:
            if open_message and x.strip():
                sender, at, t = out[-1]
                out[-1] = (sender, at, f"{t}\n{x}")
            continue
        who = NAMED.match(m[3])
        open_message = who is not None
        if who:
            out.append((who[1], m[1] or m[2], who[2]))
    return out


def named_log(text: str) -> list[Message] | None:
    """``Name: message`` log: most lines are named, by two or more senders of whom one returns."""
    lines = [x for x in text.split("\n") if x.strip()]
    hits = [m for x in lines[:80] if (m := NAMED.match(x))]
    senders = Counter(m[1] for m in hits)
    if len(lines) < 5 or len(hits) < 6 or len(hits) < 0.6 * len(lines[:80]) or len(senders) < 2 or max(senders.values()) < 2:
        return None
    out: list[Message] = []
    for x in lines:
        m = NAMED.match(x)
        if m:
            out.append((m[1], "", m[2]))
        elif out:
            out[-1] = (*out[-1][:2], f"{out[-1][2]}\n{x}")
    return out


def _time(v) -> str:
    try:
        return datetime.fromtimestamp(float(v), timezone.utc).strftime("%Y-%m-%d %H:%M")
    except (TypeError, ValueError):
        return str(v or "")[:16].replace("T", " ")


def workspace_json(data) -> list[Message] | None:
    """Workspace export: a list of messages with user and ts; joins and other notices are left out."""
    if not (isinstance(data, list) and data and all(isinstance(m, dict) for m in data) and any(m.get("type") == "message" and "ts" in m for m in data)):
        return None
    name = lambda m: (m.get("user_profile") or {}).get("real_name") or m.get("username") or m.get("user") or ""
    return [(name(m), _time(m.get("ts")), m["text"]) for m in data if m.get("type") == "message" and not m.get("subtype") and m.get("text")]


def guild_json(data) -> list[Message] | None:
    """Guild export: messages with author and content; nicknames first."""
    if not (isinstance(data, dict) and isinstance(data.get("messages"), list) and ("guild" in data or "channel" in data)):
        return None
    rows = [m for m in data["messages"] if isinstance(m, dict) and m.get("content")]
    return [((m.get("author") or {}).get("nickname") or (m.get("author") or {}).get("name") or "", _time(m.get("timestamp")), m["content"]) for m in rows]


class _Messenger(HTMLParser):
    def __init__(self):
        super().__init__()
        self.messages, self.stack, self.now = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "br" and self.now is not None:
            self.now["text"] += "\n"
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        mark = next((c for c in ("from_name", "text", "media_wrap", "reply_to", "forwarded", "date") if c in classes), "")
        if "message" in classes:
            self.now = {"service": "service" in classes, "from": "", "text": "", "date": "", "marks": []}
            self.messages.append(self.now)
            mark = "message"
        elif self.now is not None and mark in ("media_wrap", "reply_to", "forwarded"):
            self.now["marks"].append({"media_wrap": "[media]", "reply_to": "[reply]", "forwarded": "[forwarded]"}[mark])
        elif self.now is not None and mark == "date":
            self.now["date"] = a.get("title") or ""
        self.stack.append(mark)

    def handle_endtag(self, tag):
        if self.stack and tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.stack.pop()

    def handle_data(self, data):
        inside = next((m for m in reversed(self.stack) if m), "")
        if self.now is not None and inside in ("from_name", "text"):
            self.now["from" if inside == "from_name" else "text"] += data


def messenger_html(text: str) -> list[Message] | None:
    """Messenger export in HTML: service messages skipped, senders carried forward, marks for media and replies."""
    if 'class="message' not in text:
        return None
    p = _Messenger()
    p.feed(text)
    out, sender = [], ""
    for m in p.messages:
        if m["service"]:
            continue
        sender = m["from"].strip() or sender
        body = " ".join([*m["marks"], m["text"].strip()]).strip()
        if body:
            out.append((sender, m["date"], body))
    return out


def messages(name: str, text: str) -> tuple[str, list[Message]] | None:
    """Format and messages by the first importer that takes the file, else None."""
    kind = name.lower().rpartition(".")[2]
    if kind == "json":
        try:
            data = json.loads(text)
        except ValueError:
            return None
        tries = [("workspace", workspace_json), ("guild", guild_json)]
    else:
        data = text
        tries = [("messenger", messenger_html)] if kind in ("html", "htm") else [("phone", phone_export), ("log", named_log)]
    for label, read in tries:
        found = read(data)
        if found:
            return label, found
    return None


def dialogue(found: list[Message]) -> str:
    return "\n".join(f"[{at}] {who}: {t}" if at else f"{who}: {t}" for who, at, t in found)
