"""HTML to Markdown, Markdown to blocks, blocks to chunks: one Python pass per document, in Arrow batches.

Parsing is sequential within a document, so it is the one place of the ingestion that leaves the JVM; documents are
independent, nothing is shuffled. A document that fails gives one row with its error and no chunks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

MAX_CHARS, MIN_CHARS = 2000, 120
SILENT = {"script", "style", "template", "noscript"}
BLOCK_TAGS = {"p", "div", "section", "article", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr"}
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([\w+-]*)")
HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
LINK = re.compile(r"\[([^\]]+)\]\([^)]*\)")
EMPHASIS = re.compile(r"(\*\*|__|~~|`)(.+?)\1")
ROW = re.compile(r"^\s*\|.*\|\s*$")
DIVIDER = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
NOISE = [re.compile(r"^(?:#[\w/-]+\s*)+$"), re.compile(r"^(?:https?://\S+\s*)+$"), re.compile(r"^[\W_]*$")]
CONTENT_HEADING = re.compile(r"https?://\S+|^[^:：]{1,40}[:：]\s*\S+")
SENTENCE = re.compile(r"[^。！？.!?；;\n]*[。！？.!?；;\n]+|[^。！？.!?；;\n]+$")


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.row: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.row, self.header = [], False
        elif tag in ("td", "th"):
            self.header |= tag == "th"
            if self.row is not None:
                self.row.append("")
        elif tag == "br":
            self._put("；" if self.row is not None else "\n")
        elif tag == "img":
            a = dict(attrs)
            if a.get("src"):
                self._put(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag in BLOCK_TAGS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "tr" and self.row is not None:
            cells = [" ".join(c.split()) for c in self.row]
            self.row = None
            self.out.append("\n| " + " | ".join(cells) + " |" + ("\n|" + " --- |" * len(cells) if self.header else ""))
        elif tag in BLOCK_TAGS and not self.silent:
            self.out.append("\n\n" if tag != "li" else "")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self._put(data if self.row is not None else re.sub(r"\s+", " ", data))

    def _put(self, text: str) -> None:
        if self.row:
            self.row[-1] += text
        elif self.row is None:
            self.out.append(text)


def html_to_markdown(html: str | None) -> str:
    """Visible text as Markdown; comments, scripts and styles go. Null gives an empty text."""
    parser = _Html()
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def slug(text: str) -> str:
    """The anchor of a heading: lower case, words joined by hyphens."""
    return re.sub(r"[\s-]+", "-", re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", text).lower()).strip()).strip("-") or "section"


def visible(text: str) -> str:
    """Inline marks removed: links keep their label, emphasis its content; zero-width characters go."""
    text = LINK.sub(r"\1", re.sub("[\u200b\u200c\u2060\ufeff]", "", text))
    for _ in range(3):
        text = EMPHASIS.sub(r"\2", text)
    return text.strip()


def blocks_of(text: str | None) -> list[dict]:
    """Blocks in order: kind (heading, text, code, list, quote, table, image, frontmatter), text, level, anchor, src."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff").split("\n")
    out: list[dict] = []
    anchors: dict[str, int] = {}
    held: list[str] = []
    kind = "text"

    def add(k: str, body: str, **more) -> None:
        if body.strip() or k == "image":
            out.append({"kind": k, "text": body, "level": None, "anchor": None, "src": None} | more)

    def flush() -> None:
        nonlocal held, kind
        if held:
            body = "\n".join(held) if kind != "text" else " ".join(x.strip() for x in held)
            plain = visible(body) if kind != "code" else body
            if kind != "text" or not any(n.match(plain) for n in NOISE):
                add(kind, plain)
        held, kind = [], "text"

    i = 0
    if lines and lines[0].strip() == "---":
        stop = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), None)
        if stop:
            add("frontmatter", "\n".join(lines[1:stop]))
            i = stop + 1
    while i < len(lines):
        line = lines[i]
        fence = FENCE.match(line)
        if fence:
            flush()
            stop = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(fence[1]) and not lines[k].strip().strip(fence[1][0])), len(lines))
            body = "\n".join(lines[i + 1 : stop])
            add("text" if fence[2].lower() in ("plain", "text", "txt") else "code", body)
            i = stop + 1
            continue
        heading = HEADING.match(line)
        under = i + 1 < len(lines) and line.strip() and not held and re.fullmatch(r" {0,3}(=+|-{2,})\s*", lines[i + 1]) and not ROW.match(line) and not ITEM.match(line)
        if heading or under:
            flush()
            level, title = (len(heading[1]), visible(heading[2])) if heading else (1 if "=" in lines[i + 1] else 2, visible(line))
            base = slug(title)
            anchors[base] = anchors.get(base, -1) + 1
            if title:
                add("heading", title, level=level, anchor=base + (f"-{anchors[base]}" if anchors[base] else ""))
            i += 1 if heading else 2
            continue
        if ROW.match(line):
            flush()
            rows = []
            while i < len(lines) and ROW.match(lines[i]):
                rows.append([visible(c) for c in lines[i].strip().strip("|").split("|")])
                i += 1
            add("table", table_text(rows, [bool(DIVIDER.match("|".join(r))) for r in rows]))
            continue
        if not line.strip() or RULE.match(line):
            flush()
            i += 1
            continue
        images = list(IMAGE.finditer(line))
        if images:
            rest = IMAGE.sub("", line)
            flush()
            for m in images:
                add("image", m[1], src=m[2])
            line = rest
            if not line.strip():
                i += 1
                continue
        new = "list" if ITEM.match(line) else "quote" if line.lstrip().startswith(">") else "text"
        if new != kind and not (kind == "list" and line.startswith(("  ", "\t"))):
            flush()
            kind = new
        held.append(re.sub(r"^\s*>\s?", "", line) if new == "quote" else line)
        i += 1
    flush()
    return out


def table_text(rows: list[list[str]], divider: list[bool]) -> str:
    """``header：value；…`` per row; an empty first cell takes the value above it; a lone header stays as it is."""
    rows = [r for r, d in zip(rows, divider, strict=True) if not d]
    if len(rows) < 2:
        return "；".join(rows[0]) if rows else ""
    head, above, out = rows[0], None, []
    for r in rows[1:]:
        r = r + [""] * (len(head) - len(r))
        lead = True
        filled = []
        for k, c in enumerate(r):
            lead &= not c
            filled.append(above[k] if lead and above and k < len(above) else c)
        above = filled
        out.append("；".join(f"{h}：{c}" if h else c for h, c in zip(head, filled, strict=False) if c))
    return "\n".join(x for x in out if x)


def pack(parts: list[str], joint: str, most: int) -> list[str]:
    """Neighbours joined while they fit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= most:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def fit(text: str, most: int) -> list[str]:
    """A text cut into pieces of at most ``most``: at sentences, else at the last soft boundary of the window."""
    if len(text) <= most:
        return [text]
    pieces: list[str] = []
    for s in SENTENCE.findall(text):
        while len(s) > most:
            soft = max((m.end() for m in re.finditer(r"[\s，,、：:]", s[:most]) if m.end() > most * 55 // 100), default=most)
            pieces.append(s[:soft])
            s = s[soft:]
        if s:
            pieces.append(s)
    return [p for p in pack(pieces, "", most) if p.strip()]


def chunks_of(text: str | None, most: int = MAX_CHARS, least: int = MIN_CHARS) -> list[dict]:
    """Chunks of a document in order: seq, kind (text, table, code, image), heading_path, anchor, text, src, block_id, aliases.

    Under every heading prose comes first, then images, then code; prose, lists and quotes are packed up to ``most``
    characters; tables and code are never mixed with prose; a prose chunk under ``least`` is merged with its neighbour of
    the same heading where both fit. A heading that is content (an address, a label with its value) is part of its text. Then
    prose chunks of neighbouring headings with one parent are merged where one is under ``least`` and both fit, each
    under its heading's name; their paths are the chunk's aliases. Ids are made of the levels and anchors of the headings and
    a number within them.
    """
    regions: list[dict] = [{"path": [], "anchor": None, "blocks": [], "id": ""}]
    stack: list[tuple[int, str, str]] = []
    for b in blocks_of(text):
        if b["kind"] == "heading":
            while stack and stack[-1][0] >= b["level"]:
                stack.pop()
            stack.append((b["level"], b["text"], b["anchor"]))
            regions.append({"path": [t for _, t, _ in stack], "anchor": b["anchor"], "blocks": [], "id": "".join(f"/H{level}/{anchor}" for level, _, anchor in stack)})
            if CONTENT_HEADING.search(b["text"]):
                regions[-1]["blocks"].append({"kind": "text", "text": b["text"]})
        elif b["kind"] != "frontmatter":
            regions[-1]["blocks"].append(b)
    out: list[dict] = []
    for region in regions:
        own: list[tuple[str, str, str | None]] = []
        run: list[str] = []

        def close(run=run, own=own) -> None:
            packed = pack([p for t in run for p in fit(t, most)], "\n\n", most)
            k = 1
            while k < len(packed):
                if min(len(packed[k - 1]), len(packed[k])) < least and len(packed[k - 1]) + 2 + len(packed[k]) <= most:
                    packed[k - 1 : k + 1] = [packed[k - 1] + "\n\n" + packed[k]]
                else:
                    k += 1
            own.extend(("text", p, None) for p in packed)
            run.clear()

        for b in region["blocks"]:
            if b["kind"] in ("text", "list", "quote"):
                run.append(b["text"])
            elif b["kind"] == "table":
                close()
                own.extend(("table", p, None) for p in pack([p for r in b["text"].split("\n") for p in fit(r, most)], "\n", most))
        close()
        own += [("image", b["text"], b["src"]) for b in region["blocks"] if b["kind"] == "image"]
        own += [("code", p, None) for b in region["blocks"] if b["kind"] == "code" for p in pack([q for line in b["text"].split("\n") for q in fit(line, most) or [line]], "\n", most)]
        for n, (kind, body, src) in enumerate(own):
            out.append({"seq": len(out), "kind": kind, "heading_path": " > ".join(region["path"]), "anchor": region["anchor"], "text": body, "src": src, "block_id": f"{region['id']}#{n}", "aliases": [], "path": region["path"]})
    return siblings(out, most, least)


def siblings(chunks: list[dict], most: int, least: int) -> list[dict]:
    """Neighbouring prose chunks of different headings with one parent, merged where one is short and both fit."""
    out: list[dict] = []
    for c in chunks:
        a = out[-1] if out else None
        near = a is not None and a["kind"] == c["kind"] == "text" and c["path"] and a["last"] != c["path"] and len(a["last"]) == len(c["path"]) and a["last"][:-1] == c["path"][:-1]
        if near and min(a["own"], len(c["text"])) < least:
            first = a["text"] if a["aliases"] else f"【{a['last'][-1]}】\n{a['text']}"
            text = f"{first}\n\n【{c['path'][-1]}】\n{c['text']}"
            if len(text) <= most:
                aliases = [*(a["aliases"] or [a["heading_path"]]), c["heading_path"]]
                a |= {"text": text, "aliases": aliases, "heading_path": " > ".join(c["path"][:-1]) or a["heading_path"], "last": c["path"], "own": len(c["text"])}
                continue
        out.append(c | {"last": c["path"], "own": len(c["text"])})
    return [{k: v for k, v in c.items() if k not in ("last", "own", "path")} | {"seq": n} for n, c in enumerate(out)]


CHUNKS = "seq int, kind string, heading_path string, anchor string, chunk string, src string, error string, block_id string, aliases array<string>"


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", html: bool = False, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """``key`` and the chunks of every document. Null and empty documents have none; a failure is its class name in ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["k"], frame["t"], strict=True):
                try:
                    rows += [(k, c["seq"], c["kind"], c["heading_path"], c["anchor"], c["text"], c["src"], None, c["block_id"], c["aliases"]) for c in chunks_of(html_to_markdown(t) if html else t, most, least)]
                except Exception as e:  # noqa: BLE001 - one document must not end the job
                    rows.append((k, None, None, None, None, None, None, type(e).__name__, None, None))
            out = pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in CHUNKS.split(", "))])
            yield out.astype({"seq": "Int32"})

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"{key} {src.schema['k'].dataType.simpleString()}, {CHUNKS}")


def line_noise(documents: DataFrame, kept: Column | None = None) -> DataFrame:
    """noise and lines: how many lines of the texts hold knowledge and how many none (of those ``kept``, or of all)."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line"))
    lines = lines if kept is None else lines.where(kept)
    return lines.groupBy(T.line_noise(F.col("line")).alias("noise")).agg(F.count(F.lit(1)).alias("lines"))
