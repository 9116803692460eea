"""Chunking of sections with code and tables: simple, code-aware, hierarchical and hybrid.

Simple and code-aware chunking works section by section, without a shuffle. Hierarchical and hybrid planning over a document's sections is
sequential, so a document's sections are brought together (one shuffle, by document, and a sort that can spill) and worked through one document at a
time in an Arrow pass; documents are independent of each other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from docloom import conf, schemas
from docloom.conf import ChunkConfig

# --- text, as the folds of operators.chunking have it ---


def _groups(pieces: list[str], limit: int, extra: int, overlap: int = 0) -> list[list[str]]:
    out: list[list[str]] = []
    now: list[str] = []
    size = 0
    for piece in pieces:
        if now and size + len(piece) > limit:
            out.append(now)
            kept: list[str] = []
            size = 0
            while overlap > 0 and len(kept) < len(now) and size < overlap:
                kept.insert(0, now[-1 - len(kept)])
                size += len(kept[0])
            now = kept
        now = [*now, piece]
        size += len(piece) + extra
    return [*out, now] if now else out


def fixed_pieces(text: str, c: ChunkConfig) -> list[tuple[str, int, int]]:
    out, start = [], 0
    while start < len(text):
        end = min(start + c.max_size, len(text))
        if end < len(text) and c.sentences:
            cuts = [m.start() + 1 for m in re.finditer(r"[.!?](?=[ \n])", text[: end - 1]) if m.start() >= max(start + c.min_size, end - 100)]
            cuts += [end - 1] if text[end - 2 : end - 1] in tuple(".!?") and text[end - 1] in " \n" and end - 2 >= max(start + c.min_size, end - 100) else []
            end = max(cuts, default=end)
        out.append((text[start:end], start, end))
        start = end - c.overlap if end - c.overlap > start else end
    return out


def _sentences(text: str, c: ChunkConfig, mode: str) -> list[str]:
    if mode == "clean":
        return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]
    parts = re.split(c.sentence_regex, text)
    out = [(a + b).strip() for a, b in zip(parts[::2], parts[1::2])]
    return [*out, parts[-1].strip()] if len(parts) % 2 and parts[-1].strip() else out


def _running(contents: list[str]) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for content in contents:
        out.append((content, at, at + len(content)))
        at += len(content)
    return out


# --- one section's chunks; a section is a dict of schemas.SECTION_FIELDS with path and parent_id ---


def _chunk(s: dict, content: str, kind: str = "text", strategy: str = "", start: int = 0, end: int | None = None, language: str | None = None, code: bool = False, table: bool = False) -> dict:
    return {
        "chunk_type": kind, "strategy": strategy, "section_id": s["id"], "section_title": s["title"], "section_path": s["breadcrumb"] or s.get("path") or s["title"], "level": s["level"], "parent_id": s.get("parent_id"),
        "language": language, "has_code": code, "has_table": table, "start_char": start, "end_char": len(content) if end is None else end, "content": content,
    }


def _header(s: dict, c: ChunkConfig) -> str:
    return f"[Section {s['id']}: {s['title']}]\n\n" if c.header else ""


def text_chunks(s: dict, c: ChunkConfig, kind: str, mode: str = "clean") -> list[dict]:
    text = s["content"] or ""
    if not text:
        return []
    if kind == "fixed_size":
        return [_chunk(s, _header(s, c) + x, "text", kind, a, b) for x, a, b in fixed_pieces(text, c)]
    if kind == "sentence_based":
        groups = [" ".join(g) for g in _groups(_sentences(text, c, mode), c.max_size, 0, c.overlap)]
    else:
        pieces = [p for p in (x.strip() for x in text.split(c.paragraph)) if p]
        groups = [c.paragraph.join(g) for g in _groups(pieces, c.max_size, len(c.paragraph))]
    return [_chunk(s, x, "text", kind, a, b) for x, a, b in _running([_header(s, c) + g for g in groups])]


def _fence(block: dict) -> str:
    return f"```{block['language']}\n{block['content']}\n```"


def section_chunks(s: dict, c: ChunkConfig, mode: str = "paired") -> list[dict]:
    """One chunk if all fits; else a summary, the text, and a chunk for each code block and table."""
    code, tables, text = s["code_blocks"] or [], s["tables"] or [], s["content"] or ""
    size = len(text) + sum(len(b["content"]) + 100 for b in code) + sum(len(str(t["headers"])) + sum(len(str(r)) for r in t["rows"]) for t in tables)
    if size <= c.max_size:
        parts = [f"[Section {s['id']}: {s['title']}]", *([text] if text else []), *("\n" + _fence(b) for b in code)]
        for t in tables:
            parts += [*([f"\nTable: {t['caption']}"] if t["caption"] else []), f"[Table with {len(t['rows'])} rows]"]
        return [_chunk(s, "\n\n".join(parts), "mixed" if code or tables else "text", "section_based", language=code[0]["language"] if code else None, code=bool(code), table=bool(tables))]
    out = []
    if c.summary:
        said = [f"[Section Summary: {s['id']} - {s['title']}]", f"Level: {s['level']}", f"Path: {s['breadcrumb'] or s.get('path') or s['title']}"]
        if text:
            said.append("\nPreview: " + (text[:200] + "..." if len(text) > 200 else text))
        if code:
            said += [f"\nContains {len(code)} code example(s)", "Languages: " + ", ".join(sorted({b["language"] for b in code}))]
        if tables:
            said.append(f"\nContains {len(tables)} table(s)")
        out.append(_chunk(s, "\n".join(said), "header", "section_based"))
    out += text_chunks(s, c, "sentence_based", mode)
    for b in code:
        out.append(_chunk(s, f"[Code Example from Section {s['id']}: {s['title']}]\n\n{_fence(b)}", "code", "section_based", language=b["language"], code=True))
    for t in tables:
        said = [f"[Table from Section {s['id']}: {s['title']}]", *([f"Caption: {t['caption']}"] if t["caption"] else []), *(["Headers: " + " | ".join(t["headers"])] if t["headers"] else []), f"Data: {len(t['rows'])} rows"]
        said += [f"Row {i}: " + " | ".join(r) for i, r in enumerate(t["rows"][:5], 1)] + ([f"... and {len(t['rows']) - 5} more rows"] if len(t["rows"]) > 5 else [])
        out.append(_chunk(s, "\n".join(said), "table", "section_based", table=True))
    return out


# --- code-aware ---

# indentation is blanks alone: taking in line breaks would hide what follows an empty line
_PY_CLASS, _PY_DEF = re.compile(r"^([ \t]*)class\s+(\w+)\s*[(:]", re.M), re.compile(r"^([ \t]*)def\s+(\w+)\s*[(]", re.M)
_PY_BREAK = re.compile(r"\s*#.*$|(?:from\s+\S+\s+)?import\s.*$")
_CS_CLASS = re.compile(r"^([ \t]*)(?:internal|private|protected|public)?\s*(?:abstract|sealed|static)?\s*class\s+(\w+)", re.M)
_CS_SPACE = re.compile(r"^namespace\s+(\w[\w.]*)", re.M)


def python_units(code: str) -> list[tuple[str, int, int]]:
    """Classes by indentation, then top-level functions: name, start, end."""
    lines, out = code.split("\n"), []
    ends = [0]
    for line in lines:
        ends.append(ends[-1] + len(line) + 1)
    upto = lambda n: max(0, ends[n] - 1)
    for m in _PY_CLASS.finditer(code):
        at, pad = code.count("\n", 0, m.start()), " " * len(m[1])

        def closes(line: str, pad: str = pad) -> bool:
            return bool(line.strip()) and not line.startswith(pad + " ") and (not line.startswith(pad) or line[len(pad) :].startswith(("class", "def")))

        out.append((f"class {m[2]}", m.start(), upto(next((i for i in range(at + 1, len(lines)) if closes(lines[i])), len(lines)))))
    for m in _PY_DEF.finditer(code):
        if m[1]:
            continue
        at = code.count("\n", 0, m.start())
        out.append((f"def {m[2]}", m.start(), upto(next((i for i in range(at + 1, len(lines)) if lines[i].strip() and lines[i][0] != " "), len(lines)))))
    return out


def _closing(code: str, at: int, depth: int) -> int:
    """Place after the brace that closes what is open; the end if none does."""
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return at + m.end()
    return len(code)


def csharp_units(code: str) -> list[tuple[str, int, int]]:
    """Namespaces, then classes, by braces."""
    out = [(f"namespace {m[1]}", m.start(), _closing(code, m.end(), 0)) for m in _CS_SPACE.finditer(code)]
    for m in _CS_CLASS.finditer(code):
        brace = code.find("{", m.end())
        if brace >= 0:
            out.append((f"class {m[2]}", m.start(), _closing(code, brace + 1, 1)))
    return out


def split_points(code: str, language: str, most: int) -> list[int]:
    """Places after most characters where a line invites a cut."""
    lines, at, out = code.split("\n"), 0, []
    for i, line in enumerate(lines):
        at += len(line) + 1
        if at < most:
            continue
        bare = line.strip()
        if language == "python":
            follows = i + 1 < len(lines) and (_PY_DEF.match(lines[i + 1]) or _PY_CLASS.match(lines[i + 1]))
            good = not bare or _PY_BREAK.match(line) or follows
        else:
            good = bare in ("", "}") or re.match(r"using\s+.*$", line) or bare.startswith("//")
        if good:
            out.append(at)
    return out


#: Analyzers by language: (logical units, split points); a user's own go here too.
ANALYZERS = {"python": (python_units, lambda code, most: split_points(code, "python", most)), "csharp": (csharp_units, lambda code, most: split_points(code, "csharp", most))}


def split_code(block: dict, most: int, structured: bool = True, residue: bool = False) -> list[tuple[str, int, int]]:
    """A large code block by its units, else at split points, else by lines. residue: also what lies outside of all units."""
    code, language = block["content"], block["language"]
    units = ANALYZERS[language][0](code) if structured and language in ANALYZERS else []
    if units:
        out, now, size = [], [], 0

        def flush() -> None:
            if now:
                a, b = min(u[1] for u in now), max(u[2] for u in now)
                out.append((code[a:b], a, b))
                now.clear()

        for unit in units:
            n = unit[2] - unit[1]
            if n > most or size + n > most:
                flush()
                size = 0
            now.append(unit)
            size += n
            if n > most:
                flush()
                size = 0
        flush()
        if residue:
            at = 0
            for _, a, b in sorted(out, key=lambda x: x[1]):
                if a > at and code[at:a].strip():
                    out.append((code[at:a], at, a))
                at = max(at, b)
            if code[at:].strip():
                out.append((code[at:], at, len(code)))
        return out
    points = ANALYZERS[language][1](code, most) if language in ANALYZERS else []
    if points:
        cuts = [0, *[p for p in points if p < len(code)], len(code)]
        return [(code[a:b], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    lines, out, now, size = code.split("\n"), [], [], 0
    for line in lines:
        if now and size + len(line) + 1 > most:
            out.append("\n".join(now))
            now, size = [], 0
        now.append(line)
        size += len(line) + 1
    return [(x, 0, len(x)) for x in ([*out, "\n".join(now)] if now else out)]


def code_segments(s: dict) -> list[dict]:
    """Text and fenced code of the content in order, then the section's code blocks."""
    text, out, at = s["content"] or "", [], 0
    for m in re.finditer(r"`{3}(\w*)\n(.*?)\n`{3}", text, re.S):
        if text[at : m.start()].strip():
            out.append({"language": None, "content": text[at : m.start()], "structured": False})
        out.append({"language": m[1] or "text", "content": m[2], "structured": False})
        at = m.end()
    if text[at:].strip():
        out.append({"language": None, "content": text[at:], "structured": False})
    return out + [b | {"structured": True} for b in s["code_blocks"] or []]


def code_chunks(s: dict, c: ChunkConfig) -> list[dict]:
    groups: list[tuple[list[dict], int, int]] = []
    now: list[dict] = []
    size = 0
    for segment in code_segments(s):
        n = len(segment["content"])
        if segment["language"] and n > c.max_code:
            if now:
                groups.append((now, 0, 0))
                now, size = [], 0
            groups += [([segment | {"content": x}], a, b) for x, a, b in split_code(segment, c.max_code, segment["structured"])]
            continue
        if now and size + n > c.max_size:
            groups.append((now, 0, 0))
            now, size = [], 0
        now.append(segment)
        size += n
    if now:
        groups.append((now, 0, 0))
    out = []
    for segments, a, b in groups:
        said = [f"[Section {s['id']}: {s['title']}]"] if c.header else []
        for x in segments:
            said += [f"```{x['language']}", x["content"], "```"] if x["language"] else [x["content"]]
        languages = [x["language"] for x in segments if x["language"]]
        kind = "text" if not languages else "code" if len(languages) == len(segments) else "mixed"
        out.append(_chunk(s, "\n\n".join(said), kind, "code_aware", a, b, Counter(languages).most_common(1)[0][0] if languages else None, bool(languages), bool(s["tables"])))
    return out


# --- hierarchical ---


def table_text(t: dict, most: int = 10) -> str:
    out = [f"Table: {t['caption']}"] if t["caption"] else []
    n = len(t["headers"] or [])
    if n:
        out += ["| " + " | ".join(t["headers"]) + " |", "|" + " --- |" * n]
    out += ["| " + " | ".join((r + [""] * (n - len(r)))[:n] if n else r) + " |" for r in t["rows"][:most]]
    return "\n".join([*out, f"... and {len(t['rows']) - most} more rows"] if len(t["rows"]) > most else out)


def section_size(s: dict) -> int:
    cells = lambda row: sum(len(x) + 3 for x in row or [])
    tables = sum(cells(t["headers"]) + sum(map(cells, t["rows"])) + len(t["caption"] or "") for t in s["tables"] or [])
    return len(s["content"] or "") + sum(len(b["content"]) for b in s["code_blocks"] or []) + tables


class _Tree:
    def __init__(self, sections: list[dict]) -> None:
        self.by_id = {s["id"]: s for s in sections}
        self.children: dict[str, list[dict]] = {}
        for s in sections:
            if s.get("parent_id"):
                self.children.setdefault(s["parent_id"], []).append(s)

    def path(self, s: dict) -> str:
        out, seen, now = [], set(), s
        while now is not None and now["id"] not in seen:
            seen.add(now["id"])
            out.append(now["title"])
            now = self.by_id.get(now.get("parent_id"))
        return " > ".join(reversed(out))


def _whole(s: dict, tree: _Tree, c: ChunkConfig) -> list[dict]:
    code, tables, text = s["code_blocks"] or [], s["tables"] or [], s["content"] or ""
    parts = [f"[Section {s['id']}: {s['title']}]", *([f"Path: {tree.path(s)}"] if c.hierarchy else []), *([text] if text else [])]
    for b in code:
        parts += [f"\n```{b['language']}", b["content"], "```"]
    parts += [table_text(t) for t in tables]
    kind = "mixed" if code and text.strip() else "code" if code else "table" if tables else "text"
    return [_chunk(s, "\n\n".join(parts), kind, "section_based", language=code[0]["language"] if code else None, code=bool(code), table=bool(tables))]


def _summary(s: dict, tree: _Tree) -> dict:
    said = [f"[Section Summary: {s['id']} - {s['title']}]", f"Path: {tree.path(s)}", f"Level: {s['level']}"]
    text = s["content"] or ""
    if text:
        said.append("\nContent Preview:\n" + (text[:300] + "..." if len(text) > 300 else text))
    if s["code_blocks"]:
        said += [f"\nContains {len(s['code_blocks'])} code example(s)", "Languages: " + ", ".join(sorted({b["language"] for b in s["code_blocks"]}))]
    if s["tables"]:
        said.append(f"\nContains {len(s['tables'])} table(s)")
    below = tree.children.get(s["id"], [])
    if below:
        said += [f"\nSubsections ({len(below)}):", *(f"  - {x['id']} {x['title']}" for x in below[:5]), *([f"  ... and {len(below) - 5} more"] if len(below) > 5 else [])]
    return _chunk(s, "\n".join(said), "header", "section_based")


def _split(s: dict, tree: _Tree, c: ChunkConfig) -> list[dict]:
    out = [_summary(s, tree)] if c.summary else []
    texts = ["\n\n".join(g) for g in _groups((s["content"] or "").split("\n\n") if s["content"] else [], c.max_size, 0)]
    out += [_chunk(s, x, "text", "section_based") for x in texts]
    out += [_chunk(s, _fence(b), "code", "section_based", language=b["language"], code=True) for b in s["code_blocks"] or []]
    return out + [_chunk(s, table_text(t), "table", "section_based", table=True) for t in s["tables"] or []]


def _single(s: dict, tree: _Tree, c: ChunkConfig) -> list[dict]:
    return _split(s, tree, c) if section_size(s) > 2000 else _whole(s, tree, c)


def hierarchical_chunks(sections: list[dict], c: ChunkConfig) -> list[dict]:
    """Chunks of a document's sections: small leaves grouped with small siblings, large ones split, parents with their children."""
    tree, done, out = _Tree(sections), set(), []
    sizes = {s["id"]: section_size(s) for s in sections}
    for s in sorted(sections, key=lambda s: (s["level"], s["id"])):
        if s["id"] in done:
            continue
        done.add(s["id"])
        children = tree.children.get(s["id"], [])
        if sizes[s["id"]] <= 800 and not children:
            group, size = [s], sizes[s["id"]]
            for other in tree.children.get(s["parent_id"], []) if s.get("parent_id") in tree.by_id else []:
                n = sizes[other["id"]]
                if other["id"] not in done and n <= 800 and size + n <= c.max_size:
                    group.append(other)
                    size += n
                    done.add(other["id"])
            if len(group) == 1:
                out += _whole(s, tree, c)
                continue
            parts = [f"[Grouped Sections: {', '.join(x['title'] for x in group)}]"]
            for x in group:
                parts += [f"\n## {x['title']}", *([x["content"]] if x["content"] else [])]
                for b in x["code_blocks"] or []:
                    parts += [f"\n```{b['language']}", b["content"], "```"]
            out.append(_chunk(s, "\n\n".join(parts), "mixed", "section_based", code=any(x["code_blocks"] for x in group), table=any(x["tables"] for x in group)))
        elif sizes[s["id"]] > 2000:
            out += _split(s, tree, c)
        elif children:
            done.update(x["id"] for x in children)
            family = _Tree([s, *children])
            if c.summary:
                out.append(_summary(s, tree))
                out += _whole(s, tree, c) if s["content"] or s["code_blocks"] or s["tables"] else []
                out += [x for child in children for x in _single(child, family, c)]
            else:
                out += [x for each in (s, *children) for x in _single(each, family, c)]
        else:
            out += _whole(s, tree, c)
    return out


# --- hybrid ---

_FLAGS = {"(?i)": re.I, "(?s)": re.S, "(?m)": re.M}


def analyse(s: dict, children: int | None = None) -> dict:
    """Ratios, scores, type, recommended strategy and confidence of a section; as functions.text has them."""
    text, code, tables = s["content"] or "", s["code_blocks"] or [], s["tables"] or []
    full = "\n".join([*([text] if text else []), *(b["content"] for b in code), *(" ".join(r) for t in tables for r in ([t["headers"]] if t["headers"] else []) + t["rows"])])
    languages = sorted({b["language"] for b in code})
    if not full:
        return {"content_type": "pure_text", "text_ratio": 0.0, "code_ratio": 0.0, "table_ratio": 0.0, "complexity": 0.0, "readability": 0.5, "density": 0.0, "languages": [], "strategy": "fixed_size", "confidence": 0.5}
    n_code = sum(len(b["content"]) for b in code)
    n_table = sum(len(x) for t in tables for r in [t["headers"] or [], *t["rows"]] for x in r) + sum(len(t["caption"] or "") for t in tables)
    words = full.split()
    technical = sum(len(re.findall(p, full, re.I)) for p in conf.TECHNICAL)
    shapes = sum(len(re.findall(p, full, re.S)) for p in conf.CODE_SHAPES)
    density = min(1.0, (technical + 2 * shapes) / len(words)) if words else 0.0
    marks = len(re.findall(r"^#+\s+", text, re.M)) + len(re.findall(r"^\s*[-*+]\s+", text, re.M))
    terms = [min(1.0, s["level"] / 5), min(1.0, len(code) / 5), min(1.0, len(tables) / 3), *([] if children is None else [min(1.0, children / 10)]), min(1.0, marks / 20)]
    complexity = sum(terms) / len(terms)
    sentences, own = len(re.findall(r"[.!?]+", text)), text.split()
    readability = 0.5
    if sentences and own:
        together = len(re.findall("|".join(conf.TECHNICAL), text, re.I))
        readability = (max(0, 1 - (len(own) / sentences - 15) / 20) + max(0, 1 - (len(text.replace(" ", "")) / len(own) - 5) / 5) + max(0, 1 - together / len(own))) / 3
    t, k, b = len(text) / len(full), n_code / len(full), n_table / len(full)
    level = s["level"]
    cases = (
        ("code_heavy", k > 0.4 or (k > 0.2 and density > 0.3)), ("table_heavy", b > 0.3), ("mixed_content", k > 0.1 and t > 0.5), ("api_reference", density > 0.4 and level > 2),
        ("tutorial", 0.1 < density < 0.4 and level <= 3), ("examples", k > 0.05 and t > 0.6), ("structured_doc", t > 0.8 and level > 1), ("pure_text", True),
    )
    kind = next(name for name, holds in cases if holds)
    strategy, base = conf.STRATEGY_OF[kind]
    less = (complexity > 0.6) + (0.3 < k < 0.7) + (len(text) + n_code > 3000)
    return {"content_type": kind, "text_ratio": t, "code_ratio": k, "table_ratio": b, "complexity": complexity, "readability": readability, "density": density, "languages": languages, "strategy": strategy, "confidence": max(0.3, base - 0.1 * less)}


def quality(chunk: dict) -> float:
    """Mean of size, completeness, coherence and context scores."""
    text = chunk["content"]
    n = len(text)
    size = 0.5 if n < 200 else 0.8 if n < 500 else 1.0 if n <= 1200 else 0.7 if n <= 2000 else 0.3
    ended = 0.5 if not re.search(r"[.!?]", text) else 1.0 if text.rstrip().endswith((".", "!", "?", "```")) else 0.7
    fences = 0.3 if re.search(r"```[^`]*\Z", text) else 1.0 if re.search(r"```.*?```", text, re.S) else 0.8
    words = text.lower().split()
    coherence = 0.6 if len(words) < 10 else min(1.0, 5 * sum(min(k / len(words), 0.2) for w, k in Counter(words).most_common(5) if len(w) > 3 and k > 1))
    context = ((1.0 if chunk["section_title"] else 0.5) + (1.0 if chunk["section_path"] else 0.7) + (1.0 if chunk["chunk_type"] != "text" else 0.8)) / 3
    return (size + (ended + fences) / 2 + coherence + context) / 4


def adapted(c: ChunkConfig, analysis: dict) -> ChunkConfig:
    """Sizes to suit the content; all other knobs as by default."""
    base, kind = ChunkConfig(max_size=c.max_size, min_size=c.min_size, overlap=c.overlap), analysis["content_type"]
    if kind == "code_heavy":
        return replace(base, max_size=int(c.max_size * 1.2))
    if kind == "api_reference":
        return replace(base, max_size=int(c.max_size * 0.8))
    if kind == "tutorial":
        return replace(base, overlap=int(c.overlap * 1.3))
    return replace(base, max_size=int(c.max_size * 0.9), overlap=int(c.overlap * 1.2)) if analysis["readability"] < 0.5 else base


#: Section strategies by name: (section, config) -> chunks; a user's own go here too.
STRATEGIES = {
    "fixed_size": lambda s, c: text_chunks(s, c, "fixed_size"),
    "sentence_based": lambda s, c: text_chunks(s, c, "sentence_based"),
    "paragraph_based": lambda s, c: text_chunks(s, c, "paragraph_based"),
    "section_based": section_chunks,
    "code_aware": code_chunks,
}


def hybrid_section(s: dict, c: ChunkConfig) -> list[dict]:
    """The recommended strategy; below the least quality, the first fallback that reaches it, else fixed size."""
    analysis = analyse(s)
    own = adapted(c, analysis)
    run = lambda name: STRATEGIES.get(name, STRATEGIES["fixed_size"])(s, own)
    good = lambda chunks: bool(chunks) and sum(map(quality, chunks)) / len(chunks) >= conf.LEAST_QUALITY
    chunks = run(analysis["strategy"])
    if chunks and not good(chunks):
        others = [x for x in conf.FALLBACKS.get(analysis["content_type"], conf.FALLBACK) if x != analysis["strategy"]]
        chunks = next((x for x in map(run, others) if good(x)), None) or run("fixed_size")
    return [x | {"strategy": "hybrid", "language": x["language"] or next(iter(analysis["languages"]), None), "quality_score": quality(x)} for x in chunks]


def global_strategy(analyses: list[dict]) -> str:
    """Votes times mean confidence; the first of the best."""
    by: dict[str, list[float]] = {}
    for a in analyses:
        by.setdefault(a["strategy"], []).append(a["confidence"])
    return max(by, key=lambda k: sum(by[k]), default="hybrid")


def strategy_votes(analyses: DataFrame, *keys: str) -> DataFrame:
    """Of each strategy, its votes and weight (votes times mean confidence) among rows of strategy and confidence."""
    return analyses.groupBy(*keys, "strategy").agg(F.count("*").alias("votes"), F.sum("confidence").alias("weight"))


def hybrid_chunks(sections: list[dict], c: ChunkConfig) -> list[dict]:
    tree = _Tree(sections)
    best = global_strategy([analyse(s, len(tree.children.get(s["id"], []))) for s in sections])
    if best == "section_based":
        return hierarchical_chunks(sections, c)
    return [x for s in sections for x in hybrid_section(s, c)]


DOCUMENT_STRATEGIES = {"hierarchical": hierarchical_chunks, "hybrid": hybrid_chunks}
_ANALYSIS = "content_type string, text_ratio double, code_ratio double, table_ratio double, complexity double, readability double, density double, languages array<string>, strategy string, confidence double"


def _wanted(sections: DataFrame) -> list[str]:
    return ["id", "title", "level", "breadcrumb", "content", "code_blocks", "tables", *[c for c in ("parent_id", "path") if c in sections.columns]]


#: Rows, and bytes of more than one, that are taken from a batch at a time; rows and characters of their content after which what they make is handed on.
STEP, MOST_BYTES, MOST_ROWS, MOST_CHARS = 64, 4 << 20, 2000, 4 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            parts = [batch.slice(at, STEP)]
            while parts:
                part = parts.pop()
                if part.num_rows > 1 and part.nbytes > MOST_BYTES:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield from part.to_pylist()


def _documents(keys: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """A function over batches of sections (s) in order of keys: the keys and sections of a document at a time, whatever the batches' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, found = None, []
        for row in _rows(batches):
            own = {k: row[k] for k in keys}
            if found and own != now:
                yield now | {"sections": found}
                found = []
            now = own
            found.append(row["s"])
        if found:
            yield now | {"sections": found}

    return run


def _rows_to(schema: StructType, rows_of: Callable[[dict], list[dict]], rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]] = _rows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches: the rows that rows_of makes of each row, beside the row's own values of columns it doesn't make. What is held at once is bounded."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handed = lambda out: pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in arrow], schema=arrow)
        out, size = [], 0
        for row in rows(batches):
            own = {f.name: row[f.name] for f in arrow if f.name in row}
            for made in rows_of(row):
                out.append(own | made)
                size += len(made.get("content") or "")
                if len(out) >= MOST_ROWS or size >= MOST_CHARS:
                    yield handed(out)
                    out, size = [], 0
        if out:
            yield handed(out)

    return run


def _with_places(chunks: list[dict]) -> list[dict]:
    """Chunks with their quality, and their place within their section."""
    totals, at, out = Counter(x["section_id"] for x in chunks), Counter(), []
    for x in chunks:
        out.append({"quality_score": quality(x)} | x | {"chunk_index": at[x["section_id"]], "total_chunks": totals[x["section_id"]]})
        at[x["section_id"]] += 1
    return out


def _beside(sections: DataFrame, keys: tuple[str, ...], fields: str) -> StructType:
    schema = StructType([*[sections.schema[k] for k in keys], *_parse_datatype_string(fields).fields])
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


def analyses(sections: DataFrame, *keys: str) -> DataFrame:
    """keys, id and the analysis of each section (see analyse()), row by row."""
    made = sections.select(*keys, F.struct(*_wanted(sections)).alias("s"))
    return made.mapInArrow(_rows_to(_beside(sections, (*keys, "id"), _ANALYSIS), lambda row: [{"id": row["s"]["id"], **analyse(row["s"])}]), _beside(sections, (*keys, "id"), _ANALYSIS))


def chunk_sections(sections: DataFrame, strategy: str, *keys: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks (schemas.CHUNKS) of each document's sections by a strategy of STRATEGIES or DOCUMENT_STRATEGIES.

    sections: keys and schemas.SECTION_FIELDS, with parent_id and path if known. chunk_index counts within a section. Strategies of
    STRATEGIES work row by row; those of DOCUMENT_STRATEGIES need a document's sections together, in order of pos.
    """
    schema = _beside(sections, keys, schemas.CHUNKS)
    if strategy in STRATEGIES:
        rows = sections.select(*keys, F.struct(*_wanted(sections)).alias("s"))
        return rows.mapInArrow(_rows_to(schema, lambda row: _with_places(STRATEGIES[strategy](row["s"], config))), schema)
    if strategy not in DOCUMENT_STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join([*STRATEGIES, *DOCUMENT_STRATEGIES])}")
    if "pos" not in sections.columns:
        raise ValueError("sections need pos, their order in the document")
    chunks = lambda row: _with_places(DOCUMENT_STRATEGIES[strategy](row["sections"], config))
    rows = sections.select(*keys, "pos", F.struct(*_wanted(sections)).alias("s"))
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    return rows.sortWithinPartitions(*keys, "pos", "s").mapInArrow(_rows_to(schema, chunks, _documents(keys)), schema)
