"""HTML documents as relations: nodes, table of contents, sections with ordered mixed content, tables, code.

The tree work of a document is done in one Arrow pass over its row; everything between documents, and the hierarchy, is columns and joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from docloom import conf, schemas
from docloom.functions.markup import Element, parse
from docloom.operators.lineage import cut

_EXAMPLE = "section-example-container"


def _per_document(df: DataFrame, html: str, fields: str, rows_of, columns: tuple[str, ...] = ()) -> DataFrame:
    """df's other columns beside each row that rows_of makes of html; of the fields made, only columns if any are named: what nobody reads is costly to hand on."""
    rest = [f for f in df.schema if f.name != html]
    made_fields = [f for f in _parse_datatype_string(fields).fields if not columns or f.name in columns]
    schema = StructType([*[StructField(f.name, f.dataType, True) for f in rest], *made_fields])
    arrow = to_arrow_schema(schema)
    kept, made_names = [f.name for f in rest], [f.name for f in made_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, texts = batch.select(kept), batch.column(batch.schema.get_field_index(html))
            at: list[int] = []
            columns: list[list] = [[] for _ in made_names]

            def flushed() -> pa.RecordBatch:
                arrays = [pa.array(column, arrow.field(len(kept) + i).type) for i, column in enumerate(columns)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*others.take(pa.array(at, pa.int64())).columns, *arrays], schema=arrow)  # noqa: B023

            for i, text in enumerate(texts):
                for made in rows_of(text.as_py()):
                    at.append(i)
                    for column, name in zip(columns, made_names):
                        column.append(made[name])
                if len(at) >= 5000:
                    yield flushed()
                    at, columns = [], [[] for _ in made_names]
            yield flushed()

    return df.mapInArrow(run, schema)


def _node_rows(html: str | None) -> list[dict]:
    out: list[dict] = []

    def visit(e: Element, parent: int | None, depth: int) -> None:
        stack = [(e, parent, depth, None)]
        while stack:
            e, parent, depth, at = stack.pop()
            if at is not None:
                out[at]["end"] = len(out) - 1
                continue
            at = len(out)
            kids = [c for c in e.children if isinstance(c, Element)]
            own = "".join(c for c in e.children if isinstance(c, str)).strip()
            out.append({"node": at, "parent": parent, "depth": depth, "end": at, "tag": e.tag, "classes": e.classes, "attrs": list(e.attrs.items()), "text": own, "has_children": bool(kids)})
            stack.append((e, parent, depth, at))
            stack += [(k, at, depth + 1, None) for k in reversed(kids)]

    for child in parse(html).children:
        if isinstance(child, Element):
            visit(child, None, 0)
    return out


def html_nodes(df: DataFrame, html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """The elements of each document: node (its place in document order), parent, depth, end (last node below), tag, classes, attrs, own text; or some of these."""
    return _per_document(df, html, schemas.NODES, _node_rows, columns)


def nodes_within(df: DataFrame, *tags: str, html: str = "html") -> DataFrame:
    """Pairs of each node of tags and each node below it (node, tag, inner_node, inner_tag): within() of a document's own nodes, in its pass, without a join."""

    def pairs(text: str | None) -> list[dict]:
        nodes = _node_rows(text)
        below = lambda n: nodes[n["node"] + 1 : n["end"] + 1]
        return [{"node": n["node"], "tag": n["tag"], "inner_node": x["node"], "inner_tag": x["tag"]} for n in nodes if n["tag"] in tags for x in below(n)]

    return _per_document(df, html, "node int, tag string, inner_node int, inner_tag string", pairs)


# --- table of contents and sections ---


def _clean(root: Element) -> None:
    for e in [e for e in root.walk() if e.tag in conf.DROPPED_TAGS or (e.tag == "nav" and not e.first("a", where=lambda a: any(re.search(r"toc-h\d+", c) for c in a.classes)))]:
        if e.parent is not None:
            e.parent.children = [c for c in e.parent.children if c is not e]


def _toc_rows(root: Element) -> list[dict]:
    heading = root.first("h2", "h3", "h4", where=lambda e: "table of content" in e.text(False).lower())
    nav = next((e for e in heading.after() if e.tag == "nav"), None) if heading else None
    out = []
    for link in nav.all("a", where=lambda a: a.attrs.get("href", "").startswith("#")) if nav else []:
        href, full = link.attrs["href"].lstrip("#"), link.text()
        numbered = re.match(r"([\d.]+)\s+(.+)$", full)
        section, title = numbered.groups() if numbered else (href, full)
        out.append({"id": section, "title": title, "level": section.count(".") + 1, "href": href, "full_text": full})
    return out


def table_of_contents(df: DataFrame, html: str = "html") -> DataFrame:
    return _per_document(df, html, schemas.TOC, lambda text: _toc_rows(parse(text)))


def code_language(code: str) -> str:
    """As functions.text.detect_code_language(), for use within a document's pass."""
    low = code.lower()
    if any(m in low for m in conf.CLI_MARKS):
        return "cli"
    python = sum(n for m, n in conf.PYTHON_MARKS.items() if m in low)
    csharp = sum(m in low for m in conf.CSHARP_MARKS)
    return "python" if python > csharp else "csharp" if csharp else "text"


def _language_in(classes: list[str], extended: bool = False) -> str | None:
    for name in map(str.lower, classes):
        for language, marks in (("python", ("python",)), ("csharp", ("csharp", "c#") if extended else ("csharp",)), ("cli", ("cli", "bash", "shell") if extended else ("cli",))):
            if any(m in name for m in marks):
                return language
    return None


def code_of(pre: Element) -> dict | None:
    """A pre element's code; none in a div that isn't an example container, or if it is blank."""
    parent = pre.parent
    if parent is not None and parent.tag == "div" and _EXAMPLE not in parent.attrs.get("class", ""):
        return None
    language = _language_in(pre.classes, True) or (_language_in(parent.classes) if parent is not None else None) or "text"
    code = pre.first("code")
    content = (code or pre).text(False)
    if code is not None:
        for name in code.classes:
            language = _language_in([name]) or language
    if language == "text":
        language = code_language(content)
    return {"language": language, "content": content} if content.strip() else None


def table_of(table: Element) -> dict | None:
    """Headers, rows and caption; none without headers and rows."""
    cells = lambda tr, *tags: [c.text() for c in tr.all(*tags)]
    headers: list[str] = []
    head, row = table.first("thead"), table.first("tr")
    if head is not None:
        top = head.first("tr")
        headers = cells(top, "th", "td") if top is not None else []
    elif row is not None:
        headers = cells(row, "th")
    rows: list[list[str]] = []
    for tr in (table.first("tbody") or table).all("tr"):
        own = cells(tr, "td", "th")
        if own and (rows or tr.first("th") is None):
            rows.append(own)
    caption = table.first("caption")
    return {"headers": headers, "rows": rows, "caption": caption.text() if caption is not None else None} if headers or rows else None


def inline_code(code: Element) -> str:
    content = code.text()
    language = next((x for x in map(lambda c: _language_in([c]), code.classes) if x in ("python", "csharp")), "code")
    return f"{content}({language})" if content else ""


def formatted_text(e: Element) -> str:
    """Text with inline code marked, without example containers and their code."""
    parts = []
    for child in e.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "code":
            parts.append(inline_code(child))
        elif child.tag == "div" and _EXAMPLE in child.attrs.get("class", ""):
            continue
        elif child.tag == "pre":
            if not (e.tag == "div" and _EXAMPLE in e.attrs.get("class", "")):
                parts.append(child.text(False))
        else:
            parts.append(formatted_text(child))
    return "".join(parts).strip()


def error_text(e: Element) -> str:
    return f"⚠️ Error: {e.text()}"


def step_text(e: Element) -> str:
    said = [t for t in (p.text() for p in e.all("p")) if t] or [t for t in [e.text()] if t]
    return "\n\n".join(said)


def fieldset_text(e: Element) -> str:
    out = []
    legend = e.first("div", where=lambda x: "example-legend" in x.classes)
    if legend is not None:
        out.append(f"📚 {legend.text()}:")
    for link in e.all("a", where=lambda x: "example-algorithm-link" in x.classes):
        href = link.attrs.get("href", "")
        badge = link.first("span", where=lambda x: any("badge" in c for c in x.classes))
        name = href.rsplit("/", 1)[-1] if href else link.text()
        out.append(f"  - {name} ({badge.text()})" if badge is not None else f"  - {name}")
    return "\n".join(out)


_SPECIAL = (("error-messages", "Error Message", error_text), ("tutorial-step", "Tutorial Step", step_text), ("example-fieldset", "Example Algorithms", fieldset_text))


def api_text(div: Element) -> str:
    """Headings, paragraphs and code snippets of a resolved type's container."""
    container = div.first("div", where=lambda e: "inner-tree-container" in e.classes)
    out = []
    for e in container.walk() if container is not None else ():
        said = e.text()
        if e.tag == "h4":
            out.append(f"## {said}")
        elif e.tag == "p" and said:
            out.append(said)
        elif e.tag == "div" and "code-snippet" in e.classes and said:
            out.append(f"`{said}`")
    return "\n".join(out)


def api_plain_text(html: str, value: str) -> str:
    """A rendered type as plain text."""
    out = [f"[API Reference: {value}]"]
    for e in parse(html).all("h4", "p", "div"):
        said = e.text()
        if e.tag == "h4":
            out.append(f"\n{said}")
        elif e.tag == "p":
            out.append(said)
        elif "code-snippet" in e.classes and said:
            out.append(f"- {said}")
    return "\n".join(out)


class _Section:
    """Collects a section's mixed elements, code, tables and text."""

    def __init__(self) -> None:
        self.mixed: list[dict] = []
        self.code: list[dict] = []
        self.tables: list[dict] = []
        self.said: list[str] = []

    def add(self, kind: str, content: str, order: int, language: str | None = None, title: str | None = None, context: str | None = None) -> None:
        self.mixed.append({"pos": len(self.mixed), "type": kind, "content": content, "order": order, "language": language, "title": title, "context": context})

    def add_code(self, pre: Element, order: int) -> bool:
        found = code_of(pre)
        if found is None:
            return False
        self.code.append({"language": found["language"], "content": found["content"].strip()})
        self.add("code", found["content"], order, found["language"], conf.CODE_TITLES.get(found["language"], f"{found['language']} Code Example"))
        return True

    def add_table(self, table: Element, order: int) -> None:
        found = table_of(table)
        if found:
            self.tables.append(found)
        self.add("table", "[Table Data]", order, title="Data Table")

    def add_api(self, e: Element, order: int) -> int:
        """The resolved type of a data-tree element, in both languages."""
        value = e.attrs.get("data-tree", "")
        if not value or e.first("div", where=lambda x: "base-expandable-type" in x.classes) is None:
            return order
        for language, mark in (("python", ""), ("csharp", " (C#)")):
            div = e.first("div", where=lambda x: language in x.classes)
            said = api_text(div) if div is not None else ""
            if said:
                self.add("api_content", said, order, language, f"API: {value}{mark}", f"Resolved from data-tree: {value}")
                order += 1
        return order

    def add_text(self, e: Element, order: int) -> str:
        special = [(title, say(x)) for name, title, say in _SPECIAL for x in e.all("div", where=lambda x: name in x.classes)]
        special = [(title, text) for title, text in special if text]
        for i, (title, text) in enumerate(special):
            self.add("text", text, order + i, title=title)
        if special:
            return "\n\n".join(text for _, text in special)
        self._containers(e, order)
        text = formatted_text(e)
        if len(text.strip()) > 10:
            self.add("text", text, order)
        return text

    def _containers(self, e: Element, order: int) -> None:
        if e.tag == "div" and _EXAMPLE in e.attrs.get("class", ""):
            for pre in e.all("pre"):
                self.add_code(pre, order)
            return
        for child in e.children:
            if isinstance(child, Element):
                self._containers(child, order)

    def add_body(self, body: Element, order: int) -> None:
        for child in body.children:
            if isinstance(child, str):
                if child.strip():
                    self.said.append(child.strip())
                    self.add("text", child.strip(), order)
                    order += 1
                continue
            special = next(((title, say) for name, title, say in _SPECIAL if child.tag == "div" and name in child.attrs.get("class", "")), None)
            if special:
                text = special[1](child)
                if text:
                    self.said.append(text)
                    self.add("text", text, order, title=special[0])
                    order += 1
            elif child.tag == "pre":
                if self.add_code(child, order):
                    self.said.append("[Code Block]")
                    order += 1
            elif child.tag == "table":
                self.add_table(child, order)
                self.said.append("[Table]")
                order += 1
            else:
                text = self.add_text(child, order)
                if text and not (text.startswith("{") and text.endswith("}")):
                    self.said.append(text)

    def row(self) -> dict:
        return {"content": " ".join("\n\n".join(self.said).split()), "mixed": self.mixed, "code_blocks": self.code, "tables": self.tables}


def _fill(section: _Section, start: Element) -> None:
    """What follows a section's head, up to the next head."""
    order = 1
    for e in start.after():
        if (e.tag == "p" and "page-breadcrumb" in e.classes) or (e.tag == "div" and "page-heading" in e.classes):
            break
        if e.tag == "p" and "page-break" in e.attrs.get("style", ""):
            continue
        for tree in [*([e] if e.attrs.get("data-tree") else []), *e.all("div", where=lambda x: "data-tree" in x.attrs)]:
            order = section.add_api(tree, order)
        if e.attrs.get("data-tree"):
            continue
        if e.tag == "h3":
            if e.text():
                section.said.append(f"### {e.text()}")
                section.add("text", f"### {e.text()}", order)
                order += 1
        elif e.tag == "html":
            body = e.first("body")
            if body is not None:
                section.add_body(body, order)
                order += sum(m["order"] >= order for m in section.mixed)
        elif e.tag == "pre":
            order += section.add_code(e, order)
        elif e.tag == "table":
            section.add_table(e, order)
            order += 1
        else:
            text = section.add_text(e, order)
            if text and text not in section.said:
                section.said.append(text)


def slug_id(title: str) -> str:
    import hashlib

    bare = re.sub(r"-+", "-", re.sub(r"[^a-z0-9\-]", "", title.lower().replace(" ", "-")))
    digest = hashlib.md5(title.encode("utf-8"), usedforsecurity=False)
    return f"{bare}-{digest.hexdigest()[:6]}"


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _from_headings(root: Element) -> list[dict]:
    out = []
    for h in root.all(*_HEADINGS):
        if "table of content" in h.text(False).lower():
            continue
        around = h.above("section")
        while around is not None and not around.attrs.get("id"):
            around = around.above("section")
        level, section = int(h.tag[1]), _Section()
        for e in h.after():
            if e.tag in _HEADINGS and int(e.tag[1]) <= level:
                break
            if e.tag == "pre":
                found = code_of(e)
                if found:
                    section.code.append({"language": found["language"], "content": found["content"].strip()})
            elif e.tag in ("p", "ul", "ol") and (text := formatted_text(e)):
                section.said.append(text)
        own = h.attrs.get("id") or (around.attrs["id"] if around is not None else "") or slug_id(h.text(False))
        out.append({"id": own, "title": h.text(), "level": level, "section_number": "", "breadcrumb": ""} | section.row())
    return out


def section_rows(html: str | None) -> list[dict]:
    """A document's sections with something in them, in document order."""
    root = parse(re.sub(r"(?i)^<!DOCTYPE[^>]*>", "", html or ""))
    toc = {t["id"]: t for t in _toc_rows(root)}
    _clean(root)
    found, crumb, out = [], "", []
    for e in root.walk():
        if e.tag == "p" and "page-breadcrumb" in e.classes:
            crumb = e.text()
        elif e.tag == "section" and "id" in e.attrs:
            found.append((e, crumb))
    if not found:
        out = _from_headings(root)
    for e, crumb in found:
        own = e.attrs["id"]
        if not own:
            continue
        known, head = toc.get(own, {}), e.first("h2") or e.first("h1")
        title = head.text() if head is not None else known.get("title", f"Section {own}")
        section = _Section()
        around = e.parent
        _fill(section, around if around is not None and around.tag == "div" and "page-heading" in around.classes else e)
        out.append({"id": own, "title": title, "level": known.get("level", own.count(".") + 1), "section_number": own, "breadcrumb": crumb} | section.row())
    ids = {r["id"] for r in out}
    parents = {i.rpartition(".")[0] for i in ids if "." in i}
    kept = [r for r in out if r["content"] or r["code_blocks"] or r["tables"] or r["mixed"] or r["id"] in parents]
    return [r | {"pos": i} for i, r in enumerate(kept)]


def sections(df: DataFrame, html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """Sections of each document, df's other columns beside them; all of schemas.SECTION_FIELDS, or columns of them."""
    return _per_document(df, html, schemas.SECTION_FIELDS, section_rows, columns)


def placed(found: list[dict]) -> list[dict]:
    """A document's sections with parent_id, path and depth: as with_parents(), with_paths() and tree() have them."""
    titles: dict[str, str] = {}
    for r in found:
        titles[r["id"]] = min(titles.get(r["id"], r["title"]), r["title"])
    upper = {i: i.rpartition(".")[0] for i in titles if "." in i and i.rpartition(".")[0] in titles}

    def said(section_id: str) -> list[str]:
        out = [titles[section_id]]
        while section_id in upper:
            section_id = upper[section_id]
            out.append(titles[section_id])
        return out[::-1]

    paths = {i: said(i) for i in titles}
    return [r | {"parent_id": upper.get(r["id"]), "path": " > ".join(paths[r["id"]]), "depth": len(paths[r["id"]]) - 1} for r in found]


def section_trees(df: DataFrame, html: str = "html", columns: tuple[str, ...] = (), depth: int | None = None) -> DataFrame:
    """Sections with parent_id, path and depth (0 of a root), made in the document's own pass, without joins; depth: down to that depth."""
    rows = lambda text: [r for r in placed(section_rows(text)) if depth is None or r["depth"] <= depth]
    return _per_document(df, html, f"{schemas.SECTION_FIELDS}, parent_id string, path string, depth int", rows, columns)


def sections_with_contents(df: DataFrame, html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """Sections with toc_title and toc_level, as with_contents() has them, from the document's own pass; of entries of one id the first counts."""

    def rows(text: str | None) -> list[dict]:
        first: dict[str, dict] = {}
        for t in _toc_rows(parse(text)):
            first.setdefault(t["id"], t)
        known = lambda r: first.get(r["id"], {})
        return [r | {"toc_title": known(r).get("title"), "toc_level": known(r).get("level")} for r in section_rows(text)]

    return _per_document(df, html, f"{schemas.SECTION_FIELDS}, toc_title string, toc_level int", rows, columns)


# --- hierarchy of sections that are relations: joins and windows ---
# What a pass over documents makes is estimated far too small, so that joins of it would be broadcast: they are merge joins, by hint.


def id_order(section_id: Column) -> Column:
    """Sort key of a dotted id: its numeric parts."""
    return F.transform(F.filter(F.split(section_id, r"\."), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("bigint"))


def with_parents(df: DataFrame, *keys: str) -> DataFrame:
    """parent_id: the id less its last part, where there is such a section in the same document."""
    upper = F.when(F.col("id").contains("."), F.regexp_replace("id", r"\.[^.]*$", ""))
    known = df.select(*keys, F.col("id").alias("__parent")).distinct()
    return df.withColumn("__parent", upper).join(known.withColumn("__known", F.lit(True)).hint("merge"), [*keys, "__parent"], "left").withColumn("parent_id", F.when(F.col("__known"), F.col("__parent"))).drop("__parent", "__known")


def last_before(df: DataFrame, value: Column, *keys: str, order: str = "pos") -> Column:
    """Of each row, the last value that isn't null among the rows before it in its document (a section's breadcrumb, say)."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def with_level_parents(df: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """parent_id: the nearest earlier section of a smaller level (levels up to 9 looked up by windows; no self-join)."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct(F.col(order).alias("at"), F.col("id").alias("id"))), ignorenulls=True).over(before) for n in range(1, 10)]
    shallower = F.array(*[F.when(F.col("level") > n, x) for n, x in enumerate(last, 1)])
    return df.withColumn("parent_id", F.array_max(shallower)["id"])


def with_paths(df: DataFrame, *keys: str) -> DataFrame:
    """path: titles from the root, joined by ' > ', whatever the depth.

    Each round doubles how far every section has followed its parents, so there are as many as the logarithm of the depth; a parent that
    isn't there, or that has been met already, ends a path. Of sections of one id the least by title counts as a parent.
    """
    own = df.where("id is not null").groupBy(*keys, "id").agg(F.min(F.struct("title", "parent_id")).alias("s"))
    state = cut(own.select(*keys, "id", F.col("s.parent_id").alias("next"), F.array("id").alias("ids"), F.array(F.coalesce("s.title", F.lit(""))).alias("titles")))
    while True:
        up = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("id").alias("__id"), F.col("next").alias("__next"), F.col("ids").alias("__ids"), F.col("titles").alias("__titles"))
        both = state.join(up.hint("merge"), reduce(and_, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("next") == F.col("__id")]), "left")
        more = F.col("__id").isNotNull() & ~F.arrays_overlap("ids", F.coalesce("__ids", F.array().cast("array<string>")))
        joined = lambda x: F.when(more, F.concat(f"__{x}", x)).otherwise(F.col(x)).alias(x)
        state = cut(both.select(*keys, "id", F.when(more, F.col("__next")).alias("next"), joined("ids"), joined("titles")))
        if not state.where("next is not null").limit(1).count():
            break
    paths = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("id").alias("__id"), F.array_join("titles", " > ").alias("path"))
    return df.join(paths.hint("merge"), reduce(and_, [*[df[k].eqNullSafe(paths[f"__{k}"]) for k in keys], df["id"] == paths["__id"]]), "left").select(*[df[c] for c in df.columns], F.coalesce("path", "title").alias("path"))


def with_children(df: DataFrame, *keys: str) -> DataFrame:
    """n_children and is_leaf."""
    n = df.where("parent_id is not null").groupBy(*keys, F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return df.join(n.hint("merge"), [*keys, "id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("is_leaf", F.col("n_children") == 0)


def siblings(df: DataFrame, *keys: str) -> DataFrame:
    """(id, sibling) of sections with the same parent."""
    a, b = df.select(*keys, "parent_id", "id"), df.select(*keys, "parent_id", F.col("id").alias("sibling"))
    return a.join(b.hint("merge"), [*keys, "parent_id"]).where("id <> sibling")


def descendants(df: DataFrame, *keys: str, depth: int | None = None) -> DataFrame:
    """(ancestor, id, distance), down to depth levels, by default to the leaves; a section that is its own ancestor goes no further."""
    edges = cut(df.where("parent_id is not null").select(*keys, F.col("parent_id").alias("ancestor"), "id"))
    out = step = edges.withColumn("distance", F.lit(1))
    up = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("id").alias("__via"), F.col("ancestor").alias("__above"))
    n = 1
    while depth is None or n < depth:
        n += 1
        on = reduce(and_, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("ancestor") == F.col("__via")])
        step = cut(step.where("ancestor != id").join(up.hint("merge"), on).select(*keys, F.col("__above").alias("ancestor"), "id", F.lit(n).alias("distance")))
        if not step.limit(1).count():
            break
        out = out.unionByName(step)
    return out


def within(outer: DataFrame, inner: DataFrame, *keys: str) -> DataFrame:
    """Pairs of an outer node and each node below it (inner_node, inner_tag), by the nodes' intervals; outer's columns are kept."""
    low = inner.select(*keys, F.col("node").alias("inner_node"), F.col("tag").alias("inner_tag"))
    return outer.join(low.hint("merge"), [*keys]).where((F.col("inner_node") > F.col("node")) & (F.col("inner_node") <= F.col("end")))


def with_contents(found: DataFrame, contents: DataFrame, *keys: str) -> DataFrame:
    """Sections beside the title and level of their first entry in the table of contents, null where there is none."""
    first = contents.groupBy(*keys, "id").agg(F.first("title").alias("toc_title"), F.first("level").alias("toc_level"))
    return found.join(first.hint("merge"), [*keys, "id"], "left")


def tree(df: DataFrame, *keys: str, depth: int) -> DataFrame:
    """Roots (depth 0) and what lies at most depth levels below them, parents before children within each round."""
    out = step = root_sections(df).withColumn("depth", F.lit(0))
    for n in range(1, depth + 1):
        up = step.select(*keys, F.col("id").alias("__up"))
        step = df.join(up.hint("merge"), [*[df[k].eqNullSafe(up[k]) for k in keys], df["parent_id"] == up["__up"]], "left_semi").withColumn("depth", F.lit(n))
        out = out.unionByName(step)
    return out


def api_plain_texts(df: DataFrame, html: str = "html") -> DataFrame:
    """text of each row's rendered type (html, value)."""
    fields = "text string"
    both = df.withColumn(html, F.to_json(F.struct(F.col("value").alias("v"), F.col(html).alias("h"))))
    return _per_document(both, html, fields, lambda row: [{"text": api_plain_text(json.loads(row).get("h", ""), json.loads(row).get("v", ""))}])


def find_section(df: DataFrame, section_id: str) -> DataFrame:
    return df.where(F.col("id") == section_id).orderBy("pos").limit(1)


def sections_at_level(df: DataFrame, level: int) -> DataFrame:
    return df.where(F.col("level") == level)


def sections_with_code(df: DataFrame, language: str | None = None) -> DataFrame:
    return df.where(F.size("code_blocks") > 0) if language is None else df.where(F.exists("code_blocks", lambda b: b["language"] == language))


def root_sections(df: DataFrame) -> DataFrame:
    return df.where("parent_id is null")


def elements(df: DataFrame, *keys: str) -> DataFrame:
    """The mixed elements, a row each."""
    return df.select(*keys, "id", F.explode("mixed").alias("e")).select(*keys, "id", "e.*")
