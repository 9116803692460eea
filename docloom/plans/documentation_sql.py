"""DuckDB SQL for the queries of plans.documentation, from the parts alone."""

from __future__ import annotations

_NAMES = dict(zip("knbtz", ("p_partkey", "p_name", "p_brand", "p_type", "p_size")))


def _said(template: str) -> str:
    """SQL of a text with {k}, {n}, {b}, {t} and {z} taken from a part."""
    out, rest = [], template
    while rest:
        text, brace, rest = rest.partition("{")
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        if brace:
            name, _, rest = rest.partition("}")
            out.append(f"{_NAMES[name]}::varchar")
    return "(" + (" || ".join(out) or "''") + ")"


def _null(template: str | None) -> str:
    return "null::varchar" if template is None else _said(template)


def _rows(columns: str, *rows: str) -> str:
    """One row of each part for each of rows, which name columns."""
    names = columns.split()
    made = (f"select p_partkey, {', '.join(f'{v} as "{c}"' for c, v in zip(names, row))} from part" for row in rows)
    return " union all ".join(made)


_SECTIONS = (
    (0, "1", "The {n}", 1, "Parts / {t}", "The {n} of {b} has size {z}. ### Notes on {t} first notenote {z} short"),
    (1, "1.1", "Price of {n}", 2, "Parts / {t} / Price", "Call price({k})(python) or {b}(code) now. ⚠️ Error: Do not sell {n} First {k} then {z} 📚 Examples: - {b}.py (Py)"),
    (2, "1.2", "Code", 2, "Parts / {t} / Code", "not an example {k}"),
    (3, "1.2.1", "API of {b}", 3, "API", ""),
)
_CODE = (("csharp", "var p = {k};"), ("python", "p = {k}"), ("python", "import numpy as np\ndef f(self):\n    return {k}"), ("cli", "pip install {n}"))
_TITLES = {"csharp": "C# Code Example", "python": "Python Code Example", "cli": "Command Line Example", "text": "Code Example"}
_API = "Resolved from data-tree: {b}"
#: section, pos, type, content, order, language, title, context
_ELEMENTS = (
    ("1", 0, "text", "The {n} of {b}\n  has size {z}.", 1, None, None, None),
    ("1", 1, "text", "### Notes on {t}", 1, None, None, None),
    ("1", 2, "text", "first notenote {z}", 2, None, None, None),
    ("1.1", 0, "text", "Call price({k})(python) or {b}(code) now.", 1, None, None, None),
    ("1.1", 1, "table", "[Table Data]", 1, None, "Data Table", None),
    ("1.1", 2, "table", "[Table Data]", 2, None, "Data Table", None),
    ("1.1", 3, "text", "⚠️ Error: Do not sell {n}", 3, None, "Error Message", None),
    ("1.1", 4, "text", "First {k}\n\nthen {z}", 3, None, "Tutorial Step", None),
    ("1.1", 5, "text", "📚 Examples:\n  - {b}.py (Py)", 3, None, "Example Algorithms", None),
    *(("1.2", i if i < 2 else i + 1, "code", content, (1, 1, 1, 2)[i], language, _TITLES[language], None) for i, (language, content) in enumerate(_CODE)),
    ("1.2", 2, "text", "not an example {k}", 1, None, None, None),
    ("1.2.1", 0, "api_content", "## {b}\nA brand of size {z}.\n`get({k})`", 1, "python", "API: {b}", _API),
    ("1.2.1", 1, "api_content", "## {b}CS", 2, "csharp", "API: {b} (C#)", _API),
)
_NESTED = (
    ("1", 0, "text", "bare {n}", 1, None, None, None),
    ("1", 1, "code", "x = {k}", 2, "text", "Code Example", None),
    ("1", 2, "table", "[Table Data]", 3, None, "Data Table", None),
    ("1", 3, "text", "⚠️ Error: bad {b}", 4, None, "Error Message", None),
    ("1", 4, "text", "A paragraph of {b}.", 5, None, None, None),
)
#: class: depths of its elements in each page
_DEPTHS = {
    "site": [2], "toc-h1": [5], "toc-h2": [5, 5], "toc-h3": [5], "page-heading": [2], "python": [3, 3, 4], "csharp": [3, 4], "box": [2, 2], "error-messages": [3], "tutorial-step": [3],
    "example-fieldset": [3], "example-legend": [4], "example-algorithm-link": [4], "badge-py": [5], "section-example-container": [2], "plain": [2], "base-expandable-type": [3],
    "inner-tree-container": [5, 5], "code-snippet": [6],
}
_CONTENTS = (("1", "{n}", 1), ("1.1", "Price of {n}", 2), ("1.2", "Code", 2), ("1.2.1", "API", 3))
_TABLES = ((0, "Brand|Price", "{b}|{z};all|{k}", "Prices {k}"), (1, "Size", "{z}", None))
_PATHS = {"1": "The {n}", "1.1": "The {n} > Price of {n}", "1.2": "The {n} > Code", "1.2.1": "The {n} > Code > API of {b}"}


def _slug(title: str) -> str:
    sql = _said(title)
    return f"regexp_replace(regexp_replace(replace(lower({sql}), ' ', '-'), '[^a-z0-9\\-]', '', 'g'), '-+', '-', 'g') || '-' || substr(md5({sql}), 1, 6)"


def _elements(rows) -> str:
    return _rows("id pos type content ord language title context", *((f"'{i}'", pos, f"'{kind}'", _said(content), order, _null(language), _null(title), _null(context)) for i, pos, kind, content, order, language, title, context in rows))


def oracle_sql() -> dict[str, str]:
    parent = lambda i: f"'{i.rpartition('.')[0]}'" if "." in i else "null::varchar"
    depths = " union all ".join(f"select '{c}' as class, {round(sum(d) / len(d), 6)}::double avg_depth, {min(d)} min_depth, {max(d)} max_depth, {len(d)} * count(*) n from part" for c, d in _DEPTHS.items())
    markdown = "**Prices {k}**\n\n| Brand | Price |\n| --- | --- |\n| {b} | {z} |\n| all | {k} |"
    from docloom.plans import documentation as d

    derived = lambda i: " ".join(f"[{title}]" if kind == "code" else content for own, _, kind, content, _, _, title, _ in sorted(_ELEMENTS, key=lambda e: e[:2]) if own == i and kind in ("code", "text"))
    each = [(f"class_{c}", len(x)) for c, x in _DEPTHS.items()] + [("attr_data-tree", 1), ("id_N.N", 2), ("id_N.N.N", 1)]
    third = "count(*) filter (p_partkey % 3 = 0)"
    counts = " union all ".join([*(f"select '{i}' pattern_id, {n} * count(*) frequency from part" for i, n in each), f"select 'class_page-breadcrumb', 4 * count(*) + {third} from part", f"select 'id_N', count(*) + {third} from part"])
    page = f"{_said(d._HEAD + d._PRICE + d._CODE + d._API)} || case when p_partkey % 3 = 0 then {_said(d._EMPTY)} else '' end || '</body></html>'"
    has = lambda i: "true" if i == "1.2" else "false"
    return {
        "doc_contents": _rows("id title level href full_text", *((f"'{i}'", _said(t), lv, f"'{i}'", _said(f"{i} {t}")) for i, t, lv in _CONTENTS)),
        "page_sections": _rows("pos id title level section_number breadcrumb content", *((p, f"'{i}'", _said(t), lv, f"'{i}'", _said(b), _said(c)) for p, i, t, lv, b, c in _SECTIONS)),
        "heading_titles": _rows(
            "pos id title level content n_code",
            (0, _said("top{k}"), _said("Part {k}"), 1, _said("The {n}. More on {b}. one{z} none end {z}"), 1),
            (1, _slug("Type {t}"), _said("Type{t}"), 2, _said("one{z}"), 1),
            (2, _slug("Deep"), _said("Deep"), 3, _said("Below."), 0),
            (3, _slug("Last & least"), _said("Last & least"), 4, _said("end {z}"), 0),
        ),
        "doc_elements": _elements(_ELEMENTS),
        "nested_body_elements": _elements(_NESTED),
        "nested_body_sections": _rows("id content n_tables", ("'1'", _said("bare {n} [Code Block] [Table] ⚠️ Error: bad {b} A paragraph of {b}."), 1)),
        "doc_code": _rows("id place language content", *(("'1.2'", i, f"'{language}'", _said(c)) for i, (language, c) in enumerate(_CODE))),
        "doc_tables": _rows("id place headers cells caption", *(("'1.1'", i, f"'{h}'", _said(c), _null(caption)) for i, h, c, caption in _TABLES)),
        "class_depth_stats": f"{depths} union all select 'page-breadcrumb', 2.0::double, 2, 2, 4 * count(*) + count(*) filter (p_partkey % 3 = 0) from part",
        "nodes_within": "select tag, k * (select count(*) from part) n from (values ('nav', 10), ('ul', 10), ('table', 16)) v(tag, k)",
        "sections_with_language": "select p_partkey, '1.2' id from part",
        "point_lookup": "select p_partkey, '1.1' id, 'Price of ' || p_name title from part where p_partkey = 7",
        "tree_to_depth": _rows("id depth parent_id", *((f"'{i}'", i.count("."), parent(i)) for _, i, *_ in _SECTIONS if i.count(".") < 2)),
        "contents_joined": _rows("id toc_title toc_level", *((f"'{i}'", _said(t), lv) for i, t, lv in _CONTENTS)),
        "api_texts": f"select p_partkey, {_said('[API Reference: {b}]' + chr(10) + chr(10) + '{b}' + chr(10) + 'Size {z}.' + chr(10) + '- get({k})')} as text from part",
        "config_of_sections": _rows("id preset", ("'1'", "'default'"), ("'1.1'", "'default'"), ("'1.2'", "'csharp'"), ("'1.2.1'", "'api_reference'")),
        "rag_rows_v1": _rows(
            "id path has_code has_tables languages code_keys table_0 parent_id",
            *((f"'{i}'", _said(_PATHS[i]), has(i), "true" if i == "1.1" else "false", "'cli,csharp,python'" if i == "1.2" else "''", "'code_block_0,code_block_1,code_block_2,code_block_3'" if i == "1.2" else "''", _said(markdown) if i == "1.1" else "null::varchar", parent(i)) for _, i, *_ in _SECTIONS),
        ),
        "parsed_round_trip": _rows("pos id title level breadcrumb parent_id content n_code n_tables", *((n, f"'{i}'", _said(t), lv, _said(b), parent(i), _said(derived(i)), 4 if i == "1.2" else 0, 2 if i == "1.1" else 0) for n, i, t, lv, b, _ in _SECTIONS)),
        "parsed_statistics": f"select p_partkey, 4 n_sections, 4 total_sections, 4 total_code_blocks, 2 total_tables, {len(_ELEMENTS)} total_mixed_elements, 'cli,csharp,python' languages from part",
        "html_files": f"select p_partkey, md5({page}) digest from part where p_partkey < 24",
        "snapshot_counts": f"select pattern_id, frequency from ({counts})",
        "adaptive_coverage": f"select round(sum(frequency) filter (pattern_id not like 'id!_%' escape '!') / sum(frequency), 6)::double coverage, count(*) n_baseline, count(*) filter (pattern_id not like 'id!_%' escape '!') n_found, 1.0::double last_ratio from ({counts})",
        "section_statistics": f"select p_partkey, 4 total_sections, 4 total_code_blocks, 2 total_tables, {len(_ELEMENTS)} total_mixed_elements, 'cli,csharp,python' languages from part",
    }


# --- chunks of sections ---

_N, _NN = "chr(10)", "chr(10) || chr(10)"
_DEFAULTS = {"language": "null::varchar", "has_code": "false", "has_table": "false", "start_char": "0", "end_char": "length(content)"}


def _made(source: str, key: str, **columns: str) -> str:
    """A select of chunks from source; columns not given have their defaults."""
    given = {**_DEFAULTS, **columns}
    content, rest = given.pop("content"), ", ".join(f"{v} as {c}" for c, v in given.items() if c not in ("where", "end_char"))
    return f"select *, {given['end_char']} end_char from (select {key}, {rest}, {content} as content from {source} where {columns.get('where', 'true')})"


def _chunk_rows(key: str, parts: list[str]) -> str:
    columns = f"{key}, section_id, ord, chunk_type, strategy, language, has_code, has_table, start_char, end_char, content"
    made = " union all ".join(f"select {columns} from ({p})" for p in parts)
    return f"""made as materialized ({made}) select {key}, section_id, row_number() over (partition by {key}, section_id order by ord) - 1 chunk_index, count(*) over (partition by {key}, section_id) total_chunks, chunk_type, strategy,
        language, has_code, has_table, start_char::bigint start_char, end_char::bigint end_char, length(content) n_chars, md5(content) digest from made"""


def _fence(language: str, content: str, joiner: str = _N) -> str:
    return f"'```{language}' || {joiner} || {content} || {joiner} || '```'"


def _section_parts() -> tuple[str, list[str]]:
    """Tables before, and chunks, of documents as sections."""
    from docloom.plans.oracles import _PAIRED, _SENTENCE_FOLD, _numbered

    before = f"""{_numbered(_PAIRED)}, {_SENTENCE_FOLD}, sec as materialized (select *, doc_id % 3 = 0 c1, doc_id % 6 = 0 c2, doc_id % 4 = 0 tb, doc_id % 8 = 0 cap, 's' || doc_id section_id,
        length(text) + case when doc_id % 3 = 0 then length('x = ' || doc_id) + 100 else 0 end + case when doc_id % 6 = 0 then 104 else 0 end + case when doc_id % 4 = 0 then 18 + length(lang) + length(source) else 0 end size from documents)"""
    head = "section_id || ': ' || lang || ']'"
    python, csharp = _fence("python", "'x = ' || doc_id"), _fence("csharp", "'y();'")
    single = f"""'[Section ' || {head} || {_NN} || text || case when c1 then {_NN} || {_N} || {python} else '' end || case when c2 then {_NN} || {_N} || {csharp} else '' end
        || case when cap then {_NN} || {_N} || 'Table: Cap' else '' end || case when tb then {_NN} || '[Table with 1 rows]' else '' end"""
    summary = f"""'[Section Summary: ' || section_id || ' - ' || lang || ']' || {_N} || 'Level: 2' || {_N} || 'Path: ' || source || {_NN} || 'Preview: ' || substr(text, 1, 200) || case when length(text) > 200 then '...' else '' end
        || case when c1 then {_NN} || 'Contains ' || (1 + c2::int) || ' code example(s)' || {_N} || 'Languages: ' || case when c2 then 'csharp, ' else '' end || 'python' else '' end || case when tb then {_NN} || 'Contains 1 table(s)' else '' end"""
    table = f"""'[Table from Section ' || {head} || {_N} || case when cap then 'Caption: Cap' || {_N} else '' end || 'Headers: a | b' || {_N} || 'Data: 1 rows' || {_N} || 'Row 1: ' || lang || ' | ' || source"""
    example = f"'[Code Example from Section ' || {head} || {_NN} || "
    running = "(select c.doc_id, 's' || c.doc_id section_id, c.chunk_index, c.content said, sum(length(c.content)) over (partition by c.doc_id order by c.chunk_index) upto from chunks c join sec on c.doc_id = sec.doc_id where size > 1000)"
    common = {"section_id": "section_id", "strategy": "'section_based'"}
    return before, [
        _made("sec", "doc_id", **common, ord="0", chunk_type="case when c1 or tb then 'mixed' else 'text' end", language="case when c1 then 'python' end", has_code="c1", has_table="tb", content=single, where="size <= 1000"),
        _made("sec", "doc_id", **common, ord="0", chunk_type="'header'", content=summary, where="size > 1000"),
        _made(running, "doc_id", **common | {"strategy": "'sentence_based'"}, ord="1 + chunk_index", chunk_type="'text'", start_char="upto - length(said)", content="said", end_char="start_char + length(content)"),
        _made("sec", "doc_id", **common, ord="1000000", chunk_type="'code'", language="'python'", has_code="true", content=example + python, where="size > 1000 and c1"),
        _made("sec", "doc_id", **common, ord="1000001", chunk_type="'code'", language="'csharp'", has_code="true", content=example + csharp, where="size > 1000 and c2"),
        _made("sec", "doc_id", **common, ord="2000000", chunk_type="'table'", has_table="true", content=table, where="size > 1000 and tb"),
    ]


def _code_parts() -> list[str]:
    """Chunks of documents whose heads surround code, by doc_id % 5; functions of 53 characters, classes of 30, script lines of 21, fenced blocks of 136."""
    print_ = _fence("python", "'print(1)'", _NN)
    small = f"case when doc_id % 2 = 0 then {_NN} || {_fence('csharp', chr(39) + 'z = ' + chr(39) + ' || doc_id', _NN)} else '' end"
    before, after = f"'Before ' || doc_id || '.' || {_N}", f"{_N} || 'After.'"
    whole = f"{before} || {_NN} || {print_} || {_NN} || {after}"
    own = {"section_id": "'c' || doc_id", "strategy": "'code_aware'", "start_char": "0", "end_char": "0"}

    def pieces(variant: int, language: str, code: str, cuts: str) -> str:
        """Chunks of code from a to b, by cuts: SQL of a list of {i, a, b}."""
        source = f"(select doc_id, {code} code, unnest({cuts}) c from documents where doc_id % 5 = {variant})"
        return _made(source, "doc_id", **own | {"start_char": "c.a", "end_char": "upto"}, upto="c.b", ord="1 + c.i", chunk_type="'code'", language=f"'{language}'", has_code="true", content=_fence(language, "substr(code, c.a + 1, c.b - c.a)", _NN))

    def units(each: int, most: int, n: int, total: int) -> str:
        """most units of each characters a chunk, of n; the last goes to the end."""
        return f"list_transform(range(0, {-(-n // most)}), lambda i: {{'i': i, 'a': i * {most * each}, 'b': least((i + 1) * {most * each} - 1, {total})}})"

    functions = "repeat('def f():' || chr(10) || '    return \"' || repeat('a', 30) || '\"' || chr(10), 100)"
    classes = "repeat('public class C {' || chr(10) || '    int x;' || chr(10) || '}' || chr(10), 200)"
    fenced = "left(repeat(repeat('y = 1234567890' || chr(10), 9) || chr(10), 20), 2719)"
    script = "left(repeat('echo twenty letters.' || chr(10), 200), 4199)"
    fenced_cuts = "list_transform(range(0, 9), lambda i: {'i': i, 'a': case when i = 0 then 0 else 1632 + (i - 1) * 136 end, 'b': least(1632 + i * 136, 2719)})"
    lines = "(select list({'i': i, 'a': i * 1491, 'b': least((i + 1) * 1491 - 1, 4199)}) from range(0, 3) t(i))"
    mixed = "case when doc_id % 2 = 0 then 'mixed' else 'text' end"
    sharp = "case when doc_id % 2 = 0 then 'csharp' end"
    script_rows = pieces(4, "bash", script, lines).replace("upto end_char", "length(substr(content, 1)) - 14 end_char").replace("c.a as start_char", "0 as start_char")
    return [
        _made("documents", "doc_id", **own, ord="0", chunk_type="'mixed'", language="'python'", has_code="true", content=f"{whole} || case when doc_id % 5 = 0 then {small} else '' end", where="doc_id % 5 < 3"),
        pieces(1, "python", functions, units(53, 28, 100, 5300)),
        pieces(2, "csharp", classes, units(30, 51, 200, 6000)).replace("least((i + 1) * 1530 - 1, 6000)", "least((i + 1) * 1530 - 1, 5999)"),
        _made("documents", "doc_id", **own, ord="1000", chunk_type="'code'", language="'csharp'", has_code="true", content=_fence("csharp", "'z = ' || doc_id", _NN), where="doc_id % 5 in (1, 2) and doc_id % 2 = 0"),
        _made("documents", "doc_id", **own, ord="0", chunk_type="'text'", content=before, where="doc_id % 5 > 2"),
        pieces(3, "python", fenced, fenced_cuts),
        script_rows,
        _made("documents", "doc_id", **own, ord="1000", chunk_type=mixed, language=sharp, has_code="doc_id % 2 = 0", content=f"{after} || {small}", where="doc_id % 5 > 2"),
    ]


def _tree_parts() -> list[str]:
    fence = "```python\n\np = {k}\n\n```"
    table = "| h | i |\n| --- | --- |\n| {b} |  |"
    summary = f"{_said('[Section Summary: 3 - Large]' + chr(10) + 'Path: Large' + chr(10) + 'Level: 1' + chr(10) + chr(10) + 'Content Preview:' + chr(10))} || repeat('a', 300) || " + _said(
        "...\n\nContains 1 code example(s)\nLanguages: python\n\nContains 1 table(s)\n\nSubsections (4):\n  - 3.1 One\n  - 3.2 Two\n  - 3.3 Wide\n  - 3.4 Rest"
    )
    grouped = _said(f"[Grouped Sections: One, Two, Wide]\n\n\n## One\n\nOne {{k}}.\n\n\n## Two\n\nTwo {{z}}.\n\n\n{fence}\n\n\n## Wide\n\n") + " || repeat('w', 790)"
    rows = (
        ("1", 0, "header", None, 0, 0, _said("[Section Summary: 1 - Parent]\nPath: Parent\nLevel: 1\n\nContent Preview:\nAbout {n}.\n\nSubsections (2):\n  - 1.1 First child\n  - 1.2 Second child")),
        ("1", 1, "text", None, 0, 0, _said("[Section 1: Parent]\n\nPath: Parent\n\nAbout {n}.")),
        ("1.1", 0, "mixed", "python", 1, 0, _said("[Section 1.1: First child]\n\nPath: Parent > First child\n\nChild of {b}.\n\n\n" + fence)),
        ("1.2", 0, "table", None, 0, 1, _said("[Section 1.2: Second child]\n\nPath: Parent > Second child\n\n" + table)),
        ("2", 0, "text", None, 0, 0, _said("[Section 2: Small {n}]\n\nPath: Small {n}\n\nSmall {t}.")),
        ("3", 0, "header", None, 0, 0, summary),
        *(("3", 1 + i, "text", None, 0, 0, f"repeat('{c}', 900)") for i, c in enumerate("abc")),
        ("3", 4, "code", "python", 1, 0, _said("```python\np = {k}\n```")),
        ("3", 5, "table", None, 0, 1, _said(table)),
        ("3.1", 0, "mixed", None, 1, 0, grouped),
        ("3.4", 0, "text", None, 0, 0, _said("[Section 3.4: Rest]\n\nPath: Large > Rest\n\n") + " || repeat('r', 790)"),
        ("4", 0, "text", None, 0, 0, _said("[Section 4: Medium]\n\nPath: Medium\n\n") + " || repeat('m', 1500)"),
    )
    return [_made("part", "p_partkey", section_id=f"'{i}'", ord=str(n), strategy="'section_based'", chunk_type=f"'{kind}'", language=_null(language), has_code=str(bool(code)), has_table=str(bool(tab)), content=content) for i, n, kind, language, code, tab, content in rows]


def _hybrid_parts() -> list[str]:
    text = "The {n} of {b} is here. It has a size of {z} and that is all there is to say about it, more or less; the {n} is a {t} one. Nobody knows why it is so, and nobody has asked."
    code = "var x = 1;\nvar y = {k};\nreturn new Thing(" + "x, y, " * 30 + "x);"
    own = {"section_id": "'h'", "ord": "0"}
    return [
        _made("part", "p_partkey", **own, strategy="'hybrid'", chunk_type="'text'", content=_said("[Section h: {n}]\n\n" + text), where="p_partkey % 8 = 0"),
        # no strategy reaches the least quality: fixed size, whose offsets leave the header out
        _made("part", "p_partkey", **own, strategy="'hybrid'", chunk_type="'text'", end_char="length(content) - 15 - length(content[13:strpos(content, ']') - 1])", content=_said("[Section h: {n}]\n\na b c d e f g h i j k l {z}"), where="p_partkey % 8 = 4"),
        _made("part", "p_partkey", **own, strategy="'hybrid'", chunk_type="'mixed'", language="'csharp'", has_code="true", end_char="0", content=_said(f"[Section h: {{n}}]\n\n{text}\n\n```csharp\n\n{code}\n\n```"), where="p_partkey % 4 = 1"),
        _made("part", "p_partkey", **own, strategy="'section_based'", chunk_type="'table'", has_table="true", content=_said("[Section h: {n}]\n\nPath: {n}\n\nTable: Sizes\n| brand | size |\n| --- | --- |\n| {b} | {z} |"), where="p_partkey % 4 = 2"),
    ]


def _analysed() -> str:
    """analysed: a row a document, by the definitions of ratios, scores, type and confidence."""
    from docloom import conf
    from docloom.plans.oracles import _count

    technical = " + ".join(_count("full_", "(?i)" + p) for p in conf.TECHNICAL)
    shapes = " + ".join(_count("full_", "(?s)" + p) for p in conf.CODE_SHAPES)
    words = lambda c: _count(c, "\\S+")
    sentences, together = _count("t", "[.!?]+"), _count("t", "(?i)" + "|".join(conf.TECHNICAL))
    read = f"case when {sentences} = 0 or {words('t')} = 0 then 0.5 else (greatest(0, 1 - ({words('t')} / {sentences} - 15) / 20) + greatest(0, 1 - (length(replace(t, ' ', '')) / {words('t')} - 5) / 5) + greatest(0, 1 - {together} / {words('t')})) / 3 end"
    marks = f"({_count('t', '(?m)^#+\\s+')} + {_count('t', '(?m)^\\s*[-*+]\\s+')})"
    strategy = " ".join(f"when '{k}' then '{s}'" for k, (s, _) in conf.STRATEGY_OF.items())
    base = " ".join(f"when '{k}' then {c}" for k, (_, c) in conf.STRATEGY_OF.items())
    return f"""raw as (select doc_id, lang, case when doc_id % 97 > 0 then substr(text, 1, 600) else '' end t, 1 + doc_id % 4 lv, case when doc_id % 4 > 0 then repeat('z = f(1)' || chr(10), (doc_id % 4 * 12)::int) end c,
            case when doc_id % 3 > 0 then doc_id % 3 * 9 end n_rows, case when doc_id % 4 = 0 then '' when doc_id % 2 = 0 then 'python' else 'cli' end languages from documents),
        whole as materialized (select *, concat_ws(chr(10), nullif(t, ''), c, case when n_rows > 0 then 'h' || repeat(chr(10) || 'some cell ' || lang, n_rows::int) end) full_,
            case when n_rows > 0 then 1 + n_rows * (9 + length(lang)) + (doc_id % 2 = 0)::int else 0 end n_table, coalesce(length(c), 0) n_code from raw),
        measured as materialized (select *, length(t) / length(full_) tr, n_code / length(full_) k, n_table / length(full_) b, least(1.0, ({technical} + 2 * ({shapes})) / {words('full_')})::double d, ({read})::double r,
            (least(1.0, lv / 5) + least(1.0, (c is not null)::int / 5) + least(1.0, (n_rows is not null)::int / 3) + least(1.0, {marks} / 20))::double / 4 x from whole where full_ <> ''),
        typed as (select *, case when k > 0.4 or (k > 0.2 and d > 0.3) then 'code_heavy' when b > 0.3 then 'table_heavy' when k > 0.1 and tr > 0.5 then 'mixed_content' when d > 0.4 and lv > 2 then 'api_reference' when d > 0.1 and d < 0.4 and lv <= 3 then 'tutorial'
            when k > 0.05 and tr > 0.6 then 'examples' when tr > 0.8 and lv > 1 then 'structured_doc' else 'pure_text' end content_type from measured),
        analysed as materialized (select doc_id, content_type, case content_type {strategy} end strategy, languages, tr text_ratio, k code_ratio, b table_ratio, x complexity, r readability, d density,
            greatest(0.3, case content_type {base} end - 0.1 * ((x > 0.6)::int + (k > 0.3 and k < 0.7)::int + (length(t) + n_code > 3000)::int))::double confidence from typed
            union all select doc_id, 'pure_text', 'fixed_size', '', 0, 0, 0, 0, 0.5, 0, 0.5 from whole where full_ = '')"""


def chunk_sql() -> dict[str, str]:
    from docloom.plans.oracles import _quality

    before, parts = _section_parts()
    rows = _chunk_rows("doc_id", parts)
    numbers = ", ".join(f"round({c}, 6) {c}" for c in ("text_ratio", "code_ratio", "table_ratio", "complexity", "readability", "density", "confidence"))
    return {
        "section_based_section_chunks": f"with recursive {before}, {rows}",
        "section_chunk_quality": f"with recursive {before}, {rows.partition(') select doc_id')[0]}), {_quality()}",
        "code_aware_section_chunks": f"with {_chunk_rows('doc_id', _code_parts())}",
        "hierarchical_section_chunks": f"with {_chunk_rows('p_partkey', _tree_parts())}",
        "hybrid_section_chunks": f"with {_chunk_rows('p_partkey', _hybrid_parts())}",
        "section_analysis": f"with {_analysed()} select doc_id, content_type, strategy, languages, {numbers} from analysed",
        "analysis_votes": f"with {_analysed()} select doc_id % 7 lang, strategy, count(*) votes, round(sum(confidence), 4) weight from analysed group by all",
    }
