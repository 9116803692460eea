"""DuckDB SQL for the catalogue's queries, written independently of the Spark expressions."""

from __future__ import annotations

from docloom import conf
from docloom.sources.files import default_rules

_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)>"
_TAGS = f"""raw_tags as materialized (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '{_TAG}')) raw, generate_subscripts(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '{_TAG}'), 1) pos from pages),
tags as materialized (select page_id, pos, lower(regexp_extract(raw, '{_TAG}', 1)) tag, regexp_extract(raw, '{_TAG}', 2) attributes from raw_tags)"""
_CLASS = """(?i)\\sclass\\s*=\\s*["'']([^"'']*)["'']"""
_CLASSES = f"""classed as materialized (select page_id, tag, unnest(list_filter(string_split_regex(regexp_extract(attributes, '{_CLASS}', 1), '\\s+'), lambda c: c <> '')) class from tags)"""
_PATTERNS = f"""{_TAGS}, {_CLASSES}, rows_ as materialized (select page_id, 'tag_' || tag pattern_id from tags union all select page_id, 'class_' || class from classed
    union all select page_id, 'attr_' || lower(unnest(regexp_extract_all(attributes, '\\s(data-[a-zA-Z0-9_-]+)', 1))) from tags
    union all select page_id, 'id_' || regexp_replace(regexp_replace(i, '\\d+', 'N', 'g'), '[0-9a-f]{{8,}}', 'HASH', 'g') from (select page_id, regexp_extract(attributes, '(?i)\\sid\\s*=\\s*["'']([^"'']*)["'']', 1) i from tags) where i <> ''),
counts as materialized (select pattern_id, count(*) frequency from rows_ group by all)"""


def _any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _sum(text: str, words, weight: str = "1") -> str:
    return "(" + " + ".join(f"{weight} * contains({text}, '{w}')::int" for w in words) + ")"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_SAMPLED = f"('0x' || substr(md5('0/' || page_id), 1, 7))::bigint < {int(0.1 * (1 << 28))}"
_HIGH = f"(frequency >= 10 or {_any('lower(pattern_id)', conf.HIGH_VALUE.split())} or starts_with(pattern_id, 'attr_data-'))"
_TIER = f"case when {_HIGH} then 'high' when frequency >= 3 then 'medium' else 'low' end"
_FOUND = f"""{_PATTERNS}, valuable as (select pattern_id, frequency from counts where {_HIGH} and regexp_matches(pattern_id, '[^_]{{3,}}$')),
sampled as (select pattern_id, count(*) frequency from rows_ where {_SAMPLED} and not regexp_matches(pattern_id, '_..$') group by all),
found as materialized (select * from valuable union all select pattern_id, cast(trunc(frequency / 0.1) as bigint) from sampled where pattern_id not in (select pattern_id from valuable)),
both_ as materialized (select c.pattern_id, c.frequency, f.frequency found, {_TIER.replace("frequency", "c.frequency").replace("pattern_id", "c.pattern_id")} tier from counts c left join found f on c.pattern_id = f.pattern_id)"""


def _scored(where: str = "true") -> str:
    value, low = "selector_value", "lower(sample)"
    kinds = ", ".join(f"least(1.0, 0.2 * {_sum('lower(' + value + ')', w.split())})" for w in conf.EVIDENCE_TYPES.values())
    shapes = " + ".join(f"regexp_matches({low}, '{p}')::int" for p in conf.EVIDENCE_SHAPES)
    sample = f"coalesce(least(1.0, {_sum(low, conf.EVIDENCE_WORDS, '0.15')} + {_sum(low, conf.EVIDENCE_SIGNS, '0.1')} + 0.2 * ({shapes})), 0)"
    suggest = " ".join(f"when {_any('lower(' + value + ')', w.split())} then '{t}'" for t, w in conf.SUGGEST_BY_VALUE)
    return f"""pg as (select page_id, trim(substr(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 200)) title, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') h from pages where {where}),
    ts as (select page_id, title, lower(regexp_extract(unnest(regexp_extract_all(h, '{_TAG}')), '<([a-zA-Z0-9]+)', 1)) selector_value from pg),
    cs as (select selector_value, count(*) frequency, coalesce(arg_min(title, page_id) filter (title <> ''), '') sample from ts group by all),
    sc as (select 'class_' || selector_value pattern_id, 'class' selector_type, *, least(1.0, least(0.3, 0.1 * (frequency / 100)) + 0.4 * greatest({kinds}) + 0.2 * {sample} + 0.1 * (case when frequency between 10 and 1000 then 0.5 when frequency between 5 and 2000 then 0.3 else 0.1 end)) evidence from cs),
    scored as (select *, case {suggest} when {_any(low, conf.SUGGEST_BY_SAMPLE)} or starts_with({low}, '$ ') or contains({low}, '#!/bin/bash') then 'code_content' when evidence > 0.7 then 'documentation_text' else 'unknown' end suggested from sc)"""


_DECISIONS = "select 'class_' || p_brand pattern_id, 'class' selector_type, p_brand selector_value, case p_partkey % 3 when 0 then '' when 1 then 'code_content' else 'table_content' end human_decision, p_partkey as version from part"
_LATEST = f"latest as (select * from ({_DECISIONS}) qualify row_number() over (partition by selector_value order by version <> 0, version desc) = 1)"
_TREE = """tree as materialized (select cast(r_regionkey + 1 as varchar) id, r_name title, 1 as level, cast(null as varchar) parent_id from region
    union all select (n_regionkey + 1) || '.' || (n_nationkey + 1), n_name, 2, cast(n_regionkey + 1 as varchar) from nation
    union all select (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || c_custkey, c_name, 3, (n_regionkey + 1) || '.' || (n_nationkey + 1) from customer join nation on c_nationkey = n_nationkey where c_custkey % 20 = 0)"""


def _numbered(pieces: str) -> str:
    """pieces: SQL of doc_id and a list p; numbered pieces, first of each document first."""
    return f"src as materialized ({pieces}), pieces as materialized (select doc_id, unnest(p) piece, generate_subscripts(p, 1) i from src)"


def _greedy(pieces: str, limit: int, extra: int, joiner: str) -> str:
    """chunks(doc_id, chunk_index, content) of greedy groups."""
    return f"""{_numbered(pieces)}, fold as (select doc_id, i, piece, length(piece) + {extra} size, 1 grp from pieces where i = 1
        union all select n.doc_id, n.i, n.piece, case when f.size + length(n.piece) > {limit} then 0 else f.size end + length(n.piece) + {extra}, f.grp + (f.size + length(n.piece) > {limit})::int
        from fold f join pieces n on n.doc_id = f.doc_id and n.i = f.i + 1),
    chunks as materialized (select doc_id, grp - 1 chunk_index, string_agg(piece, {joiner} order by i) content from fold group by all)"""


_LINES = "select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') p from documents"
_PARAGRAPHS = _greedy(_LINES, 1000, 1, "chr(10)")
_RUNNING = """select doc_id, chunk_index, count(*) over (partition by doc_id) total_chunks, coalesce(sum(length(content)) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), 0)::bigint start_char,
    sum(length(content)) over (partition by doc_id order by chunk_index)::bigint end_char, length(content) char_count, md5(content) digest from chunks"""


def _spans(text: str, end: str, following: str) -> str:
    """Spans s, e of documents' text t by recursion; end: of s, t and n; following: of s, e and n."""
    return f"""src as materialized (select doc_id, t, length(t) n from (select doc_id, {text} t from documents) where length(t) > 0),
    walk as (select doc_id, t, n, 0::bigint s, ({end.replace("$s", "0::bigint")})::bigint e, 0 chunk_index from src
        union all select doc_id, t, n, nxt, ({end.replace("$s", "nxt")})::bigint, chunk_index + 1 from (select *, ({following})::bigint nxt from walk) where nxt < n),
    spans as materialized (select doc_id, t, s start_char, e end_char, chunk_index from walk)"""


_SPAN_ROWS = "select doc_id, chunk_index, count(*) over (partition by doc_id) total_chunks, start_char, end_char, end_char - start_char char_count, md5(substr(t, start_char + 1, end_char - start_char)) digest from spans"
_FIXED = _spans("text", "least($s + 1000, n)", "case when e - 200 > s then e - 200 else e end")
_AT_END = "case when $s + 1000 < n and regexp_matches(substr(t, greatest($s + 100, $s + 900) + 1, 100), '[.!?][ \\n]') then $s + 900 + length(regexp_extract(substr(t, $s + 901, 100), '(?s)^(.*[.!?])[ \\n]', 1)) else least($s + 1000, n) end"


def _break(s: str, e: str) -> str:
    part = f"substr(t, {s} + 1, {e} - {s})"
    return f"""(case when regexp_matches({part}, '[.!?]\\s+') then {s} + length(regexp_extract({part}, '(?s)^(.*[.!?]\\s+)', 1)) when {e} >= n then n when not regexp_matches(substr(t, {e}, 1), '[\\pL\\pN]') then {e}
        when contains({part}, ' ') then {e} - strpos(reverse({part}), ' ') + 1 else {e} end)"""


def _text_end() -> str:
    first = f"(case when $s + 1000 < n then {_break('$s', '($s + 1000)')} else n end)"
    return f"case when {first} - $s < 100 and {first} < n then {_break('$s', 'least($s + 100, n)')} else {first} end"


_NORMAL = "case when length(trim(one)) >= 50 then trim(case when right(one, 1) in ('.', '!', '?') then one else one || '.' end) end"

# overlap: the shortest suffix of the group before whose length reaches 200
_SENTENCE_FOLD = """fold as (select doc_id, i, 1::bigint lo, length(piece)::bigint size, 1 grp from pieces where i = 1
    union all select doc_id, i, nlo, case when cut then (select coalesce(sum(length(p.piece)), 0) from pieces p where p.doc_id = x.doc_id and p.i >= nlo and p.i < x.i) + len else size + len end, grp + cut::int from
        (select y.*, case when cut then coalesce((select max(q.i) from pieces q where q.doc_id = y.doc_id and q.i >= y.lo and q.i < y.i
            and (select sum(length(p.piece)) from pieces p where p.doc_id = y.doc_id and p.i >= q.i and p.i < y.i) >= 200), y.lo) else y.lo end nlo from
            (select n.doc_id, n.i, f.lo, f.size, f.grp, length(n.piece) len, f.size + length(n.piece) > 1000 cut from fold f join pieces n on n.doc_id = f.doc_id and n.i = f.i + 1) y) x),
chunks as materialized (select g.doc_id, g.grp - 1 chunk_index, string_agg(p.piece, ' ' order by p.i) content from (select doc_id, grp, max(lo) lo, max(i) hi from fold group by all) g join pieces p on p.doc_id = g.doc_id and p.i between g.lo and g.hi group by all)"""
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_CLEAN = """select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') p from documents"""
_PAIRED = f"""select doc_id, list_concat(list_transform(range(1, len(q), 2), lambda i: {_STRIP.format("q[i] || q[i + 1]")}), case when len(q) % 2 = 1 and {_STRIP.format("q[-1]")} <> '' then [{_STRIP.format("q[-1]")}] else [] end) p
    from (select doc_id, string_split_regex(text, '[.!?]\\s+') q from documents)"""
_ADVANCED_FOLD = """fold as (select doc_id, i, i lo, (length(piece) + 2)::bigint size, 1 grp from pieces where i = 1
    union all select n.doc_id, n.i, case when f.size + length(n.piece) > 1000 then f.i else f.lo end, case when f.size + length(n.piece) > 1000 then length(q.piece) else f.size end + length(n.piece) + 2, f.grp + (f.size + length(n.piece) > 1000)::int
    from fold f join pieces n on n.doc_id = f.doc_id and n.i = f.i + 1 join pieces q on q.doc_id = f.doc_id and q.i = f.i),
chunks as materialized (select g.doc_id, g.grp - 1 chunk_index, string_agg(p.piece, chr(10) || chr(10) order by p.i) content from (select doc_id, grp, max(lo) lo, max(i) hi from fold group by all) g join pieces p on p.doc_id = g.doc_id and p.i between g.lo and g.hi group by all)"""

_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_TECH = " + ".join(_count("text", "(?i)" + p) for p in conf.TECHNICAL)
_DENSITY = f"case when {_WORDS} = 0 then 0 else least(1.0, ({_TECH} + 2 * ({' + '.join(_count('text', '(?s)' + p) for p in conf.CODE_SHAPES)})) / {_WORDS}) end"
_SENTENCES = _count("text", "[.!?]+")
_READ = f"""case when {_SENTENCES} = 0 or {_WORDS} = 0 then 0.5 else (greatest(0, 1 - ({_WORDS} / {_SENTENCES} - 15) / 20) + greatest(0, 1 - (length(replace(text, ' ', '')) / {_WORDS} - 5) / 5)
    + greatest(0, 1 - {_count("text", "(?i)" + "|".join(conf.TECHNICAL))} / {_WORDS})) / 3 end"""
_STRATEGY = " ".join(f"when '{k}' then '{s}'" for k, (s, _) in conf.STRATEGY_OF.items())
_BASE = " ".join(f"when '{k}' then {c}" for k, (_, c) in conf.STRATEGY_OF.items())
_MARKS = f"({_count('text', '(?m)^#+[ \\t\\n\\r]+')} + {_count('text', '(?m)^\\s*[-*+]\\s+')})"
_TYPED = f"""typed as materialized (select *, case content_type {_STRATEGY} end strategy, greatest(0.3, case content_type {_BASE} end - 0.1 * ((complexity > 0.6)::int + (k > 0.3 and k < 0.7)::int + (n_chars > 3000)::int)) confidence from
    (select *, case when k > 0.4 or (k > 0.2 and d > 0.3) then 'code_heavy' when b > 0.3 then 'table_heavy' when k > 0.1 and 1 - k > 0.5 then 'mixed_content' when d > 0.4 and lv > 2 then 'api_reference' when d > 0.1 and d < 0.4 and lv <= 3 then 'tutorial'
        when k > 0.05 and 1 - k > 0.6 then 'examples' when 1 - k > 0.8 and lv > 1 then 'structured_doc' else 'pure_text' end content_type,
        (least(1.0, lv / 5) + least(1.0, cast(trunc(k * 10) as int) / 5) + 0 + least(1.0, {_MARKS} / 20)) / 4 complexity from
    (select *, 1 + doc_id % 4 lv, (doc_id % 6 / 10)::double k, (doc_id % 5 / 10)::double b, {_DENSITY} d from documents)))"""
_TABLE = """lines as (select l_orderkey, list(case when l_linenumber % 2 = 0 then [l_partkey::varchar, l_returnflag] else [l_partkey::varchar, l_returnflag, l_linestatus, 'x'] end order by l_linenumber, l_partkey::varchar, l_returnflag, l_linestatus) rows_, case when l_orderkey % 20 = 0 then 'Order ' || l_orderkey end caption from lineitem where l_orderkey % 10 = 0 group by l_orderkey)"""


def _quality() -> str:
    """Mean quality of chunks made(doc_id, content, chunk_type), whose title and path are given, by document."""
    return r"""own as materialized (select row_number() over () no, doc_id, content, chunk_type, length(content) n from made), words as (select no, unnest(regexp_extract_all(lower(content), '\S+')) word, generate_subscripts(regexp_extract_all(lower(content), '\S+'), 1) i from own),
        counted as (select no, word, count(*) k, min(i) i from words group by all), whole as (select no, count(*) w from words group by all), top5 as (select * from counted qualify row_number() over (partition by no order by k desc, i) <= 5),
        together as (select no, case when w < 10 then 0.6 else least(1.0, 5 * sum(case when length(word) > 3 and k > 1 then least(0.2, k / w) else 0 end)) end coherence from top5 join whole using (no) group by no, w)
        select doc_id, round(avg((case when n < 200 then 0.5 when n < 500 then 0.8 when n <= 1200 then 1.0 when n <= 2000 then 0.7 else 0.3 end
            + (case when not regexp_matches(content, '[.!?]') then 0.5 when regexp_matches(content, '(?:[.!?]|```)\s*$') then 1.0 else 0.7 end
              + case when regexp_matches(content, '```[^`]*$') then 0.3 when regexp_matches(content, '(?s)```.*?```') then 1.0 else 0.8 end) / 2
            + coherence + (2 + case when chunk_type = 'text' then 0.8 else 1.0 end) / 3) / 4), 6)::double quality from own join together using (no) group by doc_id"""


def _rules() -> list[tuple[int, int, str, str, str]]:
    rules = default_rules() | {"navigation_content": [{"tag": "nav"}, {"class": "ad"}]}
    order = sorted(rules, key=lambda t: t != "skip_content")
    return [(i, j, k, *next(iter(r.items()))) for i, k in enumerate(order) for j, r in enumerate(rules[k])]


def _fragment() -> str:
    """SQL of a part's rendered type."""
    snippet = lambda kind, name: f"'<div class=\"code-snippet\"><span class=\"object-type\">' || {kind} || '</span> <code>' || {name} || '</code></div>'"
    box = lambda *parts: "concat_ws(chr(10), '<div class=\"subsection-content\">', " + ", ".join(parts) + ", '</div>')"
    typed = lambda label, value: f"'<div class=\"subsection-header\">{label}:</div>' || chr(10) || '<p class=\"subsection-content\">' || {value} || '</p>'"
    enum = "p_partkey % 3 = 0"
    members = [
        (snippet("'field'", "'f1'"), box("'<p>' || p_brand || '</p>'")),
        (snippet("'property'", "'Size'"), box(typed("Type", "'int'"))),
        (snippet("'method'", "'Get'"), box("'<p>gets</p>'", f"case when p_partkey % 5 = 0 then {typed('Returns', chr(39) + 'bool' + chr(39))} end")),
    ]
    inner = box(*[x for pair in members for x in pair])
    head = [f"'<h4>' || p_name || case when {enum} then ' Enumeration' else '' end || '</h4>'", snippet(f"case when {enum} then 'enum' else 'class' end", "'Shop.' || p_brand"), "case when p_partkey % 2 = 0 then '<p>' || p_type || '</p>' end", inner]
    return f"concat_ws(chr(10), {', '.join(head)})"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"({i}, {j}, '{k}', '{t}', '{v}')" for i, j, k, t, v in _rules())
    coverage = lambda t: f"coalesce(sum(coalesce(found, 0)) filter (tier = '{t}') / sum(frequency) filter (tier = '{t}'), 1.0)"
    by_type = " union all ".join(f"select '{t}' content_type, frequency, found from both_ where {_any('lower(pattern_id)', w.split())}" for t, w in conf.COVERAGE_TYPES.items())
    title = "lower(substr(text, 1, 200))"
    titles = " ".join(f"when {_any(title, w)} then '{n}'" for n, w in conf.TITLE_ROUTES)
    media = ", ".join([f"('tag', '{t}')" for t in conf.MEDIA_TAGS] + [f"('class', '{c}')" for c in conf.MEDIA_CLASSES])
    python = " + ".join(f"{n} * contains(low, '{m}')::int" for m, n in conf.PYTHON_MARKS.items())
    doctype = "(?i)<!DOCTYPE\\s+html[^>]*>"
    flat = "html || chr(10) || html"
    for p in (doctype, "(?i)<html[^>]*>", "(?i)<body[^>]*>", "(?i)</html>", "(?i)</body>"):
        flat = f"regexp_replace({flat}, '{p}', '', 'g')"
    flat = f"""'<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><meta charset="utf-8"><title>Documents</title></head>' || chr(10) || '<body>' || chr(10) || trim({flat}, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '</body>' || chr(10) || '</html>'"""
    cell_line = lambda r: f"'| ' || array_to_string({r}, ' | ') || ' |'"
    cosine = "sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)))"
    topk = lambda k, where: f"""with v as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings),
        s as (select b.vec_id query_id, a.vec_id, {cosine} similarity from v a join v b on a.i = b.i where {where} group by all)
        select query_id, vec_id, row_number() over (partition by query_id order by round(similarity, 9) desc, vec_id) as rank, round(similarity, 5) similarity from s qualify rank <= {k}"""  # noqa: E731
    merged = f"""new_ as materialized (with {_scored()} select * from scored), old_ as materialized (with {_scored("page_id % 2 = 0")} select * from scored where length(selector_value) > 1),
            m as (select n.pattern_id, n.frequency, n.evidence, o.pattern_id is null fresh, abs(n.frequency - o.frequency) / o.frequency > 0.5 by_freq, abs(n.evidence - o.evidence) > 0.2 by_evidence, o.frequency old_f, o.evidence old_e from new_ n left join old_ o on n.selector_value = o.selector_value)"""
    compiled = f"""{_LATEST}, own as (select case when human_decision = '' then 'skip_content' else human_decision end content_type, selector_type, selector_value, pattern_id by_ from latest),
            every as materialized (select * from own union all select 'skip_content', t, v, chr(65535) from (values {media}) m(t, v) where exists (select 1 from own where content_type = 'skip_content')),
            types as (select content_type, row_number() over (order by content_type <> 'skip_content', min(by_), content_type) - 1 type_ord from every group by content_type),
            compiled as materialized (select content_type, selector_type, selector_value, row_number() over (partition by content_type order by by_, selector_type, selector_value) - 1 rule_ord, type_ord from every join types using (content_type))"""
    return {
        "doc_count_per_page": f"select page_id, len(regexp_extract_all(html, '{doctype}')) n_docs from pages",
        "flatten_multi_html": f"select page_id, md5(f) digest, length(f) n_chars from (select page_id, {flat} f from pages)",
        "split_multi_html": f"select page_id, 2 total_documents, 1 doc_index, length({_STRIP.format('html')}) n_chars from pages where html ilike '<!DOCTYPE html%'",
        "undoctyped": "select page_id, md5(regexp_replace(html, '(?i)^<!DOCTYPE[^>]*>', '')) digest from pages",
        "tag_freq": f"with {_TAGS} select tag, count(*) n from tags group by all",
        "class_freq": f"with {_TAGS}, {_CLASSES} select class, count(*) n from classed group by all",
        "attr_freq": f"with {_TAGS} select pattern_id, count(*) frequency from (select unnest(regexp_extract_all(attributes, '\\s([a-zA-Z-]+)\\s*=', 1)) pattern_id from tags) group by all order by 2 desc, 1 limit 50",
        "top_tags": f"with {_PATTERNS} select pattern_id, frequency from counts order by 2 desc, 1 limit 5",
        "pattern_tiers": f"with {_PATTERNS} select pattern_id, frequency, {_TIER} tier from counts",
        "high_value_patterns": f"with {_PATTERNS} select pattern_id, frequency from counts where {_HIGH}",
        "id_patterns": "select o_orderkey, regexp_replace(regexp_replace('sec' || o_orderkey || '-' || substr(md5(o_orderkey::varchar), 1, 12), '\\d+', 'N', 'g'), '[0-9a-f]{8,}', 'HASH', 'g') id_pattern from orders",
        "hash_sample_scan": f"with {_PATTERNS} select pattern_id, cast(trunc(count(*) / 0.1) as bigint) frequency from rows_ where {_SAMPLED} group by all",
        "reservoir_sample": f"with {_TAGS} select page_id, pos - 1 pos, tag from tags order by md5('0/' || page_id || '/' || (pos - 1)), page_id, pos limit 50",
        "combine_scans": f"with {_FOUND} select pattern_id, frequency from found",
        "coverage_overall": f"with {_FOUND} select round(sum(coalesce(found, 0)) / sum(frequency), 6) overall_coverage, count(*) n_baseline, count(found) n_found from both_",
        "coverage_by_tier": f"with {_FOUND} select " + ", ".join(f"round({coverage(t)}, 6) {t}_coverage" for t in ("high", "medium", "low")) + " from both_",
        "coverage_by_type": f"with {_FOUND} select content_type, round(sum(coalesce(found, 0)) / sum(frequency), 6) coverage from ({by_type}) group by all",
        "missing_patterns": f"with {_FOUND} select pattern_id, frequency from both_ where found is null order by 2 desc, 1 limit 50",
        "evidence_scores": f"with {_scored()} select pattern_id, selector_type, selector_value, frequency, round(evidence, 6) evidence_score from scored",
        "suggested_types": f"with {_scored()} select pattern_id, suggested suggested_type from scored",
        "top_candidates": f"with {_scored()} select pattern_id, round(evidence, 6) evidence_score from scored where frequency >= 3 order by evidence desc, pattern_id limit 8",
        "review_merge": f"""with {merged}
            select pattern_id, frequency, case when fresh then 1 when by_freq or by_evidence then 2 else 3 end as priority, case when fresh or by_freq or by_evidence then '' else 'skip' end human_decision,
            case when fresh then '' when by_freq or by_evidence then '⚠️ CHANGED: ' || concat_ws(', ', case when by_freq then 'freq ' || old_f || '→' || frequency end, case when by_evidence then 'evidence ' || printf('%.2f', old_e) || '→' || printf('%.2f', evidence) end) else 'seen' end notes, round(evidence, 6) evidence_score from m""",
        "decision_breakdown": f"select coalesce(nullif(trim(human_decision), ''), 'empty') decision, count(*) n from ({_DECISIONS}) group by all",
        "latest_decision": f"with {_LATEST} select selector_value, human_decision, version from latest",
        "rules_compiled": f"with {compiled} select content_type, selector_type, selector_value, rule_ord, type_ord from compiled",
        "rules_round_trip": f"with {compiled} select type_ord, rule_ord, content_type, selector_type, selector_value from compiled",
        "rules_grouped": f"with {compiled} select type_ord, content_type, string_agg(selector_type || ':' || selector_value, ',' order by rule_ord) rules from compiled group by type_ord, content_type",
        "decision_statistics": f"select count(*) n_rows, count(distinct version) n_files, max(version) latest_version, count(*) filter (human_decision <> '') n_decided from ({_DECISIONS})",
        "review_first_ten": f"with {merged} select pattern_id, case when fresh then 1 when by_freq or by_evidence then 2 else 3 end as priority from m order by 2, round(evidence, 3) desc, 1 limit 10",
        "review_round_trip": f"with {_scored()} select pattern_id, selector_type, selector_value, frequency, round(evidence, 3) evidence_score, suggested suggested_type, '' human_decision, 1 as version from scored",
        "chunk_quality": f"with recursive {_PARAGRAPHS}, made as (select doc_id, content, 'text' chunk_type from chunks), {_quality()}",
        "chunks_round_trip": f"with recursive {_PARAGRAPHS} select lang, count(*) n_chunks, sum(length(content))::bigint chars from chunks join documents using (doc_id) group by lang",
        "classify_elements": f"""with {_TAGS}, rules(type_ord, rule_ord, content_type, t, v) as (values {rules}), sel as (select page_id, pos, 'tag' t, tag v from tags union all select page_id, pos, 'attr', 'href' from tags
            union all select page_id, pos, 'class', unnest(string_split_regex(regexp_extract(attributes, '{_CLASS}', 1), '\\s+')) from tags),
            hit as (select page_id, pos, arg_min(content_type, type_ord * 1000 + rule_ord) content_type from sel join rules using (t, v) group by all)
            select tag, case when content_type = 'skip_content' then 'SKIP' else coalesce(content_type, '{conf.DEFAULT_TYPE}') end as label, count(*) n from tags left join hit using (page_id, pos) group by all""",
        "parser_cross_check": f"with {_TAGS} select tag, count(*) by_tree, count(*) by_regex from tags group by all",
        "section_hierarchy": f"with {_TREE} select id, level, parent_id from tree",
        "section_paths": f"with {_TREE} select a.id, concat_ws(' > ', c.title, b.title, a.title) path from tree a left join tree b on a.parent_id = b.id left join tree c on b.parent_id = c.id",
        "section_children": f"with {_TREE} select a.id, count(b.id) n_children from tree a left join tree b on b.parent_id = a.id group by a.id",
        "leaf_sections": f"with {_TREE} select id, title from tree where id not in (select parent_id from tree where parent_id is not null)",
        "section_siblings": f"with {_TREE} select a.id, b.id sibling from tree a join tree b on a.parent_id = b.parent_id and a.id <> b.id where a.level < 3 and b.level < 3",
        "section_descendants": f"with {_TREE}, e as (select parent_id ancestor, id, 1 distance from tree where parent_id is not null union all select b.parent_id, a.id, 2 from tree a join tree b on a.parent_id = b.id where b.parent_id is not null) select ancestor, count(*) n, max(distance) deepest from e group by all",
        "sections_by_level": f"with {_TREE} select id, title from tree where level = 2",
        "ordered_ids": f"with {_TREE} select id, replace(id, '.', '/') sort_key from tree",
        "level_hierarchy": "with d as (select lang, doc_id, 1 + doc_id * 7 % 4 lv from documents) select a.doc_id::varchar id, (select max(b.doc_id) from d b where b.lang = a.lang and b.doc_id < a.doc_id and b.lv < a.lv)::varchar parent_id from d a",
        "breadcrumb_asof": "select a.doc_id, coalesce((select max(b.doc_id) from documents b where b.source = a.source and b.doc_id < a.doc_id and b.n_chars > 3000), -1) crumb from documents a",
        "fixed_chunks": f"with recursive {_FIXED} {_SPAN_ROWS}",
        "fixed_chunks_at_sentences": f"with recursive {_spans('text', _AT_END, 'case when e - 200 > s then e - 200 else e end')} {_SPAN_ROWS}",
        "paragraph_chunks": f"with recursive {_PARAGRAPHS} {_RUNNING}",
        "sentence_chunks": f"with recursive {_numbered(_CLEAN)}, {_SENTENCE_FOLD} {_RUNNING}",
        "sentence_chunks_paired": f"with recursive {_numbered(_PAIRED)}, {_SENTENCE_FOLD} {_RUNNING}",
        "text_chunks": f"with recursive {_spans('(select ' + _NORMAL + ''' from (select regexp_replace(text, '\\s+', ' ', 'g') one))''', _text_end(), 'case when e < n and e - 200 > s then e - 200 else e end')} {_SPAN_ROWS}",
        "advanced_text_chunks": f"with recursive {_numbered(_LINES)}, {_ADVANCED_FOLD} {_RUNNING}",
        "chunk_overlap": f"with recursive {_FIXED} select doc_id, chunk_index, coalesce(greatest(0, lag(end_char) over w - start_char), 0) overlap_previous, coalesce(greatest(0, end_char - lead(start_char) over w), 0) overlap_next from spans window w as (partition by doc_id order by chunk_index)",
        "paragraph_chunks_by_lang": f"with recursive {_PARAGRAPHS} select lang, count(*) n_chunks, round(avg(length(content)), 6) avg_chars, max(length(content)) max_chars from chunks join documents using (doc_id) group by lang",
        "chunk_ids": f"with recursive {_PARAGRAPHS} select doc_id, chunk_index, md5(source || '_' || doc_id || '_' || chunk_index || '_' || substr(content, 1, 50)) chunk_id from chunks join documents using (doc_id)",
        "chunk_sizes": f"with recursive {_PARAGRAPHS} select doc_id, chunk_index, length(content) char_count, {_count('content', '\\S+')} word_count from chunks",
        "chunk_quality_size": f"with recursive {_PARAGRAPHS} select doc_id, chunk_index, case when length(content) < 200 then 0.5 when length(content) < 500 then 0.8 when length(content) <= 1200 then 1.0 when length(content) <= 2000 then 0.7 else 0.3 end::double score from chunks",
        "chunk_completeness": f"""with recursive {_PARAGRAPHS} select doc_id, chunk_index, ((case when not regexp_matches(content, '[.!?]') then 0.5 when regexp_matches(rtrim(content), '(?:[.!?]|```)$') then 1.0 else 0.7 end
            + case when regexp_matches(content, '```[^`]*$') then 0.3 when regexp_matches(content, '(?s)```.*?```') then 1.0 else 0.8 end) / 2)::double score from chunks""",
        "chunk_coherence": f"""with recursive {_PARAGRAPHS}, w as (select doc_id, chunk_index, unnest(regexp_extract_all(lower(content), '\\S+')) word, generate_subscripts(regexp_extract_all(lower(content), '\\S+'), 1) i from chunks),
            c as (select doc_id, chunk_index, word, count(*) k, min(i) i from w group by all), n as (select doc_id, chunk_index, count(*) n from w group by all),
            top5 as (select * from c qualify row_number() over (partition by doc_id, chunk_index order by k desc, i) <= 5)
            select doc_id, chunk_index, round(case when n < 10 then 0.6 else least(1.0, 5 * sum(case when length(word) > 3 and k > 1 then least(0.2, k / n) else 0 end)) end, 6) score from top5 join n using (doc_id, chunk_index) group by doc_id, chunk_index, n""",
        "chunk_context": f"""with recursive {_PARAGRAPHS} select doc_id, chunk_index, round((1.0::double + case when doc_id % 2 = 0 then 1.0 else 0.7 end + case when doc_id % 3 = 0 then 0.8 else 1.0 end) / 3, 6) score,
            'Source: f | Section: ' || case when doc_id % 2 = 0 then source else '' end || ' | Language: ' || lang as context from chunks join documents using (doc_id)""",
        "detect_code_language": f"""select doc_id, case when {_any("low", conf.CLI_MARKS)} then 'cli' when {python} > {_sum("low", conf.CSHARP_MARKS)} then 'python' when {_any("low", conf.CSHARP_MARKS)} then 'csharp' else 'text' end as language from (select doc_id, lower(text) low from documents)""",
        "clean_text": "select doc_id, md5(c) digest, length(c) n_chars from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) c from documents)",
        "slug_ids": "select doc_id, regexp_replace(regexp_replace(replace(lower(t), ' ', '-'), '[^a-z0-9\\-]', '', 'g'), '-+', '-', 'g') || '-' || substr(md5(t), 1, 6) slug from (select doc_id, substr(text, 1, 60) t from documents)",
        "readability": f"select doc_id, round({_READ}, 6) score from documents",
        "tech_density": f"select doc_id, round({_DENSITY}, 6) density from documents",
        "text_flags": "select doc_id, " + ", ".join(f"regexp_matches(text, '{flag}{'|'.join(ps)}') {name}" for name, flag, ps in (("lists", "(?m)", conf.LIST_ITEMS), ("formulas", "(?i)", conf.FORMULAS), ('"references"', "(?i)", conf.REFERENCES))) + " from documents",
        "enough_content": "select doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 50 enough from documents",
        "code_titles": """select doc_id, l as language, case l when 'cli' then 'Command Line Example' when 'csharp' then 'C# Code Example' when 'python' then 'Python Code Example' when 'text' then 'Code Example' else l || ' Code Example' end title
            from (select doc_id, case doc_id % 5 when 0 then 'python' when 1 then 'csharp' when 2 then 'cli' when 3 then 'text' else lang end l from documents)""",
        "content_type": f"with {_TYPED} select doc_id, content_type, strategy, round(complexity, 6) complexity, round(confidence, 6) confidence from typed",
        "strategy_vote": f"with {_TYPED} select strategy, count(*) votes, round(count(*) * avg(confidence), 4) weight from typed group by all",
        "section_complexity": f"""select doc_id, round(0.3 * least(1.0, n_chars / 2000) + 0.25 * least(1.0, doc_id % 7 / 5) + 0.15 * least(1.0, doc_id % 4 / 3) + 0.15 * least(1.0, doc_id % 12 / 10)
            + 0.15 * least(1.0, ({_count("text", "(?m)^\\s*[-*+]\\s+")} + {_count("text", "\\[[^\\]]+\\]")} + {_count("text", "\\$[^$]+\\$")}) / 20), 6) score, n_chars + doc_id % 3 * 700 <= 800 is_small, n_chars + doc_id % 3 * 700 > 2000 is_large,
            doc_id % 3 * 700 > 1.5 * n_chars code_heavy, n_chars > 500 or doc_id % 5 > 2 content_heavy from documents""",
        "config_for_title": f"select doc_id, case {titles} else 'default' end preset, case doc_id % 3 when 0 then 'tutorial' when 1 then 'api_reference' else 'default' end by_file from documents",
        "table_markdown": f"""with {_TABLE} select l_orderkey, case when caption is null then '' else '**' || caption || '**' || chr(10) || chr(10) end || '| part | flag | status |' || chr(10) || '| --- | --- | --- |' || chr(10)
            || array_to_string(list_transform(rows_, lambda r: {cell_line("(r || [''])[1:3]")}), chr(10)) markdown from lines""",
        "table_sizes": f"""with {_TABLE}, z as (select l_orderkey, length('partflagstatus') + list_sum(list_transform(rows_, lambda r: list_sum(list_transform(r, lambda x: length(x))))) + coalesce(length(caption), 0) chars, 3 + list_sum(list_transform(rows_, lambda r: len(r))) cells from lines)
            select l_orderkey, (chars + 3 * cells)::bigint with_separators, chars::bigint chars from z""",
        "patched_placeholders": """select p_partkey, 2 n_found, k n_patched, 2 - k n_failed, case when k = 1 then 'partial' else 'failed' end status, k = 0 unpatched from (select p_partkey, regexp_matches(p_brand, '[1234]$')::int k from part)""",
        "resolution_stats": "select count(*) total, count(*) filter (ok) successful, count(*) filter (not ok) failed, round(count(*) filter (ok) / count(*), 6) rate from (select regexp_matches(p_brand, '[123]$') ok from part)",
        "vector_topk": topk(5, "true"),
        "vector_topk_filtered": topk(3, "a.label = 1"),
        "stale_files": "select o_orderkey path from orders where o_orderkey % 3 = 0 or o_orderdate >= timestamp '1996-01-01'",
        "cache_stats": "select count(*) n_files, round(sum(o_orderkey * 1000) / 1048576, 2) mb, strftime(min(o_orderdate), '%Y-%m-%d') oldest, strftime(max(o_orderdate), '%Y-%m-%d') newest from orders",
        "upserted": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
        "purged_cache": "select o_orderkey path from orders where o_orderdate >= timestamp '1996-03-01' - interval 30 day",
        "fresh_answers": "select o_orderkey question from orders where o_orderdate >= timestamp '1996-03-01' - interval 240 hour and o_orderpriority = '1-URGENT'",
        "sampling_ratio": f"with {_TAGS} select count(*) filter ({_SAMPLED}) n_sampled, count(*) n_processed, round(count(*) filter ({_SAMPLED}) / count(*), 6) ratio from tags",
        "class_text_stats": f"""with {_TAGS}, t as (select page_id, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) k from pages)
            select tag as class, round(avg(k), 6) avg_length, max(k) max_length, round(avg((k > 10)::int), 6) content_share, count(*) n from tags join t using (page_id) group by tag having count(*) >= 300""",
        "class_tags": """with c as (select source, lang, count(*) k from documents group by all), t as (select *, row_number() over (partition by source order by k desc, lang) place from c)
            select source as class, round(a, 6) avg_text_length, round(h, 6) children_share, top_tags from (select source, avg(length(text)) a, avg((doc_id % 2 = 0)::int) h from documents group by source) join (select source, string_agg(lang, ',' order by place) top_tags from t where place <= 3 group by source) using (source)""",
        "languages_of_sources": "select source, string_agg(distinct lang, ',' order by lang) languages from documents group by source",
        "chunk_statistics": f"with recursive {_PARAGRAPHS}, k as (select * from chunks join documents using (doc_id) where length(text) > 500) select count(distinct doc_id) sections_processed, (select count(*) from documents) - count(distinct doc_id) sections_skipped, count(*) chunks, sum(length(content))::bigint chars, round(avg(length(content)), 6) avg_chars from k",
        "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) n, round(sum(value), 4) total from events group by all",
        "table_rows_for_export": f"with {_TABLE} select l_orderkey, len(rows_[1:3]) n_rows, array_to_string(flatten(rows_[1:3]), '|') cells from lines",
        "event_sliding_windows": "select strftime(h, '%Y-%m-%d %H') as hour, event_type, count(*) n from (select date_trunc('hour', ts) h, event_type from events union all select date_trunc('hour', ts) - interval 1 hour, event_type from events) group by all",
        "event_sessions": """with gaps as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 1 hour, true)::int fresh from events), numbered as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from gaps)
            select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') began, count(*) n, round(sum(value), 4) total from numbered group by user_id, s""",
        "refreshed_cache": "select o_orderkey path, case when stale then '1999-01-01' else '1996-01-01' end as day, stale refreshed from (select o_orderkey, o_orderkey % 3 = 0 or o_orderdate >= timestamp '1996-01-01' stale from orders where o_orderkey % 7 > 0)",
        "select_second_document": "select page_id, '<!DOCTYPE html><p>' || page_id || '</p>' html from pages where html ilike '<!DOCTYPE html%'",
        "config_round_trip": "select * from (values " + ", ".join(f"('{n}', {c.max_size}, {c.min_size}, {c.overlap}, {c.max_code}, '{c.strategy}')" for n, c in conf.PRESETS.items()) + ") v(preset, max_size, min_size, overlap, max_code, strategy)",
        "rendered_types": f"select p_partkey, {_fragment()} fragment from part",
        "batch_totals": "select count(distinct source) files, count(distinct source || lang) documents_processed, count(*) total_sections from documents",
    }
