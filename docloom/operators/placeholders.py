"""Placeholders of API types in HTML: found, resolved from a table, rendered, patched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schemas

_ATTRIBUTE = r"data-tree\s*=\s*"
_OPEN = r"<div\s+" + _ATTRIBUTE + r"""["']([^'"]+)['"][^>]*"""
_WHOLE = "(?is)" + _OPEN + r">.*?</div>"
_ALONE = "(?i)" + _OPEN + "/?>"


def _tag(name: str, classes: str, more: str = "") -> str:
    return f'<{name} class="{classes}"{more}>'


def placeholders(html: Column) -> Column:
    """(value, element) of each div with data-tree, then of unclosed ones whose value hasn't come up. Resolved elements are passed over."""
    def found(pattern: str) -> Column:
        pairs = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda e: F.struct(F.regexp_extract(e, pattern, 1).alias("value"), e.alias("element")))
        return F.filter(pairs, lambda p: ~F.contains(p["element"], F.lit("base-expandable-type")))

    whole, resolved = found(_WHOLE), F.regexp_extract_all(html, F.lit("(?is)" + _OPEN + r">\s*<div class=\"base-expandable-type"), F.lit(1))
    values = F.concat(F.transform(whole, lambda p: p["value"]), resolved, F.array(F.lit("root")))
    return F.array_distinct(F.concat(whole, F.filter(found(_ALONE), lambda p: ~F.array_contains(values, p["value"]))))


def normalised_name(value: Column, names: dict[str, str]) -> Column:
    """value, or what names has for it."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value) if names else value


def rendered(types: DataFrame, response: str = "response") -> DataFrame:
    """types (name, language, response JSON) with fragment: the type as HTML, null where the response has no type."""
    t = F.from_json(F.col(response), schemas.API_TYPE)
    some = lambda c: F.length(c) > 0
    enum = F.coalesce(F.contains(t["base-type-full-name"], F.lit("Enum")), F.lit(False))
    snippet = lambda kind, name: F.concat(F.lit(_tag("div", "code-snippet") + _tag("span", "object-type")), kind, F.lit("</span> <code>"), name, F.lit("</code></div>"))
    box = lambda *parts: F.concat_ws("\n", F.lit(_tag("div", "subsection-content")), *parts, F.lit("</div>"))
    para = lambda c: F.when(some(c), F.concat(F.lit("<p>"), c, F.lit("</p>")))
    typed = lambda label, c: F.when(some(c), F.concat(F.lit(f"{_tag('div', 'subsection-header')}{label}:</div>\n{_tag('p', 'subsection-content')}"), c, F.lit("</p>")))

    def members(kind: str, key: str, label: str | None, returned: str | None, needs: bool) -> Column:
        own = F.filter(t[key], lambda m: some(m[f"{kind}-name"]) & (some(m[f"{kind}-description"]) if needs else F.lit(True)))
        each = lambda m: F.concat_ws("\n", snippet(F.lit(kind), m[f"{kind}-name"]), box(para(m[f"{kind}-description"]), *([typed(label, m[returned])] if returned else [])))
        return F.coalesce(F.transform(own, each), F.array().cast("array<string>"))

    inner = F.concat(members("field", "fields", None, None, True), members("property", "properties", "Type", "property-short-type-name", False), members("method", "methods", "Returns", "method-return-short-type-name", False))
    parts = [
        F.when(some(t["type-name"]), F.concat(F.lit("<h4>"), t["type-name"], F.when(enum, " Enumeration").otherwise(""), F.lit("</h4>"))),
        F.when(some(t["full-type-name"]), snippet(F.when(enum, "enum").otherwise("class"), t["full-type-name"])),
        para(t["description"]),
        F.when(F.size(inner) > 0, box(F.array_join(inner, "\n"))),
    ]
    return types.withColumn("fragment", F.nullif(F.concat_ws("\n", *parts), F.lit("")))


def resolved(values: DataFrame, types: DataFrame) -> DataFrame:
    """value and content for each distinct value: both languages, one standing in for the other; content is null where neither is known."""
    of = lambda language: types.where(F.col("language") == language).select(F.col("name").alias("value"), F.col("fragment").alias(language))
    both = values.select("value").distinct().join(of("python"), "value", "left").join(of("csharp"), "value", "left")
    python, csharp = F.coalesce("python", "csharp"), F.coalesce("csharp", "python")
    inner = _tag("div", "inner-tree-container section-code-wrapper")
    pane = lambda language, content, style: F.concat(F.lit(f"{_tag('div', language, f' data-tree-language={chr(34)}{language}{chr(34)} data-tree={chr(34)}root{chr(34)}{style}')}\n{inner}\n"), content, F.lit("\n</div>\n</div>"))
    name = F.element_at(F.split("value", r"\."), -1)
    buttons = "".join(f"{_tag('button', mark)}{label}</button>" for mark, label in (("lang-csharp", "C#"), ("lang-python", "Python")))
    boxes = ("base-expandable-type section-example-container", "base-expandable-header", "base-expandable-link", "blue-text-action language-buttons")
    head = "\n".join(_tag("div", b) for b in boxes)
    content = F.concat(F.lit(head + "\n"), name, F.lit(f"\n<span>Select Language: {buttons}</span>\n</div>\n"), pane("python", python, ""), F.lit("\n"), pane("csharp", csharp, ' style="display: none;"'), F.lit("\n</div>" * 3))
    return both.select("value", content.alias("content"))


def patch(pages: DataFrame, types: DataFrame, key: str, html: str = "html") -> DataFrame:
    """pages with every known placeholder replaced; n_found, n_patched, n_failed and status of each. types: name, language, fragment."""
    with_found = pages.withColumn("__found", placeholders(F.col(html)))
    each = with_found.select(key, F.posexplode("__found").alias("at", "p")).select(key, "at", "p.value", "p.element")
    known = each.join(resolved(each, types), "value", "left")
    new = F.concat(F.lit('<div data-tree="'), F.col("value"), F.lit('">\n'), F.col("content"), F.lit("\n</div>"))
    swaps = known.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("at", "element", new.alias("new"))))).alias("__swaps"), F.count("*").alias("n_found"), F.count("content").alias("n_patched"))
    out = pages.join(swaps, key, "left")
    out = out.withColumn(html, F.aggregate(F.coalesce("__swaps", F.array().cast("array<struct<at:int,element:string,new:string>>")), F.col(html), lambda h, s: F.replace(h, s["element"], s["new"])))
    out = out.withColumns({"n_found": F.coalesce("n_found", F.lit(0)), "n_patched": F.coalesce("n_patched", F.lit(0))}).withColumn("n_failed", F.col("n_found") - F.col("n_patched"))
    status = F.when(F.col("n_found") == 0, "no_data_trees").when(F.col("n_patched") == 0, "failed").when(F.col("n_failed") > 0, "partial").otherwise("success")
    return out.drop("__swaps").withColumn("status", status)


def resolution_stats(values: DataFrame) -> DataFrame:
    """values: (value, content), one row a request."""
    ok = F.count_if(F.col("content").isNotNull())
    return values.agg(F.count("*").alias("total"), ok.alias("successful"), (F.count("*") - ok).alias("failed"), F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("rate"))
