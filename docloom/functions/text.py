"""Scalar text functions as Spark columns: all stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import conf


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def hits(text: Column, parts) -> Column:
    """How many of parts text contains."""
    return reduce(add, [_flag(F.contains(text, F.lit(p))) for p in parts])


def any_hit(text: Column, parts) -> Column:
    return hits(text, parts) > 0


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def clean_text(text: Column) -> Column:
    """White space (Unicode's) as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(title: Column) -> Column:
    bare = F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), r"[^a-z0-9\-]", "")
    return F.concat(F.regexp_replace(bare, "-+", "-"), F.lit("-"), F.substring(F.md5(title.cast("binary")), 1, 6))


def word_count(text: Column) -> Column:
    """Words by white space."""
    return count(text, r"(?U)\S+")


def detect_code_language(code: Column) -> Column:
    """cli if any of its marks occurs; else python or csharp by their marks; else text. Null is text."""
    low = F.lower(code)
    python = reduce(add, [n * _flag(F.contains(low, F.lit(p))) for p, n in conf.PYTHON_MARKS.items()])
    csharp = hits(low, conf.CSHARP_MARKS)
    return F.when(hits(low, conf.CLI_MARKS) > 0, "cli").when(python > csharp, "python").when(csharp > 0, "csharp").otherwise("text")


def normalise_language(language: Column) -> Column:
    low = F.lower(language)
    return F.when(low.isin("c#", "cs", "csharp"), "csharp").when(low.isin("py", "python"), "python").when(low.isin("bash", "cli", "cmd", "shell"), "cli").otherwise(low)


def code_title(language: Column) -> Column:
    return F.coalesce(*[F.when(language == k, F.lit(v)) for k, v in conf.CODE_TITLES.items()], F.concat(language, F.lit(" Code Example")))


def technical_matches(text: Column) -> Column:
    return reduce(add, [count(text, "(?i)" + p) for p in conf.TECHNICAL])


def readability(text: Column) -> Column:
    """0.5 for text without sentences or words. The sentence and word terms have no upper bound."""
    sentences, words = count(text, r"[.!?]+"), word_count(text)
    per_sentence, per_word = words / sentences, F.length(F.replace(text, F.lit(" "), F.lit(""))) / words
    together = count(text, "(?i)" + "|".join(conf.TECHNICAL))
    terms = [F.greatest(F.lit(0.0), 1 - (per_sentence - 15) / 20), F.greatest(F.lit(0.0), 1 - (per_word - 5) / 5), F.greatest(F.lit(0.0), 1 - together / words)]
    return F.when((F.coalesce(sentences, F.lit(0)) == 0) | (words == 0), 0.5).otherwise(reduce(add, terms) / 3)


def technical_density(text: Column) -> Column:
    words = word_count(text)
    code = reduce(add, [count(text, "(?s)" + p) for p in conf.CODE_SHAPES])
    return F.when(words == 0, 0.0).otherwise(F.least(F.lit(1.0), (technical_matches(text) + 2 * code) / words))


def has_lists(text: Column) -> Column:
    return F.coalesce(text.rlike("(?m)" + "|".join(conf.LIST_ITEMS)), F.lit(False))


def has_formulas(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(conf.FORMULAS)), F.lit(False))


def has_references(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(conf.REFERENCES)), F.lit(False))


def structure_complexity(level: Column, code_blocks: Column, tables: Column, content: Column, children: Column | None = None) -> Column:
    capped = lambda x, most: F.least(F.lit(1.0), x / most)
    marks = count(content, r"(?m)^#+\s+") + count(content, r"(?m)^\s*[-*+]\s+")
    terms = [capped(level, 5), capped(code_blocks, 5), capped(tables, 3), *([] if children is None else [capped(children, 10)]), capped(marks, 20)]
    return reduce(add, terms) / len(terms)


def content_type(text_ratio: Column, code_ratio: Column, table_ratio: Column, level: Column, density: Column) -> Column:
    return (
        F.when((code_ratio > 0.4) | ((code_ratio > 0.2) & (density > 0.3)), "code_heavy")
        .when(table_ratio > 0.3, "table_heavy")
        .when((code_ratio > 0.1) & (text_ratio > 0.5), "mixed_content")
        .when((density > 0.4) & (level > 2), "api_reference")
        .when((density > 0.1) & (density < 0.4) & (level <= 3), "tutorial")
        .when((code_ratio > 0.05) & (text_ratio > 0.6), "examples")
        .when((text_ratio > 0.8) & (level > 1), "structured_doc")
        .otherwise("pure_text")
    )


def strategy(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(s)) for k, (s, _) in conf.STRATEGY_OF.items()], F.lit("hybrid"))


def confidence(kind: Column, complexity: Column, code_ratio: Column, size: Column) -> Column:
    base = F.coalesce(*[F.when(kind == k, F.lit(c)) for k, (_, c) in conf.STRATEGY_OF.items()], F.lit(0.6))
    less = _flag(complexity > 0.6) + _flag((code_ratio > 0.3) & (code_ratio < 0.7)) + _flag(size > 3000)
    return F.greatest(F.lit(0.3), base - 0.1 * less)


def section_complexity(text_size: Column, code_blocks: Column, tables: Column, children: Column, content: Column) -> Column:
    capped = lambda x, most: F.least(F.lit(1.0), x / most)
    shapes = count(content, r"(?m)^\s*[-*+]\s+") + count(content, r"\[[^\]]+\]") + count(content, r"\$[^$]+\$")
    return 0.3 * capped(text_size, 2000) + 0.25 * capped(code_blocks, 5) + 0.15 * capped(tables, 3) + 0.15 * capped(children, 10) + 0.15 * capped(shapes, 20)


def size_flags(whole: Column, text: Column, code: Column, blocks: Column) -> Column:
    """is_small, is_large, code_heavy and content_heavy of a section by its sizes and code blocks."""
    return F.struct((whole <= 800).alias("is_small"), (whole > 2000).alias("is_large"), (code > 1.5 * text).alias("code_heavy"), ((text > 500) | (blocks > 2)).alias("content_heavy"))


def distinct_languages(languages: Column) -> Column:
    """Aggregate: the languages of a group, sorted."""
    return F.array_sort(F.collect_set(languages))


def size_score(size: Column) -> Column:
    return F.when(size < 200, 0.5).when(size < 500, 0.8).when(size <= 1200, 1.0).when(size <= 2000, 0.7).otherwise(0.3)


def completeness_score(content: Column) -> Column:
    ended = F.when(content.rlike(r"(?s)[.!?`]\s*\z") & content.rlike(r"(?s)(?:[.!?]|```)\s*\z"), 1.0).otherwise(0.7)
    sentences = F.when(content.rlike("[.!?]"), ended).otherwise(0.5)
    open_fence = content.rlike(r"(?s)```[^`]*\z")
    fences = F.when(open_fence, 0.3).when(content.rlike(r"(?s)```.*?```"), 1.0).otherwise(0.8)
    return (sentences + fences) / 2


def top_words(content: Column, k: int = 5) -> Column:
    """The k commonest lower-cased words with their counts (negative); ties: the one seen first. Words are sorted once and counted by runs.

    sort_array() has an order of its own, where array_sort() interprets a comparing expression for every pair.
    """
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def counted(words):
        word = lambda i: F.get(words, i)["word"]
        new = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))

        def runs(starts):
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(words))
            each = F.transform(starts, lambda s, j: F.struct((s - end(j)).alias("n"), F.get(words, s)["i"].alias("i"), word(s).alias("word")))
            return F.slice(F.sort_array(each), 1, k)

        return F.when(F.size(words) > 0, let(new, runs)).otherwise(F.array().cast("array<struct<n:int,i:int,word:string>>"))

    found = F.regexp_extract_all(F.lower(content), F.lit(r"(?U)\S+"), F.lit(0))
    return let(F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("i")))), counted)


def coherence_score(content: Column) -> Column:
    words = word_count(content)
    def score(n):
        each = F.transform(top_words(content), lambda s: F.when((F.length(s["word"]) > 3) & (s["n"] < -1), F.least(F.lit(0.2), -s["n"] / n)).otherwise(0.0))
        return F.when(n < 10, 0.6).otherwise(F.least(F.lit(1.0), 5 * F.aggregate(each, F.lit(0.0), lambda a, x: a + x)))

    return F.element_at(F.transform(F.array(words), score), 1)


def context_score(title: Column, path: Column, kind: Column) -> Column:
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return (F.when(given(title), 1.0).otherwise(0.5) + F.when(given(path), 1.0).otherwise(0.7) + F.when(kind != "text", 1.0).otherwise(0.8)) / 3


def chunk_quality(content: Column, title: Column, path: Column, kind: Column) -> Column:
    return (size_score(F.length(content)) + completeness_score(content) + coherence_score(content) + context_score(title, path, kind)) / 4


def config_for_title(title: Column, language: Column | None = None, has_code: Column | None = None) -> Column:
    """Preset by words of the title, then by the language of a section with code."""
    low, out = F.lower(title), None
    for name, words in conf.TITLE_ROUTES:
        out = F.when(any_hit(low, words), name) if out is None else out.when(any_hit(low, words), name)
    if language is not None and has_code is not None:
        out = out.when(has_code & language.isin("python", "csharp"), language)
    return out.otherwise("default")


def config_for_file(name: Column) -> Column:
    out = None
    for part, preset in conf.FILE_ROUTES:
        hit = F.contains(F.lower(name), F.lit(part))
        out = F.when(hit, preset) if out is None else out.when(hit, preset)
    return out.otherwise("default")


def table_markdown(headers: Column, rows: Column, caption: Column) -> Column:
    """A table of strings as Markdown, rows cut and padded to the header; empty without both."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    n = F.coalesce(F.size(headers), F.lit(0))
    pad = lambda r: F.when(n > 0, F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(r)))), 1, F.greatest(n, F.lit(1)))).otherwise(r)
    head = F.when(n > 0, F.array(line(headers), F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), n), "|"), F.lit("|")))).otherwise(F.array().cast("array<string>"))
    title = F.when(F.length(caption) > 0, F.array(F.concat(F.lit("**"), caption, F.lit("**\n")))).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: line(pad(r)))
    return F.when((n == 0) & (F.coalesce(F.size(rows), F.lit(0)) == 0), "").otherwise(F.array_join(F.concat(title, head, body), "\n"))


def table_chars(headers: Column, rows: Column, caption: Column, separators: int = 3) -> Column:
    """Characters of a table's cells and caption, with separators for each cell."""
    cells = lambda row: F.aggregate(row, F.lit(0), lambda a, x: a + F.length(x) + separators)
    whole = F.aggregate(F.coalesce(rows, F.array().cast("array<array<string>>")), F.lit(0), lambda a, r: a + cells(r))
    return F.coalesce(cells(headers), F.lit(0)) + whole + F.coalesce(F.length(caption), F.lit(0))


def generalise_id(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\d+", "N"), "[0-9a-f]{8,}", "HASH")
