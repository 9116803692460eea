"""Constants and presets. Keyword lists are kept as sets: only membership matters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class ChunkConfig:
    """Chunking knobs. Those under ``inert`` are accepted and kept, and read by no operator."""

    max_size: int = 1000
    min_size: int = 100
    overlap: int = 200
    max_code: int = 1500
    strategy: str = "hybrid"
    header: bool = True
    summary: bool = True
    sentences: bool = True
    sentence_regex: str = r"[.!?]\s+"
    paragraph: str = "\n\n"
    hierarchy: bool = True
    # inert
    max_tokens: int | None = None
    overlap_tokens: int | None = None
    small_code_intact: bool = True
    code_by_function: bool = True
    section_bounds: bool = True
    small_tables_intact: bool = True
    table_rows_intact: int = 20
    whole_code: bool = True
    position_meta: bool = True


_CORPUS = ChunkConfig(max_size=1200, min_size=200, overlap=150, max_tokens=384, overlap_tokens=50, sentence_regex=r"(?<=[!.?])(?:\s+)(?=[A-Z])")
#: Presets by use, then by kind of corpus or section.
PRESETS: dict[str, ChunkConfig] = {
    "embedding": ChunkConfig(max_size=500, min_size=50, overlap=50, max_tokens=256, strategy="sentence_based"),
    "qa": ChunkConfig(),
    "code": ChunkConfig(max_size=1500, min_size=200, overlap=100, max_code=2000, strategy="code_aware"),
    "documentation": ChunkConfig(max_size=1200, overlap=150),
    "default": _CORPUS,
    "python": replace(_CORPUS, max_size=1500, max_code=2000, strategy="code_aware"),
    "csharp": replace(_CORPUS, max_size=1800, max_code=2000, strategy="code_aware"),
    "api_reference": replace(_CORPUS, max_size=800, overlap=100),
    "tutorial": replace(_CORPUS, max_size=1000, overlap=200, strategy="paragraph_based"),
    "engine": replace(_CORPUS, max_code=1800),
    "writing": replace(_CORPUS, max_size=1000, overlap=200, strategy="paragraph_based"),
}
#: (part of a file name, preset), the first that fits holds.
FILE_ROUTES = (("lean-engine", "engine"), ("writing-algorithms", "writing"), ("lean-cli", "api_reference"), ("research", "tutorial"))
TITLE_ROUTES = (("api_reference", ("api", "class", "method", "reference")), ("tutorial", ("getting started", "guide", "how to", "tutorial")))


def save_config(config: ChunkConfig, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(asdict(config), file, indent=2)


def load_config(path: str) -> ChunkConfig:
    with open(path, encoding="utf-8") as file:
        known = {f.name for f in fields(ChunkConfig)}
        return ChunkConfig(**{k: v for k, v in json.load(file).items() if k in known})


def export_presets() -> str:
    return json.dumps({name: asdict(c) for name, c in sorted(PRESETS.items())}, indent=2)


# Code language by indicators, on lower-cased text; a weight of 2 counts an indicator twice.
PYTHON_MARKS = {"__init__": 1, "class ": 1, "def ": 2, "elif": 1, "from ": 1, "import ": 1, "import numpy": 1, "import pandas": 1, "print(": 1, "self.": 1}
CSHARP_MARKS = ("();", "int ", "namespace ", "new ", "private ", "public ", "public class", "public override", "string ", "using ", "var ", "void ")
CLI_MARKS = ("$ ", "--", "cd ", "chmod ", "conda ", "dotnet ", "export ", "git ", "ls ", "mkdir", "pip ", "sudo ")
CODE_TITLES = {"cli": "Command Line Example", "csharp": "C# Code Example", "python": "Python Code Example", "text": "Code Example"}
DROPPED_TAGS = frozenset("audio embed iframe img link meta object script style video".split())

# Analysis of text, as Java regexes.
TECHNICAL = (
    r"\b(?:algorithm|class|exception|function|method|parameter|return|variable)\b",
    r"\b(?:API|HTTP|JSON|REST|SDK|URI|URL|XML)\b",
    r"\b(?:database|index|query|schema|table)\b",
    r"\b(?:authentication|client|request|response|server)\b",
)
CODE_SHAPES = (r"`{3}\w*\n.*?\n`{3}", r"`[^`]+`", r"^\s*(?:class|def|for|from|if|import|while)\s+", r"^\s*(?:class|namespace|private|public|using)\s+")
LIST_ITEMS = (r"^\s*[-*+]\s+", r"^\s*\d+\.\s+")
FORMULAS = (r"\$[^$]+\$", r"\\\([^)]+\\\)", r"\b(?:derivative|equation|formula|integral|sum)\b")
REFERENCES = (r"\[[^\]]+\]", r"(?:check|refer to|see|visit)\s+\w+")
#: Content type: (strategy, confidence).
STRATEGY_OF = {
    "api_reference": ("section_based", 0.8),
    "code_heavy": ("code_aware", 0.9),
    "examples": ("code_aware", 0.8),
    "mixed_content": ("hybrid", 0.8),
    "pure_text": ("sentence_based", 0.8),
    "structured_doc": ("section_based", 0.9),
    "table_heavy": ("section_based", 0.8),
    "tutorial": ("paragraph_based", 0.7),
}
_TEXTUAL = ("paragraph_based", "sentence_based", "fixed_size")
FALLBACKS = {"code_heavy": ("section_based", "paragraph_based", "fixed_size"), "mixed_content": _TEXTUAL, "structured_doc": _TEXTUAL}
FALLBACK = ("paragraph_based", "fixed_size")
LEAST_QUALITY = 0.6

# Evidence of a markup pattern.
EVIDENCE_WORDS = ("#!/bin/bash", "$ ", "class ", "def ", "import ", "private", "public ", "sudo ", "using ")
EVIDENCE_SIGNS = ("!=", "()", ";", "==", "=>", "{", "}")
EVIDENCE_SHAPES = (r"@\w+", r"\w+\.\w+\(", r"^\s*#", r"^\s*//", r"^\s*\$ ")
EVIDENCE_TYPES = {
    "api": "api class method namespace property reference",
    "code": "bash cli code csharp example highlight python shell syntax",
    "interactive": "calculator interactive tool widget",
    "navigation": "breadcrumb menu nav sidebar toc",
    "table": "data grid responsive table",
    "tutorial": "guide lesson step tutorial walkthrough",
}
SUGGEST_BY_VALUE = (
    ("code_content", "bash cli code csharp highlight python"),
    ("api_reference", "api data-tree reference"),
    ("table_content", "grid table"),
    ("navigation_content", "breadcrumb nav toc"),
)
SUGGEST_BY_SAMPLE = ("class ", "def ", "import")
HIGH_VALUE = "algorithm api code container content csharp data example main python reference section table tree tutorial"
COVERAGE_TYPES = {
    "api": "api method reference tree",
    "code": "code csharp example highlight python",
    "content": "container content main section",
    "navigation": "breadcrumb menu nav toc",
    "table": "data grid responsive table",
}
FREQUENCY_CHANGE, EVIDENCE_CHANGE = 0.5, 0.2
REVIEW_COLUMNS = ("Pattern ID", "Selector Type", "Selector Value", "Estimated Frequency", "Evidence Score", "Sample Content", "Suggested Type", "Human Decision", "Notes")
MEDIA_TAGS = "img video audio iframe embed object canvas script style link meta".split()
MEDIA_CLASSES = "image img video audio media gif animation player embed cover-icon cover-image chart graph diagram".split()
#: (content type, classes, attributes, tags) in order of the types' precedence; the first entry is skipped content.
DEFAULT_RULES = (
    (
        "skip_content",
        "badge badge-csharp badge-python badge-sm blue-text-action centered clickable col-md-6 col-sm-12 col-xs-12 content cover-content cover-section-description cover-section-name"
        " cover-section-tagline csharp-result dataframe dataframe-wrapper docs-image docutils fa fa-external-link icon-name img-responsive lang-csharp lang-python language-buttons"
        " language-python literal notranslate pipe-separator pre pull-right py python-result qc-embed-backtest qc-embed-dummy qc-embed-element qc-embed-frame regression-test-results"
        " search sources testable to-be-tested " + " ".join(MEDIA_CLASSES),
        "",
        " ".join(MEDIA_TAGS),
    ),
    ("api_reference", "base-expandable-header base-expandable-link base-expandable-type inner-tree-container object-type property-description py-obj section-code-wrapper section-example-container subsection-content subsection-header xref", "data-fields data-tree data-tree-language", ""),
    ("navigation_content", "docs-internal-link docs-landing-link docs-landing-link-wrap docs-landing-links page-breadcrumb page-heading page-section-name see-also toc-h1 toc-h2 toc-h3 toc-h4 toc-h5 toc-h6", "", ""),
    ("table_content", "cause-examples hidden-xs qc-table table table-condensed table-dense table-reflow table-striped ticker-table vertical-table", "", ""),
    ("code_content", "Python arg-name code-snippet code-source error-messages public-file-name", "", ""),
    ("tutorial_content", "button-name csharp docs-tutorial example-algorithm-link example-fieldset python tutorial-header tutorial-step", "", ""),
    ("documentation_text", "example-legend internal-content latex-variable new-term placeholder-text sub-heading-content sub-heading-landing ul-option", "", ""),
)
DEFAULT_TYPE = "documentation_text"
TARGET_COVERAGE, SAMPLE_RATIO, MOST_ATTEMPTS, MOST_RATIO, RESERVOIR = 0.95, 0.1, 3, 0.3, 100_000
TOP_K, CACHE_HOURS = 5, 24
