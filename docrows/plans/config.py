"""Configuration. Every key has an effect; unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

import yaml

from ..functions.lexicon import DATE_FORMATS, PARSER_TERMS, REQUIRED
from ..operators.validate import FieldRule, GlobalRules, Validation
from ..sources.sinks import CsvOptions


@dataclass(frozen=True)
class ParserConfig:
    enabled: bool = True
    auto_detect: bool = True
    keywords: tuple[str, ...] = ()
    rules: tuple[FieldRule, ...] = ()


#: Required fields and keywords of parsers that a program has declared, by name.
DECLARED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}


@dataclass(frozen=True)
class Config:
    """Settings of a pipeline. ``parsers`` are asked in their order."""

    parsers: dict[str, ParserConfig] = field(default_factory=lambda: {k: ParserConfig(keywords=v) for k, v in PARSER_TERMS.items()})
    min_columns: int = 2
    max_header_rows: int = 3
    include_metadata: bool = False
    date_formats: tuple[str, ...] = DATE_FORMATS
    date_output: str = "yyyy-MM-dd"
    normalize_unicode: bool = True
    lowercase_headers: bool = True
    validation: Validation = field(default_factory=Validation)
    deduplicate: bool = True
    key_columns: tuple[str, ...] = ()
    keep: str = "first"
    csv: CsvOptions = field(default_factory=CsvOptions)
    json_orient: str = "records"
    json_internal: bool = False
    max_pages: int = 100
    prefer_tables: bool = True
    ocr_fallback: bool = True
    strategy: str = "auto"

    def terms(self) -> dict[str, tuple[str, ...]]:
        """Terms by parser; those of declared parsers that aren't configured come last."""
        own = {k: p.keywords or DECLARED.get(k, ((), ()))[1] for k, p in self.parsers.items() if p.enabled and p.auto_detect}
        return own | {k: words for k, (_, words) in DECLARED.items() if k not in self.parsers and words}

    def rules_of(self, parser: str) -> tuple[FieldRule, ...]:
        """A parser's rules, and its required fields that have none."""
        own = self.parsers.get(parser, ParserConfig()).rules
        known = {r.name for r in own}
        return own + tuple(FieldRule(n, required=True) for n in (*REQUIRED.get(parser, ()), *DECLARED.get(parser, ((), ()))[0]) if n not in known)


#: How documents are extracted; ``table_first`` asks for tables even where ``prefer_tables`` is off.
STRATEGIES = ("auto", "text_first", "table_first")
#: Date directives and what they are in Spark's patterns.
DIRECTIVES = {"%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%H": "H", "%M": "m", "%S": "s"}


def spark_format(directives: str, out: bool = False) -> str:
    """A strftime format in Spark's patterns; on output days and months have two digits."""
    result, text = "", ""
    i = 0
    while i < len(directives):
        mark = DIRECTIVES.get(directives[i : i + 2])
        if mark:
            result += (f"'{text}'" if any(c.isalpha() for c in text) else text) + (mark * 2 if out and len(mark) == 1 else mark)
            text, i = "", i + 2
        else:
            text, i = text + directives[i], i + 1
    return result + (f"'{text}'" if any(c.isalpha() for c in text) else text)


def _take(tree: dict[str, Any], known: set[str], where: str) -> dict[str, Any]:
    if unknown := set(tree) - known:
        raise ValueError(f"unknown keys in {where or 'the configuration'}: {', '.join(sorted(unknown))}")
    return tree


def _rule(name: str, tree: dict[str, Any]) -> FieldRule:
    _take(tree, {f.name for f in fields(FieldRule)} - {"name"}, f"the rule of {name}")
    return FieldRule(name, **{**tree, "allowed_values": tuple(tree.get("allowed_values", ()))})


def from_dict(tree: dict[str, Any] | None) -> Config:
    """Settings from a nested dict; what is absent has its default."""
    tree = _take(tree or {}, {"parsers", "extraction", "normalization", "validation", "deduplication", "output"}, "")
    c = Config()
    if parsers := tree.get("parsers"):
        own = {}
        for name, p in parsers.items():
            p = _take(p or {}, {"enabled", "auto_detect", "keywords", "validation", "min_columns", "max_header_rows", "include_metadata"}, f"parsers.{name}")
            rules = tuple(_rule(n, r) for n, r in p.get("validation", {}).items())
            own[name] = ParserConfig(p.get("enabled", True), p.get("auto_detect", True), tuple(p.get("keywords", ())), rules)
            c = replace(c, **{k: p[k] for k in ("min_columns", "max_header_rows", "include_metadata") if k in p})
        c = replace(c, parsers=own)
    e = _take(tree.get("extraction", {}), {"max_pages", "prefer_tables", "ocr_fallback", "strategy"}, "extraction")
    if e.get("strategy", "auto") not in STRATEGIES:
        raise ValueError(f"unknown extraction.strategy {e['strategy']!r}; there are {', '.join(STRATEGIES)}")
    c = replace(c, **e)
    n = _take(tree.get("normalization", {}), {"dates", "text"}, "normalization")
    dates = _take(n.get("dates", {}), {"input_formats", "output_format"}, "normalization.dates")
    if "input_formats" in dates:
        c = replace(c, date_formats=tuple(spark_format(f) for f in dates["input_formats"]))
    if "output_format" in dates:
        c = replace(c, date_output=spark_format(dates["output_format"], out=True))
    c = replace(c, **_take(n.get("text", {}), {"normalize_unicode", "lowercase_headers"}, "normalization.text"))
    v = _take(tree.get("validation", {}), {"enabled", "on_error", "max_errors", "rules"}, "validation")
    shared = GlobalRules(**_take(v.get("rules", {}), {"non_negative_totals", "valid_dates"}, "validation.rules"))
    c = replace(c, validation=Validation((), shared, v.get("enabled", True), v.get("on_error", "warn"), v.get("max_errors", 10)))
    d = _take(tree.get("deduplication", {}), {"enabled", "key_columns", "keep"}, "deduplication")
    c = replace(c, deduplicate=d.get("enabled", True), key_columns=tuple(d.get("key_columns", ())), keep=d.get("keep", "first"))
    o = _take(tree.get("output", {}), {"csv", "json"}, "output")
    c = replace(c, csv=CsvOptions(**_take(o.get("csv", {}), {f.name for f in fields(CsvOptions)}, "output.csv")))
    j = _take(o.get("json", {}), {"orient", "include_internal_fields"}, "output.json")
    return replace(c, json_orient=j.get("orient", "records"), json_internal=j.get("include_internal_fields", False))


def load(path: str) -> Config:
    """Settings from a YAML file; an empty one has all defaults, a missing one is an error."""
    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))
