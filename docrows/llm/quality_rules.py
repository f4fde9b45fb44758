"""Quality rules by a bitmask ledger.

Every rule is evaluated once for each document: the ledger keeps its measurements and a mask with a bit for each rule that it
fails. Policies are masks of rules with a version. They are applied to the ledger, and so are ablations, which first count
documents by mask and then look at the few masks there are; neither reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, mix, span_hash

#: What is counted of a text, all of it longs.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_letters", "n_capitals", "n_letter_words")
#: Rules in the order of their bits: name, and when a document fails. A rule keeps its bit for good; new ones go at the end.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("bullet_lines", "100 * n_bullet_lines > 90 * n_lines"),
    ("ellipsis_lines", "100 * n_ellipsis_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 30 * n_letters"),
    ("letterless_words", "100 * n_letter_words < 80 * n_words"),
    ("many_words", "n_words > 100000"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of ``must`` and at most ``most`` of ``may``."""

    version: str
    must: tuple[str, ...]
    may: tuple[str, ...] = ()
    most: int = 0

    @property
    def must_mask(self) -> int:
        return sum(BIT[r] for r in self.must)

    @property
    def may_mask(self) -> int:
        return sum(BIT[r] for r in self.may)

    def keeps(self, failed: str = "failed") -> str:
        """SQL that holds for the masks of kept documents."""
        return f"({failed} & {self.must_mask}) = 0 AND bit_count({failed} & {self.may_mask}) <= {self.most}"


_SHAPE = tuple(name for name, _ in RULES if name not in (*BASE, "many_words"))
#: base: what is always asked. strict: every rule but that on long texts, which says nothing of quality. lenient: one fault of shape is forgiven.
POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("strict", (*BASE, *_SHAPE)), Policy("lenient", BASE, _SHAPE, 1))}

_SYMBOL, _LETTER, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


def _repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its value stands elsewhere in its document, and whether it stands there earlier. By 64 bits."""
    _, first, at, n = np.unique(mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    return n[at] > 1, first[at] != np.arange(len(at))


def measure_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES for each text of a batch."""
    t = Texts(column).words()
    data, n = t.data, len(t.offs) - 1
    total = lambda marks: np.r_[0, np.cumsum(marks, dtype=np.int64)]
    within = lambda marks: np.diff(total(marks)[t.offs])
    out = {"n_words": np.diff(t.first)}
    points = total((data & 0xC0) != 0x80)
    of_word = np.repeat(np.arange(n), out["n_words"])
    count = lambda doc, marks: np.bincount(doc[marks], minlength=n)
    out["word_chars"] = np.bincount(of_word, points[t.ends] - points[t.starts], n).astype(np.int64)
    out["n_symbols"], out["n_letters"], out["n_capitals"] = (within(kind[data]) for kind in (_SYMBOL, _LETTER, _CAPITAL))
    letters = total(_LETTER[data] | (data >= 0x80))
    out["n_letter_words"] = count(of_word, letters[t.ends] > letters[t.starts])

    # windows of three words
    h, again = t.hashes(), np.zeros(len(t.starts), bool)
    whole = np.flatnonzero(of_word[2:] == of_word[:-2])
    window = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:])))[whole] if len(whole) else np.zeros(0, np.uint64)
    found = whole[_repeats(of_word[whole], window)[0]]
    for k in range(3):
        again[found + k] = True
    out["n_repeat_words"] = count(of_word, again)

    # lines that hold a word
    edge = np.zeros(len(data) + 1, bool)
    edge[t.offs] = True
    edge[np.flatnonzero(data == 10) + 1] = True
    begins = np.flatnonzero(edge[:-1])
    ends = np.r_[begins[1:], len(data)][: len(begins)]
    ends = ends - (data[ends - 1] == 10) if len(begins) else ends
    low, high = np.searchsorted(t.starts, begins), np.searchsorted(t.starts, ends)
    held = low < high
    begins, ends, low, high = begins[held], ends[held], low[held], high[held]
    of_line = np.searchsorted(t.offs, begins, side="right") - 1
    out["n_lines"] = np.bincount(of_line, minlength=n)
    out["n_dup_lines"] = count(of_line, _repeats(of_line, span_hash(mix(data.astype(np.uint64) + np.uint64(1)), begins, ends))[1])
    spare = np.r_[np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)]  # so that three bytes can be looked at anywhere
    reads = lambda at, text: np.logical_and.reduce([spare[at + 3 + k] == b for k, b in enumerate(text.encode())])
    head, tail = t.starts[low], t.ends[high - 1]
    out["n_bullet_lines"] = count(of_line, np.logical_or.reduce([reads(head, mark) for mark in "-*•‣"]))
    out["n_ellipsis_lines"] = count(of_line, reads(tail - 3, "...") & (tail - 3 >= begins) | reads(tail - 3, "…"))
    return out


def quality_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and ``failed`` (a bit for each of RULES) for each row of ``docs``; other columns are not read.

    Words are runs without white space, of every whole text; a null text has none. A text without words fails ``few_words``
    alone. Equal words, windows and lines are told by 64 bits of hash within a text. Rows that repeat get a row each, whether
    they have an id or not; no rows give no rows.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                found = measure_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = " + ".join(f"IF({fails}, {BIT[name]}L, 0L)" for name, fails in RULES)
    return rows.withColumn("failed", F.expr(failed))


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """``ledger`` with base_failed, kept and policy (its version)."""
    base = sum(BIT[r] for r in BASE)
    return ledger.withColumns({"base_failed": F.expr(f"(failed & {base}) <> 0"), "kept": F.expr(policy.keeps()), "policy": F.lit(policy.version)})


def ablations(ledger: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and each of its rules: n_docs, n_kept, n_failed (documents that fail the rule), n_only (those that would be kept without it).

    Documents are counted by mask first, of which there are at most 2 ** len(RULES), however many documents; the rest works on masks.
    A ledger without rows gives no rows.
    """
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(*(
        F.struct(
            F.lit(p.version).alias("policy"), F.lit(rule).alias("rule"), F.expr(p.keeps()).alias("kept"), F.expr(f"(failed & {BIT[rule]}) <> 0").alias("fails"),
            F.expr(p.keeps(f"(failed & {~BIT[rule]})")).alias("without"),
        ) for p in policies for rule in (*p.must, *p.may)
    ))
    counted = lambda what: F.sum(F.expr(f"IF({what}, n, 0L)"))
    return masks.select("n", F.inline(cases)).groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), counted("kept").alias("n_kept"), counted("fails").alias("n_failed"), counted("without AND NOT kept").alias("n_only")
    )


def failure_profile(ledger: DataFrame, by: list[str]) -> DataFrame:
    """For each group of ``by``: n_docs, any_failed (rules that some document fails) and all_failed (rules that all fail), as masks."""
    return ledger.groupBy(*by).agg(F.count("*").alias("n_docs"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))
