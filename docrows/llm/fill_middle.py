"""Fill-in-middle transformation by a table-driven byte automaton.

One scan takes every byte of a batch of texts through a transition table that knows how UTF-8 continues, where units begin
and which sentinel is being spelled. A transition carries marks (a code point begins, a unit begins, a sentinel is whole),
whose counts give each text's units, code points and whether it can be rearranged at all. A second pass finds the cuts
among the marked bytes and moves the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks

#: Marks of a transition.
CODE_POINT, UNIT, SENTINEL = 1, 2, 4
#: Bytes that a lane of the scan walks, and those before it that bring it into the right state: a state depends on the last
#: ``len(sentinel) - 1`` bytes only, as it is what they spell and whether the last of them is white space.
LANE = 512
_BREAK = 0xFF  # stands between texts; never a byte of UTF-8


def automaton(sentinels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Transition table (state, byte) -> state and the marks of each transition.

    A state is what the last bytes spell of a sentinel, and whether a white space, a word or nothing stands before. Units are
    white space with the word after it, or the white space at the end: one begins with the text, and with white space after a word.
    """
    spelled = sorted({s.encode()[:n] for s in sentinels for n in range(len(s.encode()))})
    start, gap, word = 0, 1, 2
    states = [(before, part) for before in (start, gap, word) for part in (spelled if before == word else [b""])]
    number = {s: i for i, s in enumerate(states)}
    table, marks = np.zeros((len(states), 256), np.uint8), np.zeros((len(states), 256), np.uint8)
    for (before, part), i in number.items():
        for byte in range(256):
            if byte == _BREAK:
                continue  # to the start, no marks
            space = byte == 32 or 9 <= byte <= 13
            read = part + bytes([byte])
            whole = any(read.endswith(s.encode()) for s in sentinels)
            rest = max((p for p in spelled if read.endswith(p)), key=len)
            table[i, byte] = number[(gap, b"") if space else (word, rest)]
            marks[i, byte] = CODE_POINT * (byte & 0xC0 != 0x80) | UNIT * (before == start or space and before == word) | SENTINEL * whole
    return table, marks


def scan(data: np.ndarray, table: np.ndarray, marks: np.ndarray, memory: int) -> np.ndarray:
    """The marks of each byte. Lanes of the data are walked side by side; each begins ``memory`` bytes early, by when its state is right."""
    lanes = -(-len(data) // LANE) or 1
    padded = np.full(memory + lanes * LANE, _BREAK, np.uint8)
    padded[memory : memory + len(data)] = data
    steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, memory + LANE)[::LANE].T)
    table, marks = table.astype(np.int16).ravel() * 256, marks.ravel()
    state, out = np.zeros(lanes, np.int16), np.empty((LANE, lanes), np.uint8)
    for k, byte in enumerate(steps):
        at = state + byte
        if k >= memory:
            np.take(marks, at, out=out[k - memory])
        state = table[at]
    return out.T.ravel()[: len(data)]


def _transform(batches: Iterator[pa.RecordBatch], sentinels: tuple[str, str, str], names: list[str]) -> Iterator[pa.RecordBatch]:
    table, marks = automaton(sentinels)
    memory = max(len(s.encode()) for s in sentinels)
    prefix, suffix, middle = (s.encode() for s in sentinels)
    for batch in batches:
        for part in chunks(batch, "text", 1 << 19):
            texts = Texts(part.column("text"))
            n, ends = len(texts.offs) - 1, texts.offs + np.arange(len(texts.offs))
            data = np.full(ends[-1], _BREAK, np.uint8)  # a break after each text
            at = np.ones(len(data), bool)
            at[ends[1:] - 1] = False
            data[at] = texts.data
            found = scan(data, table, marks, memory)[at]  # the first pass
            points = np.r_[0, np.cumsum(found & CODE_POINT, dtype=np.int64)]
            units = np.flatnonzero(found & UNIT)
            first = np.searchsorted(units, texts.offs)
            hits = np.searchsorted(np.flatnonzero(found & SENTINEL), texts.offs)
            count = np.diff(first)
            draws = [part.column(f"h{k}").to_numpy() for k in (1, 2)]
            moved = part.column("moved").to_numpy(zero_copy_only=False) & (np.diff(hits) == 0) & (np.diff(texts.offs) > 0)
            spm = part.column("spm").to_numpy(zero_copy_only=False)
            edges = np.r_[units, len(texts.data)]  # the second pass: unit k of a text begins at edges[first + k]
            low, high = (f(draws[0] % (count + 1), draws[1] % (count + 1)) for f in (np.minimum, np.maximum))
            cuts = [np.where(k == count, texts.offs[1:], edges[first[:-1] + k]) for k in (low, high)]
            raw, out = texts.data.tobytes(), []
            for i in range(n):
                a, b, c, d = int(texts.offs[i]), int(cuts[0][i]), int(cuts[1][i]), int(texts.offs[i + 1])
                if not moved[i]:
                    out.append(raw[a:d])
                elif spm[i]:
                    out.append(suffix + raw[c:d] + prefix + raw[a:b] + middle + raw[b:c])
                else:
                    out.append(prefix + raw[a:b] + suffix + raw[c:d] + middle + raw[b:c])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(count), pa.array(np.where(moved, np.where(spm, "spm", "psm"), "plain"), pa.string()),
                    pa.array(points[cuts[0]] - points[texts.offs[:-1]], mask=~moved), pa.array(points[cuts[1]] - points[cuts[0]], mask=~moved),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names,
            )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output for each row of ``docs``; other columns are not read.

    A document is cut after two numbers of units drawn by hash from ``seed`` and its id; of 100 documents ``rate`` are
    rearranged, of 100 of those ``spm_share`` with the suffix first. ``sentinels`` (in ASCII without white space; each begins
    with a character that none of them holds elsewhere) go before the prefix, suffix and middle. Texts that are null (read as empty), empty or hold
    a sentinel stay plain, and their cuts are null; so do those that the draw leaves alone. A row without id draws as if its
    id were the empty string. Rows that repeat an id and text get the same output; no rows give no rows. Whole texts count,
    whatever their length; a task holds half a MB of texts, or one longer text, beside what Arrow brings it.
    """
    assert all(s.isascii() and s and not any(c.isspace() for c in s) for s in sentinels) and not any(s[0] in t[1:] for s in sentinels for t in sentinels)
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), digest.alias("digest"))
    draw = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    rows = rows.select("doc_id", "text", draw(1).alias("h1"), draw(2).alias("h2"), (draw(3) % 100 < rate).alias("moved"), (draw(4) % 100 < spm_share).alias("spm"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return rows.mapInArrow(lambda it: _transform(it, sentinels, names), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``output`` was made from. A rearranged text holds no sentinel but the three, so they part it without doubt."""
    part = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
