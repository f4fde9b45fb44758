"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ra", "ten", "sul"]) for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(10)) for _ in range(n))
    rows = [(i, text(rng.randrange(3, 30)), "xx", f"s{i % 4}", 0) for i in range(240)]
    item = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [(300, rows[0][1], "xx", "s0", 0), (301, rows[1][1].replace("ka", "KA", 1), "xx", "s1", 0), (302, "!!@@##$$%%" * 60, "xx", "s2", 0), (303, text(5) + " " + item + " " + text(5), "xx", "s3", 0)]
    rows += [(304, None, None, None, None), (None, text(4), "xx", "s1", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(230)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    import corpus_pipeline as p
    from docrows.llm.common import materialize

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, corpus), "stage")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == (columns if name != p.STAGES[-1][0] else [*columns, "copy"])
    first, second, third, fourth, last = kept.values()
    assert 302 not in first and set(range(240)) <= set(first) and 304 in first and None in first
    assert 300 not in second and set(range(240)) <= set(second)  # all lines of the copy stand in the first document
    assert set(range(240)) <= set(third)
    assert 303 not in fourth and set(range(240)) <= set(fourth)
    assert set(last) <= set(fourth) and max(last.count(i) for i in set(last)) <= 2


def test_short_lines(spark):
    """Exact repeats of short lines go; near ones, blank ones and those of rows without an id stay."""
    import corpus_pipeline as p

    rows = [(1, "Les.\nfirst of the long lines here\n\nLes."), (2, "Lex.\nLes.\n\n  \nOf, edti oner."), (3, "Of, edti oner.\n  \nanother of long lines, unlike it"), (4, "Les."), (None, "Les.")]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.line_deduplication(spark, docs, "").collect()}
    want = {1: "Les.\nfirst of the long lines here\n", 2: "Lex.\n\n  \nOf, edti oner.", 3: "  \nanother of long lines, unlike it", None: "Les."}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_stages_against_brute_force(spark, corpus):
    """Each stage on its own input, by comparing everything with everything."""
    import corpus_pipeline as p
    from test_operators import PlainModel, levenshtein, levenshtein_to_best, linked

    from docrows.llm.common import materialize

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages, outs = [f for _, f in p.STAGES], []
    for stage in stages:
        outs.append((docs, materialize(stage(spark, docs, corpus), "stage")))
        docs = outs[-1][1]
    rows = [([(r.doc_id, r.text, r.lang) for r in a.collect()], [(r.doc_id, r.text) for r in b.collect()]) for a, b in outs]

    start, kept = rows[0]  # the model's own numbers are compared in test_quality_against_plain_model
    model = PlainModel([t.encode() for i, t, _ in start if i is not None and i < 230 and zlib.crc32(str(i).encode()) % 4 != 3])
    worst = max(start, key=lambda r: -model.mean_log(r[1].encode()) if r[1] else float("-inf"))
    assert {i for i, _ in kept} == {i for i, _, _ in start} - {worst[0]} == {i for i, _, _ in start} - {302}

    start, kept = rows[1]
    flat = sorted((i, n, x) for i, t, _ in start if i is not None and t for n, x in enumerate(t.split("\n")))
    letters = lambda x: [x.count(c) for c in "abcdefghijklmnopqrstuvwxyz "]  # noqa: E731  an edit changes two at most
    seen, whole, gone = {}, set(), set()
    for i, n, x in flat:
        own, long = letters(x), len(x) >= 20
        other = (y for k in range(-2, 3) for y, c in seen.get(len(x) + k, ()) if sum(abs(p - q) for p, q in zip(own, c)) <= 4)
        if x.strip() and x in whole or long and any(levenshtein(x, y) <= 2 for y in other):
            gone.add((i, n))
        whole.add(x)
        if long:
            seen.setdefault(len(x), []).append((x, own))
    want = set()
    for i, t, _ in start:
        lines = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone] if t else []
        if t is None or len(lines) == len(t.split("\n")) or "".join(lines).strip():
            want.add((i, t if t is None else "\n".join(lines)))
    assert set(kept) == want

    start, kept = rows[2]
    _, find = linked([(i, t) for i, t, _ in start if i is not None], 5)
    assert {i for i, _ in kept} == {i for i, _, _ in start if i is None or find(i) == i}

    start, kept = rows[3]
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").first().text.split()
    def leaks(t):
        w = (t or "").lower().split()
        return any(levenshtein_to_best(item, w[k : k + 36]) <= 6 for k in range(max(len(w) - 23, 0)) if len(set(item) & set(w[k : k + 36])) >= len(set(item)) - 6)
    assert {i for i, _ in kept} == {i for i, t, _ in start if not leaks(t)}

    start, kept = rows[4]
    size, taken = {}, {}
    source = {(r.doc_id, r.text): r.source for r in outs[4][0].collect()}
    for i, t, _ in start:
        size[source[i, t]] = size.get(source[i, t], 0) + len((t or "").split())
    for i, t in kept:
        taken[source[i, t]] = taken.get(source[i, t], 0) + len((t or "").split())
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), (3, 1, 2, 3, 1)))
    target, open_, total = {}, set(size), 1.5 * sum(size.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} or {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    longest = max(len((t or "").split()) for _, t, _ in start)
    assert all(abs(taken.get(s, 0) - target[s]) <= longest for s in size) and max(kept.count(k) for k in kept) <= 2


def test_run(spark, corpus):
    import corpus_pipeline as p

    assert p.run(spark, corpus).count() > 240
