"""Operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import importlib
import itertools
import random
import re
import time

import pytest

from docrows.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, quality, substring_dedup
from docrows.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string, rows long, node long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, langs=None, sources=None):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], None, "x", "y", 1, 2, 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(rng):
    a, b = words(rng, 120), words(rng, 90)
    c = a[:]
    c[5] = "changed"
    return [
        (5, " ".join(a)), (3, " ".join(a)), (9, " ".join(c)), (4, None), (6, ""), (7, " \n\t "), (8, "one"), (10, " ".join(b) + "\n" + " ".join(a[20:90])),
        (11, " ".join(b)), (11, " ".join(b)), (12, "\n".join(" ".join(words(rng, 9)) for _ in range(300))), (None, " ".join(a)), (None, "alone here"), (13, "x " * 400),
    ]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = awkward(rng)
    for k in range(20, 60):
        base = words(rng, rng.choice([3, 30, 200]))
        out.append((k, " ".join(base)))
        if k % 3 == 0:
            near = [w if rng.random() > 0.03 else "new" for w in base]
            out.append((k + 100, " ".join(near)))
    return out


def test_exact_dedup(spark, texts):
    got = exact_dedup.exact_dedup(docs(spark, texts), slots=4).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(
        (str(i), str(k), len(groups[norm(t)]), i is not None and i == k, hashlib.sha256(norm(t).encode()).hexdigest())
        for i, t in texts for k in [min((x for x in groups[norm(t)] if x is not None), default=None)]
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_heavy_group_and_empty(spark):
    many = [(i, "same text" if i % 3 else f"t{i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(docs(spark, many).repartition(7), slots=3)
    assert got.where("kept").count() == 1001 and got.where("group_size = 2000 AND keep_id = 1").count() == 2000
    assert exact_dedup.exact_dedup(docs(spark, many).where("false")).count() == 0


def test_substring_dedup(spark, texts):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs(spark, texts)).collect())
    first, want = {}, []
    rows = [(i, WORD.findall(t or "")) for i, t in texts]
    rank = lambda i: float("inf") if i is None else i
    for i, w in rows:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, float("inf")), rank(i))
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < rank(i) for j in range(50)}
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert substring_dedup.substring_dedup(docs(spark, texts).where("false")).count() == 0


def test_substring_dedup_greedy(spark, monkeypatch):
    """A factor goes on in its reference although another one holds the next phrases first; later blocks use what earlier ones repeat."""
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(100)]
    rows = [(1, " ".join(a[60:200])), (2, " ".join(b + a)), (3, " ".join(b + a)), (4, " ".join(["x"] + a))]
    got = {r.doc_id: (r.n_removed, [tuple(f) for f in r.factors or []]) for r in substring_dedup.substring_dedup(docs(spark, rows).coalesce(1)).collect()}
    assert got[3] == (300, [(0, 300, 2, 0)]) and got[1] == (0, []) and got[2] == (140, [(160, 300, 1, 0)])
    assert got[4][0] == 200 and got[4][1][0] == (1, 201, 2, 100)
    monkeypatch.setattr(substring_dedup, "BLOCK", 3000)
    seen = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs(spark, rows * 3).coalesce(1)).collect()}
    assert seen == {1: 0, 2: 140, 3: 300, 4: 200}


def test_substring_dedup_long_text(spark):
    rng = random.Random(30)
    long = words(rng, 300_000, 10**6)  # over two megabytes
    rows = [(1, " ".join(long)), (2, " ".join(["q"] * 9 + long[1000:250_000])), (3, " ".join(long[5:60]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got == {1: (300_000, 0), 2: (249_009, 249_000), 3: (55, 55)}


def test_substring_dedup_across_factors(spark):
    """A passage whose halves stand in different documents is only removed as far as one document holds 50 words of it."""
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[30:] + b[:49])), (4, " ".join(a[30:] + b[:50]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50, 4: 99 + 1}


def linked(rows, k):
    """Sets of all documents, and the least id that each reaches, by comparing all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sets, find


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(spark, texts, k):
    rows = [(i, t) for i, t in texts if i is not None]
    sets, find = linked(rows, k)
    got = near_dedup.near_dedup(docs(spark, texts), shingle=k).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(s), find(i), i == find(i)) for i, s in sets.items()}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None) and len(got) == len(texts)


def test_near_dedup_large_group(spark):
    """Copies with a few changes each: one component, though a node holds far more of them than are compared exhaustively."""
    rng = random.Random(1)
    base = words(rng, 150)
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"n{rng.random()}" for w in base)) for i in range(400)]
    _, find = linked(rows, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs(spark, rows), shingle=2).collect()}
    assert sum(got[i] != find(i) for i, _ in rows) <= 2 and sum(find(i) == 0 for i, _ in rows) > 300
    assert near_dedup.near_dedup(docs(spark, rows).where("false")).count() == 0


def test_near_dedup_crowd(spark, monkeypatch):
    """Rows that resemble most of a group, linked with it or not, are compared in place and end where brute force puts them."""
    rng, seen = random.Random(12), []
    base = words(rng, 150)
    share = lambda i: 0.01 if i < 300 else 0.09 + 0.03 * rng.random()
    rows = [(i, " ".join(w if rng.random() > p else f"n{rng.random()}" for w in base)) for i in range(340) for p in [share(i)]]
    whole = near_dedup.crowd_pairs
    monkeypatch.setattr(near_dedup, "crowd_pairs", lambda *a: seen.append(1) or whole(*a))
    _, find = linked(rows, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs(spark, rows), shingle=2).collect()}
    assert seen and sum(got[i] != find(i) for i, _ in rows) <= 1 and sum(find(i) > 0 for i, _ in rows) > 5


def test_near_dedup_unsplit_nodes(spark, monkeypatch):
    """Groups whose rows agree in all tokens, and nodes too large for a task, give what brute force gives."""
    rng = random.Random(21)
    for k, v in (("MOST", 40), ("DEEPEST", 4), ("SMALL", 8), ("BLOCK", 30), ("PART", 3)):
        monkeypatch.setattr(near_dedup, k, v)
    base, rows = words(rng, 1200), []
    for i in range(150):  # a long text and a changed word or two: nearly all tokens are the same
        w = base[:]
        for _ in range(1 + (i % 2)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    edge = [w if rng.random() > 0.1 else f"m{k}" for k, w in enumerate(base)]
    rows += [(500 + k, " ".join(edge[: 1200 - 3 * k])) for k in range(4)]
    _, find = linked(rows, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs(spark, rows), shingle=2).collect()}
    assert got == {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("most", [500, 3])  # few links make a hub
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(importlib.import_module("docrows.llm.components"), "LINKS", most)
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (50, 50)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, **{k: 200 for k in range(200, 260)}}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(1), []
    for _ in range(1500):
        a = "".join(rng.choice("ab cñ") for _ in range(rng.randrange(3, 12)))
        b = a
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(b) + 1)
            b = rng.choice([b[:p] + "z" + b[p:], b[:p] + b[p + 1 :], b[:p] + "y" + b[p + 1 :]])
        a, b = sorted((a, b), key=len, reverse=True)
        if b and len(a) - len(b) <= 2:
            rows.append((a, b, min(levenshtein(a, b), 3)))
    got = spark.createDataFrame(rows, "a string, b string, d int").withColumn("x", F.least(line_dedup.banded_distance(F.col("a"), F.col("b"), 2), F.lit(3)))
    assert len(rows) > 1000 and got.where("x <> d").count() == 0


@pytest.mark.parametrize("part,block", [(1024, 8192), (4, 5)])  # small ones, so that groups are cut
def test_line_dedup(spark, monkeypatch, part, block):
    monkeypatch.setattr(line_dedup, "PART", part)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcde fg") for _ in range(rng.randrange(15, 40))) for _ in range(60)]
    family = "the same beginning of a line number %s and the same end of it"
    pool = lines + [family % k for k in range(30)] + ["ünïcode linê with ä tail %d" % k for k in range(3)]

    def change(x):
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(x) + 1)
            x = rng.choice([x[:p] + "z" + x[p:], x[:p] + x[p + 1 :], x[:p] + "y" + x[p + 1 :]])
        return x

    rows = [(i, "\n".join(change(rng.choice(pool)) for _ in range(rng.randrange(8)))) for i in rng.sample(range(1000), 80)]
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (None, pool[0]), (2003, "\n".join([pool[0]] * 5))]
    flat = sorted((i, n, x) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")) if len(x) >= 20)
    gone = {(i, n) for k, (i, n, x) in enumerate(flat) if any(abs(len(x) - len(y)) <= 2 and levenshtein(x, y) <= 2 for _, _, y in flat[:k])}
    for r in line_dedup.line_dedup(docs(spark, rows)).collect():
        t = dict(rows)[r.doc_id]
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (r.doc_id, n) not in gone)
        assert (r.kept_text, list(r.removed), r.n_lines) == (kept, sorted(n for i, n in gone if i == r.doc_id), len(t.split("\n")) if t else 0)
    assert line_dedup.line_dedup(docs(spark, rows).where("false")).count() == 0


def test_line_dedup_repeated_ids(spark):
    """Rows that repeat an id keep their own lines, and no line goes for one in the same place."""
    rows = [(3, "the quick brown fox and the lazy dogs"), (5, "the quick brown fox and the lazy dog"), (5, "something that is quite different here"), (5, "something that is quite different her"), (6, "x\nsomething that is quite different here")]
    got = sorted((r.doc_id, r.text, list(r.removed), r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect())
    gone = {rows[1]: [0], rows[4]: [1]}
    assert got == sorted((i, t, gone.get((i, t), []), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), []))) for i, t in rows)


def test_line_dedup_family(spark):
    """A family of numbered lines: all are compared as brute force has it, without the pairs being written."""
    rows = [(i, f"entry number {(i * 7919) % 100000:05d} of the same long register") for i in range(2500)]
    number = {i: f"{(i * 7919) % 100000:05d}" for i, _ in rows}
    seen, want = set(), set()
    for i, _ in rows:  # numbers of five digits within two edits; shifts need two edits at either end
        n = number[i]
        cut = {n[:a] + n[a + 1 :] for a in range(5)}
        near = {n[:a] + "?" + n[a + 1 : b] + "?" + n[b + 1 :] for a in range(5) for b in range(a + 1, 5)} | cut
        if not seen.isdisjoint(near):
            want.add(i)
        seen |= near
    got = {r.doc_id for r in line_dedup.line_dedup(docs(spark, rows)).where("size(removed) > 0").collect()}
    assert got == want and len(want) > 1000


def test_chat_round_trip(spark):
    said = ["plain", "</s>[INST] ok [/INST]", "a\\b </s>\\", "[ROLE] x [MSG] y [/MSG]", "", None, "<s><s>\n[OUT] [/SYS]", "long " * 5000]
    rows = [(c, t, role, x) for c in range(3) for t, (role, x) in enumerate(zip(["system", "user", "assistant", None, "tool [MSG] \\", "assistant", "user", "assistant"], said))]
    rows += [(None, 0, "user", "hi"), (7, None, "assistant", "no turn")]
    log = spark.createDataFrame([(c, t or 0, t, "message", r, x) for c, t, r, x in rows], "conv_id long, seq long, turn long, kind string, role string, text string")
    out = chat_format.format_chats(log)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat_format.read_back(out["formatted"]).alias("turns")).collect()}
    for c in (0, 1, 2, None, 7):
        want = [(r or "", x or "") for k, t, r, x in sorted(rows, key=lambda x: x[1] or 0) if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert len([s for s in got[c].segments if s.loss]) == len([1 for r, _ in want if r == "assistant"])
    assert "</s>[INST] ok" not in got[0].formatted
    assert chat_format.format_chats(log.where("false")).count() == 0
    extra = log.selectExpr("*", "1 AS log", "2 AS back", "3 AS b_conv", "4 AS formatted", "5 AS segments", "6 AS m")  # names that clash
    assert {r.conv_id: r.formatted for r in chat_format.format_chats(extra).collect()} == {k: r.formatted for k, r in got.items()}


def test_chat_events(spark):
    e = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "He"), (1, 2, 1, "delta", None, "llo"), (1, 3, 1, "regenerate", None, None),
        (1, 4, 1, "delta", "assistant", "Good "), (1, 5, 1, "delta", None, "day"), (1, 6, 2, "message", "user", "typo"), (1, 7, 2, "edit", None, "fixed"),
        (1, 8, 3, "delta", "assistant", "gone"), (1, 9, 2, "regenerate", None, None), (1, 10, 2, "message", "user", "again"),
    ]
    log = spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = sorted((r.turn, r.role, r.text) for r in chat_format.fold_events(log).collect())
    assert got == [(0, "user", "hi"), (1, "assistant", "Good day"), (2, "user", "again")]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60))) for i in range(600)] + [(None, "a b"), (700, None)]
    sources = [rng.choice(["a", "b", "c", "d", None]) for _ in rows]
    d = docs(spark, rows, sources=sources)
    mix = mixing.mix_sources(d, mixing.ranked_weights(d, (3, 1, 2))).collect()
    assert len(mix) == len(rows)
    assert sorted(map(str, mix)) == sorted(map(str, mixing.mix_sources(d.repartition(5), mixing.ranked_weights(d, (3, 1, 2))).collect()))
    size, taken, target = {}, {}, {}
    for r in mix:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.size * r.repeats <= 2 * r.size
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), itertools.cycle((3, 1, 2))))
    total, want, open_ = 1.5 * sum(size.values()), {}, set(size)
    while open_:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 30 for s in size)
    assert mixing.mix_sources(d.where("false"), mixing.ranked_weights(d.where("false"), (3, 1, 2))).count() == 0


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(15, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (0, "twice named but with other words in it")]
    items += [(7, items[7][1]), (7, items[7][1])]  # an item thrice
    rows, planted = [(1000, None), (1001, ""), (1002, "x")], set()
    for k in range(200):
        base = words(rng, rng.randrange(1, 200))
        if k % 2:
            i, t = items[rng.randrange(40)]
            w = t.split()
            kinds = rng.choice([[["new"], [], ["new", "old"]], [[]], [["new", "old"]]])  # any edits, or only words lost or put in
            for p in rng.sample(range(len(w)), rng.choice([0, 1, len(w) // 5])):
                w[p] = rng.choice([[x] if x == "new" else [x, w[p]] if x == "old" else [] for x in ("new", "old", "")]) if len(kinds) == 3 else ([] if kinds == [[]] else ["old", w[p]])
            w = [x for y in w for x in (y if isinstance(y, list) else [y])]
            p = rng.randrange(len(base) + 1)
            base[p:p] = w
        rows.append((k, " ".join(base).upper() if k % 7 == 0 else " ".join(base)))
    rows += [(3, dict(rows)[3])]
    for k, t in set(rows):
        w = (t or "").lower().split()
        for i, x in set(items):
            x = (x or "").split()
            e = len(x) // 5
            if len(x) >= 5 and len(set(x) & set(w)) >= len(set(x)) - e:
                if any(levenshtein_to_best(x, w[p : p + len(x) + e]) <= e for p in range(max(len(w) - len(x) + e + 1, 0))):
                    planted.add((k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()]
    got = set(found)
    assert got <= planted and len(got) >= 0.99 * len(planted) > 50
    assert all(found.count((k, i)) == (3 if i == 7 else 1) * (2 if k == 3 else 1) for k, i in got)
    assert decontaminate.find_leaks(docs(spark, rows).where("false"), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows), bench.where("false")).count() == 0


def levenshtein_to_best(a, b):
    """Edits from a to the nearest beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontaminate_lsh_recall():
    """The LSH on its own: signatures of windows with a fifth of their words edited agree with the item's in some repetition."""
    import numpy as np

    rng, hit, all_ = np.random.default_rng(4), 0, 400
    for k in range(all_):
        n = int(rng.integers(15, 60))
        item = rng.integers(1 << 10, 1 << 62, n + 20).astype(np.uint64)
        w = list(item[:n])
        for p in sorted(rng.choice(n, n // 5, replace=False), reverse=True):
            kind = rng.integers(3)
            w[p : p + 1] = [[], [np.uint64(rng.integers(1 << 62))], [np.uint64(rng.integers(1 << 62)), w[p]]][kind]
        w = np.array([*w, *item[n:]], np.uint64)[:n]
        both = [decontaminate.embed(x[None, :], np.array([n]), 5)[:, 0] for x in (item[:n], w)]
        hit += bool((both[0] == both[1]).any())
    assert hit >= 0.98 * all_


def test_decontaminate_wide_items(spark):
    """A very long item beside short ones, and a text that holds it."""
    rng = random.Random(18)
    wide = words(rng, 3000, 10**6)
    bench = spark.createDataFrame([(1, " ".join(wide)), (2, "five words are here now")], "item_id long, text string")
    copy = ["x"] * 50 + [w for k, w in enumerate(wide) if k % 10] + ["y"] * 50
    got = {(r.doc_id, r.item_id, r.start, r.edits) for r in decontaminate.find_leaks(docs(spark, [(1, " ".join(copy)), (2, "so five words are here now")]), bench).collect()}
    assert got == {(1, 1, 49, 300), (2, 2, 1, 0)}  # the x before the copy stands for the first word, which the copy lacks


def edited(rng, words_, n, where):
    """A copy with n edits of single words, all at one place or spread."""
    out, size = list(words_), len(words_)
    begin = {"start": 0, "middle": (size - n) // 2, "end": size - n}.get(where)
    places = rng.sample(range(size), n) if begin is None else range(begin, begin + n)
    for p in sorted(places, reverse=True):
        out[p : p + 1] = rng.choice([[], ["new"], ["new", out[p]]])
    return out


def test_decontaminate_recall_by_place(spark):
    """Copies with just under a fifth of their words edited are found wherever the edits lie, in items of 50 to 3000 words."""
    rng, items, rows = random.Random(19), [], []
    sizes = {50: 12, 120: 12, 300: 10, 500: 8, 1000: 5, 3000: 2}
    for n, copies in sizes.items():
        for where in ("start", "middle", "end", "spread"):
            for _ in range(copies):
                key = len(items)
                w = words(rng, n, 10**6)
                items.append((key, " ".join(w)))
                rows.append((key, " ".join(words(rng, 30) + edited(rng, w, n // 5 - 1, where) + words(rng, 30))))
                rows.append((10_000 + key, " ".join(words(rng, 30) + edited(rng, w, n // 5 + n // 8, "spread") + words(rng, 30))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows).repartition(8), bench).collect()}
    assert all(d == i or d == 10_000 + i for d, i in got)
    lost = [i for i, _ in items if (i, i) not in got]
    assert len(lost) <= 0.02 * len(items), [(len(items[i][1].split()), i) for i in lost]


def test_substring_dedup_splits_hot_addresses(spark, monkeypatch):
    """A footer shorter than a window, in every document among other words, is no task's alone, and all that repeats is still found."""
    import collections
    import functools

    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "SAMPLED", 2)
    monkeypatch.setattr(substring_dedup, "HOT", 200)
    rng = random.Random(21)
    footer, passage = words(rng, 45), words(rng, 70)
    rows = [(k, " ".join(words(rng, 60, 10**6) + footer + words(rng, 60, 10**6) + (passage if k % 9 == 0 else []))) for k in range(2000)]
    rows += [(5000 + k, rows[k][1]) for k in range(0, 40, 7)]
    d = docs(spark, rows).repartition(6)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(d).collect()}
    first = {}
    for i, t in sorted(rows):
        w = t.split()
        gone = set()
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) < i:
                gone |= set(range(p, p + 50))
        assert got[i] == (len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    table = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "fp": [i for i, _ in rows], "text": [t for _, t in rows]})]
    hot = substring_dedup.hot_addresses(d.select(d.doc_id, fingerprint(d), d.text), 50)
    assert len(hot) >= 1

    def largest(hot):
        many = collections.Counter()
        for b in functools.partial(substring_dedup._send, window=50, hot=hot)(iter(table)):
            for a, p in zip(b.column("address").to_pylist(), b.column("phrases").to_pylist()):
                many[a] += len(p or b"") // 8
        return max(many.values()), sum(many.values())

    assert largest(hot[:0])[0] > 0.05 * largest(hot[:0])[1]
    assert largest(hot)[0] < 0.005 * largest(hot)[1]


def fingerprint(d):
    from pyspark.sql import functions as F

    return F.xxhash64(d.text).alias("fp")


def test_best_window():
    rng = random.Random(20)
    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 8))], [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        most = rng.randrange(4)
        all_ = [(levenshtein_to_best(a, b[p:]), p) for p in range(len(b))]
        want = min(all_, default=(99, 0))
        got = decontaminate.best_window(a, b, most)
        assert got == (want if want[0] <= most and want[0] < len(a) else got) and (got is None) == (want[0] > most or not b), (a, b, most)
        assert decontaminate.edit_distance(a, b) == decontaminate.edit_distance(b, a)


def test_html():
    page = (
        '<html><head><title>T</title><script>var x="<p>no</p>"</script></head><body><nav><a>Menu</a></nav><div class="cookie-notice">We use cookies, and more of them.</div>'
        "<article><h1>Head &amp; title</h1><p>First <b>bold</b> text,   with\nlines.<br>After a break.<p>Second paragraph &lt;here&gt;.</article>"
        '<aside>Side, bar.</aside><div id="comments"><p>A reader says something, at length. And more.</p></div><form>Name</form><footer>&copy; 2024, us.</footer></body></html>'
    )
    assert html_extract.main_text(page) == "Head & title First bold text, with lines. After a break. Second paragraph <here>."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("<div><p>Only this text, no more.</p></div>") == "Only this text, no more."
    assert html_extract.main_text("< <b <!-- x") is not None
    assert html_extract.main_text("<div>" * 2000 + "deep text." + "</div>" * 2000) == "deep text."


@pytest.mark.parametrize("wrapper", ['div class="content with-sidebar"', 'div id="page" class="no-sidebar"', 'div class="wrapper header-fixed"', 'form id="f"'])
def test_html_wrapper(wrapper):
    """An element around the article is no furniture, whatever its class says; what is inside it can be."""
    page = f'<body><div class="cookie">Cookies.</div><{wrapper}><p>A first text, of some length.</p><p>A second one, no shorter.</p><div class="sidebar">Side.</div></{wrapper.split()[0]}></body>'
    assert html_extract.main_text(page) == "A first text, of some length. A second one, no shorter."


PROSE = "This is a fairly long sentence, with some commas, and it says a thing. Another one follows it, no shorter than the first. "


@pytest.mark.parametrize("name", ["related-work", "content share-wide"])
def test_html_misleading_names(name):
    assert html_extract.main_text(f'<div class="{name}">{f"<p>{PROSE}</p>" * 4}</div>') == " ".join([PROSE.strip()] * 4)


def test_html_paths_choose():
    """Without names that say so: a list of links goes, a short table in the content and an introduction beside it stay."""
    links = "".join(f"<div><a href=/{k}>Section {k}</a></div>" for k in range(8))
    page = f"<body>{links}<div><p>{PROSE}</p></div><section><h2>Head</h2>{f'<p>{PROSE}{PROSE}</p>' * 5}<table><tr><td>1<td>2</table></section></body>"
    assert html_extract.main_text(page) == " ".join([PROSE.strip(), "Head"] + [(PROSE + PROSE).strip()] * 5 + ["1", "2"])


@pytest.mark.parametrize("piece", ["<a ", "<div>x. ", "<a '>'", "<div><b>x", "&amp;<p", "<form class=ad><p>a, b.", "<!--", "</p><li>"])
def test_html_linear(piece):
    """A megabyte of it takes little time."""
    began = time.process_time()
    html_extract.main_text(piece * ((1 << 20) // len(piece)))
    assert time.process_time() - began < 8  # about a second; reading again and again would take hours


def plain_scores(page):
    """Scores by the definition, with each path, element and sum written out anew for each block."""
    t = html_extract.Tree(page)
    blocks = html_extract.blocks_of(t)

    def chain(e):
        return [] if e < 0 else [*chain(t.parent[e]), e]

    size = lambda bs: sum(len(b[2]) for b in bs)
    under = lambda e: [b for b in blocks if e in chain(b[0])]
    art = [b for b in blocks if t.article[b[0]]]

    def furniture(e):
        inner = [b for b in under(e) if b in art]
        return t.named[e] and (t.article[t.parent[e]] or size(under(e)) < size(blocks) / 2 or size(inner) < size(art))

    out = []
    for b in blocks:
        same = [x for x in blocks if x[1] == b[1]]
        own = size(same) / len(same) * (1 + sum(len(re.findall("[.,;:!?…。，！？]", x[2])) for x in same) / len(same))
        free = 1 - sum(x[3] for x in same) / sum(len(x[2].replace(" ", "")) for x in same)
        out.append((own, free, html_extract.NAMED_WEIGHT if any(furniture(e) for e in chain(b[0])) else 1.0))
    ratio = [a * f * w for a, f, w in out]
    mean = sum(r * len(b[2]) for r, b in zip(ratio, blocks)) / size(blocks)
    core = [b for b, r in zip(blocks, ratio) if r >= mean * html_extract.CORE]
    if size([b for b in core if b in art]) >= size(core) / 2:
        inside, in_article = art, True
    else:
        roots = [e for e in range(len(t.parent)) if size([b for b in under(e) if b in core]) >= html_extract.HELD * size(core) and t.tag[e] not in ("p", "li", "td", "th", "tr", "h1", "pre", "blockquote")]
        inside, in_article = under(max(roots)), False
    got = []
    for k, b in enumerate(blocks):
        near = []
        for x, i in [(x, i) for i, x in enumerate(blocks) if x[1] == b[1]]:
            around = [(out[j][0], w) for j, w in ((i - 1, 1), (i, 2), (i + 1, 1)) if 0 <= j < len(blocks)]
            near.append(sum(v * w for v, w in around) / sum(w for _, w in around))
        if b in inside:
            got.append(max(sum(near) / len(near), mean) * (1 if in_article else out[k][1]) * out[k][2])
        else:
            got.append(ratio[k])
    return got, mean * html_extract.LEAST


def test_html_scores_against_plain_version():
    rng = random.Random(31)
    tags = ["div", "p", "section", "li", "ul", "article", "td", "h1", 'div class="ad"', 'div id="comments"', "form", "b", "a href=x"]

    def grow(depth):
        if depth == 0 or rng.random() < 0.25:
            return rng.choice(["short", PROSE, "a, b.", "words without any mark at all", ""])
        tag = rng.choice(tags)
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{tag.split()[0]}>"

    for _ in range(60):
        page = "<body>" + "".join(grow(4) for _ in range(3)) + "</body>"
        t = html_extract.Tree(page)
        blocks = html_extract.blocks_of(t)
        if blocks:
            score, least = html_extract.scores(t, blocks)
            want, bound = plain_scores(page)
            assert score.tolist() == pytest.approx(want) and least == pytest.approx(bound)


def test_html_query(spark):
    rows = [(1, "u", "<article><p>A text, here.</p></article>", "x", 7), (2, None, None, "x", 7), (2, None, None, "x", 7), (None, "v", "", "x", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")  # names that clash
    got = sorted(map(str, ((r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(pages).collect())))
    assert html_extract.extract_main_text(pages.where("false")).count() == 0
    assert got == sorted(map(str, [(1, "A text, here.", 13), (2, "", 0), (2, "", 0), (None, "", 0)]))


def test_language_id(spark, monkeypatch):
    rng = random.Random(4)
    sounds = {"aa": "ba be bi bo bu".split(), "bb": "kra kre kri kro".split(), "cc": "ñu ñe ña lo".split()}
    make = lambda l: " ".join("".join(rng.choice(sounds[l]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(i, make(list(sounds)[i % 3])) for i in range(300)]
    d = docs(spark, rows, langs=[list(sounds)[i % 3] for i, _ in rows])
    from pyspark.sql import functions as F

    held = language_id.held_out(F.col("doc_id"))
    p = language_id.learn_profiles(d, ~held)
    got = language_id.identify_language(d, p).withColumn("held", held).collect()
    apart = [r for r in got if r.held]  # never learned from
    assert len(apart) > 50 and sum(r.lang_pred == list(sounds)[r.doc_id % 3] for r in apart) >= 0.98 * len(apart)
    assert all(0 <= r.score <= 1 for r in got)
    odd = [(1, None), (2, "12 !?"), (3, ""), (4, "ba " * 400_000), (4, "ba " * 400_000)]
    found = language_id.identify_language(docs(spark, odd), p).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in found) == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa")] and all(r.score == 0 for r in found if r.doc_id < 4)
    assert language_id.identify_language(d, p.where("false")).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.identify_language(d.where("false"), p).count() == 0
    monkeypatch.setattr(language_id, "LANGUAGES", 2)  # two blocks give the same answers
    again = language_id.identify_language(d, language_id.learn_profiles(d, ~held)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in again) == sorted((r.doc_id, r.lang_pred, r.score) for r in got)
    same = spark.createDataFrame([(x, v) for v in p.where("lang = 'aa'").select("v").first() for x in ("zz", "aa", "mm")], p.schema)
    assert {r.lang_pred for r in language_id.identify_language(docs(spark, [(1, "ba be"), (2, "bi")]), same).collect()} == {"aa"}  # a tie


def test_language_id_against_plain_model(spark):
    """Trigram by trigram, with dicts; scores equal to the last bit, however the rows are dealt."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(24)
    sounds = {"aa": "ba be Bi bo", "bb": "kra kre kri", "cc": "ñu ña lo ß"}
    make = lambda lang: "".join(rng.choice(sounds[lang].split()) + rng.choice(["", " ", " ", ". ", "1", "\n"]) for _ in range(rng.randrange(1, 60)))
    rows = [(k, make(lang), lang) for k in range(240) for lang in [rng.choice(list(sounds))]]
    rows += [(1000, "12 !?", "aa"), (1001, None, "bb"), (1002, "", None), (1003, "Ǆ x", None), (1004, "bakra " * 30, None), (1004, "bakra " * 30, None)]
    basis = {}

    def vector(c):
        if c not in basis:
            basis[c] = language_id.letter_vectors(np.array([ord(c)]), language_id.DIMENSIONS)[0].astype(np.int64)
        return basis[c]

    def bundle(text):
        low = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        x, total = f" {low} ", np.zeros(language_id.DIMENSIONS, np.int64)
        for a, b, c in zip(x, x[1:], x[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return total, bool(low)

    learned = {lang: sum(bundle(t)[0] for k, t, x in rows if x == lang and k % 3) for lang in sounds}
    proto = {lang: np.rint(v / np.linalg.norm(v) * 2**20) for lang, v in learned.items()}

    def plain(text):
        v, has = bundle(text)
        cos = {lang: float(v @ m) / np.sqrt(m @ m) / max(np.sqrt(float(v @ v)), 1) for lang, m in proto.items()}
        best = max(sorted(cos), key=cos.get)
        return (best, min(max(cos[best], 0.0), 1.0)) if has else ("und", 0.0)

    d = docs(spark, [r[:2] for r in rows], langs=[r[2] for r in rows])
    profiles = language_id.learn_profiles(d, F.col("doc_id") % 3 != 0)
    want = sorted((k, *plain(t)) for k, t, _ in rows)
    for dealt in (d.repartition(1), d.repartition(7), d.orderBy(F.desc("doc_id"))):
        assert sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify_language(dealt, profiles).collect()) == want


def test_quality(spark, monkeypatch):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "rain", "falls", "on", "hills", "and", "runs", "down", "again"]) for _ in range(rng.randrange(5, 80)))
    bad = lambda: "".join(rng.choice("%$#@!?XQZ0123 ") for _ in range(300))
    rows = [(i, bad() if i % 10 == 0 else good()) for i in range(500)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    whole = {r.doc_id: r for r in quality.classify(docs(spark, rows), labels).collect()}
    assert {i for i, r in whole.items() if r.rejected} == {i for i in range(0, 500, 10)}
    assert whole[900].perplexity is None and not whole[900].rejected and not whole[901].rejected
    monkeypatch.setattr(quality, "SHARD", 300)  # many shards give the same scores
    many = quality.classify(docs(spark, rows), labels)
    assert len(quality.shard_files(quality.train(docs(spark, [(i, good()) for i in range(200)]).select("text")))[1]) >= 3
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one worker for each task
    parts = {r.doc_id: r for r in many.collect()}
    apart = {i: (r.perplexity, parts[i].perplexity) for i, r in whole.items() if r.perplexity and parts[i].perplexity != pytest.approx(r.perplexity)}
    assert apart == {}
    assert quality.classify(docs(spark, rows), labels.where("false")).where("rejected").count() == 0
    assert quality.classify(docs(spark, rows).where("false"), labels).count() == 0


class PlainModel:
    """The n-gram model by its definition, with dicts: counts, continuation counts, discounts, interpolation."""

    def __init__(self, texts):
        from collections import Counter, defaultdict

        counts = {5: Counter(self.grams(t)[i] for t in texts for i in range(len(t)))}
        for k in (4, 3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.p, self.left = {0: {b"": 1 / 256}}, {}
        for k in range(1, 6):
            n1, n2, n3, n4 = (sum(1 for n in counts[k].values() if n == i) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0
            off = [min(max(i - (i + 1) * y * b / a, 0.1), i) if a and n1 else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            total, freed = defaultdict(int), defaultdict(float)
            for g, n in counts[k].items():
                total[g[:-1]] += n
                freed[g[:-1]] += off[min(n, 3) - 1]
            self.left[k - 1] = {c: freed[c] / total[c] for c in total}
            self.p[k] = {g: (n - off[min(n, 3) - 1]) / total[g[:-1]] + self.left[k - 1][g[:-1]] * (self.p[k - 1][g[1:]] if k > 1 else 1 / 256) for g, n in counts[k].items()}

    @staticmethod
    def grams(t):
        return [(b"\0" * 4 + t)[i : i + 5] for i in range(len(t))]

    def mean_log(self, t):
        import math

        total = 0.0
        for g in self.grams(t):
            for k in (5, 4, 3, 2, 1, 0):
                x = g[5 - k :]
                if x in self.p[k] or k == 0:
                    total += math.log(self.p[k][x] if k else 1 / 256)
                    break
                total += math.log(self.left[k - 1].get(x[:-1], 1.0))
        return total / len(t)


@pytest.mark.parametrize("shard", [None, 4000])
def test_quality_against_plain_model(spark, monkeypatch, shard):
    """Perplexities and limits by language, one with a limit of its own and one that shares that of all; repeated rows, a very long text."""
    import math
    import zlib

    if shard:
        monkeypatch.setattr(quality, "SHARD", shard)
    rng = random.Random(23)
    sound = {"aa": "ka lo mi ra ten sul".split(), "bb": "ñu ör est vin".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make("bb" if i % 12 == 0 else "aa", rng.randrange(3, 25)), "bb" if i % 12 == 0 else "aa") for i in range(700)]
    rows += [(1000, "!?%$ 0123 " * 30, "aa"), (1001, make("aa", 40), None), (1002, "x" * 300, "bb"), (1003, make("aa", 12000), "aa"), (5, rows[5][1], "aa"), (1004, None, "aa")]
    trusted = set(range(600))
    aside = lambda i: zlib.crc32(str(i).encode()) % 4 == 3
    model = PlainModel([t.encode() for i, t, _ in rows if i in trusted and not aside(i)])
    log = {t: model.mean_log(t.encode()) for _, t, _ in rows if t and len(t) < 5000}
    held = [(lang, log[t], len(t.encode())) for i, t, lang in rows if i in trusted and aside(i)]
    mean = lambda some: sum(x * n for _, x, n in some) / sum(n for _, _, n in some)
    of = {lang: [h for h in held if h[0] == lang] for lang in ("aa", "bb")}
    assert len(of["aa"]) >= 100 and len(of["bb"]) < 50
    drawn = lambda n, x, y: (n * x + quality.STEADY_ROWS * y) / (n + quality.STEADY_ROWS)
    own = {lang: drawn(len(some), mean(some), mean(held)) for lang, some in of.items()}
    log_ppl = lambda lang, x, n: -(x * n + own.get(lang, mean(held)) * 300) / (n + 300)
    ppl = lambda *h: math.exp(log_ppl(*h))
    at = lambda some: sorted(log_ppl(*h) + own[h[0]] for h in some)[math.ceil(0.995 * len(some)) - 1]
    margin = lambda n: quality.MARGIN / math.sqrt(n + quality.STEADY_ROWS)
    limit = {lang: math.exp(-own[lang] + drawn(len(some), at(some), at(held)) + margin(len(some))) for lang, some in of.items()}
    every = math.exp(-mean(held) + at(held) + margin(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, [r[:2] for r in rows], langs=[r[2] for r in rows]), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text and len(r.text) < 5000:
            want = ppl(r.lang, log[r.text], len(r.text.encode()))
            assert r.perplexity == pytest.approx(want, rel=1e-6) and r.limit == pytest.approx(limit.get(r.lang, every), rel=1e-6) and r.rejected == (r.perplexity > r.limit)
    assert {r.doc_id for r in got if r.rejected} >= {1000, 1002} and not any(r.rejected for r in got if r.doc_id in (1003, 1004))


def test_quality_limit_is_the_quantile(spark):
    """The limit is hardly over the quantile of the rows kept aside, so that junk of repeated words just above it is rejected."""
    import math

    from pyspark.sql import functions as F

    rng = random.Random(16)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ra", "ten", "sul"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randrange(30, 120)))) for i in range(700)]
    junk = [(1000 + k, " ".join(text(120 - k) + ["Der"] * k)) for k in range(0, 121)]  # more and more of it one word
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows + junk), labels).withColumn("aside", quality.calibration(F.col("doc_id"))).collect()
    held = sorted(r.perplexity for r in got if r.aside and r.doc_id < 1000)
    limit = got[0].limit
    assert len(held) >= 100 and any(limit == pytest.approx(x * math.exp(quality.MARGIN / math.sqrt(len(held) + quality.STEADY_ROWS))) for x in held) and limit < 1.02 * held[-1]
    above = {r.doc_id for r in got if r.perplexity > limit}
    close = {r.doc_id for r in got if r.doc_id >= 1000 and limit < r.perplexity < 1.1 * limit}
    assert {r.doc_id for r in got if r.rejected} == above and len(close) > 2 and {1000 + k for k in range(90, 121)} <= above


def test_model_sums_to_one(spark):
    from docrows.llm.common import Texts

    import numpy as np
    import pyarrow as pa

    text = spark.createDataFrame([("abracadabra and more",), ("abrasive cadavers",), (None,)], "text string")
    begins, names = quality.shard_files(quality.train(text))
    assert begins == [0] and len(names) == 1
    shard = quality.read_shard(names[0])
    for context in (b"abra", b"xyzq", b"\0\0ab"):
        base = 0
        for b in context:
            base = base << 8 | b
        codes = (np.uint64(base) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp(shard.score(codes)).sum() == pytest.approx(1)
    assert quality.grams(Texts(pa.array(["ab", None, "c"])))[2].tolist() == [2, 0, 1]
