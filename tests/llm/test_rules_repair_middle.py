"""Quality rules, conversation repair and fill-in-middle against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docrows.llm import conversation_repair, fill_middle, quality_rules
from tests.llm.test_operators import docs

SPACE, UNIT = r"[\x20\x09-\x0D]", re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_texts(rng, n=200):
    """Texts of few kinds of characters, so that edges, sentinels and repeats are frequent."""
    kinds = ["a", "b.", " ", "\n", "\t", " ", "é", "漢", "😀", "<P>", "<", "P>", "<S", "<M>", "\x0b", "- ", "…", "#"]
    out = [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "<<P>", "<P", "é" * 1500, "<" * 1030 + "P>", "ab " * 4000 + "\n"]
    return out + ["".join(rng.choice(kinds[: rng.choice([6, 9, 18])]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def fim_plain(doc_id, text, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), sentinels[1] + s + sentinels[0] + p + sentinels[2] + m
    return n, "psm", len(p), len(m), sentinels[0] + p + sentinels[1] + s + sentinels[2] + m


def test_fill_in_middle(spark, monkeypatch):
    rows = list(enumerate(odd_texts(random.Random(1)))) + [(7, "one more"), (7, "one more"), (None, "no id at all"), (10**12, " a  b ")]
    d = docs(spark, rows)
    for lane in (fill_middle.LANE, 3):
        monkeypatch.setattr(fill_middle, "LANE", lane)
        got = fill_middle.fill_in_middle(d).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
        want = [(str(i), *fim_plain(i, t), t or "") for i, t in rows]
        assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(d.where("false")).count() == 0


def test_fill_in_middle_other_sentinels(spark):
    marks = ("[PRE]", "[SUF]", "[MID]")
    rows = [(i, t) for i, t in enumerate(["a [PRE] b", "[PRE", "[[SUF]", "x y z", "<P> q", "[MI D]"] * 30)]
    got = fill_middle.fill_in_middle(docs(spark, rows), sentinels=marks).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    assert sorted((r.doc_id, r.form, r.output, r.back) for r in got) == sorted((i, (w := fim_plain(i, t, marks))[1], w[4], t) for i, t in rows)
    with pytest.raises(AssertionError):
        fill_middle.fill_in_middle(docs(spark, rows), sentinels=("<a<b>", "<c>", "<d>"))


def test_automaton_counts_are_those_of_the_pattern():
    table, marks = fill_middle.automaton(("<P>", "<S>", "<M>"))
    import numpy as np

    for text in odd_texts(random.Random(2), 300):
        raw = (text or "").encode()
        found = fill_middle.scan(np.frombuffer(raw, np.uint8), table, marks, 3)
        units = UNIT.findall(text or "")
        starts = [len("".join(units[:k]).encode()) for k in range(len(units))]
        assert np.flatnonzero(found & fill_middle.UNIT).tolist() == starts
        assert int((found & fill_middle.CODE_POINT).sum()) == len(text or "")
        assert bool((found & fill_middle.SENTINEL).any()) == bool(re.search("<[PSM]>", text or ""))


def measured_plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    strip = " \t\n\x0b\x0c\r"
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_bullet_lines": sum(x.lstrip(strip)[0] in "-*•‣" for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(strip).endswith(("...", "…")) for x in lines), "n_letters": len(re.findall("[A-Za-z]", text)),
        "n_capitals": len(re.findall("[A-Z]", text)), "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w),
    }


def failed_plain(m):
    n = m["n_words"]
    fails = [
        n < 50, m["n_repeat_words"] > n / 2, not 3 * n <= m["word_chars"] <= 10 * n, m["n_symbols"] > n / 10, 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        100 * m["n_bullet_lines"] > 90 * m["n_lines"], 100 * m["n_ellipsis_lines"] > 30 * m["n_lines"], 100 * m["n_capitals"] > 30 * m["n_letters"],
        100 * m["n_letter_words"] < 80 * n, n > 100_000,
    ]
    return sum(1 << k for k, f in enumerate(fails) if f)


def ruled_texts(rng):
    prose = lambda n: " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    more = [prose(60), prose(60).upper(), "\n".join("- " + prose(8) for _ in range(9)), "\n".join(prose(9) + "..." for _ in range(9)), "\n".join(prose(9) + "…\t" for _ in range(9)),
            "\n".join([prose(12)] * 9 + [prose(40)]), " ".join(x + "$$" for x in prose(70).split()), "12 34 " * 40 + prose(20), "one two three four " * 30, prose(55) + " ... * • ‣", "..", "\n...", "x\n ...\n....", "word " * 100_001, "...\n\n…", "•", "\n•\n‣ x\n-", "aé " * 3]
    return odd_texts(rng) + more


def test_quality_ledger(spark):
    texts = ruled_texts(random.Random(3))
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[-1])]
    want = []
    for i, t in rows:
        m = measured_plain(t) if t != "word " * 100_001 else dict(n_words=100_001, word_chars=400_004, n_symbols=0, n_dup_lines=0, n_repeat_words=100_001, n_lines=1, n_bullet_lines=0, n_ellipsis_lines=0, n_letters=400_004, n_capitals=0, n_letter_words=100_001)
        want.append((str(i), *m.values(), failed_plain(m)))
    ledger = quality_rules.quality_ledger(docs(spark, rows))
    got = [(str(r.doc_id), *(r[m] for m in quality_rules.MEASURES), r.failed) for r in ledger.collect()]
    assert sorted(got) == sorted(want)
    assert len({x[-1] for x in want}) > 8 and {k for k in range(10) if any(x[-1] >> k & 1 for x in want)} == set(range(10))  # each rule fails somewhere
    for version, policy in quality_rules.POLICIES.items():
        rules = [n for n, _ in quality_rules.RULES]
        bits = lambda f: {r for k, r in enumerate(rules) if f >> k & 1}
        keeps = lambda f, p=policy: not bits(f) & set(p.must) and len(bits(f) & set(p.may)) <= p.most
        applied = quality_rules.apply_policy(ledger, policy).collect()
        assert all(r.kept == keeps(r.failed) and r.base_failed == bool(bits(r.failed) & set(quality_rules.BASE)) and r.policy == version for r in applied)
        report = {r["rule"]: r for r in quality_rules.ablations(ledger, [policy]).collect()}
        assert set(report) == set(policy.must + policy.may)
        for rule, r in report.items():
            masks = [x[-1] for x in want]
            without = [f & ~quality_rules.BIT[rule] for f in masks]
            assert (r.n_docs, r.n_kept, r.n_failed) == (len(masks), sum(map(keeps, masks)), sum(rule in bits(f) for f in masks))
            assert r.n_only == sum(keeps(b) and not keeps(a) for a, b in zip(masks, without))
    empty = quality_rules.quality_ledger(docs(spark, rows).where("false"))
    assert empty.count() == 0 and quality_rules.ablations(empty, list(quality_rules.POLICIES.values())).count() == 0
    whole = quality_rules.failure_profile(ledger, []).first()
    assert whole.any_failed == 1023 and whole.all_failed == 0 and whole.n_docs == len(rows)


LEGAL = re.compile("(s?(ua)+)?")


def faults_plain(rows):
    """Blank, duplicate or truncated for each of a conversation's rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    return out


def repairs_plain(rows):
    """(cost, letters, repaired) of the best edits: the least pair for each row and each form of what stands so far, which is told by its last letters."""
    best = {"": (0, "", ())}
    fault = faults_plain(rows)

    def put(at, key, value):
        if key not in at or value[:2] < at[key][:2]:
            at[key] = value

    def turn(form, initial):
        """What the roles so far look like with one more, if they can still be completed."""
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((form, initial))

    def inserted(at):
        for _ in range(3):
            for form, (c, l, r) in list(at.items()):
                for role in ("user", "assistant"):
                    if (f := turn(form, role[0])) is not None:
                        put(at, f, (c + 5, l + "I", (*r, (role, ""))))
        return at

    for (role, text), why in zip(rows, fault):
        then = {}
        for form, (c, l, r) in inserted(best).items():
            put(then, form, (c + 2, l + "D", r))
            if why not in ("blank", "duplicate"):
                more = 5 * (why == "truncated")
                if (f := turn(form, role[:1])) is not None:
                    put(then, f, (c + more, l + "K", (*r, (role, text))))
                for to in ("user", "assistant"):
                    if (f := turn(form, to[0])) is not None:
                        put(then, f, (c + 1 + more, l + "R", (*r, (to, text))))
        best = then
    return min(v for f, v in inserted(best).items() if f in ("", "a"))


def repairs_exhaustive(rows):
    """All edits with at most two insertions in a row, each judged by the pattern itself."""
    fault, best = faults_plain(rows), None
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(("D", "K", "Ru", "Ra"), repeat=len(rows)):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, fault)):
                continue
            letters, roles, cost = "I" * len(inserts[0]), [r[0] for r in inserts[0]], 5 * sum(map(len, inserts))
            for e, f, (role, _), more in zip(edits, fault, rows, inserts[1:]):
                letters += e[0] + "I" * len(more)
                cost += {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * (e != "D" and f == "truncated")
                roles += ([] if e == "D" else [role[:1] if e == "K" else e[1]]) + [r[0] for r in more]
            if LEGAL.fullmatch("".join(roles)) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def test_repair_plain_is_exhaustive():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", " ", "c!"])) for _ in range(rng.randrange(3))]
        assert repairs_plain(rows)[:2] == repairs_exhaustive(rows), rows


def conversations(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            at = rng.choice([turn, turn, turn, turn + 1, None])
            rows.append((conv, at, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]), rng.choice([None, "", " \n", "cut", "so.", "so.", "what?\n "] + [f"text {rng.random()}."] * 4)))
    return rows + [(7, 3, "user", "so.")] * 5 + [(8, None, "assistant", "again.")] * 12 + [(1000 + k, 0, "user", "x.") for k in range(60)]


@pytest.mark.parametrize("block", [conversation_repair.BLOCK, 4])
def test_repair_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    raw = conversations(random.Random(9), 60)
    schema = "conv_id long, turn long, role string, text string, block int, edits string, r int, place string"  # names that clash
    d = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in raw], schema)
    got = {}
    done = conversation_repair.repair_conversations(conversation_repair.damage(d), F.col("copies"))
    for r in sorted(done.collect(), key=lambda r: r.block):
        got.setdefault(r.conv_id, []).append(r)
    assert any(len(v) > 2 for v in got.values()) == (block == 4)
    space = lambda x: " " if x is None else x
    convs = {c: [] for c, *_ in raw}
    for conv, turn, role, text in raw:
        how = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        row = (turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        convs[conv] += [row] * {0: 0, 3: 2}.get(how, 1)
    assert set(got) == set(convs) and any(not v for v in convs.values())
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, *_ in rows if t is not None]
        said = [r[1:] for r in rows]
        fault = faults_plain(said)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, letters, repaired = repairs_plain(said)
        mine = got[conv]
        assert [r.block for r in mine] == list(range(len(mine))) and {r.blocks for r in mine} == {len(mine)}
        assert {r.gaps for r in mine} == {max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0} and {r.cost for r in mine} == {cost}
        assert [sum(getattr(r, f) for r in mine) for f in ("blank", "duplicate", "truncated")] == [fault.count(f) for f in ("blank", "duplicate", "truncated")]
        assert sum(r.illegal for r in mine) == sum(p not in ("su", "ua", "au") for p in pairs)
        edits = [e for r in mine for e in r.edits]
        assert "".join(e.edit for e in edits) == letters, (conv, said)
        assert [(e.role, e.text) for e in edits if e.edit != "D"] == list(repaired)
        assert LEGAL.fullmatch("".join(e.role[0] for e in edits if e.edit != "D"))
    assert conversation_repair.repair_conversations(d.where("false")).count() == 0


def test_repair_digest_of_blocks_equals_that_of_the_whole(spark, monkeypatch, tmp_path):
    from docrows.llm.queries import op12_conversation_repair

    rows = conversations(random.Random(10), 30)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = sorted(map(str, op12_conversation_repair(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(conversation_repair, "BLOCK", 3)
    assert sorted(map(str, op12_conversation_repair(spark, str(tmp_path)).collect())) == whole
