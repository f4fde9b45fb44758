"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontaminate, exact_dedup, fill_middle, html_extract, language_id, line_dedup, mixing, near_dedup, quality, quality_rules, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mix_sources(docs, mixing.ranked_weights(docs, (3, 1, 2)), budget_share=1.5, max_epochs=2.0)
    return mix.select("doc_id", "source", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(2.0 * source_size) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
                / sum(w) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(2.0 * source_size, w * (SELECT coalesce(min_by(level, ratio), 1e300) FROM l WHERE level <= ratio)) AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0) AS extra,
             sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, round(target, 4) AS target,
       (size * (whole + CASE WHEN extra > 0 AND upto - size / 2.0 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"), short_exact=True)
    return out.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS w, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, unnest(range(0, len(w))) AS n, unnest(w) AS line FROM s),
k AS (SELECT * FROM o WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, length(line) AS l, min({'d': doc_id, 'n': n}) AS first FROM k GROUP BY line),
p AS (SELECT a.line, min(b.first) AS first FROM d a JOIN d b ON b.l BETWEEN a.l - 2 AND a.l + 2 AND a.line <> b.line
      WHERE least(a.l, b.l) >= 20 AND levenshtein(a.line, b.line) <= 2 GROUP BY a.line),
f AS (SELECT d.line, least(d.first, coalesce(p.first, d.first)) AS first FROM d LEFT JOIN p ON d.line = p.line),
r AS (SELECT k.doc_id, list(k.n) AS gone FROM k JOIN f ON k.line = f.line WHERE f.first < {'d': k.doc_id, 'n': k.n} GROUP BY k.doc_id)
SELECT s.doc_id, (CASE WHEN text = '' THEN 0 ELSE len(w) END)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i - 1)), chr(10)), '') END) AS kept_sha256
FROM s LEFT JOIN r ON s.doc_id = r.doc_id
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM h),
r AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM g WHERE m < doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    place = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))  # rows that share a turn are turns of their own
    log = rows.unionByName(fixed).select(
        "conv_id", F.struct("turn", place.alias("place")).alias("turn"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )
    back = chat_format.format_chats(log).select(
        "conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(text) + len(text) - len(replace(text, '\', ''))
                + len(regexp_extract_all(text, '</?s>|\[/?(?:SYS|INST|MSG)\]|\[(?:OUT|ROLE)\]')) AS chars,
             CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
                  ELSE 21 + len(role) + len(role) - len(replace(role, '\', ''))
                       + len(regexp_extract_all(role, '</?s>|\[/?(?:SYS|INST|MSG)\]|\[(?:OUT|ROLE)\]')) END AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256 FROM g
"""


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


#: All links by shared shingles, and what each document reaches by them; the query finds them with a probability of 0.995 each, on copies of copies by other ways too.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS q FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM p WHERE 100 * q >= 80 * (m + n - q)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.a
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "perplexity", "limit", "rejected")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.identify_language(docs, profiles)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.quality_ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(ledger, quality_rules.POLICIES["strict"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
e AS (SELECT *, row_number() OVER () AS k FROM d),
p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM e WHERE len(w) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
             len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words FROM e LEFT JOIN r USING (k)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 3 * n_words OR word_chars > 10 * n_words)::BIGINT
                + 8 * (100 * n_symbols > 10 * n_words)::BIGINT + 16 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 32 * (100 * n_bullets > 90 * n_lines)::BIGINT
                + 64 * (100 * n_ellipses > 30 * n_lines)::BIGINT + 128 * (100 * n_capitals > 30 * n_letters)::BIGINT + 256 * (100 * n_letter_words < 80 * n_words)::BIGINT
                + 512 * (n_words > 100000)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 511 = 0 AS kept, failed FROM f
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    line = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    counts = ("blank", "duplicate", "truncated", "illegal")
    done = conversation_repair.repair_conversations(rows, F.col("copies")).select(
        "conv_id", "block", "blocks", "gaps", "cost", *counts, F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"),
        F.when(F.size(line) > 0, F.array_join(line, "\n")).alias("repaired"),
    )
    join = lambda of, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.col(of).alias("x")))), lambda b: b["x"]), by).alias(of)
    many = done.where("blocks > 1").groupBy("conv_id", "gaps", "cost").agg(*(F.sum(c).alias(c) for c in counts), join("audit", ""), join("repaired", "\n"))
    sha = F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256")
    return done.where("blocks = 1").drop("block", "blocks").unionByName(many).select("conv_id", "gaps", *counts, "cost", "audit", sha)


def _op12_sql() -> str:
    """Forward only: for each state the least (cost, letters, text), as equal costs at a node never go with one's letters beginning the other's."""
    then = lambda s, cost, letter, said: f"{{'c': v[{s}].c + {cost}, 'a': v[{s}].a || '{letter}', 'r': v[{s}].r || {said}}}"
    leave = lambda s: then(s, 2, "D", "''")
    keep = lambda s, initial: then(s, f"x.more + CASE x.initial WHEN '{initial}' THEN 0 ELSE 1000000000 END", "K", "x.role || ':' || x.text || chr(10)")
    rerole = lambda s, role: then(s, "1 + x.more", "R", f"'{role}:' || x.text || chr(10)")
    before = (1, 2, 4)  # states that a user's turn can follow
    step = "[" + ", ".join((
        leave(1), f"least({leave(2)}, {keep(1, 's')})", f"least({', '.join([leave(3), *(f(s, x) for s in before for f, x in ((keep, 'u'), (rerole, 'user')))])})",
        f"least({leave(4)}, {keep(3, 'a')}, {rerole(3, 'assistant')})",
    )) + "]"
    user = f"least(v[3], {', '.join(then(s, 5, 'I', repr('user:') + ' || chr(10)') for s in before)})"
    assistant = "least(v[4], {})".format(then(3, 5, "I", "'assistant:' || chr(10)"))
    then_closed = f"list_transform([list_transform([{step}], lambda v: [v[1], v[2], {user}, v[4]])[1]], lambda v: [v[1], v[2], v[3], {assistant}])[1]"
    start = "[" + ", ".join(f"{{'c': {c}::BIGINT, 'a': '{a}', 'r': {r}}}" for c, a, r in (("0", "", "''"), ("1000000000", "", "''"), ("5", "I", "'user:' || chr(10)"), ("10", "II", "'user:' || chr(10) || 'assistant:' || chr(10)"))) + "]"
    return rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(key[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                                lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS how FROM k),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, how
      FROM h WHERE how <> 0),
e AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE how = 3),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again, substr(role, 1, 1) AS initial FROM e),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN again > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
             lag(initial) OVER w AS earlier, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate,
             count_if(fault = 't')::BIGINT AS truncated, count_if(earlier || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
             list({{'role': role, 'text': text, 'initial': initial, 'more': CASE fault WHEN 'b' THEN 1000000000 WHEN 'd' THEN 1000000000 WHEN 't' THEN 5 ELSE 0 END}} ORDER BY i) AS rows
      FROM g GROUP BY conv_id),
s AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda v, x: {then_closed}, {start}) AS v FROM c),
o AS (SELECT *, least(v[1], v[4]) AS best FROM s)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(CASE WHEN best.r = '' THEN '' ELSE left(best.r, length(best.r) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM k) k LEFT JOIN o ON k.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
             ('0x' || h[17:24])::BIGINT % 100 AS moved, ('0x' || h[25:32])::BIGINT % 100 AS spm FROM h),
p AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR moved >= 50 THEN 'plain' WHEN spm < 80 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(array_to_string(w[1:least(a, b)], ''), '') AS pre, coalesce(array_to_string(w[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
             coalesce(array_to_string(w[greatest(a, b) + 1:], ''), '') AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_html_extract": op7_html_extract,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {"op1_source_mixing": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_near_dedup": OP8_SQL, "op11_quality_rules": OP11_SQL, "op12_conversation_repair": _op12_sql(), "op13_fill_in_middle": OP13_SQL}
