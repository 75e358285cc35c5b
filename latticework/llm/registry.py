"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, line_dedup, lm_score, merkle, minhash, mixing, quality_model, quality_rules, secret_scan, span_dedup, token_file, toxicity, vector_codes
from latticework.llm.shared import small, written

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shingle_sql(table: str, key: str) -> str:
    """Distinct (key, sh): the 5-word shingles of a table's lowered texts; under five words the whole sequence."""
    return rf"""
  select distinct {key}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh
  from (select {key}, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from {table})"""


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def near_sql(table: str) -> str:
    return rf"""
with recursive s as ({shingle_sql(table, "doc_id")}
), n as (select doc_id, count(*) as n from s group by 1),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), links as materialized (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), both_ways as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
low as (select a, least(a, min(b)) as c from reach group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(low.c, d.doc_id) as component_id,
  coalesce(low.c, d.doc_id) = d.doc_id as kept
from {table} d left join n using (doc_id) left join low on low.a = d.doc_id
"""

def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


_FENCES = ", ".join(
    f"quantile_disc({c}, 0.25) {'- ' + repr(quality_rules.REACH) + f' * greatest(quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25), {least})' if low else '- 1e308'} as lo_{c}, "
    f"quantile_disc({c}, 0.75) + {quality_rules.REACH!r} * greatest(quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25), {least}) as hi_{c}"
    for c, (least, low) in quality_rules.STATS.items()
)
def _mean(of: str, upper: str, c: str) -> str:
    share = f"({of}.n / ({of}.n + cast({quality_rules.PRIOR_ROWS!r} as double)))"
    return f"({share} * {of}.{c} + (1e0 - {share}) * {upper})"


_PICK = ", ".join(f"{_mean('g', _mean('l', f'a.{e}_{c}', f'{e}_{c}'), f'{e}_{c}')} as {e}_{c}" for c in quality_rules.STATS for e in ("lo", "hi"))
_INSIDE = " and ".join(f"s.{c} between t.lo_{c} and t.hi_{c}" for c in quality_rules.STATS)
#: The sketches are exact up to SKETCH_K rows of a group; beyond that the fences differ from these by the sketches' rank error.
def quality_sql(table: str) -> str:
    """CTEs up to ``verdicts``."""
    return rf"""
w as (
  select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from {table}
), win as (
  select doc_id, unnest(range(1, len(w) - 1)) as p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as x from w where len(w) >= 3
), twice as (select doc_id, p from win qualify count(*) over (partition by doc_id, x) >= 2),
rep as (select doc_id, count(distinct p + d) as n from twice, (values (0), (1), (2)) v(d) group by 1),
c as (
  select w.doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(length(regexp_replace(text, '[^A-Z]+', '', 'g')) as bigint) as n_upper,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from w left join rep using (doc_id)
), s as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, word_chars / greatest(n_words, 1) as mean_chars,
    n_symbols / greatest(word_chars, 1) as symbol_share, n_dup_lines / greatest(n_lines, 1) as dup_share,
    n_repeat_words / greatest(n_words, 1) as repeat_share, n_upper / greatest(word_chars, 1) as upper_share from c
), g as (select lang, source, count(*) as n, {_FENCES} from s group by lang, source),
l as (select lang, count(*) as n, {_FENCES} from s group by lang),
a as (select {_FENCES} from s),
t as (select g.lang, g.source, {_PICK} from g left join l on g.lang is not distinct from l.lang cross join a),
verdicts as (
  select s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, (not s.base_failed and {_INSIDE}) as kept
  from s join t on s.lang is not distinct from t.lang and s.source is not distinct from t.source
)"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


# The rules as expressions of DuckDB: kind, expression, group and least length.
_ASSIGN = "((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?)([A-Za-z0-9+/_.=-]+)"
_OP6_RULES = (
    ("assign", _ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 34),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
_OP6_SPANS = " union all ".join(
    f"""select doc_id, {k} as k, '{kind}' as kind, unnest(range(1, len(m) + 1)) as i, m, p, g from (
      select doc_id, regexp_extract_all(text, '{x}', 0) as m, regexp_extract_all(text, '{x}', {group}) as g, string_split_regex(text, '{x}') as p
      from (select doc_id, coalesce(text, '') as text from documents))"""
    for k, (kind, x, group, _) in enumerate(_OP6_RULES)
)
_OP6_PASS = " or ".join(f"kind = '{kind}' and length(g[i]) >= {n}" for kind, _, _, n in _OP6_RULES if n)
OP6_SQL = rf"""
with m as ({_OP6_SPANS}),
s as (
  select doc_id, k, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as a, length(m[i]) as n
  from m where {_OP6_PASS} or kind = 'pem'
    or kind = 'jwt' and regexp_full_match(m[i], 'eyJ[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}')
), j as (select doc_id, k, a, kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint) as x from s),
d as (
  select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    string_agg(x, ',' order by a, k) filter (k < 3) as base, string_agg(x, ',' order by a, k) as spans from j group by 1
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join d using (doc_id)
"""


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_sentences", F.size("removed").cast("long").alias("n_removed"), "n_removed_words", "first_docs")


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_passages(_table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
with t as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, regexp_extract_all(text, '[\x20\x09-\x0D]+') as s,
    regexp_matches(text, '^[\x20\x09-\x0D]')::int as lead from (select doc_id, coalesce(text, '') as text from documents)
), x as (select doc_id, k, w[k] as word, coalesce(s[k + lead], '') as after, case when k = 1 and lead = 1 then s[1] else '' end as before
  from (select *, unnest(range(1, len(w) + 1)) as k from t)),
y as (select *, coalesce(regexp_matches(lag(word) over o, '[.!?]$') or contains(lag(after) over o, chr(10)), true)::int as fresh from x window o as (partition by doc_id order by k)),
z as (select *, sum(fresh) over (partition by doc_id order by k) as sentence from y),
p as (select *, (row_number() over (partition by doc_id, sentence order by k) - 1) % {span_dedup.MAX_SENTENCE} = 0 as opens from z),
q as (select *, sum(opens::int) over (partition by doc_id order by k) - 1 as u from p),
unit as (select doc_id, u, min(k) - 1 as a, max(k) as b, string_agg(before || word || after, '' order by k) as raw from q group by 1, 2),
n as (select doc_id, max(u) as last from unit group by 1),
fwd as (select e.doc_id, e.u as i, greatest(min(f.u), e.u + 1) as j from unit e join unit f on e.doc_id = f.doc_id and f.b >= e.a + {span_dedup.MIN_WORDS} and f.u >= e.u group by 1, 2),
bwd as (select e.doc_id, least(max(f.u), e.u - 1) as i, e.u as j from unit e join unit f on e.doc_id = f.doc_id and f.a <= e.b - {span_dedup.MIN_WORDS} and f.u <= e.u group by e.doc_id, e.u),
run as (select r.* from (select * from fwd union select * from bwd) r join n using (doc_id) where i >= 0 and j <= last),
said as (select run.*, array_to_string(t.w[(c.a + 1):d.b], ' ') as x from run join t using (doc_id)
  join unit c on c.doc_id = run.doc_id and c.u = i join unit d on d.doc_id = run.doc_id and d.u = j),
again as (select *, first_value(doc_id) over v as first_doc, row_number() over v as nth from said window v as (partition by x order by doc_id, i)),
gone as (select distinct a.doc_id, u.u from again a join unit u on u.doc_id = a.doc_id and u.u between a.i and a.j where nth > 1),
kept as (
  select doc_id, count(*) as n_sentences, count(g.u) as n_removed, coalesce(sum(b - a) filter (g.u is not null), 0) as n_removed_words,
    coalesce(string_agg(raw, '' order by unit.u) filter (g.u is null), '') as text
  from unit left join gone g using (doc_id, u) group by 1
), firsts as (select doc_id, list_sort(list(distinct first_doc)) as f from again where nth > 1 group by 1)
select t.doc_id, coalesce(kept.text, t.text) as text, coalesce(n_sentences, 0) as n_sentences, coalesce(n_removed, 0) as n_removed,
  cast(coalesce(n_removed_words, 0) as bigint) as n_removed_words, coalesce(firsts.f, []) as first_docs
from t left join kept using (doc_id) left join firsts using (doc_id)
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def leak_sql(table: str) -> str:
    return f"""
with s as ({shingle_sql(table, "doc_id")}), b as ({shingle_sql("benchmark", "item_id")}),
n as (select item_id, count(*) as item_shingles from b group by 1)
select doc_id, item_id, item_shingles, count(*) as common, count(*) / item_shingles as containment
from s join b using (sh) join n using (item_id) group by doc_id, item_id, item_shingles having 100 * count(*) >= {decontaminate.CONTAINED} * item_shingles
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def line_dedup_sql(table: str) -> str:
    """CTEs up to ``deduped`` (doc_id, text, n_lines, n_removed, removed). Lines within reach share one of the shorter's segments."""
    t, least = line_dedup.EDITS, line_dedup.LEAST_CHARS
    return rf"""
lines as (
  select doc_id, line_no, line, regexp_matches(line, '[^\x20\x09-\x0D]') as inked from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line_no from {table})
), near as materialized (select distinct line, length(line) as n from lines where inked and length(line) >= {least}),
near_links as materialized (
  select a.line as a, b.line as b from near a join near b on b.n between a.n and a.n + {t} and a.line <> b.line
  where (contains(b.line, left(a.line, a.n // 3)) or contains(b.line, right(a.line, (a.n + 2) // 3)) or contains(b.line, substring(a.line, a.n // 3 + 1, (a.n + 1) // 3)))
    and levenshtein(a.line, b.line) <= {t}
), near_both as materialized (select a, b from near_links union select b, a from near_links),
near_reach(a, b) as (select a, b from near_both union select r.a, e.b from near_reach r join near_both e on r.b = e.a),
near_low as (select a as line, least(a, min(b)) as cls from near_reach group by 1, a),
placed as (select lines.*, case when inked then coalesce(cls, line) end as cls from lines left join near_low using (line)),
judged as (select *, inked and row_number() over (partition by cls order by doc_id, line_no) > 1 as gone from placed),
deduped as (
  select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '') as text, count(*) filter (inked) as n_lines,
    count(*) filter (gone) as n_removed, coalesce(list(cast(line_no as integer) order by line_no) filter (gone), []) as removed from judged group by 1
)"""


def _held_out(parts: int, part: int):
    """Whether crc32(doc_id as text) leaves this rest; a null doc_id is held out by none."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % parts == part, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(~_held_out(5, 0)).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.language_scores(_table(spark, sf_dir, "documents"), _held_out(7, 2))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(~_held_out(4, 2)).select("doc_id", F.col("quality").alias("label"))
    out = quality_model.quality_scores(_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(table: str) -> str:
    """CTEs up to ``mix``."""
    return rf"""
z as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5('17|' || coalesce(cast(doc_id as varchar), '')) as key from {table}
), s as (select source, cast(sum(size) as bigint) as n, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from z group by source),
o as (
  select *, 3 * n as cap, sum(w) over o as w_left, coalesce(sum(3 * n) over (order by 3 * n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
    (select sum(n) from s) as total from s window o as (order by 3 * n / w, source nulls last rows between current row and unbounded following)
), f as (select *, cap * w_left < w * (total - gone) as full_ from o),
r as (select coalesce(max(total), 0) - coalesce(sum(cap) filter (full_), 0) as rest, sum(w) filter (not full_) as w_rest from f),
goal as (select source, n as source_size, case when full_ then cast(cap as double) else cast(rest * w as double) / cast(w_rest as double) end as target from f, r),
quota as (select *, cast(floor(target) as bigint) // greatest(source_size, 1) as passes, cast(floor(target) as bigint) % greatest(source_size, 1) as rest from goal),
placed as (
  select z.*, quota.source_size, quota.target, quota.passes, quota.rest,
    coalesce(sum(size) over (partition by z.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from z join quota on z.source is not distinct from quota.source
), mix as (
  select doc_id, source, size, source_size, target, cast(passes + (2 * before + size <= 2 * rest)::int as bigint) as times,
    cast((passes + (2 * before + size <= 2 * rest)::int) * size as bigint) as taken from placed
)"""

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root folded from it after some texts were tampered with.

    A null doc_id is never tampered with; equal ids stand by leaf. Null and empty texts and repeated rows are leaves like others.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    changed = F.when(hit, merkle.leaf(*(F.translate("text", A_Z, a_z) if c == "text" else F.col(c) for c in docs.columns)))
    out = merkle.manifest(docs.withColumn("changed", changed), keep=["changed"])
    folded = merkle.folded(F.coalesce("changed", "leaf"), F.col("path"), F.col("turns"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(height: int = 6) -> str:
    """Trees of ``height`` levels at most; a tree that has come to one node stays as it is."""
    leaf = " || ".join(f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
    steps = []

    def tree(t: str, key: str) -> None:
        """CTEs of a forest {t}0(key, i, node, n): nodes {t}k and runs {t}r{k} of level k."""
        for k in range(height):
            steps.append(f"{t}r{k} as materialized (select {key}, i // 16 as run, n, list(node order by i) as nodes from {t}{k} group by {key}, i // 16, n)")
            steps.append(f"{t}{k + 1} as materialized (select {key}, run as i, (n + 15) // 16 as n, case when n = 1 then nodes[1] else sha256(array_to_string(nodes, '')) end as node from {t}r{k})")

    def climb(t: str, key: str, start: str) -> str:
        """Folds ``fold`` and lengthens ``path`` of rows {start}(key, i, fold, path, ...) over the levels."""
        at = start
        for k in range(height):
            run = f"(x.i // {16**k})"
            place = f"({run} % 16)"
            steps.append(
                f"{t}c{k} as materialized (select x.* exclude (fold, path), case when r.n = 1 then fold else sha256(array_to_string(r.nodes[1:{place}], '') || fold || array_to_string(r.nodes[{place} + 2:], '')) end as fold, "
                f"path || array_to_string(r.nodes[1:{place}], '') || array_to_string(r.nodes[{place} + 2:], '') as path from {at} x join {t}r{k} r on r.{key} = x.{key} and r.run = {run} // 16)")
            at = f"{t}c{k}"
        return at

    steps.append(rf"""d as materialized (
  select doc_id, coalesce('=' || source, '') as key, sha256({leaf.replace("{text}", "text")}) as leaf, case when crc % 5 = 0 then sha256({leaf.replace("{text}", f"translate(text, '{A_Z}', '{a_z}')")}) end as changed
  from (select *, case when doc_id is not null then 4294967295 - list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''),
    lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) end as crc from documents)
), t0 as materialized (select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by key) as n, leaf as node from d)""")
    tree("t", "key")
    steps.append(f"s0 as materialized (select 0 as one, key, node, row_number() over (order by encode(key)) - 1 as i, count(*) over () as n from t{height})")
    tree("s", "one")
    own = climb("t", "key", "(select *, coalesce(changed, leaf) as fold, '' as path from t0)")
    steps.append(f"h as materialized (select 0 as one, x.doc_id, x.leaf, x.fold, x.path, s.node as subroot, s.i from {own} x join s0 s using (key))")
    end = climb("s", "one", "h")
    return "with " + ",\n".join(steps) + f"""
select doc_id, leaf, subroot, z.node as root, sha256(path) as proof_sha256, fold as folded_root, fold = z.node as verified from {end}, (select node from s{height}) z"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all whole, finite embeddings, with their errors; equal ids in the first codebook stand by vector."""
    found = vector_codes.compress(_table(spark, sf_dir, "embeddings"), keep=["label"])
    by_label = written(found.rows.groupBy(F.col("label").alias("name")).agg(F.sum("error").alias("label_error")), "vector-labels")
    out = found.rows.join(small(by_label, 100_000), F.col("label").eqNullSafe(F.col("name")))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _vector_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = [rf"""v as materialized (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, embedding, len(embedding) // {parts} as width from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), x as materialized (select r, (k - 1) // width as p, (k - 1) % width as d, cast(floor(256 * cast(embedding[k] as double)) as bigint) as x from (select r, width, embedding, unnest(range(1, len(embedding) + 1)) as k from v)),
b0 as materialized (select p, r as e, d, x as c from x where r < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"far{k} as (select r, p, e, cast(sum((x - c) * (x - c)) as bigint) as far from x join b{k} using (p, d) group by r, p, e)")
        steps.append(f"a{k} as materialized (select r, p, min((far, e)) as best from far{k} group by r, p)")
        if k < rounds:
            steps.append(f"m{k} as (select p, best[2] as e, d, cast(sum(x) as bigint) as s, count(*) as n from x join a{k} using (r, p) group by p, best[2], d)")
            steps.append(f"b{k + 1} as materialized (select p, e, d, coalesce((s - ((s % n) + n) % n) // n, c) as c from b{k} left join m{k} using (p, e, d))")
    return "with " + ",\n".join(steps) + f"""
, o as (select r, string_agg(lower(printf('%02x', cast(best[2] as integer))), '' order by p) as code, cast(sum(best[1]) as bigint) as error from a{rounds} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by p, e, d)) from b{rounds}) as codebooks_sha256 from v join o using (r)"""


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids begin in the files, how many there are, and their checksum, as read back from the files."""
    files = token_file.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return files.rows().select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_span_dedup": op4_span_dedup,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_source_mixing": op10_source_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_ids": op13_token_ids,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"with recursive {line_dedup_sql('documents')} select * from deduped",
    "op3_quality_rules": f"with {quality_sql('documents')} select * from verdicts",
    "op4_span_dedup": OP4_SQL,
    "op5_minhash_dedup": near_sql("documents"),
    "op6_secret_scan": OP6_SQL,
    "op8_decontamination": leak_sql("documents"),
    "op10_source_mixing": f"with {mix_sql('documents')} select doc_id, size, source_size, target, taken from mix",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_vector_codes": _vector_sql(),
}
