"""DuckDB SQL for the queries of this subpackage that SQL can express.

Without SQL: op2, op5 (fitted models: held-out accuracy), op3 (BPE: the tokenizers library),
op4 (rolling hash: planted passages).
"""

from __future__ import annotations

from harrow.llm.chat import TEMPLATE
from harrow.llm.license_texts import MORE_TEMPLATES, TEMPLATES
from harrow.llm.mixing import Mix
from harrow.llm.rules import Rules

ORACLES: dict[str, str] = {}
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _chat() -> str:
    escaped = "replace({}, '~', '~~')"
    for control in TEMPLATE.controls:
        escaped = f"replace({escaped}, '{control}', '{control[0]}~{control[1:]}')"
    marks = len(TEMPLATE.turn) + len(TEMPLATE.body) + len(TEMPLATE.end) + 1
    return f"""with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns, coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
        sum({marks} + length({escaped.format('role')}) + length({escaped.format('text')}))::bigint as formatted_chars from m group by conv_id)
    select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g"""


ORACLES["op8_chat_format"] = _chat()


def _rules() -> str:
    rules = Rules()
    level = f"ln({rules.delta} / {len(rules.ratios) * len(rules.strata)})"
    rate = rules.risk / len(rules.ratios)
    named = ", ".join(f"'{s}'" for s in rules.strata if s != "other")
    ratios = " union all ".join(f"select doc_id, stratum, '{r}' as rule, {a}::double / greatest({b}, 1) as v from f" for r, (a, b) in rules.ratios.items())
    grid = ", ".join(f"({j}, {c}::double)" for j, c in enumerate(rules.grid))
    return f"""with w as (select doc_id, lang, coalesce(text, '') as t, {_WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^ \\t\\n\\x0B\\f\\r]')) as l from documents),
    places as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
    win as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from places),
    rep as (select doc_id, count(*) as n from (select distinct doc_id, i + unnest([0, 1, 2]) as j from win where n >= 2) group by doc_id),
    c as (select doc_id, case when lang in ({named}) then lang else 'other' end as stratum, len(w)::bigint as n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
        length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::bigint as n_upper, length(regexp_replace(t, '[^!?=_~^{{}}\\[\\]\\\\/@+]+', '', 'g'))::bigint as n_marks, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
        from w left join rep using (doc_id)),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
    ratio as ({ratios}),
    good as (select doc_id, min(quality) >= 1 as good from labels where quality is not null group by doc_id),
    fit as (select r.*, g.good from ratio r join good g using (doc_id) join f using (doc_id) where not f.base_failed),
    n as (select stratum, rule, count(*) filter (good) as n_good, count(*) filter (not good) as n_bad from fit group by all),
    k as (select fit.stratum, fit.rule, j, cutoff, count(*) filter (good and v > cutoff) as kg, count(*) filter (not good and v > cutoff) as kb from fit, (values {grid}) g(j, cutoff) group by all),
    tested as (select k.*, n_good, n_bad, kg <= n_good * {rate} and ln(list_sum(list_transform(range(0, kg + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({rate}) + (n_good - i) * ln(1 - {rate}))))) <= {level} as safe
        from k join n using (stratum, rule) where kg <= n_good),
    ends as (select stratum, rule, min(j) filter (not safe) as e from tested group by all),
    useful as (select t.*, kb / greatest(n_bad, 1) - kg / greatest(n_good, 1) as gain from tested t join ends using (stratum, rule) where (e is null or j < e) and kb > 0),
    best as (select stratum, rule, cutoff from (select *, row_number() over (partition by stratum, rule order by round(gain, 9) desc, j) as r from useful where gain > 0) where r = 1),
    hit as (select ratio.doc_id, list(ratio.rule order by ratio.rule) as failed from ratio join best using (stratum, rule) where v > cutoff group by ratio.doc_id)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and hit.failed is null as kept, coalesce(array_to_string(hit.failed, ','), '') as failed_rules from f left join hit using (doc_id)"""


ORACLES["op10_quality_rules"] = _rules()

ORACLES["op9_ngram_jaccard"] = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
    links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    edges as (select a, b from links union select b, a from links),
    reach(a, b) as (select doc_id, doc_id from w union select r.a, e.b from reach r join edges e on e.a = r.b)
    select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id from w left join n using (doc_id) join reach r on r.a = w.doc_id group by all"""

ORACLES["op7_one_bit_neighbours"] = """with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d as (select q.vec_id as query_id, v.vec_id, list_distance(q.e, v.e) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10"""


def _licenses() -> str:
    values = ", ".join(f"('{t[0]}', '{t[1]}', '{t[2].replace(chr(39), chr(39) * 2)}')" for t in TEMPLATES + MORE_TEMPLATES)
    normal = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""with t as (select template, license, {grams} as g from (select template, license, string_split({normal.format('wording')}, ' ') as w from (values {values}) v(template, license, wording))),
    seg as (select distinct doc_id, s from (select doc_id, unnest(list_concat([text], list_concat(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), string_split(text, chr(10))))) as s from documents where text is not null)),
    b as (select doc_id, {grams} as g from (select doc_id, string_split({normal.format('s')}, ' ') as w from seg) where len(w) >= 2),
    d as (select doc_id, template, license, 2.0::double * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) as score from b, t where len(b.g) <= 1.5 * len(t.g) and len(t.g) <= 1.5 * len(b.g)),
    f as (select doc_id, template, license, max(score) as score from d where score >= 0.8 group by all),
    o as (select *, row_number() over (partition by doc_id order by score desc, template) as r, count(*) over (partition by doc_id) as n from f)
    select documents.doc_id, license, round(score, 6) as score, coalesce(n, 0) as n_finds from documents left join o on o.doc_id = documents.doc_id and o.r = 1"""


ORACLES["op1_license_scan"] = _licenses()


def _mix() -> str:
    mix = Mix()
    digest = lambda *parts: "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15))::bigint"
    row = digest(str(mix.seed), "coalesce(doc_id::varchar, '')", "coalesce(text, '')")
    return f"""with recursive r as (select doc_id, coalesce(source, '') as source, len({_WORDS})::bigint as n_tokens, {row} as h from documents),
    t as (select source, sum(n_tokens)::double as tokens, count(*) as n_rows from r group by source),
    b as (select sum(tokens) as n, count(*) as k, min(tokens) as least, max(tokens) as most from t where tokens > 0),
    live as (select tokens / n as p, most / n as top from t, b where tokens > 0),
    goal as (select h + {mix.entropy} * (ln(k) - h) as target from (select sum(-p * ln(p)) as h from live), b),
    even(i, low, high) as (select 0, 0::double, 1::double union all
        select i + 1, case when e >= target then mid else low end, case when e >= target then high else mid end from (
            select i, low, high, (low + high) / 2 as mid, (select ln(sum(exp((low + high) / 2 * ln(p / top)))) - (low + high) / 2 * sum(exp((low + high) / 2 * ln(p / top)) * ln(p / top)) / sum(exp((low + high) / 2 * ln(p / top))) from live) as e from even
        ), goal where i < {mix.rounds}),
    tau0 as (select low as tau from even where i = {mix.rounds}),
    repeats(i, low, high) as (select 0, tau, 1::double from tau0 union all
        select i + 1, case when pow(least / most, (low + high) / 2 - 1) <= {mix.max_passes} then low else (low + high) / 2 end, case when pow(least / most, (low + high) / 2 - 1) <= {mix.max_passes} then (low + high) / 2 else high end from repeats, b where i < {mix.rounds}),
    tau as (select case when pow(least / most, tau0.tau - 1) <= {mix.max_passes} then tau0.tau else high end as tau from tau0, repeats, b where i = {mix.rounds}),
    raw as (select source, tokens, n_rows, case when tokens > 0 then exp(tau * ln(tokens / n)) else 0 end as raw from t, tau, b),
    z as (select sum(raw) as z, max(tokens / raw) filter (raw > 0) as whole from raw),
    passes as (select source, tokens, n_rows, case when tokens > 0 then least({mix.max_passes}, round(z.whole * z / z * raw / tokens, 9)) else 1 end as passes from raw, z),
    plan as (select source, ceil(n_rows / {mix.block_rows})::bigint as n_blocks, floor(passes)::int as whole, round((passes - floor(passes)) * tokens)::bigint as share from passes),
    d as (select r.*, whole, share, {digest(str(mix.seed), "h")} % n_blocks as block from r join plan using (source)),
    o as (select *, {digest(str(mix.seed), "source", "whole + 1", "block")} as bo, {digest(str(mix.seed), "h", "whole + 1")} as po from d),
    g as (select source, h, bo, block, po, any_value(share) as share, sum(n_tokens) as t from o group by source, h, bo, block, po),
    last as (select source, h from (select *, coalesce(sum(t) over (partition by source order by bo, block, po, h rows between unbounded preceding and 1 preceding), 0) as before from g) where before < share),
    taken as (select d.*, unnest(range(1, whole + 1 + (last.h is not null)::int))::int as pass_no from d left join last on last.source = d.source and last.h = d.h)
    select doc_id, source, n_tokens, pass_no, block, {digest(str(mix.seed), "source", "pass_no", "block")} as block_order, {digest(str(mix.seed), "h", "pass_no")} as position from taken"""


ORACLES["op6_mix_sources"] = _mix()


def _shards(shards: int = 8) -> str:
    # one table row of CRC-32 from eight halvings of the index
    halve = "list_reduce(list_prepend({}::bigint, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"""with crc as (select list(v order by i) as t from (select i, {halve.format('i')} as v from range(256) r(i))),
    raw as (select doc_id, coalesce(text, '') as text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as x from documents),
    d as (select doc_id, strlen(text) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(x, lambda b: ('0x' || b)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc, ('0x' || substr(md5(text), 1, 15))::bigint as h from raw, crc),
    o as (select *, row_number() over w - 1 as place, coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0)::hugeint as start from d window w as (order by h, doc_id nulls first, size, crc)),
    total as (select sum(size)::hugeint as t, max(size) as largest from d),
    goal as (select k, k * t as target from total, range(1, {shards}) r(k)),
    met as (select k, target, o.* from goal join o on o.start * {shards} <= target and target < (o.start + o.size) * {shards}),
    grp as (select h, min(start) as start, sum(size) as size, min(place) as place, count(*) as n from o where h in (select h from met) group by h),
    unit as (select k, target, case when small then grp.start else met.start end as start, case when small then grp.size else met.size end as size, case when small then grp.place else met.place end as place, case when small then grp.n else 1 end as n
        from met join grp using (h), (select greatest(largest, t // {100 * shards}) as most from total), (values (true), (false)) s(small) where small = (grp.size <= most)),
    cut as (select case when 2 * target <= (2 * start + size) * {shards} then place else place + n end as c from unit),
    p as (select o.*, (select count(*) from cut where c <= place) as shard, coalesce((select max(c) from cut where c <= place), 0) as first from o)
    select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard::int as shard, (place - first)::bigint as slot, null::int as grown_shard from p"""


ORACLES["op11_byte_shards"] = _shards()


def _codes(entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024) -> str:
    near = """a{k} as (select p, v, any_value(w) as w, arg_min(e, (d, e)) as e, min(d) as d from (select x.p, x.v, x.w, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.c[i]) * (x.v[i] - b.c[i])))::bigint as d from x join b{k} b on b.p = x.p) group by p, v)"""
    move = """m{k} as (select p, e, list(floor_div order by i) as c from (select p, e, i, (case when s >= 0 then s // n else -((-s + n - 1) // n) end)::bigint as floor_div from (select p, e, i, sum(w * v[i])::hugeint as s, sum(w)::hugeint as n from (select *, unnest(range(1, len(v) + 1)) as i from a{k}) group by p, e, i)) group by p, e),
    b{n} as (select b.p, b.e, coalesce(m.c, b.c) as c from b{k} b left join m{k} m on m.p = b.p and m.e = b.e)"""
    steps = ",\n    ".join(f"{near.format(k=k)},\n    {move.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""with kept as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    y as (select r, vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as v from kept, range({parts}) t(p)),
    x as (select p, v, count(*) as w from y group by p, v),
    f as (select r, row_number() over (order by vec_id, v) - 1 as e from kept qualify e < {entries}),
    b0 as (select y.p, f.e, y.v as c from y join f using (r)),
    {steps},
    {near.format(k=rounds)},
    z as (select r, any_value(vec_id) as vec_id, any_value(label) as label, string_agg(lower(printf('%02x', a.e)), '' order by y.p) as code, sum(a.d)::bigint as error from y join a{rounds} a on a.p = y.p and a.v = y.v group by r),
    h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as s from b{rounds})
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256 from z, h"""


ORACLES["op12_vector_codes"] = _codes()


def _phrases(least: int = 100, longest: int = 5, most: int = 2000) -> str:
    return f"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
    n as (select lang, sum(len(w)) as n from w group by lang),
    g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, {longest + 1}) r(k) where len(w) >= k)),
    f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= {least}),
    c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k >= 2),
    cuts as (select c.lang, c.k, c.phrase, c.a, j, l.a as l, r.a as r, n.n, (1000::hugeint * c.a * n.n) // (l.a::hugeint * r.a) as score
        from (select *, unnest(range(1, k)) as j from c) c join n on n.lang = c.lang join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[j + 1 :], ' ')),
    inner_of as (select distinct lang, array_to_string(w[i : i + m - 1], ' ') as phrase, a from (select lang, w, k, a, m, unnest(range(1, k - m + 2)) as i from c, range(2, {longest}) r(m) where m < k)),
    top as (select lang, k, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang, phrase order by score, j) as o from cuts) where o = 1),
    left_over as (select top.* from top where not exists (select 1 from inner_of i where i.lang = top.lang and i.phrase = top.phrase and 100 * i.a >= 100 * top.a))
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over) where rank <= {most}"""


ORACLES["op13_collocations"] = _phrases()
