"""SQL for DuckDB that gives the same rows as the registered core queries."""

from . import cluster_sql

_P1 = r"""
with lines as (
  select raw_id, case when ends_with(raw_line, chr(13)) then substr(raw_line, 1, length(raw_line) - 1) else raw_line end as line
  from logp_raw where line_no is null or line_no <> 1
), cut as (
  select raw_id, line, regexp_extract_all(',' || line, ',(?:"(?:[^"]|"")*"|[^",]*)') as f from lines
), parsed as (
  select raw_id, line, list_sum([length(x) for x in f]) = length(line) + 1 as sound, len(f) = 6 as six,
    [case when starts_with(x, ',"') then replace(substr(x, 3, length(x) - 3), '""', '"') else substr(x, 2) end for x in f] as v
  from cut
), named as (
  select raw_id, line, sound, six, v,
    trim(v[4], ' ' || chr(9)) as s, trim(v[5], ' ' || chr(9)) as pn, trim(v[6], ' ' || chr(9)) as pi
  from parsed
), parts as (
  select *, regexp_replace(s, '[^()]', '', 'g') as r, regexp_replace(s, '[^\[\]]', '', 'g') as q,
    regexp_replace(regexp_replace(s, '\[[^\]]*\]', '', 'g'), '[^0-9]', '', 'g') as g
  from named
), judged as (
  select *,
    s <> '' as c1,
    regexp_full_match(s, '[A-Za-z0-9()\[\]=#+\-@/\\.%:*]*') as c2,
    coalesce(list_min([2 * length(replace(substr(r, 1, i), ')', '')) - i for i in range(1, length(r) + 1)]), 0) >= 0
      and 2 * length(replace(r, ')', '')) = length(r) as c3,
    replace(q, '[]', '') = '' as c4,
    coalesce(list_sum([(length(g) - length(replace(g, d::varchar, ''))) % 2 for d in range(10)]), 0) = 0 as c5,
    regexp_full_match(pn, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') as c6,
    coalesce(try_cast(pn as double) between -10 and 15, false) as c7,
    pi = '' or regexp_full_match(pi, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') as c8,
    pi = '' or coalesce(try_cast(pi as double) between -10 and 15, false) as c9
  from parts
), reasons as (
  select *, case when line is null then ['no line'] when not sound then ['broken quoting'] when not six then ['not 6 fields']
    else list_filter([
      case when not c1 then 'SMILES is empty' end, case when not c2 then 'SMILES has a foreign character' end,
      case when not c3 then 'SMILES has unbalanced round brackets' end, case when not c4 then 'SMILES has open or nested square brackets' end,
      case when not c5 then 'SMILES has an unclosed ring' end, case when not c6 then 'logPN isn''t a number' end,
      case when c6 and not c7 then 'logPN is out of range' end, case when not c8 then 'logPI isn''t a number' end,
      case when c8 and not c9 then 'logPI is out of range' end], lambda x: x is not null) end as errors
  from judged
)
"""


def _emb(more: str = "") -> str:
    """Sign bits of the embeddings: fp (id, bit), ids, c (bit, c), nn (n)."""
    return (
        """with e as (select vec_id as id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as bit from embeddings),
fp as (select id, bit from e where x > 0), ids as (select vec_id as id from embeddings), """
        + _sums(64)
        + more
    )


def _packed(more: str = "") -> str:
    return (
        """with w as (select id, min(words) as words from fp_packed where id is not null and words is not null group by id),
fp as (select id, bit from w, range(256) t(bit) where ((words[bit // 64 + 1] >> (bit % 64)) & 1) = 1), ids as (select id from w), """
        + _sums(256)
        + more
    )


def _basket(more: str = "") -> str:
    return (
        """with fp as (select distinct o_custkey as id, substr(p_brand, 7)::int - 1 as bit from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
ids as (select distinct id from fp), """
        + _sums(25)
        + more
    )


def _sums(m: int) -> str:
    return f"nn as (select count(*) as n from ids), c as (select b.bit, count(fp.id) as c from range({m}) b(bit) left join fp on fp.bit = b.bit group by b.bit)"


def _counters(k: int = 1) -> str:
    p = "({})" if k == 1 else f"pow({{}}, 1.0 / {k})"
    a, d, t = p.format("c * (c - 1) / 2.0"), p.format("(n - c) * (n - c - 1) / 2.0"), p.format("(n - c) * c::double")
    return f", k0 as (select any_value(n) as n, sum({a})::double as a, sum({d})::double as d, sum({t})::double as total_dis from c, nn), k as (select *, a + d as total_sim, a + d + total_dis as p from k0)"


_INDEX = {
    "AC": "2 / pi() * asin(sqrt(total_sim / p))",
    "BUB": "(sqrt(a * d) + a) / (sqrt(a * d) + a + total_dis)",
    "Fai": "(a + d / 2) / p",
    "Gle": "2 * a / (2 * a + total_dis)",
    "Ja": "3 * a / (3 * a + total_dis)",
    "JT": "a / (a + total_dis)",
    "RT": "total_sim / (p + total_dis)",
    "RR": "a / p",
    "SM": "total_sim / p",
    "SS1": "a / (a + 2 * total_dis)",
    "SS2": "2 * total_sim / (p + total_sim)",
}
_ALL = "select " + ", ".join(f'round({f}, 8) as "{k}"' for k, f in _INDEX.items()) + " from k"


def _scores(m: int, kind: str = "JT") -> str:
    """cs (id, comp_sim) after fp, ids, c and nn."""
    value = {"JT": "av / (av + disv)", "RR": f"av / ({m} * (n - 1) * (n - 2) / 2.0)", "SM": f"(av + dv) / ({m} * (n - 1) * (n - 2) / 2.0)"}[kind]
    return f""", g as (select any_value(n) as n, sum(c * (c - 1) / 2.0)::double as a_all, sum((n - 1 - c) * c)::double as dis_all, sum((n - 1 - c) * (n - 2 - c) / 2.0)::double as d_all from c, nn),
o as (select ids.id, count(fp.bit) as k, coalesce(sum(c.c), 0)::double as s from ids left join fp on fp.id = ids.id left join c on c.bit = fp.bit group by ids.id),
v as (select id, n, a_all - (s - k) as av, dis_all + 2 * s - n * k as disv, d_all + (n - 1) * k - s as dv from o, g),
cs as (select id, {value} as comp_sim from v)"""


_RANKED = ", r as (select id, comp_sim, row_number() over (order by comp_sim, id) - 1 as rank, (select n from nn) as n from cs)"


def _strata(strata: str, k: str) -> str:
    return (
        f", t as (select *, {k} as k, ntile({strata}) over (order by comp_sim, id) as tile from r), "
        "u as (select *, row_number() over (partition by tile order by comp_sim, id) as pos from t), "
        "st as (select row_number() over (order by pos, tile) as ord, id, k from u) "
    )


_QUOTA = """, lim as (select min(comp_sim) as lo, (max(comp_sim) - min(comp_sim)) / 10 as step from cs),
b as (select id, comp_sim, n, greatest(len(list_filter([lo + i * step for i in range(10)], lambda e: e <= comp_sim)) - 1, 0) as bin from r, lim),
u as (select *, row_number() over (partition by bin order by comp_sim, id) as pos from b),
q as (select *, row_number() over (order by pos, bin) as ord, (n * 10 / 100.0)::int as k from u)
"""

_PAIRS = """, sz as (select ids.id, count(fp.bit) as k from ids left join fp on fp.id = ids.id group by ids.id),
dots as (select a.id as i, b.id as j, count(*) as x from fp a join fp b on a.bit = b.bit and a.id < b.id group by 1, 2),
prs as (select a.id as i, b.id as j, a.k as ka, b.k as kb, coalesce(x, 0) as x from sz a join sz b on a.id < b.id left join dots on dots.i = a.id and dots.j = b.id)
"""
_PAIR = {"JT": "x::double / nullif(ka + kb - x, 0)", "RR": "x / 64.0::double", "SM": "(64 - ka - kb + 2 * x) / 64.0::double"}

_SCALED = """with e as (select vec_id as id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as bit from embeddings),
lim as (select bit, min(x) as lo, max(x) as hi from e group by bit),
kept as (select bit, lo, hi, row_number() over (order by bit) - 1 as pos from lim where hi > lo),
v as (select id, pos, (x - lo) / (hi - lo) as x from e join kept on e.bit = kept.bit)"""

_RV = """with one as (select id, min(v) as v from rv where id is not null group by id),
e as (select id, unnest(v) as x, generate_subscripts(v, 1) - 1 as bit from one),
lim as (select bit, min(x) filter (not isnan(x)) as lo, max(x) filter (not isnan(x)) as hi, bool_or(x is null or isnan(x)) as bad from e group by bit),
kept as (select bit, lo, hi, row_number() over (order by bit) - 1 as pos from lim where not bad and hi > lo),
v as (select id, pos, (x - lo) / (hi - lo) as x from e join kept on e.bit = kept.bit)"""

_REAL = """, col as (select pos, count(*)::double as n, sum(x) as s, sum(x * x) as q from v group by pos),
z as (select any_value(n) as n, count(*) as m, sum(s * s - q) / 2 as ij, sum(q) as q, sum((n - s) * (n - s) - (n - 2 * s + q)) / 2 as fl from col)"""
_REAL_INDEX = {"JT": "ij / ((n - 1) * q - ij)", "RR": "2 * ij / (m * n * (n - 1))", "SM": "2 * (ij + fl) / (m * n * (n - 1))"}


def _real_scores(kind: str) -> str:
    return f""", col as (select pos, count(*)::double as n, sum(x) as s, sum(x * x) as q from v group by pos),
z as (select id, any_value(n) - 1 as n, count(*) as m, sum((s - x) * (s - x) - (q - x * x)) / 2 as ij, sum(q - x * x) as q,
  sum((n - 1 - (s - x)) * (n - 1 - (s - x)) - (n - 1 - 2 * (s - x) + q - x * x)) / 2 as fl from v join col on v.pos = col.pos group by id),
cs as (select id, {_REAL_INDEX[kind]} as comp_sim from z)"""


_REAL_PAIR = {"JT": "xy / (xx + yy - xy)", "RR": "xy / m", "SM": "(m - sx - sy + 2 * xy) / m"}
_REAL_PAIRS = """, own as (select id, count(*) as m, sum(x) as s, sum(x * x) as q from v group by id),
dots as (select a.id as i, b.id as j, sum(a.x * b.x) as xy from v a join v b on a.pos = b.pos and a.id < b.id group by 1, 2),
prs as (select xy, p.m, p.s as sx, r.s as sy, p.q as xx, r.q as yy from dots join own p on p.id = i join own r on r.id = j)"""


def _sigma(m: int, kind: str) -> str:
    joint = "x * (x - 1) / 2.0"
    p = "c * (c - 1) / 2.0"
    if kind == "SM":
        joint += " + (n - ci - cj + x) * (n - ci - cj + x - 1) / 2.0 + (ci - x) * (ci - x - 1) / 2.0 + (cj - x) * (cj - x - 1) / 2.0"
        p += " + (n - c) * (n - c - 1) / 2.0"
    by = "(select sum(tt - (n - c) * (n - c - 1) / 2.0) / any_value(tt) from c, nn, tot)" if kind == "JT" else f"{m}"
    return f""", tot as (select n * (n - 1) / 2.0::double as tt from nn),
x as (select a.bit as i, b.bit as j, count(*) as x from fp a join fp b on a.id = b.id and a.bit < b.bit group by 1, 2),
jo as (select sum({joint}) as joint from (select a.c as ci, b.c as cj, coalesce(x, 0) as x, n from c a join c b on a.bit < b.bit left join x on x.i = a.bit and x.j = b.bit, nn)),
ps as (select sum(({p}) / tt) as s1, sum((({p}) / tt) * (({p}) / tt)) as s2 from c, nn, tot)
select round(sqrt(greatest(s1 - s2 + 2 * (joint / tt - (s1 * s1 - s2) / 2), 0)) / {by}, 8) as sigma from ps, jo, tot"""


_W = "with w as (select id, min(words) as words from fp_packed where id is not null and words is not null group by id)"
_ON = "list_sum([bit_count(x) for x in {}])"
_SAMPLE = _emb(_scores(64) + _RANKED)
_K10 = "(n * 10 / 100.0)"

ORACLE: dict[str, str] = {
    "p1_found": _P1 + "select raw_id from reasons where len(errors) > 0",
    "p1_reasons": _P1 + "select reason, count(*) as n from (select unnest(errors) as reason from reasons) group by reason",
    "p1_loaded": _P1
    + """select raw_id, v[1] as "DATABASE_ID", v[2] as "NAME", v[3] as "SMILES_n", s as "SMILES",
  try_cast(pn as double) as "logPN", try_cast(pi as double) as "logPI" from reasons where len(errors) = 0""",
}

for _kind in ("JT", "RR", "SM"):
    _k = _kind.lower()
    ORACLE |= {
        f"isim_index_{_k}": _emb(_counters()) + f" select round({_INDEX[_kind]}, 8) as isim from k",
        f"comp_sim_{_k}": _emb(_scores(64, _kind)) + " select id, round(comp_sim, 8) as comp_sim from cs",
        f"pairwise_{_k}_avg_std": _emb(_PAIRS) + f" select round(avg({_PAIR[_kind]}), 8) as mean, round(stddev_pop({_PAIR[_kind]}), 8) as std from prs",
        f"real_isim_{_k}": _SCALED + _REAL + f" select round({_REAL_INDEX[_kind]}, 8) as isim from z",
        f"real_comp_sim_{_k}": _SCALED + _real_scores(_kind) + " select id, round(comp_sim, 8) as comp_sim from cs",
        f"real_pairwise_{_k}": _SCALED + _REAL_PAIRS + f" select round(avg({_REAL_PAIR[_kind]}), 8) as mean, round(stddev_pop({_REAL_PAIR[_kind]}), 8) as std from prs",
        f"sigma_{_k}": _emb() + _sigma(64, _kind),
    }

ORACLE |= {
    "isim_index": _emb(_counters()) + f" select n, round({_INDEX['JT']}, 8) as jt, round({_INDEX['RR']}, 8) as rr, round({_INDEX['SM']}, 8) as sm from k",
    "isim_basket": _basket(_counters()) + " " + _ALL,
    "isim_packed": _packed(_counters()) + " " + _ALL,
    "isim_all_indices": _emb(_counters()) + " " + _ALL,
    "isim_counters": _emb(_counters()) + " select n, round(a, 8) as a, round(d, 8) as d, round(total_dis, 8) as total_dis, round(total_sim, 8) as total_sim, round(p, 8) as p from k",
    "isim_counters_k2": _emb(_counters(2)) + " select n, round(a, 8) as a, round(d, 8) as d, round(total_dis, 8) as total_dis, round(total_sim, 8) as total_sim, round(p, 8) as p from k",
    "isim_by_label": """with e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as bit from embeddings),
c as (select label, bit, count(*) as n, count(*) filter (x > 0) as c from e group by label, bit),
k as (select label, sum(c * (c - 1) / 2.0)::double as a, sum((n - c) * c)::double as total_dis from c group by label)
select label, round(a / nullif(a + total_dis, 0), 8) as isim from k""",
    "centroid_by_label": """with e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as bit from embeddings)
select label, bit::int as bit from e group by label, bit having count(*) filter (x > 0) * 2 >= count(*)""",
    "column_sums": _packed() + " select bit::int as bit, c from c",
    "pack_words": _emb() + """ select ids.id, coalesce(sum(case when bit < 63 then (1::hugeint << bit) when bit = 63 then -9223372036854775808::hugeint end), 0)::bigint as word
from ids left join fp on fp.id = ids.id group by ids.id""",
    "unpack_bits": _packed() + " select id, count(*) as n_on, sum(bit)::bigint as bit_sum from fp group by id",
    "popcounts": _W + f" select id, {_ON.format('words')}::int as n_on from w",
    "flip_counts": "select vec_id as id, len(list_filter(embedding, lambda x: not x > 0))::int as n_off from embeddings",
    "union_words": _emb() + " select bit::int as bit, c from c",
    "comp_sim_packed": _packed(_scores(256)) + " select id, round(comp_sim, 8) as comp_sim from cs",
    "medoid": _emb(_scores(64)) + " select id, round(comp_sim, 8) as comp_sim from cs order by cs.comp_sim, id limit 1",
    "outlier": _emb(_scores(64)) + " select id, round(comp_sim, 8) as comp_sim from cs order by cs.comp_sim desc, id limit 1",
    "sample_medoid": _SAMPLE + f" select id from r where rank < floor({_K10})",
    "sample_outlier": _SAMPLE + f" select id from r where rank >= n - floor({_K10})",
    "sample_extremes": _SAMPLE + " select id, 'low' as side from r where rank < floor(n * 5.0 / 100) union all select id, 'high' from r where rank >= n - floor(n * 5.0 / 100)",
    "sample_stratified": _SAMPLE + _strata(f"(select floor({_K10})::int from nn)", f"floor({_K10})") + "select ord::int as ord, id from st where ord <= k",
    "sample_strata7": _SAMPLE + _strata("7", f"floor({_K10})") + "select ord::int as ord, id from st where ord <= k",
    "sample_quota": _SAMPLE + _QUOTA + "select ord::int as ord, id from q where ord <= k",
    "sample_quota_soft": _SAMPLE + _QUOTA + "select ord::int as ord, id from q where pos <= (select min(pos) from (select pos, sum(count(*)) over (order by pos) as seen, any_value(k) as k from q group by pos) where seen >= k)",
    "sample_medoid_packed": _packed(_scores(256) + _RANKED) + " select id from r where rank < floor(n * 1.0 / 100)",
    "pairwise_matrix": _emb(_PAIRS) + f" select i, j, round({_PAIR['JT']}, 8) as sim from prs union all select id, id, 1.0 from ids",
    "one_against_many": _W + f""", q as (select words as qw from w order by id limit 1),
t as (select id, {_ON.format('words')} as a, {_ON.format('qw')} as b, list_sum([bit_count(words[i] & qw[i]) for i in range(1, len(words) + 1)]) as x from w, q)
select id, round(x::double / nullif(a + b - x, 0), 8) as sim from t""",
    "topk_neighbors": _emb(_PAIRS) + f""", two as (select i, j, {_PAIR['JT']} as sim from prs union all select j, i, {_PAIR['JT']} from prs),
r as (select i as id, j as neighbour, sim, row_number() over (partition by i order by sim desc, j) as rank from two where i % 50 = 0)
select id, neighbour, round(sim, 8) as sim, rank::int as rank from r where rank <= 5""",
    "minmax": _SCALED + " select id, pos::int as pos, round(x, 8) as x from v",
    "minmax_descriptors": _RV + " select id, pos::int as pos, round(x, 8) as x from v",
    "drop_nan_columns": _RV + """, good as (select bit, row_number() over (order by bit) - 1 as pos from lim where not bad)
select id, good.pos::int as pos, round(e.x, 8) as x from e join good on e.bit = good.bit""",
    "real_isim_descriptors": _RV + _REAL + f" select round({_REAL_INDEX['JT']}, 8) as isim from z",
    "real_medoid": _SCALED + _real_scores("JT") + " select id, round(comp_sim, 8) as comp_sim from cs order by cs.comp_sim, id limit 1",
    "real_outlier": _SCALED + _real_scores("JT") + " select id, round(comp_sim, 8) as comp_sim from cs order by cs.comp_sim desc, id limit 1",
    "real_pair_functions": _SCALED + """, t as (select id, count(*) as m, sum(x * (1 - x)) as xy, sum(x * x) as xx, sum((1 - x) * (1 - x)) as yy, sum(x * x * x) as x3 from v group by id)
select id, round(xy / (xx + yy - xy), 8) as jt, round(xy / m, 8) as rr, round(2 * xy / m, 8) as sm, round(x3 / 10, 8) as rr10 from t""",
    "sigma_packed": _packed() + _sigma(256, "RR"),
    "cooccurrence": _basket() + " select a.bit::int as i, b.bit::int as j, count(*) as c from fp a join fp b on a.id = b.id and a.bit < b.bit group by 1, 2",
    "stratified_sigma": _emb(_scores(64) + _RANKED) + _strata("(select floor(n * (5000.0 / n) / 100)::int from nn)", "floor(n * (5000.0 / n) / 100)") + f""", ids2 as (select id from st where ord <= k),
fp2 as (select * from fp where id in (select id from ids2)), sz as (select ids2.id, count(fp2.bit) as k from ids2 left join fp2 on fp2.id = ids2.id group by ids2.id),
dots as (select a.id as i, b.id as j, count(*) as x from fp2 a join fp2 b on a.bit = b.bit and a.id < b.id group by 1, 2),
prs as (select a.k as ka, b.k as kb, coalesce(x, 0) as x from sz a join sz b on a.id < b.id left join dots on dots.i = a.id and dots.j = b.id)
select round(avg({_PAIR['JT']}), 8) as mean, round(stddev_pop({_PAIR['JT']}), 8) as std from prs""",
    "csv_round_trip": """select count(*) as n, sum(length(NAME))::bigint as "NAME_chars", sum(length(SMILES_n))::bigint as "SMILES_n_chars", sum(length(SMILES))::bigint as "SMILES_chars",
  count(NAME) as "NAME_given", count(SMILES) as "SMILES_given", count(logPN) as "logPN_given", count(distinct NAME) as names, count(distinct SMILES) as structures from logp_data""",
    "mixed_layouts": _emb() + """, q as (select bit from fp where id = (select min(id) from ids)), sz as (select ids.id, count(fp.bit) as k from ids left join fp on fp.id = ids.id group by ids.id),
x as (select fp.id, count(*) as x from fp join q on q.bit = fp.bit group by fp.id)
select sz.id, round(coalesce(x, 0)::double / nullif(k + (select count(*) from q) - coalesce(x, 0), 0), 8) as sim from sz left join x on x.id = sz.id""",
    "centroid_of_ids": """with e as (select unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as bit from embeddings where label = 3)
select bit::int as bit from e group by bit having count(*) filter (x > 0) * 2 >= count(*)""",
    "npy_round_trip": _packed() + " select id, bit::int as bit from fp",
    "sample_random": "select vec_id as id from embeddings order by md5('1:' || vec_id), vec_id limit 50",
    "random_sigma": _emb() + f""", ids2 as (select id from ids order by md5('1:' || id), id limit 50),
fp2 as (select * from fp where id in (select id from ids2)), sz as (select ids2.id, count(fp2.bit) as k from ids2 left join fp2 on fp2.id = ids2.id group by ids2.id),
dots as (select a.id as i, b.id as j, count(*) as x from fp2 a join fp2 b on a.bit = b.bit and a.id < b.id group by 1, 2),
prs as (select a.k as ka, b.k as kb, coalesce(x, 0) as x from sz a join sz b on a.id < b.id left join dots on dots.i = a.id and dots.j = b.id)
select round(avg({_PAIR['JT']}), 8) as mean, round(stddev_pop({_PAIR['JT']}), 8) as std from prs""",
    "stream_isim": f"""with w as (select row_number() over () as id, words from fp_packed where id is not null and words is not null),
fp as (select id, bit from w, range(256) t(bit) where ((words[bit // 64 + 1] >> (bit % 64)) & 1) = 1), ids as (select id from w), {_sums(256)}{_counters()}
select n, round(a / (a + total_dis), 8) as isim from k""",
}

ORACLE |= cluster_sql.ORACLE
