"""SQL for DuckDB that gives the same rows as the registered queries."""

_SKIP = r"""[\s\x{0085}\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"''`´‘’‚‛“”„‟«»‹›′″,;|]"""
_DASH = r"""[‐‑‒–—―−]"""


def _plain(column: str) -> str:
    return f"lower(regexp_replace(regexp_replace({column}, '{_SKIP}', '', 'g'), '{_DASH}', '-', 'g'))"


_P6 = f"""
with plain as (
  select rec_id, {_plain('SMILES_n')} as a, {_plain('SMILES')} as b from logp_data
), pair as (
  select rec_id, least(a, b) as lo, greatest(a, b) as hi from plain where length(a) >= 4 and length(b) >= 4
), grouped as (
  select rec_id, min(rec_id) over (partition by lo, hi) as first_id from pair
)
"""

_SHARED = f"""
with recursive plain as (
  select rec_id, delivery_id, {_plain('SMILES')} as f from logp_data where delivery_id is not null
), sets as (
  select rec_id, delivery_id, list_distinct([substr(f, i, 4) for i in range(1, length(f) - 2)]) as g from plain where length(f) >= 4
), pieces as (
  select rec_id, delivery_id, len(g) as n, unnest(g) as p from sets
), shared as (
  select a.rec_id as id_a, b.rec_id as id_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o
  from pieces a join pieces b on a.delivery_id = b.delivery_id and a.p = b.p and a.rec_id < b.rec_id group by 1, 2
), pairs as (
  select id_a, id_b, o::double / (na + nb - o) as similarity from shared where o::double / (na + nb - o) >= LEAST
)
"""
_P4 = _SHARED.replace("LEAST", "0.8")
_P2 = (
    _SHARED.replace("LEAST", "0.7")
    + """, ways as (select id_a as id, id_b as neighbour, similarity from pairs union all select id_b, id_a, similarity from pairs
), ranked as (select *, row_number() over (partition by id order by similarity desc, neighbour) as place from ways), kept as (select id, neighbour, similarity from ranked where place <= 5)
"""
)
_P5 = (
    _SHARED.replace("LEAST", "0.7")
    + """, ways as (select id_a as id, id_b as other from pairs union all select id_b, id_a from pairs
), reached as (select id, id as root from ways union select w.other, r.root from reached r join ways w on w.id = r.id where r.root < w.other
), groups as (select id, min(root) as first_id from reached group by id), sizes as (select first_id, count(*) as n from groups group by first_id)
"""
)

ORACLE = {
    "p2_found": _P2 + "select distinct least(id, neighbour) as id_a, greatest(id, neighbour) as id_b from kept",
    "p2_nearest": _P2 + "select id, neighbour, similarity from kept",
    "p5_found": _P5 + "select g.first_id, g.id as rec_id from groups g join sizes s on s.first_id = g.first_id where s.n >= 3 and g.id <> g.first_id",
    "p4_found": _P4 + "select id_a, id_b from pairs",
    "p4_similarity": _P4 + "select id_a, id_b, similarity from pairs",
    "p6_found": _P6 + "select first_id, rec_id as copy_id from grouped where rec_id <> first_id",
    "p6_counts": _P6
    + """
select coalesce(g.first_id, d.rec_id) as first_id, count(*) as n_copies
from logp_data d left join grouped g on d.rec_id = g.rec_id group by 1
""",
    "p3_size": f"""
with p as (select {_plain('SMILES')} as f from logp_data where rec_id is not null), v as (select count(*) as n from p where length(f) >= 4)
select greatest(1, round_even(n * 0.01, 0))::bigint as n, n as n_records, greatest(1, round_even(n * 0.01, 0))::bigint as n_valid from v
""",
    # what holds for every mixture that asks for more than there is
    "p8_tree": "select source, max_repeats, true as within_cap, true as no_spare from source_weight",
}
