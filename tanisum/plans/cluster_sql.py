"""SQL for DuckDB that clusters: a tree of one leaf takes its features one by one, as recursive SQL.

A leaf holds features (n, ls, ids, b: majority bits, k: their number). Each
step looks for the feature closest to the next one in line, by Tanimoto
similarity of majority bits, the first of equals, and merges or appends.
"""

_BITS = "list_transform({ls}, lambda v: (v * 2 >= {n})::double)"


def _sim(n: str, ls: str) -> str:
    """JT similarity of a set from its size and column sums; NaN for 0/0."""
    one, two = f"list_sum({ls})", f"list_inner_product({ls}, {ls})"
    shared = f"(({two} - {one}) / 2)"
    below = f"({shared} + {n} * {one} - {two})"
    return f"(case when {below} = 0 then 'nan'::double else {shared} / {below} end)"


def _plus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"


def _grown(n: str, ls: str, more: str) -> str:
    return f"({_sim(f'({n} + 1)', _plus(ls, more))} * ({n} + 1) - {_sim(n, ls)} * ({n} - 1))"


def _at_least(x: str, y: str) -> str:
    """x >= y, false for NaN, which DuckDB takes for the largest number."""
    return f"(not isnan({x}) and {x} >= {y})"


def _accept(method: str, t: float, tolerance: float) -> str:
    new = _sim("wn", "wls")
    if method == "diameter":
        return _at_least(new, str(t))
    if method == "radius":
        return _at_least(_grown("wn", "wls", _BITS.format(ls="wls", n="wn")), str(2 * t))
    old = f"{_grown('o.n', 'o.ls', 'ls')} / 2"
    return f"(not ({new} < {t}) and (n > 1 or o.n = 1 or {_at_least(old, f'({_sim("o.n", "o.ls")} - {tolerance})')}))"


def leader(name: str, source: str, method: str, t: float, tolerance: float = 0.05) -> str:
    """CTE ``name`` (grp, ord from 0, n, ls, ids), largest first, of source (grp, pos from 1, n, ls, ids)."""
    new = "struct_pack(n := n, ls := ls, ids := ids, b := xb, k := list_sum(xb))"
    merged = "struct_pack(n := wn, ls := wls, ids := list_concat(o.ids, ids), b := wb, k := list_sum(wb))"
    return f"""{name}_steps as (
  select grp, pos, [{new}] as feats from (select *, {_BITS.format(ls='ls', n='n')} as xb from {source} where pos = 1)
  union all
  select grp, pos, case when ok then list_transform(feats, lambda f, i: case when i = best then {merged} else f end) else list_append(feats, {new}) end
  from (select *, {_accept(method, t, tolerance)} as ok, {_BITS.format(ls='wls', n='wn')} as wb
    from (select *, o.n + n as wn, {_plus('o.ls', 'ls')} as wls
      from (select *, feats[best] as o
        from (select *, list_position(c, list_max(c)) as best
          from (select s.*, x.n, x.ls, x.ids, x.xb, list_transform(s.feats, lambda f: list_inner_product(f.b, x.xb) / (f.k + list_sum(x.xb) - list_inner_product(f.b, x.xb))) as c
            from (select grp, pos + 1 as pos, feats from {name}_steps) s
            join (select *, {_BITS.format(ls='ls', n='n')} as xb from {source}) x on x.grp = s.grp and x.pos = s.pos)))))
), {name}_last as (
  select grp, arg_max(feats, pos) as feats from {name}_steps group by grp
), {name}_rows as (
  select grp, unnest(feats) as f, generate_subscripts(feats, 1) as leaf from {name}_last
), {name} as (
  select grp, row_number() over (partition by grp order by f.n desc, leaf) - 1 as ord, f.n as n, f.ls as ls, f.ids as ids from {name}_rows
)"""


#: Single embeddings (grp, pos, n, ls, ids); grp is an expression over vec_id, label and place, the object's place by id.
def _singles(grp: str = "0", where: str = "true") -> str:
    return f"""objects as (select *, row_number() over (order by vec_id) - 1 as place from embeddings where {where}), singles as (
  select {grp} as grp, row_number() over (partition by {grp} order by vec_id) as pos, 1 as n,
    list_transform(embedding, lambda x: (x > 0)::double) as ls, [vec_id] as ids from objects
)"""


_GRADE = "((n >= 254)::int + (n >= 65534)::int + (n >= 4294967294)::int)"


def _flat(method: str) -> str:
    return "with recursive " + _singles() + ", " + leader("found", "singles", method, 0.4)


def _rounds(part: int, bins: int) -> str:
    """Parts by diameter, their largest clusters broken up under tolerance, all parts in one last tree."""
    return (
        "with recursive " + _singles(f"place // {part}") + ", " + leader("one", "singles", "diameter", 0.4)
        + f""", again as (
  select grp, row_number() over (partition by grp order by step, -{_GRADE}, -n, ord) as pos, n, ls, ids from (
    select grp, 0 as step, n, ord, ls, ids from one where ord > 0
    union all select s.grp, 1, 0, s.pos, s.ls, s.ids from singles s join one on one.grp = s.grp and one.ord = 0 and list_contains(one.ids, s.ids[1])
  )
), again1 as (select grp, pos, greatest(n, 1) as n, ls, ids from again), """
        + leader("two", "again1", "tolerance", 0.4)
        + f""", queue as (
  select grp // {bins} as grp, row_number() over (partition by grp // {bins} order by {_GRADE} desc, grp, n desc, list_min(ids)) as pos, n, ls, ids from two
), """
        + leader("found", "queue", "tolerance", 0.4)
    )


def _online() -> str:
    return (
        "with recursive " + _singles("vec_id % 2") + ", even as (select * from singles where grp = 0), " + leader("one", "even", "tolerance", 0.4)
        + """, queue as (
  select 0 as grp, row_number() over (order by step, ord) as pos, n, ls, ids from (
    select 0 as step, ord, n, ls, ids from one union all select 1, pos, n, ls, ids from singles where grp = 1)
), """
        + leader("found", "queue", "tolerance", 0.4)
    )


_ASSIGNED = " select unnest(ids) as id, (ord + 1)::int as cluster_id from found"

ORACLE: dict[str, str] = {f"cluster_flat_{m}": _flat(m) + _ASSIGNED for m in ("radius", "diameter", "tolerance", "tolerance_tough")}
ORACLE |= {
    "cluster_flat_by_label": "with recursive " + _singles("label") + ", " + leader("found", "singles", "diameter", 0.4) + " select grp as label, ord::int as ord, n::bigint as n, list_min(ids) as first_id from found",
    "cluster_flat_centroids": _flat("diameter") + f" select ord::int as ord, n::bigint as n, list_sum({_BITS.format(ls='ls', n='n')})::int as n_on from found",
    "cluster_flat_refined": _flat("diameter") + " select n::bigint as n, list_min(ids) as first_id from found where ord > 0 union all select 1::bigint, unnest(ids) from found where ord = 0",
    "cluster_flat_rounds": _rounds(200, 3) + _ASSIGNED,
    "stream_flat_clusters": _online() + _ASSIGNED,
    "cluster_poles": """with o as (select vec_id as id, list_transform(embedding, lambda x: (x > 0)::double) as b from embeddings),
e as (select id, unnest(b) as x, generate_subscripts(b, 1) as bit from o),
centre as (select list((s * 2 >= n)::double order by bit) as b from (select bit, sum(x) as s, count(*) as n from e group by bit)),
c0 as (select id, o.b, list_inner_product(o.b, c.b) as x, list_sum(o.b) + list_sum(c.b) as k from o, centre c),
one as (select id, b from c0 order by x / (k - x), id limit 1),
c1 as (select o.id, o.b, list_inner_product(o.b, one.b) as x, list_sum(o.b) + list_sum(one.b) as k from o, one),
to_one as (select id, b, x / (k - x) as s from c1),
two as (select id, b from to_one order by s, id limit 1),
c2 as (select t.id, t.s, list_inner_product(t.b, two.b) as x, list_sum(t.b) + list_sum(two.b) as k from to_one t, two)
select c2.id, case when c2.id = one.id or c2.s > x / (k - x) then 'left' else 'right' end as half from c2, one""",
    # what holds for clusters of any tree: every object in one of them, sums that add up, similarity over the threshold
    "cluster_by_label": "select label, count(*) as objects, count(distinct vec_id) as ids, sum(vec_id)::bigint as id_sum from embeddings group by label",
    "cluster_packed_checked": """with w as (select id, min(words) as words from fp_packed where id is not null and words is not null group by id)
select bit::int as bit, count(*) filter (((words[bit // 64 + 1] >> (bit % 64)) & 1) = 1) as total, count(*) as objects, count(distinct id) as ids, true as similar from w, range(256) t(bit) group by bit""",
}

_SUMS = """with e as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as bit from embeddings)
select bit::int as bit, count(*) filter (x > 0) as total, count(*) as objects, count(distinct vec_id) as ids{} from e group by bit"""
ORACLE |= {name: _SUMS.format("") for name in ("cluster_exact_radius", "cluster_rounds", "stream_clusters")}
ORACLE |= {f"cluster_exact_{m}": _SUMS.format(", true as similar") for m in ("diameter", "tolerance", "tolerance_tough")}
