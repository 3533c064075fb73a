"""Building blocks of the SQL that DuckDB checks queries with."""

from __future__ import annotations

TOKENS = """
numbered as (select *, row_number() over (partition by label order by vec_id) as rn from embeddings),
tokens as (
  select label::bigint as source, (rn - 1) // 16 as frame, ((rn - 1) % 16) // 4 as row, (rn - 1) % 4 as col, vec_id,
    list_transform(embedding, lambda x: x::double) as feat
  from numbered
)"""

#: features rescaled, so that lengths have a spread and real outliers
SCALED = """
scaled as (
  select source, frame, row, col, vec_id, list_transform(feat, lambda x: x * f) as feat
  from (select *, 1 + (vec_id % 11 - 5) / 50.0::double + (case when vec_id % 37 = 0 then 9 else 0 end) as f from tokens)
)"""

#: the candidate's features: the baseline's with a small regular disturbance
OTHER = """
other as (
  select source, frame, row, col, vec_id,
    list_transform(feat, lambda x, i: x + 0.01::double * ((i - 1 + vec_id) % 7 - 3)) as feat
  from tokens
)"""


def long(source: str, name: str, weight: str = "1.0::double") -> str:
    """(vec_id, w, i, v): a row for each component."""
    return f"{name} as (select vec_id, {weight} as w, unnest(range(1, len(feat) + 1)) as i, unnest(feat) as v from {source})"


def basis(x: str, p: str, k: int = 3, canonical: bool = True, squarings: int = 12) -> str:
    """CTEs p_mean(i, m) and p_comps(c, i, v): the leading directions of a long table's scatter, by squaring the
    matrix again and again, taking its largest column, and taking that direction out."""
    out = [
        f"{p}_mean as materialized (select i, sum(w * v) / greatest(sum(w), 1e-12) as m from {x} group by i)",
        f"{p}_c as materialized (select x.vec_id, x.w, x.i, x.v - m.m as v from {x} x join {p}_mean m using (i))",
        f"{p}_s0 as materialized (select a.i as i, b.i as j, sum(a.w * a.v * b.v) as v from {p}_c a join {p}_c b using (vec_id) group by a.i, b.i)",
    ]
    for c in range(k):
        s = f"{p}_s{c}"
        last = s
        for r in range(squarings):
            q = f"{p}_q{c}_{r}"
            out.append(
                f"{q} as materialized (select a.i as i, b.j as j, sum(a.v * b.v) / (select max(abs(v)) ** 2 from {last}) as v "
                f"from {last} a join {last} b on a.j = b.i group by a.i, b.j)"
            )
            last = q
        out.append(f"{p}_d{c} as materialized (select j from {last} where i = j order by v desc, j limit 1)")
        out.append(f"{p}_u{c} as materialized (select i, v / (select sqrt(sum(v * v)) from {last} where j = (select j from {p}_d{c})) as v from {last} where j = (select j from {p}_d{c}))")
        out.append(f"{p}_e{c} as materialized (select sum(a.v * s.v * b.v) as e from {s} s join {p}_u{c} a on a.i = s.i join {p}_u{c} b on b.i = s.j)")
        out.append(f"{p}_s{c + 1} as materialized (select s.i, s.j, s.v - (select e from {p}_e{c}) * a.v * b.v as v from {s} s join {p}_u{c} a on a.i = s.i join {p}_u{c} b on b.i = s.j)")
        sign = f"(select sign(v) from {p}_u{c} order by round(abs(v), 12) desc, i limit 1)" if canonical else "1"
        out.append(f"{p}_v{c} as materialized (select {c}::bigint as c, i, v * {sign} as v from {p}_u{c})")
    out.append(f"{p}_comps as materialized (" + " union all ".join(f"select * from {p}_v{c}" for c in range(k)) + ")")
    return ",\n".join(out)


def project(x: str, p: str, name: str) -> str:
    """(vec_id, c, z) for a long table under a basis."""
    return f"{name} as materialized (select x.vec_id, k.c, sum((x.v - m.m) * k.v) as z from {x} x join {p}_mean m using (i) join {p}_comps k using (i) group by x.vec_id, k.c)"


def spread(z: str, name: str, qs: tuple[float, float] = (0.02, 0.98)) -> str:
    return f"{name} as materialized (select c, quantile_cont(z, {qs[0]}) as lo, quantile_cont(z, {qs[1]}) as hi from {z} group by c)"


def colours(z: str, limits: str, name: str) -> str:
    one = lambda c: f"max(case when c = {c} then u end)"
    return (
        f"{name} as materialized (select vec_id, {one(0)} as r, {one(1)} as g, {one(2)} as b from "
        f"(select vec_id, c, greatest(0.0, least(1.0, (z - lo) / greatest(hi - lo, 1e-6))) as u from {z} join {limits} using (c)) group by vec_id)"
    )


def weighted(rows: str, name: str, part: str = "") -> str:
    """(part, x, w, id, n, cdf) in order: the plotting positions of weighted quantiles."""
    by = f"partition by {part} " if part else ""
    keep = f"{part}, " if part else ""
    return (
        f"{name} as materialized (select {keep}x, w, id, row_number() over ({by}order by x, id) as n, "
        f"(sum(w) over ({by}order by x, id) - w) / greatest(sum(w) over ({f'partition by {part}' if part else ''}) - w, 1e-12) as cdf from {rows})"
    )


def weighted_at(cdf: str, name: str, qs: str, part: str = "") -> str:
    """(part, q, value) from plotting positions; qs is a table with q."""
    keep, using = (f"{part}, ", f"p.{part} = {{}}.{part} and ") if part else ("", "")
    parts = f"(select distinct {part} from {cdf}) p, " if part else ""
    pk = f"p.{part}, " if part else ""
    group = f"group by p.{part}, q" if part else "group by q"
    return (
        f"{name} as materialized (select {keep.replace(part, 'e.' + part) if part else ''}e.q, case when e.q <= a0.cdf then a0.x when e.q >= z0.cdf then z0.x "
        f"else lo.x + least(1.0, greatest(0.0, (e.q - lo.cdf) / greatest(hi.cdf - lo.cdf, 1e-12))) * (hi.x - lo.x) end as value "
        f"from (select {pk}q, least(coalesce(min(case when d.cdf >= q then d.n end), max(d.n)), max(d.n)) as hi, max(d.n) as last from {parts}{qs}, {cdf} d "
        f"{'where d.' + part + ' = p.' + part if part else ''} {group}) e "
        + "".join(f"join {cdf} {t} on {('e.' + part + ' = ' + t + '.' + part + ' and ') if part else ''}{t}.n = {n} " for t, n in (("hi", "e.hi"), ("lo", "greatest(e.hi - 1, 1)"), ("a0", "1"), ("z0", "e.last")))
        + ")"
    )


LAB = """
  case when r <= 0.04045 then r / 12.92 else ((r + 0.055) / 1.055) ** 2.4 end as lr,
  case when g <= 0.04045 then g / 12.92 else ((g + 0.055) / 1.055) ** 2.4 end as lg,
  case when b <= 0.04045 then b / 12.92 else ((b + 0.055) / 1.055) ** 2.4 end as lb"""


def lab(rows: str, name: str, keys: str) -> str:
    """keys, L, A, B of a table with keys, r, g, b in [0, 1]."""
    f = lambda t: f"case when {t} > 216.0::double / 24389 then cbrt({t}) else (24389.0::double / 27 * {t} + 16) / 116 end"
    return f"""{name}_l as (select {keys}, {LAB} from {rows}),
{name}_x as (select {keys},
  (0.4124::double * lr + 0.3576::double * lg + 0.1805::double * lb) / 0.95047::double as x,
  (0.2126::double * lr + 0.7152::double * lg + 0.0722::double * lb) as y,
  (0.0193::double * lr + 0.1192::double * lg + 0.9505::double * lb) / 1.08883::double as z from {name}_l),
{name}_f as (select {keys}, {f('x')} as fx, {f('y')} as fy, {f('z')} as fz from {name}_x),
{name} as materialized (select {keys}, 116 * fy - 16 as l, 500 * (fx - fy) as a, 200 * (fy - fz) as bb from {name}_f)"""


def angles(p: str, q: str, name: str) -> str:
    """(i, degrees): principal angles between the spans of two bases p and q of three directions, the smallest first,
    from the eigenvalues of the 3 x 3 matrix of their products with its transpose, in closed form."""
    m = lambda a, b: f"max(case when a = {a} and b = {b} then v end)"
    cells = ", ".join(f"{m(a, b)} as m{a}{b}" for a in range(3) for b in range(3))
    s = lambda a, b: " + ".join(f"m{a}{k} * m{b}{k}" for k in range(3))
    sym = ", ".join(f"{s(a, b)} as s{a}{b}" for a in range(3) for b in range(a, 3))
    return f"""{name}_m as materialized (select a.c as a, b.c as b, sum(a.v * b.v) as v from {p}_comps a join {q}_comps b using (i) group by all),
{name}_s as (select {sym} from (select {cells} from {name}_m)),
{name}_q as (select *, (s00 + s11 + s22) / 3 as q from {name}_s),
{name}_p as (select *, sqrt(((s00 - q) ** 2 + (s11 - q) ** 2 + (s22 - q) ** 2 + 2 * (s01 ** 2 + s02 ** 2 + s12 ** 2)) / 6) as p from {name}_q),
{name}_r as (select *, ((s00 - q) * ((s11 - q) * (s22 - q) - s12 ** 2) - s01 * (s01 * (s22 - q) - s12 * s02) + s02 * (s01 * s12 - (s11 - q) * s02)) / (2 * greatest(p, 1e-300) ** 3) as r from {name}_p),
{name}_f as (select q, p, acos(greatest(-1, least(1, r))) / 3 as phi from {name}_r),
{name} as materialized (select i, degrees(acos(sqrt(greatest(0, least(1, q + 2 * p * cos(phi + case i when 0 then 0 when 1 then 4 * pi() / 3 else 2 * pi() / 3 end)))))) as degrees from {name}_f, (select unnest(range(3)) as i))"""
