"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

_VEC = "v0 as (select vec_id as page_id, cast(label as bigint) as label, embedding::double[] as e from embeddings where len(embedding) = 64)"
_CLIP = "cast(greatest(0, least(255, floor({}))) as int)"
_GRAY64 = f"""{_VEC},
ev as (select page_id, label, unnest(e) as v, generate_subscripts(e, 1) - 1 as i from v0),
px as (select a.page_id, a.i as y, b.i as x, {_CLIP.format('28 * a.label + 10 + 5 * (1 + a.page_id % 8) * (a.v + b.v)')} as v from ev a join ev b using (page_id))"""
_GRAY8 = f"""{_VEC},
ev as (select page_id, unnest(e) as v, generate_subscripts(e, 1) - 1 as i from v0),
px as (select page_id, i // 8 as y, i % 8 as x, {_CLIP.format('(v + 0.6) * 212.5')} as v from ev)"""
_NOISY8 = f"""{_VEC},
ev as (select page_id, unnest(e) as v, generate_subscripts(e, 1) - 1 as i from v0),
px as (select page_id, i // 8 as y, i % 8 as x, {_CLIP.format('128 + 212.5 * v * (1 + page_id % 10) / 40')} as v from ev)"""
_COLOR64 = f"""{_VEC},
ev as (select page_id, label, unnest(e) as v, generate_subscripts(e, 1) - 1 as i from v0),
cx as (select a.page_id, a.i as y, b.i as x,
  {_CLIP.format('172 + 8 * a.label + 4 * (1 + a.page_id % 12) * a.v')} as b,
  {_CLIP.format('172 + 8 * a.label + 4 * (1 + a.page_id % 12) * b.v')} as g,
  {_CLIP.format('172 + 8 * a.label + 4 + 4 * (1 + a.page_id % 12) * (b.v + a.v) / 2')} as r
  from ev a join ev b using (page_id)),
hx as (select *, greatest(b, g, r) as val, case when greatest(b, g, r) = 0 then 0 else cast(floor((greatest(b, g, r) - least(b, g, r)) * 255.0::double / greatest(b, g, r) + 0.5) as int) end as sat from cx)"""
_LIN = "case when {0} / 255.0::double <= 0.04045 then {0} / 255.0::double / 12.92::double else pow(({0} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end"
_BEND = "case when {0} > 0.008856 then cbrt({0}) else 7.787::double * {0} + 16.0::double / 116.0::double end"
_LAB = f""", lx as (select *, {_LIN.format('r')} as lr, {_LIN.format('g')} as lg, {_LIN.format('b')} as lb from hx),
xyz as (select *, (0.412453::double * lr + 0.357580::double * lg + 0.180423::double * lb) / 0.950456::double as cx_, 0.212671::double * lr + 0.715160::double * lg + 0.072169::double * lb as cy_, (0.019334::double * lr + 0.119193::double * lg + 0.950227::double * lb) / 1.088754::double as cz_ from lx),
fx as (select *, {_BEND.format('cx_')} as fx_, {_BEND.format('cy_')} as fy_, {_BEND.format('cz_')} as fz_ from xyz),
ab as (select *, greatest(0, least(255, floor(500.0::double * (fx_ - fy_) + 128.0::double + 0.5))) as la, greatest(0, least(255, floor(200.0::double * (fy_ - fz_) + 128.0::double + 0.5))) as lbb from fx)"""
_SIGMA = """, h as (select *, coalesce(lag(v) over wx, v) - 2 * v + coalesce(lead(v) over wx, v) as c from px window wx as (partition by page_id, y order by x)),
u as (select page_id, abs(coalesce(lag(c) over wy, c) - 2 * c + coalesce(lead(c) over wy, c)) as a from h window wy as (partition by page_id, x order by y)),
noise as (select page_id, cast(sum(a) as double) * sqrt(0.5 * pi()) / (6.0 * 6 * 6) as sigma from u group by page_id)"""
_MOIRE = """, tiles as (select page_id, y // 6 as ty, x // 6 as tx, sat < 40 as low, sqrt((la - 128) * (la - 128) + (lbb - 128) * (lbb - 128)) as c from ab where y < 60 and x < 60),
spread as (select page_id, ty, tx, stddev_pop(c) filter (low) as s from tiles group by all having avg(low::int) > 0.5 and sum(low::int) > 20),
moire as (select p.page_id, coalesce(max(s.s), 0.0) as moire from (select distinct page_id from v0) p left join spread s using (page_id) group by p.page_id)"""
_QUADS = f"""{_VEC},
qp as (select page_id, label, c, (c + page_id % 4) % 4 as slot,
  (case when c in (0, 3) then 10.0 + 20 * label else 1000.0 - (10.0 + 20 * label) end)::double + 60.0::double * (1 + page_id % 20) * e[2 * c + 1] as x,
  (case when c in (0, 1) then 10.0 + 20 * label else 1000.0 - (10.0 + 20 * label) end)::double + 60.0::double * (1 + page_id % 20) * e[2 * c + 2] as y
  from v0, range(4) t(c)),
qc as (select *, avg(x) over (partition by page_id) as mx, avg(y) over (partition by page_id) as my from qp),
qa as (select *, row_number() over (partition by page_id order by atan2(y - my, x - mx), slot) - 1 as rn from qc),
qs as (select *, first_value(rn) over (partition by page_id order by x + y, rn) as start from qa),
rect as (select page_id, mx, my, (rn - start + 4) % 4 as k, x, y from qs),
ring as (select page_id, k, x, y, mx, my, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny,
  coalesce(lag(x) over w, last_value(x) over (partition by page_id order by k rows between unbounded preceding and unbounded following)) as px,
  coalesce(lag(y) over w, last_value(y) over (partition by page_id order by k rows between unbounded preceding and unbounded following)) as py
  from rect window w as (partition by page_id order by k))"""
_JUDGED = """, turns as (select *, degrees(atan2(ny - y, nx - x)) as t, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) as side, sqrt((px - x) * (px - x) + (py - y) * (py - y)) as back from ring),
measured as (select *, ((t % 90) + 90) % 90 as a, degrees(acos(greatest(-1, least(1, ((px - x) * (nx - x) + (py - y) * (ny - y)) / (side * back + 1e-6))))) as angle from turns),
judged as (select page_id, abs(sum(x * ny - nx * y)) / 2 as area, abs(sum(x * ny - nx * y)) / 2 / 1000000.0 as coverage, max(least(a, 90 - a)) as skew,
  bool_and(angle between 55 and 125) and greatest(max(side) filter (k in (0, 2)) / (min(side) filter (k in (0, 2)) + 1e-6), max(side) filter (k in (1, 3)) / (min(side) filter (k in (1, 3)) + 1e-6)) <= 2.6 as plausible,
  max(side) filter (k in (0, 2)) as wide, max(side) filter (k in (1, 3)) as tall, max(x) filter (k = 0) as tl_x, max(y) filter (k = 0) as tl_y from measured group by page_id)"""
_EDITS = """ed as (select user_id as page_id, ts, event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
  case event_type when 'click' then 'recrop' when 'view' then 'rotate' when 'error' then 'demoire' when 'signup' then 'mode' else case when cast(json_extract_string(props, '$.k') as bigint) = 0 then 'delete' else 'export' end end as op,
  row_number() over (partition by user_id order by ts, event_id) as n from events)"""
_STATE = """select page_id,
  cast(coalesce(sum(case when op = 'rotate' and n > coalesce(crop, 0) then 90 * (k % 4) end), 0) % 360 as int) as rotation,
  coalesce(arg_max(case when op = 'mode' then ['color', 'gray', 'bw'][k % 3 + 1] end, case when op = 'mode' then n end), 'color') as mode,
  arg_max(case when op = 'recrop' then k / 400.0::double end, case when op = 'recrop' then n end) as inset,
  arg_max(case when op = 'demoire' then k % 2 = 1 end, case when op = 'demoire' then n end) as demoire,
  bool_or(op = 'delete') as deleted, cast(count(*) filter (op = 'export') as bigint) as n_exports, cast(count(*) as bigint) as n_edits
  from (select *, max(case when op = 'recrop' then n end) over (partition by page_id) as crop from {}) group by page_id"""
_CAT = """cat as (select md5(concat_ws('|', l_orderkey::bigint, l_linenumber::bigint, l_partkey::bigint, l_suppkey::bigint, trunc(l_quantity)::bigint, trunc(l_extendedprice)::bigint)) as id,
  l_orderkey as session_id, cast(l_linenumber as int) as "order", l_returnflag = 'R' as deleted, l_linestatus = 'O' as passthrough,
  100 - cast(round(l_discount * 500) as int) as pct, l_shipdate as created_at from lineitem)"""

_GATE = f"""with {_GRAY64},
hx as (select *, coalesce(lag(v) over wx, lead(v) over wx) as l, coalesce(lead(v) over wx, lag(v) over wx) as r from px window wx as (partition by page_id, y order by x)),
ds as (select page_id, x, y, v, r - l as d, l + 2 * v + r as s from hx),
gs as (select page_id, x, y, v, coalesce(lag(d) over wy, lead(d) over wy) + 2 * d + coalesce(lead(d) over wy, lag(d) over wy) as gx, coalesce(lead(s) over wy, lag(s) over wy) - coalesce(lag(s) over wy, lead(s) over wy) as gy from ds window wy as (partition by page_id, x order by y)),
tiles as (select page_id, y // 8 as ty, x // 8 as tx, avg(cast(gx * gx + gy * gy as double)) as m, avg((v >= 250)::int) as hot from gs group by all),
ranked as (select *, row_number() over (partition by page_id order by m desc, ty, tx) as n from tiles),
one as (select page_id, avg(m) filter (n <= 6) as sharpness, cast(count(*) filter (hot >= 0.6) as int) as glare_hot_tiles from ranked group by page_id)
"""

_CHROMA = f"""with {_COLOR64} {_LAB},
g as (select page_id, la - 128.0::double as da, lbb - 128.0::double as db, greatest(0.0, least(1.0, (sqrt((la - 128.0::double) * (la - 128.0::double) + (lbb - 128.0::double) * (lbb - 128.0::double)) - 12.0::double) / 18.0::double)) as s from ab),
o as (select page_id, cast(floor(128.0::double + da * s) as int) as a, cast(floor(128.0::double + db * s) as int) as b from g)
select page_id, cast(sum(a) as bigint) as sum_a, cast(sum(b) as bigint) as sum_b, cast(count(*) filter (a <> 128 or b <> 128) as bigint) as colored from o group by page_id"""

_PDF = r"""t as (select conv_id as session_id, turn, encode(text) as b from conversations where role <> 'system' and octet_length(encode(coalesce(text, ''))) > 0),
px as (select session_id, row_number() over (partition by session_id order by turn) - 1 as rank, count(*) over (partition by session_id) as n, (octet_length(b) + 63) // 64 as h, b || unhex(repeat('FF', cast((octet_length(b) + 63) // 64 * 64 - octet_length(b) as int))) as px from t),
sess as (select session_id, max(n) as n from px group by session_id),
wl as (select session_id, n, l, (n + 4 ** l - 1)::bigint // (4 ** l)::bigint as w, (n + 4 ** (l - 1) - 1)::bigint // (4 ** (l - 1))::bigint as below from sess, range(1, 7) r(l)),
lv as (select *, cast(3 + 3 * n + coalesce(sum(w) over (partition by session_id order by l rows between unbounded preceding and 1 preceding), 0) as bigint) as base from wl where l = 1 or below > 1),
nd as (select session_id, n, l, w, base, below, unnest(range(w)) as j from lv),
nx as (select nd.*, case when nd.w = 1 then 2 else nd.base + nd.j end as number, case when nd.w = 1 then '' else '/Parent ' || case when up.w = 1 then 2 else up.base + nd.j // 4 end || ' 0 R ' end as above,
  list_transform(range(least(4, nd.below - 4 * nd.j)), lambda i: case when nd.l = 1 then 3 + 3 * (4 * nd.j + i) else down.base + 4 * nd.j + i end || ' 0 R') as kids, least((4 ** nd.l)::bigint, nd.n - nd.j * (4 ** nd.l)::bigint) as c
  from nd left join lv up on up.session_id = nd.session_id and up.l = nd.l + 1 left join lv down on down.session_id = nd.session_id and down.l = nd.l - 1),
nt as (select session_id, l, j, number, number || ' 0 obj' || chr(10) || '<< /Type /Pages ' || above || '/Kids [' || array_to_string(kids, ' ') || '] /Count ' || c || ' >>' || chr(10) || 'endobj' || chr(10) as text from nx),
size as (select *, 3 + 3 * rank as k, case when n <= 4 then 2 else 3 + 3 * n + rank // 4 end as up, (64 * 1440000 + 200) // 400 as qw, (h * 1440000 + 200) // 400 as qh from px),
pts as (select *, qw // 10000 || '.' || lpad((qw % 10000)::varchar, 4, '0') as pw, qh // 10000 || '.' || lpad((qh % 10000)::varchar, 4, '0') as ph from size),
drawn as (select *, 'q ' || pw || ' 0 0 ' || ph || ' 0 0 cm /I Do Q' as d from pts),
ob as (select session_id, n, rank, k,
  k || ' 0 obj' || chr(10) || '<< /Type /Page /Parent ' || up || ' 0 R /MediaBox [0 0 ' || pw || ' ' || ph || '] /Contents ' || k + 1 || ' 0 R /Resources << /XObject << /I ' || k + 2 || ' 0 R >> >> >>' || chr(10) || 'endobj' || chr(10) as o1,
  k + 1 || ' 0 obj' || chr(10) || '<< /Length ' || length(d) || ' >>' || chr(10) || 'stream' || chr(10) || d || chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10) as o2,
  encode(k + 2 || ' 0 obj' || chr(10) || '<< /Type /XObject /Subtype /Image /Width 64 /Height ' || h || ' /ColorSpace /DeviceGray /BitsPerComponent 8 /Length ' || 64 * h || ' >>' || chr(10) || 'stream' || chr(10)) || px || encode(chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10)) as o3 from drawn),
pg as (select *, cast(9 + coalesce(sum(length(o1) + length(o2) + octet_length(o3)) over (partition by session_id order by rank rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from ob),
pend as (select session_id, cast(9 + sum(length(o1) + length(o2) + octet_length(o3)) as bigint) as e from ob group by session_id),
np as (select nt.*, cast(e + coalesce(sum(length(text)) over (partition by nt.session_id order by l, j rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from nt join pend using (session_id)),
fin as (select session_id, n, top, top + length(ttext) as root, top + length(ttext) + 49 as x, nodes + 3 * n + 1 as c from (select np.session_id, arg_max(pos, l) as top, arg_max(text, l) as ttext, count(*) as nodes from np group by np.session_id) join sess using (session_id)),
fx as (select *, c + 1 || ' 0 obj' || chr(10) || '<< /Type /XRef /Size ' || c + 2 || ' /W [1 8 0] /Root 1 0 R /Length ' || 9 * (c + 2) || ' >>' || chr(10) || 'stream' || chr(10) as opening, chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10) || 'startxref' || chr(10) || x || chr(10) || '%%EOF' || chr(10) as closing from fin),
fe as (select *, x + length(opening) as entries from fx)"""

ORACLES: dict[str, str] = {
    "gate_tiles": f"""{_GATE}select page_id, round(sharpness, 6) as sharpness, glare_hot_tiles, 64 as long_edge,
  concat_ws(',', case when sharpness < 500 then 'blur' end, case when glare_hot_tiles > 2 then 'glare' end, 'low_resolution') as flags, false as passed,
  round_even(1.0::double - 0.15::double * (1 + (sharpness < 500)::int + (glare_hot_tiles > 2)::int), 3) as confidence from one""",
    "gate_lines": f"""{_GATE}select page_id, round(sharpness, 6) as sharpness, glare_hot_tiles, 64 as long_edge,
  concat_ws(',', case when sharpness < 500 then 'blur' end, case when glare_hot_tiles > 2 then 'glare' end, 'low_resolution') as flags, false as passed from one""",
    "noise_sigma": f"with {_GRAY8} {_SIGMA} select page_id, round(sigma, 6) as sigma from noise",
    "page_noise": f"with {_GRAY8} {_SIGMA} select page_id, round(sigma, 6) as sigma from noise",
    "moire_score": f"with {_COLOR64} {_LAB} {_MOIRE} select page_id, round(moire, 5) as moire from moire",
    "adaptive_params": f"""with {_NOISY8} {_SIGMA}, {_COLOR64.replace(_VEC + ',', '').replace('ev as', 'ev2 as').replace('from ev a join ev b', 'from ev2 a join ev2 b')} {_LAB} {_MOIRE}
select page_id, round(round_even(sigma, 2), 1) as noise_sigma, case when sigma < 2 then 'none' when sigma < 9 then 'bilateral' else 'nlm' end as denoise,
  case when sigma < 2 then 0 when sigma < 5 then 12 when sigma < 9 then 30 else 0 end as sigma_color,
  (case when moire >= 4.3 then least(0.40, case when sigma < 2 then 0.35 when sigma < 9 then 0.45 else 0.60 end) else case when sigma < 2 then 0.35 when sigma < 9 then 0.45 else 0.60 end end)::double as amount,
  0.8::double as radius, moire >= 4.3 as route_demoire from noise join moire using (page_id)""",
    "paper_fraction": f"""with {_COLOR64}
select page_id, round(avg((val > 200 and sat < 40)::int), 6) as clean_share, round(avg((val > 180 and sat < 45)::int), 6) as paper_share,
  avg((val > 200 and sat < 40)::int) > 0.75 as already_clean, avg((val > 180 and sat < 45)::int) >= 0.40 as document_like from hx group by page_id""",
    "page_sanity": f"""with {_COLOR64}, n as (select page_id, (b + g + r) // 3 as m, count(*) as n from cx group by all),
f as (select page_id, max(n) / sum(n)::double as share, page_id % 50 = 7 as blank from n group by page_id)
select page_id, case when blank then 0.0::double else 1.0::double end as aspect, case when blank then 1.0::double else round(share, 6) end as uniform_frac,
  case when blank then 'empty' when share > 0.98 then 'mostly_uniform' else '' end as flags, not blank and share <= 0.98 as passed from f""",
    "level_percentiles": f"with {_GRAY8} select page_id, round(quantile_cont(v, 0.04), 6) as lo, round(quantile_cont(v, 0.78), 6) as hi from px group by page_id",
    "level_stretch": f"""with {_GRAY64}, lv as (select page_id, quantile_cont(v, 0.04) as lo, quantile_cont(v, 0.78) as hi from px group by page_id),
st as (select page_id, x, y, case when hi - lo < 1 then v else cast(floor(greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 223 + 32) as int) end as v from px join lv using (page_id))
select page_id, cast(sum(v::bigint * (x + 1) * (y + 1)) as bigint) as weighted_sum, max(v) as top, min(v) as bottom from st group by page_id""",
    "edge_thresholds": f"""with {_GRAY64}, m as (select page_id, quantile_cont(v, 0.5) as median from px group by page_id)
select page_id, median, cast(trunc(greatest(0.0, (1.0::double - 0.33::double) * median)) as int) as low, cast(trunc(least(255.0, (1.0::double + 0.33::double) * median)) as int) as high from m""",
    "page_thresholds": f"""with {_GRAY64}, m as (select page_id, quantile_cont(v, 0.5) as median from px group by page_id)
select page_id, cast(trunc(greatest(0.0, (1.0::double - 0.33::double) * median)) as int) as low, cast(trunc(least(255.0, (1.0::double + 0.33::double) * median)) as int) as high from m""",
    "black_white": f"""with {_GRAY64}, pad as (select t.i, case when t.i < 0 then -t.i when t.i > 63 then 126 - t.i else t.i end as k from range(-12, 76) t(i)),
wide as (select page_id, ay.i as y, ax.i as x, v::double as v from px join pad ay on px.y = ay.k join pad ax on px.x = ax.k),
rows as (select page_id, y, x, v, sum(v) over w as s1, sum(v * v) over w as s2 from wide window w as (partition by page_id, y order by x rows between 12 preceding and 12 following)),
sums as (select page_id, y, x, v, sum(s1) over w / 625 as m, sum(s2) over w / 625 as q from rows window w as (partition by page_id, x order by y rows between 12 preceding and 12 following)),
white as (select page_id, y, x from sums where y between 0 and 63 and x between 0 and 63 and v > m * (1 + 0.2::double * (sqrt(greatest(0, q - m * m)) / 127.5::double - 1)))
select page_id, cast(count(y) as bigint) as white, cast(coalesce(sum((y + 1) * (x + 1)), 0) as bigint) as weighted_sum from v0 left join white using (page_id) group by page_id""",
    "sauvola_lines": f"""with {_GRAY8}, pad as (select t.i, case when ((t.i % 14) + 14) % 14 < 8 then ((t.i % 14) + 14) % 14 else 14 - ((t.i % 14) + 14) % 14 end as k from range(-12, 20) t(i)),
wide as (select page_id, ay.i as y, ax.i as x, v::double as v from px join pad ay on px.y = ay.k join pad ax on px.x = ax.k),
rows as (select page_id, y, x, v, sum(v) over w as s1, sum(v * v) over w as s2 from wide window w as (partition by page_id, y order by x rows between 12 preceding and 12 following)),
sums as (select page_id, y, x, v, sum(s1) over w / 625 as m, sum(s2) over w / 625 as q from rows window w as (partition by page_id, x order by y rows between 12 preceding and 12 following)),
white as (select page_id, y, x from sums where y between 0 and 7 and x between 0 and 7 and v > m * (1 + 0.2::double * (sqrt(greatest(0, q - m * m)) / 127.5::double - 1)))
select page_id, cast(count(y) as bigint) as white, cast(coalesce(sum((y + 1) * (x + 1)), 0) as bigint) as weighted_sum from v0 left join white using (page_id) group by page_id""",
    "contrast_lines": f"""with {_GRAY64},
cnt as (select page_id, y // 8 as ty, x // 8 as tx, v, count(*) as n from px group by all),
sp as (select page_id, ty, tx, sum(greatest(n - 1, 0)) as spare from cnt group by all),
lut as (select sp.page_id, sp.ty, sp.tx, l.v, sum(least(coalesce(n, 0), 1) + spare // 256 + case when l.v % greatest(1, 256 // greatest(spare % 256, 1)) = 0 and l.v // greatest(1, 256 // greatest(spare % 256, 1)) < spare % 256 then 1 else 0 end) over (partition by sp.page_id, sp.ty, sp.tx order by l.v) as s
  from sp cross join range(256) l(v) left join cnt on cnt.page_id = sp.page_id and cnt.ty = sp.ty and cnt.tx = sp.tx and cnt.v = l.v),
t as (select page_id, ty, tx, v, least(255, floor(s * (255.0::double / 64) + 0.5::double)) as t from lut),
pos as (select i, greatest(0.0::double, least(7.0::double, i / 8.0::double - 0.5::double)) as u from range(64) r(i)),
b as (select i, cast(floor(p.u) as int) + case when side = 1 and p.u < 7 then 1 else 0 end as k, case side when 0 then 1 - (p.u - floor(p.u)) else p.u - floor(p.u) end as f from pos p, range(2) s(side)),
near as (select px.page_id, px.y, px.x, px.v, byy.k as ty, bx.k as tx, byy.f * bx.f as f from px join b byy on byy.i = px.y join b bx on bx.i = px.x where byy.f * bx.f > 0),
o as (select near.page_id, near.y, near.x, sum(f * t.t) as v from near join t on t.page_id = near.page_id and t.ty = near.ty and t.tx = near.tx and t.v = near.v group by all)
select page_id, cast(sum(cast(floor(v + 0.5::double) as bigint) * (y + 1) * (x + 1)) as bigint) as weighted_sum from o group by page_id""",
    "background_close": f"""with {_GRAY8},
d as (select page_id, y, x, greatest(v, lag(v) over wx, lead(v) over wx, lag(v) over wy, lead(v) over wy) as v from px window wx as (partition by page_id, y order by x), wy as (partition by page_id, x order by y)),
e as (select page_id, y, x, least(v, lag(v) over wx, lead(v) over wx, lag(v) over wy, lead(v) over wy) as v from d window wx as (partition by page_id, y order by x), wy as (partition by page_id, x order by y))
select page_id, cast(sum(v * (y + 1) * (x + 1)) as bigint) as weighted_sum from e group by page_id""",
    "corner_heat": f"""with recursive {_GRAY8}, hot as (select page_id, y, x from px where v >= 160),
reach as (select page_id, y, x, y * 8 + x as root from hot union select h.page_id, h.y, h.x, r.root from reach r join hot h on h.page_id = r.page_id and abs(h.y - r.y) <= 1 and abs(h.x - r.x) <= 1),
own as (select page_id, y, x, min(root) as root from reach group by all),
blobs as (select page_id, root, count(*) as n, avg(x) as cx, avg(y) as cy from own group by all),
best as (select *, row_number() over (partition by page_id order by n desc, root) as k from blobs)
select v0.page_id, round(cx, 6) as x, round(cy, 6) as y from v0 left join (select * from best where k = 1) using (page_id)""",
    "shipped_model": f"""with recursive {_GRAY8}, hot as (select page_id, y, x from px where v >= 160),
reach as (select page_id, y, x, y * 8 + x as root from hot union select h.page_id, h.y, h.x, r.root from reach r join hot h on h.page_id = r.page_id and abs(h.y - r.y) <= 1 and abs(h.x - r.x) <= 1),
own as (select page_id, y, x, min(root) as root from reach group by all),
blobs as (select page_id, root, count(*) as n, avg(x) as cx, avg(y) as cy from own group by all),
best as (select *, row_number() over (partition by page_id order by n desc, root) as k from blobs)
select v0.page_id, round(cx, 6) as x, round(cy, 6) as y, false as broken from v0 left join (select * from best where k = 1) using (page_id)""",
    "moire_stage": f"with {_GRAY64} select page_id, cast(sum(cast(v // 2 as bigint) * (y + 1) * (x + 1)) as bigint) as weighted_sum from px group by page_id",
    "export_audit": "select 'scan.export' as action, 'conversations' as target, cast(count(distinct conv_id) as bigint) as sessions, cast(count(*) as bigint) as pages from conversations where role <> 'system'",
    "mask_regions": f"""with recursive {_GRAY64},
lit as (select page_id, y, x, x - row_number() over (partition by page_id, y order by x) as g from px join v0 using (page_id) where v > 28 * label + 11 + page_id % 8),
run as (select page_id, y, min(x) as s, max(x) as e, y * 1000 + min(x) as id from lit group by page_id, y, g),
touch as (select a.page_id, a.id as u, b.id as v from run a join run b on a.page_id = b.page_id and b.y = a.y - 1 and b.s <= a.e + 1 and b.e >= a.s - 1),
side as (select page_id, u, v from touch union all select page_id, v, u from touch),
reach as (select page_id, id, id as root from run union select r.page_id, s.v, r.root from reach r join side s on s.page_id = r.page_id and s.u = r.id),
own as (select page_id, id, min(root) as root from reach group by page_id, id),
box as (select page_id, root, sum(e - s + 1) as area, min(s) as l, min(y) as t, max(e) as r, max(y) as b, sum((e - s + 1) * (s + e)) / (2 * sum(e - s + 1))::double as cx, sum((e - s + 1) * y) / sum(e - s + 1)::double as cy from run join own using (page_id, id) group by page_id, root)
select page_id, cast(root // 1000 as bigint) as y, cast(root % 1000 as bigint) as x, cast(area as bigint) as area, cast(l as bigint) as "left", cast(t as bigint) as top, cast(r as bigint) as "right", cast(b as bigint) as bottom, round(cx, 6) as cx, round(cy, 6) as cy from box""",
    "hough_turns": f"""with {_VEC},
p as (select page_id, cast(floor(e[1] * 96) as bigint) as m, k, x from v0, range(1, 4) a(k), range(48) b(x)),
px as (select page_id, 40 * k + cast(floor(x * m / 64.0::double) as bigint) as y, x from p),
d as (select t, cast(round(cos(pi() * t / 180) * 65536) as bigint) as c, cast(round(sin(pi() * t / 180) * 65536) as bigint) as s from range(180) r(t)),
votes as (select page_id, t, cast(floor((x * c + y * s + 32768) / 65536.0::double) as bigint) as rho, count(*) as n from px, d group by all),
near as (select *, coalesce(max(n) over (partition by page_id, t order by rho range between 1 preceding and 1 preceding), 0) as a, coalesce(max(n) over (partition by page_id, t order by rho range between 1 following and 1 following), 0) as b,
  coalesce(max(n) over (partition by page_id, rho order by t range between 1 preceding and 1 preceding), 0) as c, coalesce(max(n) over (partition by page_id, rho order by t range between 1 following and 1 following), 0) as d from votes),
best as (select page_id, t - 90 as g, row_number() over (partition by page_id order by n desc, t, rho) as place from near where n > 30 and n > a and n >= b and n > c and n >= d),
mid as (select page_id, quantile_cont(g, 0.5) as turn from best where place <= 100 and g > -45 and g < 45 group by page_id)
select page_id, case when abs(turn) < 0.5 then 0.0 else turn end::double as turn from mid""",
    "tile_gaussian": f"""with {_GRAY64}, tap as (select d, exp(-(d * d) / 1.28::double) / sum(exp(-(d * d) / 1.28::double)) over () as t from range(-3, 4) r(d)),
near as (select p.i, d, t, case when p.i + d < 0 then -p.i - d when p.i + d > 63 then 126 - p.i - d else p.i + d end as k from range(64) p(i), tap),
across as (select page_id, y, i as x, sum(t * v) as v from px join near on px.x = near.k group by all),
down as (select page_id, i as y, x, sum(t * v) as v from across join near on across.y = near.k group by page_id, i, x)
select page_id, cast(sum(cast(floor(v + 0.5::double) as bigint) * (y + 1) * (x + 1)) as bigint) as weighted_sum, cast(count(*) as bigint) as pixels from down group by page_id""",
    "tile_warp": f"""with {_QUADS}, {_GRAY64.replace(_VEC + ',', '')},
c as (select page_id, max(x) filter (k = 0) * 0.064::double as x0, max(y) filter (k = 0) * 0.064::double as y0, max(x) filter (k = 1) * 0.064::double as x1, max(y) filter (k = 1) * 0.064::double as y1, max(x) filter (k = 2) * 0.064::double as x2, max(y) filter (k = 2) * 0.064::double as y2, max(x) filter (k = 3) * 0.064::double as x3, max(y) filter (k = 3) * 0.064::double as y3 from rect group by page_id),
s as (select *, greatest(1, round_even(greatest(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), sqrt((x2 - x3) * (x2 - x3) + (y2 - y3) * (y2 - y3))), 0)) as ow, greatest(1, round_even(greatest(sqrt((x3 - x0) * (x3 - x0) + (y3 - y0) * (y3 - y0)), sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 0)) as oh,
  x0 - x1 + x2 - x3 as sx, y0 - y1 + y2 - y3 as sy, x1 - x2 as ax, y1 - y2 as ay, x3 - x2 as bx, y3 - y2 as byy from c),
m as (select *, (sx * byy - bx * sy) / (ax * byy - bx * ay) as g, (ax * sy - sx * ay) / (ax * byy - bx * ay) as hh from s),
o as (select page_id, oy, ox, (x0 + (x1 - x0 + g * x1) * u + (x3 - x0 + hh * x3) * v) / (1 + g * u + hh * v) as sx, (y0 + (y1 - y0 + g * y1) * u + (y3 - y0 + hh * y3) * v) / (1 + g * u + hh * v) as sy
  from (select *, ox / (ow - 1)::double as u, oy / (oh - 1)::double as v from (select *, unnest(range(cast(ow as bigint))) as ox from (select *, unnest(range(cast(oh as bigint))) as oy from m)))),
q as (select page_id, oy, ox, a, b, cast(floor(sx) as bigint) + a as i, cast(floor(sy) as bigint) + b as j, (case when a = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) * (case when b = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) as t from o, range(2) ra(a), range(2) rb(b)),
val as (select q.page_id, oy, ox, sum(t * coalesce(px.v, 0)) as v from q left join px on px.page_id = q.page_id and px.x = q.i and px.y = q.j group by q.page_id, oy, ox)
select page_id, cast(sum(cast(floor(v + 0.5::double) as bigint) * (oy + 1) * (ox + 1)) as bigint) as weighted_sum, cast(count(*) as bigint) as pixels from val group by page_id""",
    "model_corners": f"""with {_QUADS},
mp as (select page_id, case when page_id % 5 = 0 and k = 2 then 420.0::double else x end as x, case when page_id % 5 = 0 and k = 2 then 430.0::double else y end as y from rect),
mc as (select *, atan2(y - avg(y) over (partition by page_id), x - avg(x) over (partition by page_id)) as a from mp),
mr as (select page_id, x, y, row_number() over (partition by page_id order by a) as k from mc),
m2 as (select a.page_id, a.x, a.y, b.x as nx, b.y as ny, c.x as ox, c.y as oy from mr a join mr b on a.page_id = b.page_id and b.k = a.k % 4 + 1 join mr c on a.page_id = c.page_id and c.k = (a.k + 1) % 4 + 1)
select page_id, abs(sum(x * ny - nx * y)) / 2 / 1000000.0 between 0.18 and 0.985 and bool_and((nx - x) * (oy - ny) - (ny - y) * (ox - nx) > 0) as plausible from m2 group by page_id""",
    "warp_coordinates": f"""with {_QUADS},
c as (select page_id, max(x) filter (k = 0) as x0, max(y) filter (k = 0) as y0, max(x) filter (k = 1) as x1, max(y) filter (k = 1) as y1, max(x) filter (k = 2) as x2, max(y) filter (k = 2) as y2, max(x) filter (k = 3) as x3, max(y) filter (k = 3) as y3 from rect group by page_id),
t as (select *, ((x1 - x0) * (y3 - y1) - (y1 - y0) * (x3 - x1)) / ((x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1)) as t from c)
select page_id, round(x0 + t * (x2 - x0), 4) as x, round(y0 + t * (y2 - y0), 4) as y from t""",
    "moire_borders": "with s as (select p_partkey, (32 - (p_size * 10 + p_partkey % 7) % 32) % 32 as spare from part) select p_partkey, cast(spare // 2 as int) as before, cast(spare - spare // 2 as int) as after from s",
    "chroma_gate": _CHROMA,
    "chroma_lines": _CHROMA,
    "page_grays": f"""with {_COLOR64} select page_id, cast(sum(cast(floor(0.114::double * b + 0.587::double * g + 0.299::double * r + 0.5::double) as int)) as bigint) as gray, cast(sum(sat) as bigint) as saturation, cast(sum(val) as bigint) as value from hx group by page_id""",
    "rotate_pages": f"""with {_GRAY8} select page_id, cast(sum(v * (1 + case page_id % 4 when 0 then y * 8 + x when 1 then x * 8 + 7 - y when 2 then (7 - y) * 8 + 7 - x else (7 - x) * 8 + y end)) as bigint) as weighted_sum from px group by page_id""",
    "quad_geometry": f"""with {_QUADS} {_JUDGED}, ints as (select page_id, k, trunc(x) as x, trunc(y) as y, trunc(nx) as nx, trunc(ny) as ny, trunc(px) as px, trunc(py) as py from ring),
cv as (select page_id, bool_and((x - px) * (ny - y) - (y - py) * (nx - x) > 0) or bool_and((x - px) * (ny - y) - (y - py) * (nx - x) < 0) as convex from ints group by page_id)
select page_id, round(tl_x, 6) as tl_x, round(tl_y, 6) as tl_y, round(coverage, 6) as coverage, round(skew, 6) as skew, coverage >= 0.92 and skew < 2.0 as skip_warp, plausible, convex from judged join cv using (page_id)""",
    "quad_expand": f"""with {_QUADS} select page_id, cast(k as int) as corner, round(greatest(0.0, least(999.0, mx + (x - mx) * 1.05::double)) / 1000.0, 6) as x, round(greatest(0.0, least(999.0, my + (y - my) * 1.05::double)) / 1000.0, 6) as y from rect""",
    "warp_dims": f"""with {_QUADS} {_JUDGED} select page_id, greatest(1, cast(round_even(wide, 0) as int)) as out_w, greatest(1, cast(round_even(tall, 0) as int)) as out_h from judged""",
    "detection_scale": "select p_partkey, round(least(1.0::double, 1500 / greatest(p_size * 100, p_partkey % 4000 + 1)::double), 9) as scale from part",
    "quad_choice": f"""with {_QUADS} {_JUDGED},
c as (select page_id, k, 1.0::double - 0.06::double * ((k * 5 + page_id) % 12) as s, area from judged, range(12) t(k)),
m as (select page_id, k % 2 as strategy, k // 2 as nth, area * s * s as a, area * s * s * (1.0::double + (k % 3) / 10.0::double) as ra, case when k % 3 = 0 then 'rect' else 'approx' end as method, s from c),
p as (select *, row_number() over (partition by page_id, strategy order by a desc, nth) as place from m),
ic as (select page_id, s, k, trunc(x * s) as x, trunc(y * s) as y, trunc(nx * s) as nx, trunc(ny * s) as ny, trunc(px * s) as px, trunc(py * s) as py from ring, (select distinct s from c)),
cv as (select page_id, s, bool_and((x - px) * (ny - y) - (y - py) * (nx - x) > 0) or bool_and((x - px) * (ny - y) - (y - py) * (nx - x) < 0) as convex from ic group by all),
f as (select p.*, a / 1000000.0 as cover from p join cv on cv.page_id = p.page_id and cv.s = p.s where convex and place <= 8 and a >= 0.18 * 1000000 and a / 1000000.0 between 0.18 and 0.985),
g as (select *, cover * (0.5 + 0.5 * a / ra) * (case when method = 'approx' then 1.0 else 0.85 end)::double as score from f)
select page_id, cast(strategy as int) as strategy, cast(nth as int) as nth, method, round(score, 6) as score from (select *, row_number() over (partition by page_id order by score desc, strategy, place) as n from g) where n = 1""",
    "quad_best": f"""with {_QUADS} {_JUDGED},
c as (select page_id, k, 1.0::double - 0.06::double * ((k * 5 + page_id) % 12) as s, area from judged, range(12) t(k)),
m as (select page_id, k % 2 as strategy, k // 2 as nth, area * s * s as a, area * s * s * (1.0::double + (k % 3) / 10.0::double) as ra, case when k % 3 = 0 then 'rect' else 'approx' end as method, s from c),
p as (select *, row_number() over (partition by page_id, strategy order by a desc, nth) as place from m),
ic as (select page_id, s, k, trunc(x * s) as x, trunc(y * s) as y, trunc(nx * s) as nx, trunc(ny * s) as ny, trunc(px * s) as px, trunc(py * s) as py from ring, (select distinct s from c)),
cv as (select page_id, s, bool_and((x - px) * (ny - y) - (y - py) * (nx - x) > 0) or bool_and((x - px) * (ny - y) - (y - py) * (nx - x) < 0) as convex from ic group by all),
f as (select p.*, a / 1000000.0 as cover from p join cv on cv.page_id = p.page_id and cv.s = p.s where convex and place <= 8 and a >= 0.18 * 1000000 and a / 1000000.0 between 0.18 and 0.985),
g as (select *, cover * (0.5 + 0.5 * a / ra) * (case when method = 'approx' then 1.0 else 0.85 end)::double as score from f)
select page_id, cast(strategy as int) as strategy, cast(nth as int) as nth, method, round(score, 6) as score from (select *, row_number() over (partition by page_id order by score desc, strategy, place) as n from g) where n = 1""",
    "page_decisions": f"""with {_QUADS} {_JUDGED}, {_NOISY8.replace(_VEC + ',', '')} {_SIGMA},
d as (select page_id, page_id as i, case when page_id % 3 = 0 then 'blur' when page_id % 7 = 0 then 'blur,glare' else '' end as gf, case when page_id % 3 = 0 then 1 when page_id % 7 = 0 then 2 else 0 end as ng,
  page_id % 11 = 0 as forced, page_id % 5 = 0 as clean, page_id % 4 <> 0 and page_id % 5 <> 0 and (plausible or page_id % 3 = 2) as quad, page_id % 3 as meth, coverage >= 0.92 and skew < 2.0 as skip, plausible as ok,
  round(sigma, 2) >= 9 as noisy, case when page_id % 6 = 0 then true when page_id % 6 = 1 then false else page_id % 13 = 0 end as routed, page_id % 17 = 0 as bad from judged join noise using (page_id)),
t as (select *, not forced and not quad and not clean as missing, not forced and quad and not skip and not ok as unsure, forced or (quad and not skip and ok) as warped, not forced and quad and not skip and ok and meth = 1 as approx from d)
select page_id, case when warped then 'warp' else 'deskew' end as step, (case when not warped then null when forced then 0.0 when meth = 2 then 0.02 else 0.05 end)::double as margin, not forced and quad as keeps_quad, routed,
  concat_ws(',', nullif(gf, ''), case when missing then 'boundary_not_found' end, case when unsure then 'geometry_uncertain' end, case when approx then 'approx_crop' end, case when noisy then 'noisy' end, case when routed then 'screen_moire' end, case when bad then 'sanity_mostly_uniform' end) as flags,
  round_even(greatest(0.0, 1.0::double - 0.15::double * ng - 0.25::double * missing::int - 0.30::double * unsure::int - 0.10::double * approx::int - 0.30::double * bad::int), 3) as confidence from t""",
    "upload_validate": """with u as (select 'p' || page_id as name, 'text/html' as mime, encode(html) as content from pages
  union all select 'd' || doc_id, case doc_id % 3 when 0 then 'application/pdf' when 1 then 'image/png' end, encode(text) from documents
  union all select name, mime, unhex(hex) from (values ('jpeg', null, 'FFD8FFE0'), ('png', null, '89504E470D0A1A0A00'), ('heic', 'text/plain', '0000001866747970686569630000'), ('pdf', null, '255044462D312E370A2525454F460A'), ('broken', 'image/png', '255044462D312E37'), ('empty', 'image/png', ''), ('unknown', 'text/plain', '00010203'), ('declared', 'image/heif', '00010203')) t(name, mime, hex)),
h as (select name, mime, cast(octet_length(content) as int) as length, hex(content) as x from u),
k as (select *, case when length = 0 then null when x like '255044462D%' then 'pdf' when x like 'FFD8FF%' or x like '89504E470D0A1A0A%' or substr(x, 9, 16) in ('6674797068656963', '6674797068656978', '667479706D696631', '667479706865696D', '6674797068657663') then 'image'
  when mime = 'application/pdf' then 'pdf' when mime in ('image/jpeg', 'image/png', 'image/heic', 'image/heif') then 'image' end as kind from h)
select name, length, kind, case when length = 0 then 'empty file' when kind is null then 'unsupported file type' when kind = 'pdf' and not regexp_matches(x, '^(..)*2525454F46') then 'malformed PDF' end as reject_reason from k""",
    "born_digital": r"select doc_id, coalesce(length(regexp_replace(text, '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) >= 30, false) as born_digital from documents",
    "page_order": "select conv_id as session_id, turn % 3 as upload, turn as page, cast(row_number() over (partition by conv_id order by turn % 3, turn) - 1 as int) as \"order\" from conversations",
    "page_rotation": f"with {_EDITS} select page_id, rotation from ({_STATE.format('ed')})",
    "page_state": f"with {_EDITS} select page_id, round(inset, 6) as inset, mode, demoire, deleted, n_exports, n_edits from ({_STATE.format('ed')})",
    "snapshot_state": f"with {_EDITS} select page_id, round(inset, 6) as inset, mode, demoire, deleted, n_exports, n_edits, rotation from ({_STATE.format('ed')})",
    "replayed_batches": "select source, cast(((doc_id % 3) + 3) % 3 as int) as batch, cast(count(*) as bigint) as n, cast(sum(doc_id) as bigint) as ids, cast(sum(octet_length(encode(text))) as bigint) as bytes from documents group by all",
    "changed_pages": f"""with {_EDITS}, early as (select * from ed where event_id <= (select max(event_id) / 2 from events)), a as ({_STATE.format('ed')}), b as ({_STATE.format('early')})
select a.page_id from a left join b on a.page_id = b.page_id and a.rotation = b.rotation and a.mode = b.mode and a.demoire is not distinct from b.demoire and a.inset is not distinct from b.inset where b.page_id is null""",
    "export_metrics": f"with {_CAT} select session_id, cast(count(*) as bigint) as pages, round_even(sum(pct) / (100.0::double * count(*)), 3) as mean_confidence, cast(count(*) filter (pct < 60) as bigint) as low_pages from cat where not deleted group by session_id",
    "session_pdf_objects": f"""with {_PDF}
select session_id, cast(k as bigint) as number, pos as at, cast(length(o1) as bigint) as length from pg union all select session_id, k + 1, pos + length(o1), length(o2) from pg union all select session_id, k + 2, pos + length(o1) + length(o2), octet_length(o3) from pg
union all select session_id, number, pos, length(text) from np union all select session_id, 1, root, 49 from fe union all select session_id, c + 1, x, length(opening) + 9 * (c + 2) + 18 from fe""",
    "session_pdfs": rf"""with {_PDF},
part as (select session_id, 0 as pos, encode('%PDF-1.5' || chr(10)) as data from fe union all select session_id, pos, encode(o1 || o2) || o3 from pg union all select session_id, pos, encode(text) from np
union all select session_id, root, encode('1 0 obj' || chr(10) || '<< /Type /Catalog /Pages 2 0 R >>' || chr(10) || 'endobj' || chr(10) || opening) || unhex(repeat('00', 9) || '01' || lpad(hex(root), 16, '0') || '01' || lpad(hex(top), 16, '0')) from fe
union all select pg.session_id, entries + 9 * k, unhex('01' || lpad(hex(pos), 16, '0') || '01' || lpad(hex(pos + length(o1)), 16, '0') || '01' || lpad(hex(pos + length(o1) + length(o2)), 16, '0')) from pg join fe using (session_id)
union all select np.session_id, entries + 9 * number, unhex('01' || lpad(hex(pos), 16, '0')) from np join fe using (session_id) where number > 2
union all select session_id, entries + 9 * (c + 1), unhex('01' || lpad(hex(x), 16, '0')) || encode(closing) from fe),
dig as (select session_id, cast(sum(('0x' || substr(md5(encode(pos || ':') || data), 1, 8))::bigint) as bigint) as digest, count(*) as parts from part group by session_id)
select session_id, n as pages, cast(c + 1 as bigint) as objects, cast(entries + 9 * (c + 2) + length(closing) as bigint) as size, digest, parts from fe join dig using (session_id)""",
    "live_pages": f"with {_CAT} select id, session_id, \"order\", cast(row_number() over (partition by session_id order by \"order\", id) as int) as place, pct / 100.0::double < 0.6 as low_confidence, passthrough, '/api/scans/' || session_id || '/pages/' || id || '/preview' as preview from cat where not deleted",
    "scan_pages": f"""with {_CAT}, l as (select session_id, count(*) as n, string_agg("order" || ':' || id, ',' order by "order", id, pct) as pages from cat where not deleted group by session_id)
select o_orderkey as session_id, cast(coalesce(n, 0) as int) as n_pages, coalesce(pages, '') as pages from orders left join l on o_orderkey = session_id""",
    "page_reorder": f"""with {_CAT}, one as (select distinct id, session_id, "order" from cat),
w as (select id, session_id, row_number() over (partition by session_id order by id desc) - 1 as pos from one where ('0x' || substr(id, 1, 2))::int % 2 = 0)
select one.id, one.session_id, cast(coalesce(pos, "order") as int) as "order" from one left join w using (id, session_id)""",
    "latest_pdf": f"with {_CAT} select session_id, arg_max('pdfs/' || id || '.pdf', (created_at, id)) as ref, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as created_at from cat where passthrough group by session_id",
    "edit_errors": f"""with {_CAT}, one as (select distinct id, session_id, deleted, passthrough, ('0x' || substr(id, 1, 3))::int as n from cat),
e as (select *, ['recrop', 'rotate', 'mode', 'demoire'][n % 4 + 1] as op, (n % 8) * 45 as degrees, ['color', 'gray', 'bw', 'sepia'][(n // 16) % 4 + 1] as mode, (n // 4) % 3 + 3 as corners from one)
select op, case when deleted then 'page not found' when passthrough and op in ('recrop', 'mode', 'demoire') then 'page passes through' when op = 'recrop' and corners <> 4 then 'four corners needed'
  when op = 'rotate' and degrees % 90 <> 0 then 'degrees must be a multiple of 90' when op = 'mode' and mode = 'sepia' then 'unknown mode' else '' end as error, cast(count(*) as bigint) as n from e group by all""",
    "low_confidence_pages": f"with {_CAT} select passthrough, cast(count(*) filter (pct < 60) as bigint) as low, cast(count(*) as bigint) as pages from cat where not deleted group by passthrough",
    "image_lookup": f"""with {_CAT}, one as (select distinct id, session_id, deleted, ('0x' || substr(id, 1, 2))::int as n from cat)
select id, case when n % 2 = 0 then 'originals/' else 'processed/' end || id || '.png' as ref from one where not deleted and n % 3 <> 0""",
    "export_handoff": f"with {_CAT} select session_id, 'pdfs/' || session_id || '.pdf' as ref, cast(count(*) as bigint) as pages, round_even(sum(pct) / (100.0::double * count(*)), 3) as mean_confidence from cat where not deleted group by session_id",
    "created_pages": f"""with {_CAT}, one as (select distinct id, session_id, "order", passthrough, pct from cat)
select id, session_id, "order", case when not passthrough then 'processed/' || id end as processed_ref, passthrough, case when passthrough then 1.0::double else pct / 100.0::double end as confidence,
  case when passthrough then 'born_digital' else 'blur' end as flags, case when passthrough then 'passthrough' else 'auto' end as ops, 0 as rotation, 'color' as mode, false as deleted
from one where session_id in (select o_orderkey from orders where o_orderkey % 2 = 0)""",
    "line_turn": "with e as (select label, unnest(embedding)::double * 90.0::double as d from embeddings) select label, round(quantile_cont(d, 0.5), 6) as turn from e where d > -45 and d < 45 group by label",
}
