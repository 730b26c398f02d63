"""The queries' results as DuckDB SQL."""

from __future__ import annotations

_PX = "select event_id // 1000 as frame_idx, event_id % 1000 as p, cast(floor(value) as bigint) & 255 as b, user_id & 255 as g, cast(floor(value * 100) as bigint) & 255 as r from events"
_SMALL = "select event_id // 8 as frame_idx, event_id % 8 as p, cast(floor(value) as bigint) & 255 as b, user_id & 255 as g, cast(floor(value * 100) as bigint) & 255 as r from events"
_PL = f"""px as ({_PX}), dc as (select frame_idx, p, (b - g) & 255 as b, g, (r - g) & 255 as r from px),
pl as (select frame_idx, 0 as ch, p, b as v from dc union all select frame_idx, 1, p, g from dc union all select frame_idx, 2, p, r from dc)"""
_MEDIAN = "greatest(least(l, u), least(greatest(l, u), l + u - c))"
_RES = f"""{_PL}, near as (select *, lag(v, 1) over w as l, lag(v, 50) over w as u, lag(v, 51) over w as c from pl window w as (partition by frame_idx, ch order by p)),
res as (select frame_idx, ch, p, (v - (case when p = 0 then 0 when p < 50 then l when p = 50 then u else {_MEDIAN} end)) & 255 as d from near)"""
_FQ = f"{_RES}, fq as (select frame_idx, ch, cast(d as integer) as symbol, count(*) as freq from res group by all)"
_RS = f"""{_FQ}, n as (select *, sum(freq) over (partition by frame_idx, ch) as n from fq),
t as (select *, cast(2 ** ceil(log2(n)) as bigint) as t from n),
f as (select *, case when t = n then freq else cast(floor(freq * (t / cast(n as double))) as bigint) end as f from t),
k as (select *, t - sum(f) over w as rest, count(*) filter (symbol < 128 and f > 0) over w as low from f window w as (partition by frame_idx, ch)),
i as (select *, case when f > 0 and (symbol < 128 or low = 0) then 1 else 0 end as i from k),
j as (select *, sum(i) over (partition by frame_idx, ch) as m, sum(i) over (partition by frame_idx, ch order by symbol) as j from i),
rs as (select frame_idx, ch, symbol, cast(f + case when i = 1 then rest // m + case when j <= rest % m then 1 else 0 end else 0 end as bigint) as freq,
  cast(round(log2(t)) as integer) as scale from j)"""
_DENSE = "select g.frame_idx, g.ch, cast(s.symbol as integer) as symbol, coalesce(x.freq, 0) as freq from (select distinct frame_idx, ch from {0}) g cross join (select unnest(range(256)) as symbol) s left join {0} x on x.frame_idx = g.frame_idx and x.ch = g.ch and x.symbol = s.symbol"
_CODE = "(case when x <= 1 then 2 when x <= 3 then 3 when x < 16 then 4 when x < 128 then 5 when x < 4096 then 6 else 7 end + cast(floor(log2(x)) as bigint))"
_SP = "select event_id // 1000 as frame_idx, 0 as ch, event_id % 1000 as p, case when event_type = 'purchase' then cast(floor(value) as bigint) & 255 else 0 end as v from events"
_RUNS = f"""sp as ({_SP}), num as (select *, row_number() over (partition by frame_idx, ch order by p) as n from sp),
isl as (select frame_idx, ch, p, n - row_number() over (partition by frame_idx, ch order by p) as i from num where v = 0),
runs as (select frame_idx, ch, min(p) as start_p, count(*) as len from isl group by frame_idx, ch, i)"""
_ENC = "((len - 1) // {m} * {k} + case when len - (len - 1) // {m} * {m} >= {l} then {k} else len - (len - 1) // {m} * {m} end)"
_LEN = f"""{_RUNS}, rl as (select frame_idx, ch, sum(len) as z, sum({_ENC.format(m=256, k=2, l=1)}) as r1, sum({_ENC.format(m=258, k=4, l=3)}) as r3 from runs group by all),
ln as (select s.frame_idx, s.ch, s.length, cast(s.length - coalesce(z, 0) + coalesce(r1, 0) as bigint) as len1, cast(s.length - coalesce(z, 0) + coalesce(r3, 0) as bigint) as len3, s.tail
  from (select frame_idx, ch, count(*) as length, count(*) filter (v <> 0 and p > 0) as tail from sp group by all) s left join rl on rl.frame_idx = s.frame_idx and rl.ch = s.ch)"""
_DIMS = "select p_partkey as clip, cast(p_size * 16 as bigint) as width, p_partkey % 1081 as height, case p_partkey % 3 when 0 then 24 when 1 then 32 else 16 end as bpp from part"
_SOLID = """select cast(n_nationkey as bigint) as frame_idx, cast(n_regionkey as bigint) as b, cast(case when n_nationkey % 2 = 0 then n_regionkey else n_nationkey end as bigint) as g,
  cast(case when n_nationkey % 2 = 0 then n_regionkey else 7 end as bigint) as r from nation"""
_FILL = f"select frame_idx, b, g, r, p from ({_SOLID}) cross join (select unnest(range(16)) as p)"
_GREY = "b = g and g = r"

_BYTES = """b as (select lang, unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents),
counted as (select lang, cast('0x' || h as integer) as symbol, count(*) as freq from b group by all)"""
_CLAMPED = """n as (select *, sum(freq) over (partition by lang) as n from fq),
f as (select *, case when n <= 524288 then freq else greatest(1, cast(floor(freq * (524288 / cast(n as double))) as bigint)) end as f from n),
k as (select *, case when n > 524288 then 524288 - sum(f) over (partition by lang) else 0 end as rest, count(*) filter (f > 1) over (partition by lang) as m,
  count(*) filter (f > 1) over (partition by lang order by symbol) as j, f - 1 as e from f),
o as (select *, coalesce(sum(e) over (partition by lang order by e, symbol rows between unbounded preceding and 1 preceding), 0) as less,
  count(*) over (partition by lang order by e, symbol rows between current row and unbounded following) as here from k),
q as (select *, coalesce((select arg_max((-x.rest - x.less) // x.here, x.here) from o x where x.lang is not distinct from o.lang and x.rest < 0 and x.less + x.e * x.here > -x.rest), 0) as level from o),
t as (select *, -rest - sum(least(e, level)) over (partition by lang) as left_over, count(*) filter (e > level) over (partition by lang order by symbol) as turn from q)
select lang, cast(0 as integer) as ch, symbol, cast(f + case when f > 1 and rest > 0 then rest // m + case when j <= rest % m then 1 else 0 end
  when rest < 0 then -least(e, level) - case when e > level and turn <= left_over then 1 else 0 end else 0 end as bigint) as freq from t"""

SQL: dict[str, str] = {
    "frame_catalog": f"select frame_idx, cast(50 as bigint) as width, cast(20 as bigint) as height, count(*) as n_pixels from ({_PX}) group by frame_idx",
    "frame_lookup": f"select * from ({_PX}) where frame_idx = 0",
    "frame_append": f"with px as ({_PX}) select * from px union all select frame_idx + (select max(frame_idx) + 1 from px), (19 - p // 50) * 50 + p % 50, r, g, b from px",
    "dims_compatible": f"select width, height, count(*) as clips, count(distinct bpp) as formats, min(clip) as first_clip from ({_DIMS}) where width between 1 and 65535 and height between 1 and 65535 and bpp in (24, 32) group by width, height",
    "max_size": f"select clip, width * height * 3 + ((width * height * 3) >> 16) + 256 as max_compressed_size from ({_DIMS})",
    "transcode_rgbx": f"select *, cast(255 as bigint) as x from ({_PX})",
    "transcode_rgb": _PX,
    "flip_swizzle": f"select frame_idx, (19 - p // 50) * 50 + p % 50 as p, r as b, g, b as r from ({_PX})",
    "decorrelate_planes": f"with {_PL} select * from pl",
    "recorrelate_pixels": _PX,
    "predict_residual": f"with {_RES} select * from res",
    "predict_residual_mixed": f"""with {_PL}, near as (
  select frame_idx, ch, p, v, lag(v, 1) over w as l, 50 as w, lag(v, 50) over w as u, lag(v, 51) over w as c from pl where frame_idx % 2 = 0 window w as (partition by frame_idx, ch order by p)
  union all select frame_idx, ch, p, v, lag(v, 1) over w, 40, lag(v, 40) over w, lag(v, 41) over w from pl where frame_idx % 2 = 1 window w as (partition by frame_idx, ch order by p))
select frame_idx, ch, p, (v - (case when p = 0 then 0 when p < w then l when p = w then u else {_MEDIAN} end)) & 255 as d from near""",
    "predict_restore": f"with {_PL} select * from pl",
    "restore_first_row": f"with {_PL} select * from pl where p < 50",
    "byte_histogram": "select doc_id, cast('0x' || h as integer) as symbol, count(*) as freq from (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents) group by all",
    "residual_histogram": f"with {_FQ} select * from fq",
    "freq_clamp": f"with {_BYTES}, fq as (select * from counted), {_CLAMPED}",
    "freq_clamp_rare": f"""with {_BYTES}, fq as (select l.lang, s.symbol, cast(coalesce(c.freq, 0) * 1000 + 1 as bigint) as freq
  from (select distinct lang from documents) l cross join (select cast(unnest(range(256)) as integer) as symbol) s left join counted c on c.lang is not distinct from l.lang and c.symbol = s.symbol), {_CLAMPED}""",
    "freq_rescale": f"with {_RS} select * from rs",
    "freq_cumulative": f"with {_RS}, dn as ({_DENSE.format('rs')}) select frame_idx, ch, symbol, freq, cast(coalesce(sum(freq) over (partition by frame_idx, ch order by symbol rows between unbounded preceding and 1 preceding), 0) as bigint) as cum from dn",
    "header_bits": f"""with {_FQ}, dn as ({_DENSE.format('fq')}), z as (select frame_idx, ch, symbol - row_number() over (partition by frame_idx, ch order by symbol) as i from dn where freq = 0),
zr as (select frame_idx, ch, count(*) as x from z group by frame_idx, ch, i),
al as (select frame_idx, ch, {_CODE} as bits from (select frame_idx, ch, freq + 1 as x from fq) union all select frame_idx, ch, 2 + {_CODE} from zr)
select frame_idx, ch, cast(sum(bits) as bigint) as bits, cast((sum(bits) + 7) // 8 as bigint) as bytes from al group by frame_idx, ch""",
    "header_roundtrip": f"with {_FQ} select * from fq",
    "zero_runs": f"with {_RUNS} select * from runs",
    "rle_lengths": f"with {_LEN} select frame_idx, ch, length, len1, len3 from ln",
    "rle_level_choice": f"with {_LEN} select frame_idx, ch, length, len1, len3, case when tail = 0 then -1 when length * 197 // 200 <= len3 then 0 when len3 * 100 // length <= 32 and len1 < len3 * 98 // 100 then 1 else 3 end as level from ln",
    "rle_roundtrip": f"select frame_idx, level, ch, p, v from ({_SP}) cross join (select unnest([1, 3]) as level)",
    "range_roundtrip": f"with {_RES} select * from res",
    "channel_roundtrip": _SP,
    "solid_classify": f"""with al as ({_FILL} union all select frame_idx + 1000, b, g, r, p from ({_PX})),
x as (select frame_idx, min(b) = max(b) and min(g) = max(g) and min(r) = max(r) as solid, min(b) as b, min(g) as g, min(r) as r from al group by frame_idx)
select frame_idx, case when solid and {_GREY} then 'grey' when solid then 'colour' else 'general' end as kind,
  case when solid then b end as b, case when solid then g end as g, case when solid then r end as r from x""",
    "solid_fill": _FILL,
    "solid_roundtrip": f"select frame_idx, case when {_GREY} then 'grey' else 'colour' end as kind, p, b, g, r from ({_FILL})",
    "codec_roundtrip": _PX,
    "codec_roundtrip_rgbx": f"select *, cast(255 as bigint) as x from ({_PX})",
    "codec_whole_frames": _PX,
    "damaged_frames": f"""select frame_idx, cast(0 as bigint) as copy, p, b, g, r, false as damaged from ({_PX})
union all select frame_idx, copy, null, null, null, null, true from (select distinct frame_idx from ({_PX})) cross join (select unnest(range(1, 5)) as copy)""",
    "append_modes": f"""with px as ({_PX}), n as (select coalesce(max(frame_idx) + 1, 0) as n from px)
select cast(m.mode as bigint) as mode, px.frame_idx + k.k * n.n as frame_idx, p, b, g, r, cast(case when m.mode <> 32 then null when k.k = 1 then 7 else 255 end as bigint) as x
from px cross join n cross join (select unnest([0, 24, 32]) as mode) m cross join (select unnest([0, 1, 2]) as k) k""",
    "raster_equality": f"""select frame_idx, count(*) as n_pixels, count(*) filter (p % 7 <> 0 or p % 256 = 0) as n_equal, count(*) = count(*) filter (p % 7 <> 0 or p % 256 = 0) as equal from ({_PX}) group by frame_idx""",
    "incomplete_frames": f"""select event_id // 1000 as frame_idx, count(*) as n_pixels, count(distinct event_id % 1000) as n_places from events
where event_type = 'view' or event_id < 1000 group by 1 having count(distinct event_id % 1000) <> 1000""",
    "container_sizes": "select doc_id as frame_idx, cast(50 as integer) as width, cast(20 as integer) as height, cast(octet_length(encode(text)) as integer) as size from documents",
    "container_index": """with x as (select source as clip, doc_id, n_chars as size, 4 + coalesce(sum(8 + n_chars + n_chars % 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as o from documents)
select clip, doc_id, size, cast(o as bigint) as rel_offset, cast(o + 228 as bigint) as payload_offset from x""",
    "container_stats": """with x as (select source as clip, count(*) as n, max(n_chars) as m, sum(n_chars + n_chars % 2) as s from documents group by source)
select clip, n as frame_count, m as suggested_buffer_size, cast(least(m * 60, s) as bigint) as max_bytes_per_sec, cast(s + 8 * n + 4 as bigint) as movi_size, cast(s + 8 * n + 224 + 16 * n as bigint) as riff_size from x""",
    "container_roundtrip": _PX,
    "image_roundtrip": _PX,
    "container_lookup": f"select * from ({_PX}) where frame_idx = 0",
    "compressed_copy": f"with px as ({_PX}) select * from px union all select frame_idx + (select max(frame_idx) + 1 from px), p, b, g, r from px",
    "container_parallel": _SMALL,
    "container_frames": f"select * from ({_SMALL}) where frame_idx % 7 = 0",
    "container_folder": f"select printf('clip%02d', frame_idx % 25) as clip, frame_idx // 25 as frame_idx, p, b, g, r from ({_SMALL})",
    "compression_factor": "select cast(sum(n_chars) as bigint) as encoded_bytes, cast(count(*) * 3000 as bigint) as raw_bytes, sum(n_chars) / (count(*) * 3000) as factor from documents",
    "frame_diff": f"""with px as ({_PX}), d as (select frame_idx, case when p % 3 = 0 then abs(b - r) else 0 end as x from px)
select frame_idx, count(*) as n_pixels, count(*) filter (x > 0) as mismatched, max(x) as max_diff, cast(sum(2 * x) as bigint) as sum_diff, cast(0 as bigint) as unmatched, count(*) filter (x > 0) * 100.0::double / count(*) as mismatch_pct from d group by frame_idx""",
}
