"""Second opinion for the registered queries: plain SQL over the same tables."""

from __future__ import annotations

from limnos.operators.quality import EMAIL_PATTERN, PASSWORD_PATTERN, USERNAME_PATTERN
from limnos.plans import fixtures as fx
from limnos.sources.seed import BADGES, FEATURES

ORACLE: dict[str, str] = {}

_METRICS = "ph, do_, conductivity, n_no2, n_nh4, p_po4, tss, cod, aeromonas_total"

_OBS = f"obs as ({fx.as_sql(fx.OBS)})"
_OBS_TEXT = f"obs as ({fx.as_sql(fx.OBS_TEXT_ID)})"
_OBS_TAIL = f"obs as ({fx.as_sql(fx.OBS_TAIL)})"
_OBS_TIMED = f"obs as ({fx.as_sql(fx.OBS_TIMED)})"
_RAW = f"raw as ({fx.as_sql(fx.RAW_OBS)})"
_WIDE = f"raw as ({fx.as_sql(fx.RAW_WIDE)})"
_BOOKINGS = f"bookings as ({fx.as_sql(fx.BOOKINGS)})"
_ASKED = f"asked as ({fx.as_sql(fx.BOOKING_REQUESTS)})"
_USERS = f"users as ({fx.as_sql(fx.USERS)})"
_REQUESTS = f"requests as ({fx.as_sql(fx.REQUESTS)})"
_ROOMS = (
    f"flat as ({fx.as_sql(fx.ROOMS_FLAT)}), rooms as (select id, name, price,"
    " list_distinct([f1, f2, f3]) as feature_ids, list_distinct([b1, b2]) as badge_ids from flat)"
)

_SUB = """
subs as (
  select *,
    case when ph < 5.5e0 then 1e0 when ph < 6.5e0 then 99e0 * ph + -543.5e0 when ph < 8.5e0 then 100e0
         when ph < 9.5e0 then -99e0 * ph + 941.5e0 when ph is not null then 1e0 end as q_ph,
    case when do_ <= 3e0 then 1e0 when do_ < 5e0 then 49.5e0 * do_ + -147.5e0 when do_ < 7e0 then 100e0
         when do_ < 11e0 then -24.75e0 * do_ + 273.25e0 when do_ is not null then 1e0 end as q_do_,
    case when conductivity <= 1500e0 then 100e0 when conductivity < 4500e0 then -0.033e0 * conductivity + 149.5e0
         when conductivity is not null then 1e0 end as q_conductivity,
    case when n_no2 <= 0.1e0 then 100e0 when n_no2 < 1e0 then -111.1e0 * n_no2 + 111e0
         when n_no2 is not null then 1e0 end as q_n_no2,
    case when n_nh4 <= 0.3e0 then 100e0 when n_nh4 < 1.7e0 then -70.71e0 * n_nh4 + 121.21e0
         when n_nh4 is not null then 1e0 end as q_n_nh4,
    case when p_po4 <= 0.1e0 then 100e0 when p_po4 < 0.5e0 then -247.5e0 * p_po4 + 124.75e0
         when p_po4 is not null then 1e0 end as q_p_po4,
    case when tss <= 50e0 then 100e0 when tss < 150e0 then -0.99e0 * tss + 149.5e0
         when tss is not null then 1e0 end as q_tss,
    case when cod <= 10e0 then 100e0 when cod < 20e0 then -9.9e0 * cod + 199e0
         when cod is not null then 1e0 end as q_cod,
    case when aeromonas_total <= 1000e0 then 100e0 when aeromonas_total < 3000e0
         then -0.0495e0 * aeromonas_total + 149.5e0 when aeromonas_total is not null then 1e0 end as q_aeromonas_total
  from obs
)"""


def _power(score: str, weight: str) -> str:
    return f"case when {score} >= 0 then round(pow({score}, {weight}), 8) end"


_INDEXED = (
    _SUB
    + ", indexed as (select *, round("
    + " * ".join(
        [
            _power("q_ph", "0.11e0"),
            _power("q_conductivity", "0.06e0"),
            _power("q_do_", "0.1e0"),
            _power("q_tss", "0.13e0"),
            _power("q_cod", "0.1e0"),
            _power("q_n_nh4", "0.13e0"),
            _power("q_n_no2", "0.1e0"),
            _power("q_p_po4", "0.12e0"),
            _power("q_aeromonas_total", "0.15e0"),
        ]
    )
    + ", 4) as wqi from subs)"
)

ORACLE["wqi_subindices"] = f"""
with {_OBS}, {_SUB}
select id, q_ph, q_do_, q_conductivity, q_n_no2, q_n_nh4, q_p_po4, q_tss, q_cod, q_aeromonas_total from subs
"""
ORACLE["wqi_scalar"] = f"with {_OBS}, {_INDEXED} select id, place, time, wqi from indexed"
ORACLE["wqi_by_station"] = f"""
with {_OBS}, {_INDEXED}
select place, count(*) as n_rows, count(wqi) as n_index,
  cast(sum(cast(wqi as decimal(18,4))) as double) / count(wqi) as avg_wqi,
  min(wqi) as min_wqi, max(wqi) as max_wqi
from indexed group by place
"""

# --- cleaning ----------------------------------------------------------------------------

_NUMBER = "try_cast(replace({0}, ',', '.') as double)"
_PLAIN = "case when {0} = 'KPH' then '0' else {0} end"
_BACTERIA = "case when aeromonas_total in ('KPH', '< 1', '<1') then '0' else aeromonas_total end"

ORACLE["clean_detection_limits"] = f"""
with {_RAW}, numbers as (
  select src_line, {_NUMBER.format('(' + _PLAIN.format('ph') + ')')} as ph,
    {_NUMBER.format('(' + _BACTERIA + ')')} as aeromonas_total
  from raw where ph is not null and aeromonas_total is not null)
select * from numbers where ph is not null and aeromonas_total is not null
"""
ORACLE["clean_dates"] = f"""
with {_RAW}, dated as (select src_line, cast(try_strptime(obs_date, '%d/%m/%Y') as date) as d from raw)
select src_line, cast(d as string) as obs_day, year(d) as year, month(d) as month, day(d) as day from dated
"""
_COORD = "trim(replace(replace(coord, ' ', ''), chr(10), ' '))"
_GOOD_COORD = f"regexp_matches({_COORD}, '^\\d{{1,2}},\\d+\\s\\d{{1,3}},\\d+$')"
ORACLE["clean_coordinates"] = f"""
with {_RAW}, kept as (select src_line, {_COORD} as c from raw where {_GOOD_COORD})
select src_line, cast(replace(split_part(c, ' ', 1), ',', '.') as double) as latitude,
  cast(replace(split_part(c, ' ', 2), ',', '.') as double) as longitude
from kept
"""
_FILL = "last_value({0} ignore nulls) over ({1} order by src_line rows unbounded preceding) as {0}"
ORACLE["ffill_global"] = f"""
with {_RAW} select src_line, {_FILL.format('ph', '')}, {_FILL.format('aeromonas_total', '')} from raw
"""
ORACLE["ffill_per_station"] = f"""
with {_RAW} select src_line, place, {_FILL.format('ph', 'partition by place')},
  {_FILL.format('aeromonas_total', 'partition by place')} from raw
"""
_PARSED = ", ".join(
    f"{_NUMBER.format('(' + _PLAIN.format(c) + ')')} as {c}"
    for c in ["ph", "do_", "conductivity", "n_no2", "n_nh4", "p_po4", "tss", "cod"]
)


def _told(*parts: str) -> str:
    """The text that an id is hashed from."""
    return "concat(" + ", ".join(f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts) + ")"


_CLEANED = f"""
cleaned as (
  select src_line, cast(try_strptime(obs_date, '%d/%m/%Y') as date) as d,
    cast(cast(place as double) as string) as place, location, {_PARSED},
    {_NUMBER.format('(' + _BACTERIA + ')')} as aeromonas_total, {_NUMBER.format('wqi')} as wqi
  from raw
  where {_GOOD_COORD} and {' and '.join(f'{c} is not null' for c in _METRICS.split(', '))}),
warehouse as (
  select src_line, md5({_told("cast(d as string)", "place", "cast(src_line as string)")}) as id,
    d, cast(cast(d as timestamp) as string) as time, place, location, {_METRICS},
    wqi as actual_wqi, wqi as predicted_wqi
  from cleaned
  where wqi is not null and {' and '.join(f'{c} is not null' for c in _METRICS.split(', '))})"""
ORACLE["ingest_observations"] = f"with {_WIDE}, {_CLEANED} select * exclude (src_line, d) from warehouse"
ORACLE["ingest_csv"] = f"""
with {_WIDE}, {_CLEANED},
lines as (select src_line, cast(src_line % 3 as string) as part,
  cast(row_number() over (partition by src_line % 3 order by src_line) - 1 as string) as line from raw)
select w.* exclude (src_line, d) replace (md5({_told("cast(w.d as string)", "w.place", "l.part", "l.line")}) as id)
from warehouse w join lines l using (src_line)
"""
ORACLE["keyset_walk"] = f"""
with {_WIDE}, {_CLEANED}, both_ways as (
  select id, 'up' as direction, row_number() over (order by d nulls last, id) as rn from warehouse
  union all
  select id, 'down', row_number() over (order by d desc nulls last, id desc) from warehouse)
select id, direction, cast((rn - 1) // 2500 as int) as page from both_ways
"""
ORACLE["warehouse_station_page"] = f"""
with {_OBS} select * from obs where place = '24.0' and year(time) between 1995 and 1997
order by time, id limit 10 offset 10
"""

ORACLE["profile"] = f"""
with {_OBS}, long as (unpivot (select {_METRICS} from obs) on {_METRICS} into name metric value value)
select metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
  min(value) as min, max(value) as max, count(distinct value) as n_distinct,
  round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.75), 6) as p75
from long group by metric
"""
ORACLE["profile_of_loads"] = f"""
with {_OBS}, long as (unpivot (select {_METRICS} from obs) on {_METRICS} into name metric value value)
select metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max,
  true as p25_near, true as p50_near, true as p75_near, true as n_distinct_near
from long group by metric
"""
_UNBOUNDED = f"""
with obs as ({fx.as_sql(fx.UNBOUNDED)}), long as (unpivot (select level, depth from obs) on level, depth into name metric value value)
select metric, count(*) as n, count(distinct value) as n_distinct, min(value) as min, max(value) as max,
  round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.75), 6) as p75
from long group by metric
"""
ORACLE["profile_with_infinity"] = _UNBOUNDED
ORACLE["profile_with_infinity_hot"] = _UNBOUNDED
ORACLE["profile_text"] = f"""
with {_RAW}, long as (select 'coord' as "column", coord as value from raw union all select 'ph', ph from raw),
counts as (select "column", value, count(*) as c from long group by all),
ranked as (select *, row_number() over (partition by "column" order by c desc, value) as rn from counts where value is not null),
tops as (select "column", string_agg(concat(value, '=', c), ';' order by rn) as top from ranked where rn <= 3 group by "column")
select c."column", cast(coalesce(sum(c) filter (value is not null), 0) as bigint) as n,
  cast(coalesce(sum(c) filter (value is null), 0) as bigint) as n_null, count(value) as n_distinct, any_value(t.top) as top
from counts c left join tops t on t."column" = c."column" group by c."column"
"""
ORACLE["profile_text_of_loads"] = ORACLE["profile_text"].replace("count(value) as n_distinct, ", "")


def _rules(source: str, rules: list[tuple[str, str]]) -> str:
    cells = ", ".join(f"case when not ({test}) then '{name}' end" for name, test in rules)
    return f"""
with forms as ({source}), judged as (
  select id, list_filter([{cells}], lambda x: x is not null) as broken from forms)
select id, len(broken) as n_broken, array_to_string(broken, ',') as broken from judged
"""


ORACLE["user_field_rules"] = _rules(
    fx.as_sql(fx.USER_FORMS),
    [
        ("name_required", "name is not null"),
        ("name_length", "length(name) between 2 and 30"),
        ("username_required", "username is not null"),
        ("username_length", "length(username) between 2 and 20"),
        ("username_pattern", f"regexp_matches(username, '{USERNAME_PATTERN}')"),
        ("email_required", "email is not null"),
        ("email_pattern", f"regexp_matches(email, '{EMAIL_PATTERN}')"),
        ("phone_required", "phone_number is not null"),
        ("phone_length", "length(phone_number) between 10 and 15"),
        ("password_required", "password is not null"),
        ("password_pattern", f"regexp_matches(password, '{PASSWORD_PATTERN}')"),
    ],
)
ORACLE["booking_field_rules"] = _rules(
    fx.as_sql(fx.BOOKING_FORMS),
    [
        *[
            (f"{c}_required", f"{c} is not null")
            for c in [
                "user_id",
                "room_id",
                "check_in",
                "check_out",
                "total_price",
                "status",
                "guest_name",
                "guest_contact_number",
                "guest_email",
                "number_of_guests",
            ]
        ],
        ("interval", "check_in < check_out"),
    ],
)

ORACLE["booking_update_rules"] = f"""
with changes as ({fx.as_sql(fx.BOOKING_CHANGES)})
select id, case when check_in >= check_out then 'interval' else '' end as broken,
  case when field = 'secret' then field else '' end as extra
from changes
"""
ORACLE["room_field_rules"] = """
select p_partkey as id, case when p_partkey % 3 > 0 then '' else 'description_required' end as broken from part
"""

# --- readings ----------------------------------------------------------------------------

_TOPICS = {
    "ph": "ph_topic",
    "do_": "do_topic",
    "conductivity": "conductivity_topic",
    "n_no2": "n_no2_topic",
    "n_nh4": "n_nh4_topic",
    "p_po4": "p_po4_topic",
    "tss": "tss_topic",
    "cod": "cod_topic",
    "aeromonas_total": "aeromonas_total_topic",
}
_READINGS = (
    "readings as ("
    + " union all ".join(
        f"select id, place, time, '{topic}' as topic, {metric} as value from obs" for metric, topic in _TOPICS.items()
    )
    + ")"
)
_CORRELATED = f"""
with {_OBS}, {_READINGS}
select id, place, time, {', '.join(f"max(case when topic = '{t}' then value end) as {m}" for m, t in _TOPICS.items())}
from readings group by id, place, time
"""

ORACLE["unpivot_readings"] = f"with {_OBS}, {_READINGS} select id, place, time, topic, value from readings"
ORACLE["publish_decode_roundtrip"] = f"with {_OBS}, {_READINGS} select topic, place, time, value from readings"
ORACLE["correlate_pivot"] = _CORRELATED
ORACLE["correlate_join_chain"] = _CORRELATED
ORACLE["correlate_latest"] = f"""
with {_OBS} select * exclude (location) replace (case when id % 7 = 0 then ph + 1 else ph end as ph) from obs
"""
ORACLE["correlate_ambiguous"] = f"""
with {_OBS}, {_READINGS}
select place, time, topic, count(distinct value) as n_values from readings group by place, time, topic
having count(distinct value) > 1
"""
_STATION_TIME = _told("cast(time as string)", "place")
ORACLE["stream_ingest"] = f"""
with {_OBS_TIMED}, {_INDEXED}
select md5({_STATION_TIME}) as id, time, place, location, {_METRICS}, wqi as actual_wqi, wqi as predicted_wqi
from indexed where time >= timestamp '1995-01-01'
"""
ORACLE["stream_ingest_all"] = ORACLE["stream_ingest"]
ORACLE["warehouse_both_ways"] = f"""
with {_WIDE}, {_CLEANED}, last as (
  select * from warehouse where d is not null qualify row_number() over (partition by d, place order by src_line desc) = 1)
select md5({_told("time", "place")}) as id, time, place, location, {_METRICS}, actual_wqi, predicted_wqi, true as streamed from last
"""
ORACLE["stream_reading_fates"] = f"""
with {_OBS_TIMED}, {_READINGS}
select place, time, topic, value,
  case when time < timestamp '1995-01-01' then 'late'
    when time > (select max(time) from obs) - interval '10' day then 'open'
    when id % 11 = 0 then 'incomplete' else 'complete' end as fate
from readings where id % 11 <> 0 or topic not in ('ph_topic', 'tss_topic')
"""
ORACLE["stream_correlate_wqi"] = f"with {_OBS}, {_INDEXED} select id, place, time, {_METRICS}, wqi from indexed"
_CLEAN_PATH = "replace(trim(path, '/'), '/', '_')"
ORACLE["stream_request_windows"] = f"""
with {_REQUESTS}
select user_id, {_CLEAN_PATH} as path, date_trunc('hour', ts) as window_start, count(*) as n_requests
from requests group by all
"""

# --- stations ----------------------------------------------------------------------------

ORACLE["station_list"] = f"""
with {_OBS} select cast(cast(place as double) as int) as place, min_by(location, id) as location
from obs group by 1
"""
ORACLE["station_page"] = f"""
with {_OBS} select * from obs where place = '24.0' order by time, id limit 10 offset 10
"""
ORACLE["rows_in_places"] = f"""
with {_OBS} select id, place, time from obs where place in ('1.0', '24.0', '37.0')
"""
ORACLE["observations_in_order"] = f"""
with {_OBS} select id, year(time) as year, month(time) as month, day(time) as day from obs order by time, id
"""
ORACLE["station_page_header"] = f"""
with {_OBS} select count(*) as total_count, 20 < count(*) as has_more, 2 as page, 10 as items_per_page
from obs where place = '24.0'
"""
ORACLE["keyset_page"] = f"""
with {_OBS} select * from obs where time > timestamp '1998-01-01' or (time = timestamp '1998-01-01' and id > 0)
order by time, id limit 25
"""
ORACLE["deep_page"] = f"with {_OBS} select * from obs order by time, id limit 20 offset 800"
ORACLE["deep_page_text_id"] = f"with {_OBS_TEXT} select * from obs order by time desc, id limit 20 offset 800"
ORACLE["directory_pages"] = f"""
with {_OBS}, numbered as (select cast((row_number() over (order by time desc, id) - 1) // 20 + 1 as integer) as page, id, time, place from obs),
last as (select max(page) as n from numbered)
select page, id, time, place from numbered, last where page in (1, 2, n // 3, n // 2, n - 1, n)
"""
ORACLE["observation_by_id"] = f"with {_OBS} select * from obs where id = 7"

# --- forecast ----------------------------------------------------------------------------

_SPLIT = """
ranked as (
  select *, row_number() over (partition by place order by time, id) as rn, count(*) over (partition by place) as n
  from {0}),
split as (select *, case when rn <= floor(n * 0.8e0) then 'history' else 'predict' end as part from ranked)"""
_SPLIT_OBS = _SPLIT.format("obs")
_SPLIT_INDEXED = _SPLIT.format("indexed")

ORACLE["chrono_split"] = f"with {_OBS}, {_SPLIT_OBS} select id, place, time, n, part from split"
ORACLE["chrono_split_hot"] = ORACLE["chrono_split"]
ORACLE["chrono_split_text_id"] = f"""
with {_OBS_TEXT}, {_SPLIT_OBS}
select id, place, time, n, cast(floor(n * 0.8e0) as bigint) as n_history, part from split
"""
ORACLE["chrono_split_text_id_hot"] = ORACLE["chrono_split_text_id"]
ORACLE["split_status"] = f"""
with {_OBS}, {_SPLIT_OBS}
select place, count(*) filter (part = 'history') as n_history, count(*) filter (part = 'predict') as n_predict,
  case when count(*) filter (part = 'history') > 0 then 'ok' else 'insufficient data' end as status
from split group by place
"""
ORACLE["last_history"] = f"""
with {_OBS}, {_SPLIT_OBS}
select place, id, time, location, {_METRICS} from split where part = 'history' and rn = floor(n * 0.8e0)
"""
ORACLE["feature_vector"] = f"""
with {_OBS}, vectors as (
  select id, [cast(cast(place as double) as int), {_METRICS}] as v from obs),
cells as (select id, unnest(v) as x, generate_subscripts(v, 1) - 1 as pos from vectors)
select id, cast(pos as int) as pos, cast(cast(x as float) as double) as x from cells
"""
_SCORABLE = "part = 'predict' and floor(n * 0.8e0) >= 1"
ORACLE["forecast_index"] = f"""
with {_OBS}, {_INDEXED}, {_SPLIT_INDEXED} select place, time, id, wqi as predicted_wqi from split where {_SCORABLE}
"""
_UNIT_SUM = "cast(sum(cast(round(wqi * 10000) as decimal(20,0))) as double)"


def _mean(rows: str, share: str, obs: str = _OBS) -> str:
    return f"""
with {obs}, {_INDEXED}, few as (select * from indexed where {rows}), {_SPLIT.format("few").replace("0.8e0", share)}, means as (
  select place, {_UNIT_SUM} / count(*) / 10000e0 as m from split
  where part = 'history' and wqi is not null group by place)
select s.place, s.time, s.id, m.m as predicted_wqi from split s left join means m using (place)
where {_SCORABLE.replace("0.8e0", share)}
"""


def _trend(share: str) -> str:
    return f"""
with {_OBS}, {_INDEXED}, {_SPLIT_INDEXED.replace("0.8e0", share)},
days as (select *, date_diff('day', date '1970-01-01', cast(time as date)) as x,
    cast(round(wqi * 10000) as hugeint) as y from split),
sums as (select place, cast(count(*) as hugeint) as c, sum(cast(x as hugeint)) as sx, sum(y) as sy,
    sum(cast(x as hugeint) * x) as sxx, sum(x * y) as sxy
  from days where part = 'history' and wqi is not null group by place),
slopes as (select *, cast(c * sxy - sx * sy as double) / nullif(cast(c * sxx - sx * sx as double), 0) as slope
  from sums),
lines as (select place, slope, (cast(sy as double) - slope * cast(sx as double)) / cast(c as double) as intercept
  from slopes)
select d.place, d.time, d.id, (l.intercept + l.slope * cast(d.x as double)) / 10000e0 as predicted_wqi
from days d left join lines l using (place) where {_SCORABLE.replace("0.8e0", share)}
"""


ORACLE["forecast_mean"] = _mean("true", "0.8e0")
ORACLE["forecast_mean_share"] = _mean("true", "0.25e0")
ORACLE["forecast_mean_share_all"] = _mean("true", "0.25e0", _OBS_TAIL)
ORACLE["forecast_trend"] = _trend("0.8e0")
ORACLE["forecast_trend_share"] = _trend("0.25e0")
ORACLE["forecast_model"] = f"""
with {_OBS}, {_SPLIT_OBS}
select place, time, id, cast(cast(do_ as float) * cast(8.0 as float) + cast(n_nh4 as float) * cast(-4.0 as float)
  + cast(cod as float) * cast(-0.5 as float) as double) as predicted_wqi
from split where {_SCORABLE}
"""

# --- catalog -----------------------------------------------------------------------------


def _values(table: str, names: list[str]) -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1))
    return f"{table}(id, name) as (values {rows})"


_DIMS = f"{_values('features', FEATURES)}, {_values('badges', BADGES)}"


def _gathered(room: str, ids: str, dim: str) -> str:
    return (
        f"(select coalesce(string_agg(concat(d.id, ':', d.name), ';' order by d.id), '') from {dim} d"
        f" where list_contains({room}.{ids}, d.id))"
    )


_ENRICH = (
    f"select r.id, r.name, r.price, {_gathered('r', 'feature_ids', 'features')} as features,"
    f" {_gathered('r', 'badge_ids', 'badges')} as badges"
)
ORACLE["room_search"] = f"""
with {_ROOMS} select id, name, price from rooms
where price between 910 and 980 and list_has_all(feature_ids, [3]) and list_has_all(badge_ids, [4])
"""
ORACLE["room_search_bitmaps"] = f"""
with {_ROOMS} select id, name, price, count(*) over () as total_count from rooms
where price between 910 and 980 and list_has_all(feature_ids, [3]) and list_has_all(badge_ids, [4])
"""
ORACLE["room_search_bitmaps_page"] = f"""
with {_ROOMS}, found as (
  select id, name, price, count(*) over () as total_count from rooms where price between 915 and 1501.5 and list_has_all(feature_ids, [3]))
select * from found order by id limit 10 offset 10
"""
ORACLE["room_search_live"] = f"""
with rooms as ({fx.as_sql(fx.ROOMS_STATE)}) select id, name, price from rooms where is_deleted is distinct from true
"""
ORACLE["room_search_page"] = f"""
with {_ROOMS}, {_DIMS}, r as (
  select * from rooms where price between 910 and 980 and list_has_all(feature_ids, [3])
  order by id limit 10 offset 10)
{_ENRICH} from r
"""
ORACLE["room_enriched"] = f"with {_ROOMS}, {_DIMS} {_ENRICH} from rooms r"
ORACLE["room_enriched_odd"] = f"""
with {_ROOMS}, {_DIMS}, twice as (select * from features union all values (3, 'again'))
select r.id, coalesce((select string_agg(concat(d.id, ':', d.name), ';' order by d.id, d.name) from twice d
  where list_contains(r.feature_ids, d.id)), '') as features
from rooms r
"""
ORACLE["dimension_list"] = f"""
with {_ROOMS}, {_DIMS}
select f.id, f.name, count(r.id) as n_rooms from features f left join rooms r on list_contains(r.feature_ids, f.id)
group by f.id, f.name
"""

# --- bookings ----------------------------------------------------------------------------

_ACTIVE = "active as (select * from bookings where status = 'booked' and deleted_at is null)"
_CONFLICTS = f"""
with {_BOOKINGS}, {_ACTIVE}
select a.id, a.room_id, count(*) as n_overlaps
from active a join active b on a.room_id = b.room_id and a.id <> b.id
  and a.check_in <= b.check_out and a.check_out >= b.check_in
group by a.id, a.room_id
"""
ORACLE["booking_conflicts"] = _CONFLICTS
ORACLE["booking_conflicts_hot"] = _CONFLICTS
ORACLE["booking_conflict_witness"] = f"""
with {_BOOKINGS}, {_ACTIVE},
swept as (
  select *, max({{'o': check_out, 'i': id}}) over (partition by room_id order by check_in, id rows between unbounded preceding and 1 preceding) as b,
    lead(check_in) over later as next_in, lead(id) over later as next_id
  from active window later as (partition by room_id order by check_in, id)),
told as (select id, room_id, case when b.o >= check_in then b.i when next_in <= check_out then next_id end as witness from swept)
select * from told where witness is not null
"""
ORACLE["booking_conflict_witness_hot"] = ORACLE["booking_conflict_witness"]
ORACLE["booking_blocked_by"] = f"""
with {_BOOKINGS}, {_ACTIVE}, {_ASKED},
earlier as (
  select a.id, max({{'o': b.check_out, 'i': b.id}}) as b from asked a join active b on a.room_id = b.room_id and b.check_in <= a.check_in group by a.id),
later as (
  select a.id, min({{'s': b.check_in, 'i': b.id}}) as b from asked a join active b on a.room_id = b.room_id and b.check_in > a.check_in group by a.id)
select a.id, a.room_id, case when e.b.o >= a.check_in then e.b.i when l.b.s <= a.check_out then l.b.i end as witness
from asked a left join earlier e on e.id = a.id left join later l on l.id = a.id
"""
ORACLE["booking_admission_in_order"] = f"""
with recursive asked as ({fx.as_sql(fx.REQUESTS_IN_ORDER)}),
walk(id, check_out) as (
  (select id, check_out from asked order by id limit 1)
  union all
  select a.id, a.check_out from walk w join lateral (select id, check_out from asked where check_in > w.check_out order by id limit 1) a on true)
select id, case when id in (select id from walk) then 'accepted' else 'room taken by an earlier request' end as outcome from asked
"""
ORACLE["booking_clashes"] = f"""
with {_BOOKINGS}, {_ACTIVE}, {_ASKED}
select a.id, a.room_id, exists (select 1 from active b where b.room_id = a.room_id and b.id <> a.id
  and a.check_in <= b.check_out and a.check_out >= b.check_in) as clash
from asked a where a.check_in < a.check_out
"""
ORACLE["booking_admission"] = f"""
with recursive {_BOOKINGS}, {_ACTIVE}, {_ASKED},
judged as (
  select a.*, case when a.check_in >= a.check_out then 'invalid interval'
    when exists (select 1 from active b where b.room_id = a.room_id
      and a.check_in <= b.check_out and a.check_out >= b.check_in) then 'room already booked' end as outcome
  from asked a),
queue as (
  select id, room_id, check_in as s, check_out as e, row_number() over (partition by room_id order by id) as rn
  from judged where outcome is null),
walk(room_id, rn, id, free, taken) as (
  select room_id, rn, id, true, [struct_pack(s := s, e := e)] from queue where rn = 1
  union all
  select q.room_id, q.rn, q.id,
    len(list_filter(w.taken, lambda t: t.s <= q.e and t.e >= q.s)) = 0,
    case when len(list_filter(w.taken, lambda t: t.s <= q.e and t.e >= q.s)) = 0
      then list_append(w.taken, struct_pack(s := q.s, e := q.e)) else w.taken end
  from walk w join queue q on q.room_id = w.room_id and q.rn = w.rn + 1)
select id, room_id, outcome from judged where outcome is not null
union all
select id, room_id, case when free then 'accepted' else 'room taken by an earlier request' end from walk
"""
ORACLE["booking_cancel"] = f"""
with {_BOOKINGS}, asked as (select distinct event_id as id from events),
judged as (
  select b.*, case when a.id is null or b.deleted_at is not null then 'none'
    when b.status = 'cancelled' then 'Booking already cancelled'
    when b.status = 'booked' then 'Booking cancelled successfully'
    else 'Booking already checked out' end as outcome
  from bookings b left join asked a on a.id = b.id)
select id, case when outcome = 'Booking cancelled successfully' then 'cancelled' else status end as status, outcome
from judged
"""
_BOOKING_COLUMNS = "id, user_id, room_id, check_in, check_out, total_price, status"
ORACLE["user_bookings"] = f"""
with {_BOOKINGS} select {_BOOKING_COLUMNS} from bookings where user_id = 42 and deleted_at is null
order by check_in desc, id
"""
ORACLE["room_bookings"] = f"""
with {_BOOKINGS} select {_BOOKING_COLUMNS} from bookings
where room_id = 35 and deleted_at is null and status = 'booked'
  and check_out between timestamp '1996-01-01' and timestamp '1999-12-31'
order by check_out, id
"""
ORACLE["booking_joined"] = f"""
with {_BOOKINGS}, {_USERS}, flat as ({fx.as_sql(fx.ROOMS_FLAT)})
select b.id, u.username as user__username, u.is_deleted as user__is_deleted, r.name as room__name,
  r.price as room__price
from bookings b left join users u on u.id = b.user_id left join flat r on r.id = b.room_id
"""
ORACLE["joined_prefixed"] = f"""
with {_BOOKINGS}, {_USERS}
select u.id, u.username, coalesce(b.id, -1) as booking_id
from users u left join bookings b on b.user_id = u.id and u.is_superuser
where not u.is_deleted order by u.id, coalesce(b.id, -1) limit 100
"""
ORACLE["children_of_parent"] = f"""
with {_BOOKINGS}, {_USERS},
wanted as (select distinct concat('user', cast(user_id * 11 as string)) as name from events),
parents as (select id, username from users where not is_deleted),
children as (select * from bookings where deleted_at is null)
select w.name, p.id is not null as found, coalesce(p.id, -1) as parent_id, coalesce(c.id, -1) as child_id
from wanted w left join parents p on p.username = w.name left join children c on c.user_id = p.id
"""

# --- changes -----------------------------------------------------------------------------

ORACLE["insert_unique"] = f"""
with {_USERS}, new as ({fx.as_sql(fx.SIGN_UPS)}),
ranked as (select *, row_number() over (partition by username order by seq) as rn from new)
select username, seq, case when rn > 1 or username in (select username from users)
  then 'username not available' else 'accepted' end as reason
from ranked
"""

def _with_two_keys(sign_ups: tuple[str, list[str]]) -> str:
    return f"""
with recursive {_USERS}, new as ({fx.as_sql(sign_ups)}),
queue as (
  select *, row_number() over (order by seq) as rn, email in (select email from users) as e_known,
    username in (select username from users) as u_known from new),
walk(rn, seq, username, email, reason, emails, names) as (
  select cast(0 as bigint), cast(0 as bigint), '', '', '', cast([] as varchar[]), cast([] as varchar[])
  union all
  select rn, seq, username, email, reason, case when reason = 'accepted' then list_append(emails, email) else emails end,
    case when reason = 'accepted' then list_append(names, username) else names end
  from (select q.rn, q.seq, q.username, q.email, w.emails, w.names,
      case when q.e_known or list_contains(w.emails, q.email) then 'email is already registered'
        when q.u_known or list_contains(w.names, q.username) then 'username not available' else 'accepted' end as reason
    from walk w join queue q on q.rn = w.rn + 1) step)
select seq, username, email, reason from walk where rn > 0
"""


ORACLE["insert_unique_two_keys"] = _with_two_keys(fx.SIGN_UPS_TWO)
ORACLE["insert_unique_chained"] = _with_two_keys(fx.SIGN_UPS_CHAINED)
ORACLE["insert_unique_unplaced"] = f"""
with {_USERS}, new as ({fx.as_sql(fx.SIGN_UPS_UNPLACED)}),
ranked as (select *, row_number() over (partition by username order by seq nulls last) as rn from new)
select username, seq, case when seq is null then 'no place in the order'
  when rn > 1 or username in (select username from users) then 'username not available' else 'accepted' end as reason
from ranked
"""
ORACLE["new_booking_defaults"] = f"""
with forms as ({fx.as_sql(fx.BOOKING_FORMS)}),
ranked as (select *, row_number() over (partition by user_id, room_id, check_in order by id) as rn from forms)
select case when check_in is null or rn > 1 then 'none'
    else md5({_told("cast(user_id as string)", "cast(room_id as string)", "cast(check_in as string)")}) end as id,
  id as seq, user_id, room_id, coalesce(status, 'booked') as status, coalesce(number_of_guests, 1) as number_of_guests,
  case when check_in is null then 'no natural key' when rn > 1 then 'natural key repeated' else 'new' end as reason
from ranked
"""
ORACLE["partial_update"] = f"""
with {_USERS}, changes as ({fx.as_sql(fx.USER_CHANGES)}),
last as (select id, max_by(name, seq) filter (name is not null) as name,
    max_by(email, seq) filter (email is not null) as email
  from changes group by id)
select u.id, coalesce(l.name, u.name) as name, u.username, coalesce(l.email, u.email) as email
from users u left join last l on l.id = u.id
"""
ORACLE["unique_update"] = f"""
with {_USERS}, changes as ({fx.as_sql(fx.USERNAME_CHANGES)}),
owned as (select c.*, u.username as own from changes c left join users u on u.id = c.id),
firsts as (select username, min_by(id, seq) as winner from owned where username is distinct from own group by username)
select o.id, o.seq, o.username,
  case when o.username is not distinct from o.own then 'kept'
    when o.username in (select username from users) then 'username not available'
    when f.winner <> o.id then 'username not available' else 'kept' end as reason
from owned o left join firsts f on f.username = o.username
"""
ORACLE["soft_delete"] = f"""
with {_BOOKINGS}, named as (select distinct event_id as id from events)
select b.id, b.status, coalesce(cast(case when n.id is not null
  then coalesce(b.deleted_at, timestamp '2024-02-01') else b.deleted_at end as string), 'live') as deleted
from bookings b left join named n on n.id = b.id
"""
ORACLE["hard_delete"] = f"""
with {_BOOKINGS} select id, user_id, room_id from bookings where id not in (select event_id from events)
"""
ORACLE["existence_check"] = f"""
with {_BOOKINGS}, {_ROOMS} select id, room_id from bookings where room_id in (select id from rooms)
"""

# --- limits ------------------------------------------------------------------------------


def _flags(rows: str, columns: str) -> str:
    return f"""
windows as (select *, cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % period as window_start
  from {rows}),
flags as (select *, row_number() over (partition by user_id, path, window_start order by ts, event_id) > "limit"
    as limited from windows)
select {columns} from flags"""


_FIXED = f'fixed as (select event_id, user_id, ts, {_CLEAN_PATH} as path, 2 as "limit", 604800 as period from requests)'
ORACLE["rate_limit_flags"] = (
    f"with {_REQUESTS}, {_FIXED}, {_flags('fixed', 'event_id, user_id, path, window_start, limited')}"
)
ORACLE["stream_rate_limit_flags"] = ORACLE["rate_limit_flags"]
ORACLE["rate_limit_audit"] = f"""
with {_REQUESTS}, {_FIXED},
windows as (select *, cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % period as window_start
  from fixed)
select user_id, path, window_start, "limit", count(*) as n_requests, greatest(count(*) - "limit", 0) as n_limited
from windows group by user_id, path, window_start, "limit"
"""
ORACLE["rate_limit_tiers"] = f"""
with {_REQUESTS}, {_USERS},
tiers as (select distinct c_mktsegment as tier, cast(length(c_mktsegment) - 6 as int) as "limit" from customer),
rules as (select tier, path, "limit" from tiers, (values ('api_v1_click'), ('api_v1_purchase')) p(path)),
ruled as (
  select q.event_id, q.user_id, q.ts, replace(trim(q.path, '/'), '/', '_') as path, u.tier,
    coalesce(r."limit", 5) as "limit", case when r.tier is null then 86400 else 604800 end as period
  from requests q left join users u on u.id = q.user_id
    left join rules r on r.tier = u.tier and r.path = replace(trim(q.path, '/'), '/', '_')),
{_flags('ruled', 'event_id, tier, path, "limit", period, window_start, limited')}
"""
ORACLE["time_functions"] = f"""
with {_REQUESTS}
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso,
  cast(cast(ts as date) - 30 as string) as first_day, cast(cast(ts as date) + 30 as string) as last_day
from requests
"""
ORACLE["token_list"] = """
select concat('token', cast(user_id as string)) as token,
  max(date_trunc('second', ts)) + interval '604800' second as expires_at
from events group by user_id
"""
ORACLE["blacklist_filter"] = f"""
with {_USERS}
select event_id, concat('token', cast(user_id as string)) as token from events
where concat('token', cast(user_id as string)) not in
  (select concat('token', cast(id as string)) from users where tier = 'BUILDING')
"""
