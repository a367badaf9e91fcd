"""The library's tables, derived from the given ones.

Each fixture is a list of select expressions and the table they read. The text is plain enough to mean the same in
Spark and in other SQL engines: whole-number arithmetic, then one division by a double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

OBS = (
    "orders",
    [
        "o_orderkey as id",
        "o_orderdate as time",
        "concat(cast(o_custkey % 37 + 1 as string), '.0') as place",
        "concat('Station ', cast(o_custkey % 37 + 1 as string), case when o_orderkey % 5 = 0 then ' (alt)' else '' end)"
        " as location",
        "(45 + o_orderkey * 7 % 61) / 10.0e0 as ph",
        "(o_orderkey * 3 % 131) / 10.0e0 as do_",
        "(o_orderkey * 37 % 5001) * 1.0e0 as conductivity",
        "(o_orderkey * 11 % 12000) / 10000.0e0 as n_no2",
        "(o_orderkey * 13 % 200) / 100.0e0 as n_nh4",
        "(o_orderkey * 17 % 60) / 100.0e0 as p_po4",
        "(o_orderkey * 19 % 171) * 1.0e0 as tss",
        "(o_orderkey * 23 % 251) / 10.0e0 as cod",
        "(o_orderkey * 29 % 3501) * 1.0e0 as aeromonas_total",
    ],
)

# Observations known by a text.
OBS_TEXT_ID = ("orders", ["md5(cast(o_orderkey as string)) as id", *OBS[1][1:]])

# Observations of stations with a long tail, each half as large as the one before: the last have a row or two at any size of the table.
OBS_TAIL = (
    "orders",
    [
        *OBS[1][:2],
        "concat(cast(o_orderkey & -o_orderkey as string), '.0') as place",
        "concat('Station ', cast(o_orderkey & -o_orderkey as string)) as location",
        *OBS[1][4:],
    ],
)

# Observations with a time of day, so that no two of a station share their time.
OBS_TIMED = (
    "orders",
    [
        OBS[1][0],
        "o_orderdate + interval '1' second * (o_orderkey % 86400) as time",
        "concat(cast(o_custkey % 37 + 1 as string), '.0') as place",
        "concat('Station ', cast(o_custkey % 37 + 1 as string)) as location",
        *OBS[1][4:],
    ],
)

# Numbers with infinities on either side.
UNBOUNDED = (
    "orders",
    [
        "case when o_orderkey % 997 = 3 then cast('Infinity' as double) when o_orderkey % 991 = 5"
        " then cast('-Infinity' as double) else (o_orderkey * 37 % 5001) / 8.0e0 end as level",
        "(o_orderkey % 400) / 4.0e0 as depth",
    ],
)

_RAW_SHARED = [
    "o_orderkey as src_line",
    "case when o_orderkey % 29 = 0 then 'bad date' else concat(lpad(cast(1 + o_orderkey % 28 as string), 2, '0'), '/',"
    " lpad(cast(1 + o_orderkey % 12 as string), 2, '0'), '/', cast(2010 + o_orderkey % 14 as string)) end as obs_date",
    "concat(cast(o_custkey % 37 + 1 as string), '.0') as place",
    "case when o_orderkey % 23 = 0 then '10.5 106.7'"
    " when o_orderkey % 3 = 0 then concat('10,', cast(100 + o_custkey % 37 as string), ' ', chr(10), '106,',"
    " cast(500 + o_custkey % 37 as string))"
    " else concat('10,', cast(100 + o_custkey % 37 as string), chr(10), '106,', cast(500 + o_custkey % 37 as string))"
    " end as coord",
    "case when o_orderkey % 13 = 0 then 'KPH' when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then 'n/a'"
    " else concat(cast(5 + o_orderkey % 5 as string), ',', cast(o_orderkey % 10 as string)) end as ph",
    "case when o_orderkey % 11 = 0 then 'KPH' when o_orderkey % 7 = 0 then '< 1' when o_orderkey % 31 = 0 then '<1'"
    " when o_orderkey % 37 = 0 then null else cast(o_orderkey * 29 % 3501 as string) end as aeromonas_total",
]

RAW_OBS = ("orders", _RAW_SHARED)

RAW_WIDE = (
    "orders",
    [
        *_RAW_SHARED,
        "concat('Station ', cast(o_custkey % 37 + 1 as string)) as location",
        "concat(cast(20 + o_orderkey % 15 as string), ',', cast(o_orderkey % 10 as string)) as temperature",
        "concat(cast(o_orderkey * 3 % 13 as string), ',', cast(o_orderkey % 10 as string)) as do_",
        "case when o_orderkey % 43 = 0 then 'KPH' else cast(o_orderkey * 37 % 5001 as string) end as conductivity",
        "cast(o_orderkey % 90 as string) as alkalinity",
        "case when o_orderkey % 47 = 0 then 'KPH' else concat('0,', cast(10 + o_orderkey % 90 as string)) end as n_no2",
        "concat(cast(o_orderkey % 2 as string), ',', cast(o_orderkey % 100 as string)) as n_nh4",
        "concat('0,', cast(o_orderkey * 17 % 60 as string)) as p_po4",
        "cast(o_orderkey * 19 % 171 as string) as tss",
        "concat(cast(o_orderkey * 23 % 25 as string), ',', cast(o_orderkey % 10 as string)) as cod",
        "case when o_orderkey % 2 = 0 then 'KPH' else '0,02' end as h2s",
        "cast(o_orderkey % 9000 as string) as coliform",
        "case when o_orderkey % 53 = 0 then null"
        " else concat(cast(o_orderkey % 100 as string), ',', cast(o_orderkey % 7 as string)) end as wqi",
    ],
)

BOOKINGS = (
    "orders",
    [
        "o_orderkey as id",
        "o_custkey as user_id",
        "o_custkey * 7 % 500 as room_id",
        "o_orderdate as check_in",
        "o_orderdate + interval '1' day * (1 + o_orderkey % 14) as check_out",
        "o_totalprice as total_price",
        "case o_orderstatus when 'O' then 'booked' when 'F' then 'checked_out' else 'cancelled' end as status",
        "case when o_orderkey % 41 = 0 then o_orderdate end as deleted_at",
    ],
)

# Every order asks for another room, three days later; a stay of no days is invalid.
BOOKING_REQUESTS = (
    "orders",
    [
        "o_orderkey as id",
        "o_custkey as user_id",
        "o_custkey * 11 % 500 as room_id",
        "o_orderdate + interval '1' day * 3 as check_in",
        "o_orderdate + interval '1' day * (3 + o_orderkey % 9) as check_out",
    ],
)

BOOKING_FORMS = (
    "orders",
    [
        "o_orderkey as id",
        "o_custkey as user_id",
        "o_custkey * 7 % 500 as room_id",
        "case when o_totalprice < 50000 then null else o_orderdate end as check_in",
        "o_orderdate + interval '1' day * (o_orderkey % 14) as check_out",
        "o_totalprice as total_price",
        "case o_orderstatus when 'O' then 'booked' when 'F' then 'checked_out' end as status",
        "concat('Guest ', cast(o_custkey as string)) as guest_name",
        "case when o_orderpriority = '5-LOW' then null else '+1234567890' end as guest_contact_number",
        "concat('guest', cast(o_custkey as string), '@example.com') as guest_email",
        "case when o_orderpriority = '1-URGENT' then null else 2 end as number_of_guests",
    ],
)

ROOMS_FLAT = (
    "part",
    [
        "p_partkey as id",
        "p_name as name",
        "p_retailprice as price",
        "cast(p_partkey % 22 + 1 as int) as f1",
        "cast(p_size % 22 + 1 as int) as f2",
        "cast(p_partkey % 5 + 1 as int) as f3",
        "cast(p_partkey % 23 + 1 as int) as b1",
        "cast(p_size % 23 + 1 as int) as b2",
    ],
)

# Rooms of which some are deleted and some do not say.
ROOMS_STATE = (
    "part",
    [
        "p_partkey as id",
        "p_name as name",
        "p_retailprice as price",
        "case when p_partkey % 17 = 0 then true when p_partkey % 5 = 0 then null else false end as is_deleted",
    ],
)

USERS = (
    "customer",
    [
        "c_custkey as id",
        "c_name as name",
        "concat('user', cast(c_custkey as string)) as username",
        "concat('user', cast(c_custkey as string), '@example.com') as email",
        "c_mktsegment as tier",
        "case when c_custkey % 20 = 0 then true else false end as is_deleted",
        "case when c_custkey % 50 = 1 then true else false end as is_superuser",
    ],
)

USER_FORMS = (
    "customer",
    [
        "c_custkey as id",
        "case when c_nationkey = 3 then concat(c_name, ' of ', c_mktsegment, ' street') else c_name end as name",
        "replace(lower(c_name), '#', case when c_nationkey > 12 then '' else '_' end) as username",
        "concat('user', cast(c_custkey as string), case when c_nationkey > 20 then '' else '@example.com' end) as email",
        "case when c_acctbal < 0 then null else cast(c_custkey * 98765431 as string) end as phone_number",
        "case when c_mktsegment = 'BUILDING' then null else lower(c_mktsegment) end as password",
    ],
)

REQUESTS = ("events", ["event_id", "user_id", "ts", "concat('/api/v1/', event_type, '/') as path"])

# New accounts asked for by orders: many of the names are in use, and most are asked for more than once.
SIGN_UPS = ("orders", ["o_orderkey as seq", "concat('user', cast(o_custkey * 2 as string)) as username"])

# The same, some of them without a place in the order.
SIGN_UPS_UNPLACED = (
    "orders",
    ["case when o_orderkey % 19 <> 0 then o_orderkey end as seq", "concat('user', cast(o_custkey * 2 as string)) as username"],
)

# New accounts of which each shares its name or its address with the one before.
SIGN_UPS_CHAINED = (
    "customer",
    [
        "c_custkey as seq",
        "concat('link', cast((c_custkey + 1) >> 1 as string)) as username",
        "concat('link', cast(c_custkey >> 1 as string), '@example.com') as email",
    ],
)

# Requests for one room in the order of their stays, each linked with the next.
REQUESTS_IN_ORDER = (
    "orders",
    [
        "o_orderkey as id",
        "1 as room_id",
        "timestamp '1992-01-01 00:00:00' + interval '1' hour * o_orderkey as check_in",
        "timestamp '1992-01-01 00:00:00' + interval '1' hour * (o_orderkey + 9 + o_orderkey % 31) as check_out",
    ],
)

# New accounts with two names that must be free.
SIGN_UPS_TWO = (
    "customer",
    [
        "c_custkey as seq",
        "concat('user', cast(c_custkey * 7 % 900 + 1000 as string)) as username",
        "concat('user', cast(c_custkey * 3 % 1100 + 1100 as string), '@example.com') as email",
    ],
)

# Changes of bookings: most leave the stay out.
BOOKING_CHANGES = (
    "orders",
    [
        "o_orderkey as id",
        "case when o_orderkey % 3 = 0 then o_orderdate end as check_in",
        "case when o_orderkey % 4 < 3 then o_orderdate + interval '1' day * (o_orderkey % 5 - 1) end as check_out",
        "case when o_orderkey % 7 = 0 then 'secret' when o_orderkey % 7 = 1 then 'status' else 'guest_name' end as field",
    ],
)

USER_CHANGES = (
    "orders",
    [
        "o_custkey as id",
        "o_orderkey as seq",
        "case when o_orderstatus = 'F' then concat('name', cast(o_orderkey as string)) end as name",
        "case when o_orderstatus = 'O' then concat('new', cast(o_orderkey as string), '@example.com') end as email",
    ],
)

USERNAME_CHANGES = (
    "orders",
    [
        "o_custkey as id",
        "o_orderkey as seq",
        "concat('user', cast((o_custkey >> 1) + 1000 as string)) as username",
    ],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, definition: tuple[str, list[str]]) -> DataFrame:
    source, columns = definition
    return table(spark, sf_dir, source).selectExpr(*columns)


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, ROOMS_FLAT).selectExpr(
        "id",
        "name",
        "price",
        "array_distinct(array(f1, f2, f3)) as feature_ids",
        "array_distinct(array(b1, b2)) as badge_ids",
    )


def tier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per tier for two of the paths: the longer the tier's name, the higher its limit."""
    tiers = table(spark, sf_dir, "customer").selectExpr("c_mktsegment as tier").distinct()
    rule = "cast(length(tier) - 6 as int) as limit"
    paths = ["/api/v1/click/", "/api/v1/purchase/"]
    return reduce(
        DataFrame.unionByName,
        [tiers.selectExpr("tier", f"'{path}' as path", rule, "604800 as period") for path in paths],
    )


def as_sql(definition: tuple[str, list[str]]) -> str:
    """The fixture as a select statement."""
    source, columns = definition
    return f"select {', '.join(columns)} from {source}"
