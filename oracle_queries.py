"""DuckDB SQL giving the expected result of the registered queries.

Written independently of the package: nothing here is derived from its
feature tables.
"""

from __future__ import annotations

LOG = """
log AS (
  SELECT user_id, merchant_id,
         CASE WHEN pct = 0 THEN NULL ELSE merchant_id * 100 + pct END AS coupon_id,
         CASE WHEN pct = 0 THEN NULL
              WHEN pct % 2 = 0 THEN CAST(man AS VARCHAR) || ':' || CAST(pct AS VARCHAR)
              ELSE '0.' || CAST(100 - pct AS VARCHAR) END AS discount_raw,
         CASE WHEN dist = 11 THEN NULL ELSE dist END AS distance,
         CASE WHEN pct = 0 THEN NULL ELSE d END AS date_received,
         CASE WHEN pct = 0 THEN d WHEN rf = 'R' THEN d + gap ELSE NULL END AS date_used,
         row_id
  FROM (SELECT o_custkey AS user_id, l_suppkey % 40 AS merchant_id,
               CAST(round(l_discount * 100) AS INT) AS pct,
               CASE (l_suppkey % 40) % 3 WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 200 END AS man,
               CAST(l_partkey % 12 AS INT) AS dist, l_returnflag AS rf,
               DATE '2016-01-01' + CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 213 AS INT) AS d,
               CAST(l_quantity AS INT) % 25 AS gap,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
"""

CLEAN = (
    LOG
    + """,
c AS (
  SELECT user_id, merchant_id, coupon_id, discount_raw,
         coalesce(distance, -1) AS distance,
         date_received, date_used, row_id,
         CASE WHEN contains(discount_raw, ':') THEN 1 ELSE 0 END AS is_manjian,
         coalesce(CASE WHEN contains(discount_raw, ':')
                       THEN (TRY_CAST(split_part(discount_raw, ':', 1) AS DOUBLE)
                             - TRY_CAST(split_part(discount_raw, ':', 2) AS DOUBLE))
                            / TRY_CAST(split_part(discount_raw, ':', 1) AS DOUBLE)
                       ELSE TRY_CAST(discount_raw AS DOUBLE) END, 1.0) AS discount_rate,
         CASE WHEN contains(discount_raw, ':')
              THEN TRY_CAST(split_part(discount_raw, ':', 1) AS INT) ELSE -1 END AS min_cost_of_manjian,
         CASE WHEN contains(discount_raw, ':')
              THEN TRY_CAST(split_part(discount_raw, ':', 2) AS INT) ELSE -1 END AS reduce_manjian,
         CASE WHEN distance IS NULL THEN 1 ELSE 0 END AS null_distance,
         coalesce(coupon_id, 0) AS coupon0,
         date_received IS NOT NULL AS recv,
         date_used IS NOT NULL AS used,
         CAST(date_used - date_received AS INT) AS gap,
         CASE WHEN date_used - date_received <= 15 THEN 1 ELSE 0 END AS label
  FROM log)
"""
)

#: Users whose lines the file queries leave whole.
_WHOLE = "user_id % 50 NOT IN (7, 8, 10) AND NOT (user_id % 50 = 9 AND date_received IS NOT NULL)"

RAW = "user_id, merchant_id, coupon_id, discount_raw, distance, date_received, date_used"


def _spread(value: str, prefix: str, names: str) -> str:
    low, high, mean, middle = (prefix + n for n in names.split())
    mean_of = f"CAST(sum(CAST({value} AS DECIMAL(18,10))) AS DOUBLE) / count({value})"
    return f"""min({value}) AS {low}, max({value}) AS {high},
  round({mean_of}, 6) AS {mean}, round(CAST(median({value}) AS DOUBLE), 6) AS {middle}"""


def _spreads(prefix: str, off: str, off_median: str) -> str:
    return ",\n".join(
        [
            _spread("distance", prefix, "distance_min distance_max distance_mean distance_median"),
            _spread(
                "discount_rate",
                prefix,
                "discount_rate_min discount_rate_max discount_rate_mean discount_rate_median",
            ),
            _spread(
                "min_cost_of_manjian",
                prefix,
                "min_cost_of_manjian_min min_cost_of_manjian_max min_cost_of_manjian_mean min_cost_of_manjian_median",
            ),
            _spread("reduce_manjian", prefix, f"{off}min {off}max {off}mean {off_median}"),
        ]
    )


def _gaps(prefix: str, mean: str) -> str:
    return f"""round(coalesce(avg(gap) FILTER (WHERE label = 1), 0), 6) AS {prefix}{mean},
  coalesce(max(gap) FILTER (WHERE label = 1), 0) AS {prefix}max_time_gap_15,
  coalesce(min(gap) FILTER (WHERE label = 1), 0) AS {prefix}min_time_gap_15,
  CAST(coalesce(median(gap) FILTER (WHERE label = 1), 0) AS DOUBLE) AS {prefix}median_time_gap_15"""


USER_COUNTS = """
  count(*) AS field_user_id_record_cnt,
  count(*) FILTER (WHERE used) AS field_user_id_consume_cnt,
  count(*) FILTER (WHERE recv AND used) AS field_user_id_receive_and_consume_cnt,
  count(*) FILTER (WHERE NOT used) AS field_user_id_receive_and_not_consume_cnt,
  count(*) FILTER (WHERE NOT recv AND used) AS field_user_id_not_receive_and_consume_cnt,
  count(*) FILTER (WHERE recv) AS field_user_id_received_cnt"""

USER_MERCHANTS = """
  count(DISTINCT merchant_id) AS field_user_id_differ_merchant_cnt,
  count(DISTINCT merchant_id) FILTER (WHERE recv) AS field_user_id_receive_differ_merchant_cnt,
  count(DISTINCT merchant_id) FILTER (WHERE recv AND used) AS field_user_id_receive_and_consume_differ_merchant_cnt,
  count(DISTINCT merchant_id) FILTER (WHERE used) AS field_user_id_consume_differ_merchant_cnt"""

USER_DISTINCTS = (
    USER_MERCHANTS
    + """,
  count(DISTINCT merchant_id) FILTER (WHERE NOT recv) AS field_user_id_not_receive_differ_merchant_cnt,
  count(DISTINCT coupon0) AS field_user_id_differ_coupon_id_cnt,
  count(DISTINCT coupon0) FILTER (WHERE recv) AS field_user_id_receive_differ_coupon_id_cnt,
  count(DISTINCT coupon0) FILTER (WHERE NOT recv) AS field_user_id_not_receive_differ_coupon_id_cnt,
  count(DISTINCT coupon0) FILTER (WHERE recv AND used) AS field_user_id_receive_consume_differ_coupon_id_cnt,
  count(DISTINCT coupon0) FILTER (WHERE used) AS field_user_id_consume_differ_coupon_id_cnt,
  count(DISTINCT coupon0) FILTER (WHERE recv AND NOT used) AS field_user_id_receive_not_consume_differ_coupon_id_cnt,
  count(DISTINCT distance) AS field_user_id_distance_cnt,
  count(DISTINCT distance) FILTER (WHERE recv AND used) AS field_user_id_consume_distance_cnt,
  count(DISTINCT distance) FILTER (WHERE NOT used) AS field_user_id_not_consume_distance_cnt,
  count(DISTINCT distance) FILTER (WHERE recv) AS field_user_id_receive_distance_cnt,
  count(DISTINCT distance) FILTER (WHERE NOT recv) AS field_user_id_not_receive_distance_cnt,
  count(DISTINCT distance) FILTER (WHERE recv AND NOT used) AS field_user_id_receive_not_consume_distance_cnt,
  count(DISTINCT discount_rate) AS field_user_id_diff_discount_rate_cnt,
  count(DISTINCT discount_rate) FILTER (WHERE used) AS field_user_id_consume_diff_discount_rate_cnt,
  count(DISTINCT discount_rate) FILTER (WHERE recv AND used) AS field_user_id_receive_consume_diff_discount_rate_cnt,
  count(DISTINCT discount_rate) FILTER (WHERE recv) AS field_user_id_receive_diff_discount_rate_cnt,
  count(DISTINCT discount_rate) FILTER (WHERE recv AND NOT used)
    AS field_user_id_receive_not_consume_diff_discount_rate_cnt,
  count(DISTINCT discount_rate) FILTER (WHERE NOT recv) AS field_user_id_not_receive_diff_discount_rate_cnt"""
)

USER_STATS = _spreads("field_user_id_", "reduce_manjian_m", "reduce_manjian_median")

_CLASS = "CASE WHEN count(*) >= 6 THEN 2 WHEN count(*) >= 4 THEN 1 ELSE 0 END"
USER_FREQUENCY = f"""
  {_CLASS} AS field_user_id_repair_merchant_cnt,
  {_CLASS} AS field_user_id_repair_consume_merchant_cnt,
  {_CLASS} AS field_user_id_repair_receive_merchant_cnt"""

USER_GAPS = _gaps("field_user_id_", "mean_time_gap_15")

USER_ALL = ",\n".join([USER_COUNTS, USER_DISTINCTS, USER_STATS, USER_FREQUENCY, USER_GAPS])


def _merchant_counts(prefix: str, no: str, no_: str) -> str:
    return f"""
  count(*) FILTER (WHERE recv) AS {prefix}received_cnt,
  count(*) AS {prefix}record_cnt,
  count(*) FILTER (WHERE used) AS {prefix}consume_cnt,
  count(*) FILTER (WHERE recv AND used) AS {prefix}received_and_consume_cnt,
  count(*) FILTER (WHERE NOT recv AND used) AS {prefix}{no}received_and_consume_cnt,
  count(*) FILTER (WHERE NOT used) AS {prefix}{no}consume_cnt,
  count(DISTINCT user_id) FILTER (WHERE recv) AS {prefix}received_differ_user_cnt,
  count(DISTINCT user_id) AS {prefix}differ_user_cnt,
  count(DISTINCT user_id) FILTER (WHERE recv AND used) AS {prefix}received_and_consume_differ_user_cnt,
  count(DISTINCT user_id) FILTER (WHERE recv AND NOT used) AS {prefix}received_and_{no_}consume_differ_user_cnt,
  count(DISTINCT coupon0) AS {prefix}differ_coupon_cnt"""


MERCHANT_COUNTS = _merchant_counts("feature_merchant_id", "not", "not")
MERCHANT_COUNTS_V0 = _merchant_counts("feature_merchant_id_", "not_", "not_")
MERCHANT_STATS = _spreads("feature_merchant_id", "reduce_manjian_", "reduce_manjian_median")
MERCHANT_GAPS = _gaps("feature_merchant_id", "marchant_mean_time_gap_15")
MERCHANT_ALL = ",\n".join([MERCHANT_COUNTS, MERCHANT_STATS, MERCHANT_GAPS])

COUPON_V0 = """
  count(*) AS feature_coupon_id_received_cnt,
  count(*) FILTER (WHERE recv AND used) AS feature_coupon_id_received_and_consume_cnt,
  round(coalesce(avg(gap) FILTER (WHERE label = 1), 0), 6) AS feature_coupon_id_consume_mean_time_gap_15,
  CAST(coalesce(median(min_cost_of_manjian) FILTER (WHERE is_manjian = 1), 0) AS DOUBLE)
    AS feature_coupon_id_median_of_min_cost_of_manjian"""
COUPON_ALL = (
    COUPON_V0
    + """,
  round(count(*) FILTER (WHERE recv AND used) / CAST(count(*) AS DOUBLE), 6)
    AS feature_coupon_id_received_and_consume_rate"""
)


def _rate(part: str, whole: str, name: str) -> str:
    return f"round(coalesce({part} / nullif(CAST({whole} AS DOUBLE), 0), 0), 6) AS {name}"


_R, _U, _RU, _N = (
    "count(*) FILTER (WHERE recv)",
    "count(*) FILTER (WHERE used)",
    "count(*) FILTER (WHERE recv AND used)",
    "count(*)",
)

SEQUENCE = """
  CASE WHEN date_received = max(date_received) OVER uc THEN 1 ELSE 0 END
    AS this_month_user_receive_same_coupon_lastone,
  CASE WHEN date_received = max(date_received) OVER uc THEN 0 ELSE 1 END
    AS this_month_user_receive_same_coupon_firstone,
  CASE WHEN date_received = min(date_received) OVER uc THEN 1 ELSE 0 END AS is_first_receipt"""

GAPS = """
  CAST(coalesce(dn - max(dn) OVER (PARTITION BY user_id, coupon0 ORDER BY dn
                              RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS INT) AS day_gap_before,
  CAST(coalesce(min(dn) OVER (PARTITION BY user_id, coupon0 ORDER BY dn
                         RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - dn, -1) AS INT) AS day_gap_after,
  CAST(max(dn) OVER uc - min(dn) OVER uc AS INT) AS gap_sum,
  round((max(dn) OVER uc - min(dn) OVER uc) / CAST(count(*) OVER uc AS DOUBLE), 6) AS gap_mean"""

COUPON_REPEAT = """
  CASE WHEN count(*) OVER (PARTITION BY user_id, coupon0, date_received) > 1 THEN 1 ELSE 0 END
    AS simple_user_id_coupon_id_date_received_receive_receive"""
REPEATS = (
    COUPON_REPEAT
    + """,
  CASE WHEN count(*) OVER (PARTITION BY user_id, merchant_id, date_received) > 1 THEN 1 ELSE 0 END
    AS simple_user_id_merchant_id_date_received_receive_receive"""
)

RECEIPTS = "SELECT *, datediff('day', DATE '1970-01-01', date_received) AS dn FROM {source} WHERE recv"

# The days off, spelled out.
HOLIDAYS = """
2016-01-01 2016-01-02 2016-01-03 2016-01-09 2016-01-10 2016-01-16 2016-01-17 2016-01-23 2016-01-24 2016-01-30
2016-01-31 2016-02-07 2016-02-08 2016-02-09 2016-02-10 2016-02-11 2016-02-12 2016-02-13 2016-02-20 2016-02-21
2016-02-27 2016-02-28 2016-03-05 2016-03-06 2016-03-12 2016-03-13 2016-03-19 2016-03-20 2016-03-26 2016-03-27
2016-04-02 2016-04-03 2016-04-04 2016-04-09 2016-04-10 2016-04-16 2016-04-17 2016-04-23 2016-04-24 2016-04-30
2016-05-01 2016-05-02 2016-05-07 2016-05-08 2016-05-14 2016-05-15 2016-05-21 2016-05-22 2016-05-28 2016-05-29
2016-06-04 2016-06-05 2016-06-09 2016-06-10 2016-06-11 2016-06-18 2016-06-19 2016-06-25 2016-06-26 2016-07-02
2016-07-03 2016-07-09 2016-07-10 2016-07-16 2016-07-17 2016-07-23 2016-07-24 2016-07-30 2016-07-31
""".split()
_OFF = ", ".join(f"DATE '{day}'" for day in HOLIDAYS)
HOLIDAY = f"CASE WHEN date_received IN ({_OFF}) THEN 1 ELSE 0 END AS is_holiday"

_MONDAY_0 = "CAST(isodow(date_received) - 1 AS INT)"
WEEK = ",\n  ".join(f"CASE WHEN isodow(date_received) = {i + 1} THEN 1 ELSE 0 END AS week_{i}" for i in range(7))
WEEKDAY = ",\n  ".join(f"CASE WHEN isodow(date_received) = {i} THEN 1 ELSE 0 END AS weekday_{i}" for i in range(1, 8))
WEEKEND = "CASE WHEN isodow(date_received) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend"
DISTANCES = ",\n  ".join(f'CASE WHEN distance = {i} THEN 1 ELSE 0 END AS "distance__{i}"' for i in range(-1, 11))
ENCODED = f"{_MONDAY_0} AS week, {HOLIDAY}, {WEEKEND},\n  {WEEK},\n  {DISTANCES}"

CLEAN_COLUMNS = (
    RAW + ", is_manjian, round(discount_rate, 6) AS discount_rate, min_cost_of_manjian, reduce_manjian,"
    " null_distance, coupon0"
)

# The names of the interaction counts; the columns are read off them.
INTERACTIONS = {
    1: """unite_user_id unite_merchant_id unite_coupon_id unite_distance unite_discount_rate unite_date_received""",
    2: """unite_user_id_coupon_id unite_user_id_merchant_id unite_user_id_discount_rate unite_user_id_distance
    unite_user_id_date_received unite_merchant_id_coupon_id unite_merchant_id_discount_rate
    unite_merchant_id_distance unite_merchant_id_date_received unite_coupon_id_discount_rate
    unite_coupon_id_distance unite_coupon_id_date_received unite_discount_rate_distance
    unite_discount_rate_date_received""",
    3: """unite_user_id_merchant_id_date_received simple_user_id_merchant_id_coupon_id
    simple_user_id_merchant_id_discount_rate simple_user_id_merchant_id_distance
    simple_user_id_coupon_id_date_received simple_user_id_coupon_id_discount_rate
    simple_user_id_coupon_id_distance simple_user_id_discount_rate_distance
    simple_user_id_discount_rate_date_received simple_user_id_distance_date_received""",
    4: """unite_user_id_merchant_id_coupon_id_discount_rate simple_user_id_merchant_id_coupon_id_distance
    simple_user_id_merchant_id_coupon_id_date_received simple_user_id_merchant_id_discount_rate_distance
    simple_user_id_merchant_id_discount_rate_date_received simple_user_id_merchant_id_distance_date_received
    simple_user_id_coupon_id_discount_rate_distance simple_user_id_coupon_id_discount_rate_date_received
    simple_user_id_coupon_id_distance_date_received simple_user_id_discount_rate_distance_date_received
    simple_merchant_id_coupon_id_discount_rate_distance simple_merchant_id_coupon_id_discount_rate_date_received
    simple_merchant_id_coupon_id_distance_date_received simple_merchant_id_discount_rate_distance_date_received
    simple_coupon_id_discount_rate_distance_date_received""",
    5: """unite_user_id_merchant_id_coupon_id_discount_rate_distance
    simple_user_id_merchant_id_coupon_id_discount_rate_date_received
    simple_user_id_merchant_id_discount_rate_distance_date_received
    simple_user_id_coupon_id_discount_rate_distance_date_received
    simple_merchant_id_coupon_id_discount_rate_distance_date_received""",
}


def _interaction(size: int) -> str:
    named = {
        "user_id": "user_id",
        "merchant_id": "merchant_id",
        "coupon_id": "coupon0",
        "discount_rate": "discount_rate",
        "distance": "distance",
        "date_received": "date_received",
    }
    counts = []
    for name in INTERACTIONS[size].split():
        keys = ", ".join(column for text, column in named.items() if text in name)
        counts.append(f"count(*) OVER (PARTITION BY {keys}) AS {name}_receive_cnt")
    return (
        f"WITH {CLEAN} SELECT user_id, merchant_id, coupon0, round(discount_rate, 6) AS discount_rate, distance,"
        f" date_received, {', '.join(counts)} FROM c WHERE recv"
    )


def _basic(extra: str = "") -> str:
    by = "count(*) OVER (PARTITION BY user_id, {}{}) AS simple_user_id_{}"
    return ",\n  ".join(
        [
            by.format("coupon0", extra, "coupon_id_receive_cnt"),
            by.format("date_received", extra, "date_received_receive_cnt"),
            by.format("coupon0, date_received", extra, "coupon_id_date_received_receive_cnt"),
        ]
    )


BASIC = f"""count(*) OVER (PARTITION BY user_id) AS simple_user_id_receive_cnt,
  {_basic()},
  {COUPON_REPEAT},
  count(*) OVER (PARTITION BY user_id, distance) AS simple_user_id_distance_user_distance_receive,
  count(*) OVER (PARTITION BY user_id, merchant_id) AS simple_user_id_merchant_id_user_merchant_id_receive"""

KEYS = "user_id, merchant_id, coupon0, round(discount_rate, 6) AS discount_rate, distance, date_received"


def _between(column: str, first: str, last: str) -> str:
    return f"{column} BETWEEN DATE '{first}' AND DATE '{last}'"


def _active(first: str, last: str) -> str:
    used, received = _between("date_used", first, last), _between("date_received", first, last)
    return f"({used} OR (date_used IS NULL AND {received}))"


DATASETS = {
    1: ("2016-04-14", "2016-05-14"),
    "1w": ("2016-04-02", "2016-05-14"),
    2: ("2016-05-15", "2016-06-15"),
}
FEATURES = {
    1: ("2016-01-01", "2016-04-13"),
    "1w": ("2016-01-01", "2016-04-13"),
    2: ("2016-02-01", "2016-05-14"),
    3: ("2016-03-15", "2016-06-30"),
}
HISTORY = {
    "train": ("2016-03-02", "2016-04-30"),
    "validate": ("2016-01-16", "2016-03-15"),
    "test": ("2016-04-17", "2016-06-15"),
}
MIDDLE = {
    "train": ("2016-05-01", "2016-05-15"),
    "validate": ("2016-03-16", "2016-03-30"),
    "test": ("2016-06-16", "2016-06-30"),
}
LABEL = {"train": ("2016-05-16", "2016-06-15"), "validate": ("2016-03-31", "2016-04-30")}

SCORING = "date_received >= DATE '2016-07-01'"
FIRSTS = "firsts AS (SELECT coupon0, min(date_received) AS first_date_received FROM c GROUP BY coupon0)"
IS_FIRST = "CASE WHEN date_received = first_date_received THEN 1 ELSE 0 END AS is_first_date_received"


def _entity_join(rows: str, users: str, merchants: str, coupons: str) -> str:
    """Left joins of three entity tables to ``rows``; absent entities get 0."""

    def filled(table: str, key: str) -> str:
        return f"COALESCE(COLUMNS({table}.* EXCLUDE ({key})), 0)"

    return f"""
SELECT r.*, {filled('u', 'user_id')}, {filled('m', 'merchant_id')}, {filled('k', 'coupon0')}
FROM {rows} r
LEFT JOIN {users} u ON r.user_id = u.user_id
LEFT JOIN {merchants} m ON r.merchant_id = m.merchant_id
LEFT JOIN {coupons} k ON r.coupon0 = k.coupon0"""


def _tables(tag: str, where: str, users: str = USER_ALL, merchants: str = MERCHANT_ALL, coupons: str = COUPON_ALL) -> str:
    return f"""
u{tag} AS (SELECT user_id, {users} FROM c WHERE {where} GROUP BY user_id),
m{tag} AS (SELECT merchant_id, {merchants} FROM c WHERE {where} GROUP BY merchant_id),
k{tag} AS (SELECT coupon0, {coupons} FROM c WHERE {where} GROUP BY coupon0)"""


def _row_features(where: str, distinct: bool, first_flag: bool, extra: str = "") -> str:
    flag = f"{IS_FIRST}, " if first_flag else ""
    joined = "LEFT JOIN firsts USING (coupon0)" if first_flag else ""
    return f"""
SELECT {'DISTINCT' if distinct else ''} {CLEAN_COLUMNS}, {flag}{extra}
  {SEQUENCE}, {GAPS}, {REPEATS}, {ENCODED}
FROM ({RECEIPTS.format(source='c')} AND {where}) {joined}
WINDOW uc AS (PARTITION BY user_id, coupon0)"""


def _training(windows: tuple) -> str:
    parts, selects = [], []
    for i in windows:
        parts.append(_tables(f"_{i}", _active(*FEATURES[i])))
        parts.append(f"r_{i} AS ({_row_features(_between('date_received', *DATASETS[i]), True, True)})")
        selects.append(_entity_join(f"r_{i}", f"u_{i}", f"m_{i}", f"k_{i}"))
    return f"""WITH {CLEAN}, {FIRSTS}, {', '.join(parts)}
SELECT *, CASE WHEN date_used - date_received <= 15 THEN 1 ELSE 0 END AS label
FROM ({' UNION ALL '.join(selects)})"""


def _scoring_set() -> str:
    rows = _row_features(SCORING, False, True).replace(
        "date_received, date_used,", "date_received, CAST(NULL AS DATE) AS date_used,", 1
    )
    return f"""WITH {CLEAN}, {FIRSTS}, {_tables('_3', _active(*FEATURES[3]))}, r AS ({rows})
{_entity_join('r', 'u_3', 'm_3', 'k_3')}"""


def _assemble_window() -> str:
    rows = _row_features(_between("date_received", *DATASETS[2]), False, False)
    return f"""WITH {CLEAN}, {_tables('_2', _active(*FEATURES[2]))}, r AS ({rows})
{_entity_join('r', 'u_2', 'm_2', 'k_2')}"""


def _v0_set() -> str:
    sets = " UNION ALL ".join(
        f"SELECT *, '{name}' AS split FROM c WHERE {_between('date_received', *span)}" for name, span in HISTORY.items()
    )
    users = USER_COUNTS + "," + USER_MERCHANTS
    tables = _tables("0", _between("date_received", *HISTORY["train"]), users, MERCHANT_COUNTS_V0, COUPON_V0)
    flag = COUPON_REPEAT.replace("date_received)", "date_received, split)")
    return f"""WITH {CLEAN}, s AS ({sets}), {tables},
r AS (SELECT {CLEAN_COLUMNS}, split, {_basic(', split')}, {flag}, {ENCODED} FROM s)
{_entity_join('r', 'u0', 'm0', 'k0')}"""


def _basic_rows(where: str, columns: str = CLEAN_COLUMNS) -> str:
    return f"SELECT {columns}, {BASIC}, {ENCODED} FROM c WHERE recv AND {where}"


def _prefixed(text: str, prefix: str) -> str:
    return text.replace(" AS field_", f" AS {prefix}field_").replace(" AS feature_", f" AS {prefix}feature_").replace(
        "\n    AS feature_", f"\n    AS {prefix}feature_"
    )


def _three_fields(name: str) -> str:
    users = USER_COUNTS + "," + USER_MERCHANTS
    parts = []
    for tag, prefix, where in (
        ("h", "history_", _between("date_received", *HISTORY[name])),
        ("w", "middle_", _between("date_used", *MIDDLE[name])),
    ):
        named = [_prefixed(text, prefix) for text in (users, MERCHANT_COUNTS_V0, COUPON_ALL)]
        parts.append(_tables(tag, where, *named))
    # The third label field is the scoring log, which has no label.
    labelled = name in LABEL
    rows = _basic_rows(_between("date_received", *LABEL[name]) if labelled else SCORING, CLEAN_COLUMNS + ", row_id")
    label = ", CASE WHEN date_used - date_received <= 15 THEN 1 ELSE 0 END AS label" if labelled else ""
    first = _entity_join("r", "uh", "mh", "kh")
    second = _entity_join("a", "uw", "mw", "kw")
    return f"""WITH {CLEAN}, {', '.join(parts)}, r AS ({rows}), a AS ({first}), b AS ({second})
SELECT * EXCLUDE (merchant_id, discount_raw, date_used){label}
FROM b"""


_BAYES_INPUTS = ("user_id", "merchant_id", "coupon0", "discount_share", "distance")


def _naive_bayes(kind: str) -> str:
    """Closed forms of both classifiers on the positional split."""
    each = range(len(_BAYES_INPUTS))
    sums = ", ".join(f"sum(x{j}) AS s{j}, sum(x{j} * x{j}) AS q{j}" for j in each)
    if kind == "multinomial":
        whole = " + ".join(f"s{j}" for j in each)
        facts = ", ".join(f"ln(s{j} + 0.1) - ln({whole} + 0.5) AS t{j}" for j in each)
        prior = "ln(n + 0.1) - ln(sum(n) OVER () + 0.1 * count(*) OVER ())"
        parts = " + ".join(f"x{j} * t{j}" for j in each)
        spread = "count(*)"
    else:
        # A billionth of the greatest variance of any input is added to each.
        spread = "1e-9 * greatest(" + ", ".join(f"var_samp(x{j})" for j in each) + ")"
        facts = ", ".join(f"s{j} / n AS m{j}, q{j} / n - (s{j} / n) * (s{j} / n) + least AS v{j}" for j in each)
        prior = "ln(n) - ln(sum(n) OVER ())"
        parts = "-0.5 * (" + " + ".join(f"ln(v{j}) + (x{j} - m{j}) * (x{j} - m{j}) / v{j}" for j in each) + ")"
    inputs = ", ".join(f"CAST({name} AS DOUBLE) AS x{j}" for j, name in enumerate(_BAYES_INPUTS))
    return f"""WITH {LOG}, e AS (SELECT row_id, user_id, merchant_id, coalesce(coupon_id, 0) AS coupon0,
            CASE WHEN contains(discount_raw, ':') THEN CAST(split_part(discount_raw, ':', 2) AS DOUBLE)
              / CAST(split_part(discount_raw, ':', 1) AS DOUBLE) ELSE 0 END AS discount_share,
            coalesce(distance, 0) AS distance, coalesce(date_received, date_used) AS event_date,
            CASE WHEN coupon_id IS NULL THEN (CASE WHEN date_used IS NULL THEN -2 ELSE -1 END)
                 WHEN date_used IS NULL THEN 0 ELSE 1 END AS label FROM log),
        p AS (SELECT *, {inputs}, count(*) OVER () AS n_all,
            row_number() OVER (ORDER BY event_date NULLS FIRST, md5(row_id), row_id) AS place FROM e),
        train AS (SELECT * FROM p WHERE place <= n_all * 1500000 // 1754884),
        test AS (SELECT * FROM p WHERE place > n_all * 1500000 // 1754884),
        g AS (SELECT label AS class, CAST(count(*) AS DOUBLE) AS n, {sums} FROM train GROUP BY label),
        a AS (SELECT {spread} AS least FROM train),
        f AS (SELECT class, {prior} AS prior, {facts} FROM g, a),
        s AS (SELECT row_id, user_id, coupon0, label, class, prior + {parts} AS score FROM test, f)
        SELECT user_id, coupon0, label, prediction FROM
          (SELECT user_id, coupon0, label, class AS prediction, row_number() OVER (PARTITION BY row_id ORDER BY score DESC) AS k FROM s)
        WHERE k = 1"""


SCORES = f"""{CLEAN},
s AS (SELECT coupon0, label, CAST((user_id * 31 + coupon0) % 101 AS DOUBLE) / 101 AS prob FROM c WHERE recv),
ranked AS (SELECT *, rank() OVER (PARTITION BY coupon0 ORDER BY prob)
                     + (count(*) OVER (PARTITION BY coupon0, prob) - 1) / 2.0 AS place FROM s),
g AS (SELECT coupon0, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label <> 1) AS negatives,
             sum(place) FILTER (WHERE label = 1) AS places FROM ranked GROUP BY coupon0),
a AS (SELECT coupon0, positives, negatives,
             (places - positives * (positives + 1) / 2.0) / (CAST(positives AS DOUBLE) * negatives) AS auc
      FROM g WHERE positives > 0 AND negatives > 0)"""

_STAGE = f"""WITH {LOG}, st AS (
SELECT user_id, merchant_id, coupon_id, date_received, date_used, discount_raw,
  CASE WHEN discount_raw IS NULL THEN 1.0
       WHEN contains(discount_raw, ':') THEN 1 - TRY_CAST(split_part(discount_raw, ':', 2) AS DOUBLE)
                                                 / TRY_CAST(split_part(discount_raw, ':', 1) AS DOUBLE)
       ELSE TRY_CAST(discount_raw AS DOUBLE) END AS discount_rate,
  CASE WHEN contains(discount_raw, ':') THEN TRY_CAST(split_part(discount_raw, ':', 1) AS INT) ELSE 0 END AS discount_man,
  CASE WHEN contains(discount_raw, ':') THEN TRY_CAST(split_part(discount_raw, ':', 2) AS INT) ELSE 0 END AS discount_jian,
  CASE WHEN discount_raw IS NULL THEN NULL WHEN contains(discount_raw, ':') THEN 1 ELSE 0 END AS discount_type,
  coalesce(distance, -1) AS distance,
  CASE WHEN date_received IS NULL THEN -1 WHEN date_used - date_received <= 15 THEN 1 ELSE 0 END AS label
FROM log)"""

_LABEL3 = "CASE WHEN date_received IS NULL THEN -1 WHEN date_used - date_received <= 15 THEN 1 ELSE 0 END"
_KEPT = f"WITH {LOG}, l AS (SELECT *, {_LABEL3} AS label FROM log WHERE date_received IS NOT NULL)"
_PLACE = """row_number() OVER (PARTITION BY label ORDER BY md5(row_id), row_id) AS place,
            count(*) OVER (PARTITION BY label) AS n"""


def _split_union(spans: dict, column: str) -> str:
    return f"WITH {LOG} " + " UNION ALL ".join(
        f"SELECT {RAW}, '{name}' AS split FROM log WHERE {_between(column, *span)}" for name, span in spans.items()
    )


def _nulls() -> str:
    columns = RAW.split(", ")
    return f"WITH {LOG} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) > count({c}) AS INT) AS has_null,"
        f" round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_ratio FROM log"
        for c in columns
    )


def _scaled() -> str:
    names = "user_id merchant_id discount_rate discount_type discount_man discount_jian distance".split()
    scaled = ", ".join(
        f"round((v_{n} - avg(v_{n}) OVER ()) / stddev_samp(v_{n}) OVER (), 6) AS scaled_{n}" for n in names
    )
    values = ", ".join(f"CAST(coalesce({n}, 0) AS DOUBLE) AS v_{n}" for n in names)
    return f"{_STAGE}, v AS (SELECT user_id, merchant_id, {values} FROM st) SELECT user_id, merchant_id, {scaled} FROM v"


KNN = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label,
                  substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS held_out FROM embeddings),
d AS (SELECT t.vec_id AS test_id, n.vec_id AS train_id, n.label, list_distance(t.v, n.v) AS distance
      FROM e t, e n WHERE t.held_out AND NOT n.held_out),
k AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id) AS place FROM d),
votes AS (SELECT test_id, label, count(*) AS votes FROM k WHERE place <= 5 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY votes DESC, label) AS r FROM votes)
SELECT test_id, label AS prediction, votes FROM best WHERE r = 1"""


def _user(columns: str) -> str:
    return f"WITH {CLEAN} SELECT user_id, {columns} FROM c GROUP BY user_id"


def _merchant(columns: str) -> str:
    return f"WITH {CLEAN} SELECT merchant_id, {columns} FROM c GROUP BY merchant_id"


def sql() -> dict[str, str]:
    """SQL by query name."""
    number = "CAST(coalesce(strftime({}, '%Y%m%d'), '0') AS INT)"
    received = number.format("date_received")
    texts = {
        "clean_discounts": f"""WITH {CLEAN} SELECT user_id, merchant_id, coupon0, is_manjian,
            round(discount_rate, 6) AS discount_rate, min_cost_of_manjian, reduce_manjian, distance, null_distance,
            date_received, date_used FROM c""",
        "staged_discounts": f"""{_STAGE} SELECT user_id, merchant_id, coupon_id, round(discount_rate, 6) AS discount_rate,
            discount_man, discount_jian, discount_type,
            round(CASE WHEN contains(discount_raw, ':') THEN discount_jian / CAST(discount_man AS DOUBLE) ELSE 0 END, 6)
              AS discount_share, distance, label FROM st""",
        "date_numbers": f"""WITH {LOG} SELECT user_id, {received} AS received_number,
            {number.format('date_used')} AS used_number, date_received AS parsed_received FROM log""",
        "read_receipts": f"WITH {LOG} SELECT {RAW} FROM log WHERE {_WHOLE}",
        "read_scoring": f"""WITH {LOG} SELECT user_id, merchant_id, coupon_id, discount_raw, distance, date_received,
            CAST(NULL AS DATE) AS date_used FROM log WHERE {_WHOLE}""",
        "rejected_lines": f"""WITH {LOG} SELECT concat(
                CASE WHEN user_id % 50 = 7 THEN 'u' ELSE '' END, user_id, ',',
                CASE WHEN user_id % 50 = 8 THEN 'null' ELSE CAST(merchant_id AS VARCHAR) END, ',',
                coalesce(CAST(coupon_id AS VARCHAR), 'null'), ',', coalesce(discount_raw, 'null'),
                CASE WHEN user_id % 50 = 10 THEN '' ELSE concat(',', coalesce(CAST(distance AS VARCHAR), 'null'), ',',
                    CASE WHEN user_id % 50 = 9 THEN '20160231' ELSE coalesce(strftime(date_received, '%Y%m%d'), 'null') END, ',',
                    coalesce(strftime(date_used, '%Y%m%d'), 'null')) END) AS line,
            CASE user_id % 50 WHEN 8 THEN 'key' WHEN 9 THEN 'date' ELSE 'fields' END AS reason
            FROM log WHERE NOT ({_WHOLE})""",
        "staged_read_back": f"WITH {LOG} SELECT {RAW}, {_LABEL3} AS label FROM log",
        "sets_read_back": f"""WITH {LOG} SELECT {RAW}, 'train' AS split FROM log WHERE {_between('date_received', *DATASETS[1])}
            UNION ALL SELECT {RAW}, 'validate' AS split FROM log WHERE {_between('date_received', *DATASETS[2])}""",
        "submission_read_back": f"""WITH {LOG} SELECT user_id, coupon_id, strftime(date_received, '%Y%m%d') AS date_received,
            CAST(coalesce(distance, 0) AS DOUBLE) / 16 AS prob FROM log WHERE date_received IS NOT NULL""",
        "label_15d": f"WITH {CLEAN} SELECT user_id, coupon_id, date_received, date_used, gap, label FROM c",
        "label_3way": f"WITH {LOG} SELECT {RAW}, {_LABEL3} AS label FROM log",
        "label_4way": f"""WITH {LOG} SELECT {RAW},
            CASE WHEN coupon_id IS NULL THEN (CASE WHEN date_used IS NULL THEN -2 ELSE -1 END)
                 WHEN date_used IS NULL THEN 0 ELSE 1 END AS label FROM log""",
        "label_distribution": f'WITH {LOG} SELECT {_LABEL3} AS label, count(*) AS "rows" FROM log GROUP BY 1',
        "labelled_rows": f"WITH {LOG} SELECT {RAW}, {_LABEL3} AS label FROM log WHERE {_LABEL3} <> -1",
        "quadrants": f"""WITH {LOG} SELECT r AS received, u AS used, count(date_n) AS "rows" FROM
            (VALUES (0), (1)) a(r) CROSS JOIN (VALUES (0), (1)) b(u)
            LEFT JOIN (SELECT CAST(date_received IS NOT NULL AS INT) AS rr, CAST(date_used IS NOT NULL AS INT) AS uu,
                              1 AS date_n FROM log) ON r = rr AND u = uu GROUP BY r, u""",
        "null_profile": _nulls(),
        "value_domain": f"WITH {CLEAN} SELECT DISTINCT round(discount_rate, 6) AS discount_rate FROM c",
        "distance_domain": f"WITH {CLEAN} SELECT DISTINCT distance FROM c",
        "date_span": f"""WITH {LOG} SELECT min(date_received) AS first_received, max(date_received) AS last_received,
            min(date_used) AS first_used, max(date_used) AS last_used FROM log""",
        "cold_users": f"""WITH {LOG} SELECT DISTINCT user_id FROM log WHERE {SCORING} AND user_id NOT IN
            (SELECT user_id FROM log WHERE {_between('date_received', *DATASETS[2])})""",
        "cold_merchants": f"""WITH {LOG} SELECT DISTINCT merchant_id FROM log WHERE merchant_id NOT IN
            (SELECT merchant_id FROM log WHERE {_between('date_used', *MIDDLE['validate'])})""",
        "preview": f"WITH {LOG} SELECT {RAW}, row_id FROM log ORDER BY row_id LIMIT 10",
        **{f"feature_window_{i}": f"WITH {LOG} SELECT {RAW} FROM log WHERE {_active(*FEATURES[i])}" for i in (1, 2, 3)},
        **{
            f"dataset_window_{name}": f"WITH {LOG} SELECT {RAW} FROM log WHERE {_between('date_received', *DATASETS[i])}"
            for name, i in (("1", 1), ("1_as_written", "1w"), ("2", 2))
        },
        "scoring_rows": f"WITH {LOG} SELECT {RAW.replace(', date_used', '')} FROM log WHERE {SCORING}",
        "history_field": _split_union(HISTORY, "date_received"),
        "middle_field": _split_union(MIDDLE, "date_used"),
        "label_field": _split_union(LABEL, "date_received"),
        "stratified_split": f"""{_KEPT}, p AS (SELECT *, {_PLACE} FROM l) SELECT row_id, user_id, label,
            CASE WHEN place <= ceil(n * 0.2) THEN 'validate' ELSE 'train' END AS split FROM p""",
        "stratified_folds": f"""{_KEPT}, p AS (SELECT *, {_PLACE} FROM l) SELECT row_id, user_id, label,
            CASE WHEN place <= n // 3 THEN 0 WHEN place <= n * 2 // 3 THEN 1 ELSE 2 END AS fold FROM p""",
        "date_split": f"""WITH {LOG} SELECT {RAW},
            CASE WHEN date_received < DATE '2016-05-30' THEN 'train' ELSE 'validate' END AS split
            FROM log WHERE date_received <= DATE '2016-06-15'""",
        "positional_split": f"""WITH {LOG}, e AS (SELECT *, coalesce(date_received, date_used) AS event_date FROM log),
            p AS (SELECT *, count(*) OVER () AS n,
              row_number() OVER (ORDER BY event_date NULLS FIRST, md5(row_id), row_id) AS place FROM e)
            SELECT row_id, user_id, event_date,
              CASE WHEN place <= n * 1500000 // 1754884 THEN 'train' ELSE 'test' END AS split FROM p""",
        "user_counts": _user(USER_COUNTS),
        "user_distincts": _user(USER_DISTINCTS),
        "user_stats": _user(USER_STATS),
        "user_frequency": _user(USER_FREQUENCY),
        "user_gaps": _user(USER_GAPS),
        "user_features": _user(USER_ALL),
        "user_features_v0": _user(USER_COUNTS + "," + USER_MERCHANTS),
        "merchant_counts": _merchant(MERCHANT_COUNTS),
        "merchant_stats": _merchant(MERCHANT_STATS),
        "merchant_gaps": _merchant(MERCHANT_GAPS),
        "merchant_features_v0": _merchant(MERCHANT_COUNTS_V0),
        "coupon_features": f"WITH {CLEAN} SELECT coupon0, {COUPON_ALL} FROM c GROUP BY coupon0",
        "coupon_features_v0": f"WITH {CLEAN} SELECT coupon0, {COUPON_V0} FROM c GROUP BY coupon0",
        "redemption_rates": _user(
            ", ".join(
                [
                    _rate(_RU, _R, "field_user_id_receive_and_consumer_rate"),
                    _rate(_U, _N, "field_user_id_consumer_rate"),
                    _rate(_R, _N, "field_user_id_receive_rate"),
                    "count(DISTINCT merchant_id) FILTER (WHERE label = 1)"
                    " AS field_user_id_receive_and_consume_differ_merchant_cnt_15",
                ]
            )
        ),
        "merchant_rates": _merchant(
            ", ".join(
                [
                    _rate(_RU, _R, "feature_merchant_idreceived_and_consume_rate"),
                    _rate(_U, _N, "feature_merchant_idconsumer_rate"),
                    _rate(_R, _N, "feature_merchant_idreceive_rate"),
                ]
            )
        ),
        "basic_counts": f"WITH {CLEAN} SELECT {KEYS}, {BASIC} FROM c WHERE recv",
        "v0_row_features": f"WITH {CLEAN} SELECT {KEYS}, {_basic()}, {COUPON_REPEAT} FROM c WHERE recv",
        **{f"interaction_{size}": _interaction(size) for size in INTERACTIONS},
        "receipt_order": f"""WITH {CLEAN} SELECT user_id, merchant_id, coupon0, date_received, {SEQUENCE}
            FROM c WHERE recv WINDOW uc AS (PARTITION BY user_id, coupon0)""",
        "receipt_gaps": f"""WITH {CLEAN} SELECT user_id, coupon0, date_received, {GAPS}
            FROM ({RECEIPTS.format(source='c')}) WINDOW uc AS (PARTITION BY user_id, coupon0)""",
        "receipt_bounds": f"""WITH {CLEAN} SELECT user_id, coupon0, max(date_received) AS max_date_received,
            min(date_received) AS min_date_received FROM c WHERE recv GROUP BY ALL""",
        "repeat_flags": f"""WITH {CLEAN} SELECT user_id, merchant_id, coupon0, date_received, {REPEATS}
            FROM c WHERE recv""",
        "first_receipt": f"""WITH {CLEAN}, {FIRSTS} SELECT user_id, coupon0, date_received, {IS_FIRST}
            FROM c LEFT JOIN firsts USING (coupon0)""",
        "first_dates": f"WITH {CLEAN}, {FIRSTS} SELECT * FROM firsts",
        "weekday_onehot": f"""WITH {LOG} SELECT user_id, date_received, {_MONDAY_0} AS week,
            CAST(isodow(date_received) AS INT) AS weekday, {WEEKEND}, {WEEK}, {WEEKDAY} FROM log""",
        "distance_onehot": f"WITH {CLEAN} SELECT user_id, distance, {DISTANCES} FROM c",
        "holiday_flag": f"WITH {LOG} SELECT user_id, date_received, {HOLIDAY} FROM log",
        "day_of_month": f"""WITH {LOG} SELECT user_id, date_received,
            CAST(day(date_received) AS INT) AS day_of_month FROM log""",
        "assemble_window": _assemble_window(),
        "training_set": _training((1, 2)),
        "training_set_as_written": _training(("1w", 2)),
        "scoring_set": _scoring_set(),
        "basic_set": f"""WITH {CLEAN} {_basic_rows(_between('date_received', *HISTORY['train']),
            CLEAN_COLUMNS + ', label')}""",
        "assemble_v0": _v0_set(),
        "three_fields": _three_fields("train"),
        "three_fields_validate": _three_fields("validate"),
        "three_fields_test": _three_fields("test"),
        "coupon_auc": f"WITH {SCORES} SELECT coupon0, positives, negatives, round(auc, 6) AS auc FROM a",
        "mean_coupon_auc": f"WITH {SCORES} SELECT round(avg(auc), 6) AS mean_auc, count(*) AS coupons FROM a",
        "mismatch_count": f"""WITH {SCORES} SELECT
            count(*) FILTER (WHERE CAST(prob > 0.5 AS INT) <> label) AS mismatches, count(*) AS "rows" FROM s""",
        "global_auc": f"""WITH {CLEAN},
            f AS (SELECT label, CAST((user_id * 7919 + coupon0 * 31) % 100003 AS DOUBLE) / 100003 AS prob FROM c WHERE recv),
            w AS (SELECT label, rank() OVER (ORDER BY prob)
              + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS place FROM f),
            t AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS q,
                         sum(place) FILTER (WHERE label = 1) AS places FROM w)
            SELECT round((places - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * q), 6) AS auc FROM t""",
        "naive_bayes_gaussian": _naive_bayes("gaussian"),
        "naive_bayes_multinomial": _naive_bayes("multinomial"),
        "scaled_predictors": _scaled(),
        "knn_vote": KNN,
    }
    return texts
