"""Queries written in the mapping language: the verbs by family, segments, loops, lookups and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.compiler import Transform

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(name: str, table: str, fields: str, sql: str | None, *, keep=(), order=(), partition=(), prepare=None, head: str = "", section: str = "{}", after=None):
    """Register a mapping over a table and its SQL."""
    text = f"{head}\n{section}\n{fields}"

    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        df = prepare(df) if prepare else df
        out = Transform(text).apply(df, keep=keep, order=order, partition=partition)
        return after(out) if after else out

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


mapped(
    "flagship", "orders",
    """
key = @.o_orderkey
status = %lookupDefault "STATUS.name" @.o_orderstatus "other"
priority = %upper @.o_orderpriority
weekday = %dayOfWeek @.o_orderdate
taxed = %round %multiply @.o_totalprice @$const.rate ##2
place = %rowNumber "x"
running = %round %accumulate "total" @.o_totalprice ##2
""",
    """SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'other' END AS status, upper(o_orderpriority) AS priority,
    isodow(o_orderdate)::BIGINT AS weekday, round((o_totalprice * 1.1)::DECIMAL(38, 9), 2)::DOUBLE AS taxed, row_number() OVER w AS place, round(sum(o_totalprice) OVER w, 2) AS running
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
    head='{$}\nconst.rate = #1.1\n{$accumulator}\ntotal = #0\n{$table.STATUS[code,name]}\nO, "open"\nF, "finished"', order=("o_orderkey",), partition=("o_custkey",),
)

mapped(
    "verbs_text_case", "customer",
    """
id = @.c_custkey
v_upper = %upper @.c_name
v_lower = %lower @.c_mktsegment
v_trim = %trim %wrap @.c_name "  " "\\t "
v_trim_left = %trimLeft %wrap @.c_name "  " " "
v_trim_right = %trimRight %wrap @.c_name " " " \\n"
v_capitalize = %capitalize %lower @.c_mktsegment
v_title = %titleCase %lower @.c_name
v_camel = %camelCase @.c_name
v_pascal = %pascalCase @.c_name
v_snake = %snakeCase @.c_name
v_kebab = %kebabCase @.c_name
v_slug = %slugify @.c_name
v_space = %normalizeSpace %concat @.c_name "   " @.c_mktsegment " "
v_clean = %clean %concat " " @.c_name
v_reverse = %reverseString @.c_name
v_length = %length @.c_name
v_words = %wordCount %concat @.c_name " " @.c_mktsegment
""",
    """SELECT c_custkey AS id, upper(c_name) AS v_upper, lower(c_mktsegment) AS v_lower, c_name AS v_trim, c_name || ' ' AS v_trim_left, ' ' || c_name AS v_trim_right,
    upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] AS v_capitalize,
    list_aggregate(list_transform(regexp_extract_all(lower(c_name), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS v_title,
    lower(regexp_extract_all(c_name, '[a-zA-Z0-9]+')[1]) || list_aggregate(list_transform(regexp_extract_all(c_name, '[a-zA-Z0-9]+')[2:] || [''], lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS v_camel,
    list_aggregate(list_transform(regexp_extract_all(c_name, '[a-zA-Z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS v_pascal,
    lower(list_aggregate(regexp_extract_all(c_name, '[a-zA-Z0-9]+'), 'string_agg', '_')) AS v_snake, lower(list_aggregate(regexp_extract_all(c_name, '[a-zA-Z0-9]+'), 'string_agg', '-')) AS v_kebab,
    regexp_replace(trim(regexp_replace(lower(c_name), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+', '-', 'g') AS v_slug, c_name || ' ' || c_mktsegment AS v_space, c_name AS v_clean, reverse(c_name) AS v_reverse,
    length(c_name) AS v_length, len(string_split(c_name || ' ' || c_mktsegment, ' ')) AS v_words FROM customer""",
)

mapped(
    "verbs_text_slice", "part",
    """
id = @.p_partkey
v_concat = %concat @.p_name "/" @.p_size "/" @.p_brand
v_substring = %substring @.p_name ##2 ##3
v_tail = %substring @.p_name ##-3 ##2
v_truncate = %truncate @.p_name ##4
v_replace = %replace @.p_brand "Brand" "B"
v_regex = %replaceRegex @.p_name "[aeiou]+" "_"
v_split = %split @.p_brand "#" ##1
v_tokens = %join %tokenize @.p_type " " "|"
v_contains = %contains @.p_name "o"
v_starts = %startsWith @.p_brand "Brand"
v_ends = %endsWith @.p_name "1"
v_match = %match @.p_name "[0-9]$"
v_matches = %matches @.p_type "^[A-Z]+"
v_left = %leftOf @.p_brand "#"
v_right = %rightOf @.p_brand "#"
v_between = %between %wrap @.p_brand "<" ">" "<" ">"
v_pad = %pad @.p_size ##4 "."
v_pad_left = %padLeft @.p_size ##4 "0"
v_pad_right = %padRight @.p_size ##1 "0"
v_center = %center @.p_size ##5 "*"
v_repeat = %repeat @.p_size ##2
v_wrap = %wrap @.p_size "(" ")"
v_mask = %mask @.p_brand "##-A*"
v_distance = %levenshtein @.p_name @.p_brand
""",
    """SELECT p_partkey AS id, p_name || '/' || p_size || '/' || p_brand AS v_concat, substr(p_name, 3, 3) AS v_substring, substr(p_name, length(p_name) - 2, 2) AS v_tail, left(p_name, 4) AS v_truncate,
    replace(p_brand, 'Brand', 'B') AS v_replace, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS v_regex, string_split(p_brand, '#')[2] AS v_split,
    array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') AS v_tokens, contains(p_name, 'o') AS v_contains, starts_with(p_brand, 'Brand') AS v_starts,
    ends_with(p_name, '1') AS v_ends, regexp_matches(p_name, '[0-9]$') AS v_match, regexp_matches(p_type, '^[A-Z]+') AS v_matches, string_split(p_brand, '#')[1] AS v_left,
    CASE WHEN contains(p_brand, '#') THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS v_right, p_brand AS v_between, rpad(p_size::VARCHAR, greatest(4, length(p_size::VARCHAR))::INT, '.') AS v_pad,
    lpad(p_size::VARCHAR, greatest(4, length(p_size::VARCHAR))::INT, '0') AS v_pad_left, p_size::VARCHAR AS v_pad_right,
    repeat('*', (5 - length(p_size::VARCHAR)) // 2) || p_size || repeat('*', 5 - length(p_size::VARCHAR) - (5 - length(p_size::VARCHAR)) // 2) AS v_center,
    repeat(p_size::VARCHAR, 2) AS v_repeat, '(' || p_size || ')' AS v_wrap,
    substr(p_brand, 1, 2) || CASE WHEN length(p_brand) > 2 THEN '-' ELSE '' END || substr(p_brand, 3, 2) AS v_mask, levenshtein(p_name, p_brand) AS v_distance FROM part""",
)

mapped(
    "verbs_encoding", "orders",
    """
id = @.o_orderkey
v_b64 = %base64Encode @.o_orderpriority
v_b64d = %base64Decode %base64Encode @.o_orderpriority
v_hex = %hexEncode @.o_orderpriority
v_hexd = %hexDecode %hexEncode @.o_orderpriority
v_url = %urlEncode @.o_orderpriority
v_urld = %urlDecode %urlEncode @.o_orderpriority
v_sha256 = %sha256 @.o_orderpriority
v_sha1 = %sha1 @.o_orderpriority
v_sha512 = %sha512 "abc"
v_md5 = %md5 @.o_orderpriority
v_crc = %crc32 "123456789"
v_json = %jsonEncode @.o_orderpriority
v_decoded = %jsonPath %wrap @.o_orderkey "{\\"a\\":" "}" "$.a"
v_uuid = %uuid "seed"
""",
    """SELECT o_orderkey AS id, base64(encode(o_orderpriority)) AS v_b64, o_orderpriority AS v_b64d, lower(hex(o_orderpriority)) AS v_hex, o_orderpriority AS v_hexd, replace(url_encode(o_orderpriority), '+', '%20') AS v_url,
    o_orderpriority AS v_urld, sha256(o_orderpriority) AS v_sha256, sha1(o_orderpriority) AS v_sha1,
    'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS v_sha512, md5(o_orderpriority) AS v_md5, 3421780262 AS v_crc,
    '"' || o_orderpriority || '"' AS v_json, o_orderkey::VARCHAR AS v_decoded, '92597597-79c7-5c07-b0df-6d96e9de8df8' AS v_uuid FROM orders""",
)

mapped(
    "verbs_logic", "lineitem",
    """
id = @.l_orderkey
line = @.l_linenumber
v_eq = %eq @.l_returnflag "R"
v_ne = %ne @.l_linenumber "1"
v_lt = %lt @.l_quantity ##10
v_lte = %lte @.l_quantity ##10
v_gt = %gt @.l_discount #0.05
v_gte = %gte @.l_tax "0.05"
v_and = %and %gt @.l_quantity ##10 %lt @.l_quantity ##20
v_or = %or %eq @.l_returnflag "A" %eq @.l_returnflag "R"
v_xor = %xor %gt @.l_quantity ##10 %gt @.l_quantity ##20
v_not = %not @.l_discount
v_if = %ifElse %gt @.l_quantity ##25 "large" "small"
v_cond = %cond %gt @.l_quantity ##40 "xl" %gt @.l_quantity ##20 "l" "m"
v_switch = %switch @.l_returnflag "A" "accepted" "R" "returned" "none"
v_coalesce = %coalesce ~ @.l_linestatus
v_ifnull = %ifNull ~ @.l_returnflag
v_ifempty = %ifEmpty "" @.l_returnflag
v_isnull = %isNull @.missing
v_string = %isString @.l_returnflag
v_number = %isNumber @.l_quantity
v_boolean = %isBoolean @.l_quantity
v_array = %isArray @.l_quantity
v_object = %isObject @.l_quantity
v_date = %isDate @.l_returnflag
v_type = %typeOf @.l_quantity
v_assert = %assert %gt @.l_quantity ##0 "no quantity"
""",
    """SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag = 'R' AS v_eq, l_linenumber <> 1 AS v_ne, l_quantity < 10 AS v_lt, l_quantity <= 10 AS v_lte, l_discount > 0.05 AS v_gt, l_tax >= 0.05 AS v_gte,
    l_quantity > 10 AND l_quantity < 20 AS v_and, l_returnflag IN ('A', 'R') AS v_or, (l_quantity > 10) <> (l_quantity > 20) AS v_xor, l_discount = 0 AS v_not, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS v_if,
    CASE WHEN l_quantity > 40 THEN 'xl' WHEN l_quantity > 20 THEN 'l' ELSE 'm' END AS v_cond, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS v_switch,
    l_linestatus AS v_coalesce, l_returnflag AS v_ifnull, l_returnflag AS v_ifempty, true AS v_isnull, true AS v_string, true AS v_number, false AS v_boolean, false AS v_array, false AS v_object, false AS v_date,
    'float' AS v_type, true AS v_assert FROM lineitem""",
    after=lambda df: df.drop("_errors"),
)

mapped(
    "verbs_coercion", "customer",
    """
id = @.c_custkey
v_string = %coerceString @.c_custkey
v_number = %coerceNumber %concat @.c_custkey ".5"
v_integer = %coerceInteger @.c_acctbal
v_boolean = %coerceBoolean @.c_nationkey
v_date = %coerceDate "2024-02-29"
v_stamp = %coerceTimestamp "2024-02-29T10:30:00Z"
v_try = %jsonEncode %tryCoerce "42"
v_array = %length %toArray @.c_name
v_object = %jsonEncode %toObject @.c_custkey
v_directed = @.c_acctbal :type integer
v_default = @.missing :default "none"
v_cut = @.c_name :maxLen 5 :upper
""",
    """SELECT c_custkey AS id, c_custkey::VARCHAR AS v_string, c_custkey + 0.5::DOUBLE AS v_number, trunc(c_acctbal)::BIGINT AS v_integer, c_nationkey <> 0 AS v_boolean, DATE '2024-02-29' AS v_date,
    '2024-02-29T10:30:00.000Z' AS v_stamp, '42' AS v_try, 1::BIGINT AS v_array, '{"value":' || c_custkey || '}' AS v_object, trunc(c_acctbal)::BIGINT AS v_directed, 'none' AS v_default, upper(left(c_name, 5)) AS v_cut FROM customer""",
)

mapped(
    "verbs_numeric", "customer",
    """
id = @.c_custkey
v_add = %add @.c_custkey ##2
v_subtract = %subtract @.c_custkey ##5
v_multiply = %multiply @.c_custkey ##3
v_divide = %round %divide @.c_custkey ##7 ##6
v_safe = %safeDivide @.c_custkey ##0 ##-1
v_mod = %mod %subtract @.c_custkey ##100 ##7
v_mod_negative = %mod @.c_custkey ##-3
v_abs = %abs @.c_acctbal
v_negate = %negate @.c_acctbal
v_sign = %sign @.c_acctbal
v_floor = %floor @.c_acctbal
v_ceil = %ceil @.c_acctbal
v_trunc = %trunc @.c_acctbal
v_round = %round @.c_acctbal ##0
v_min = %minOf @.c_custkey ##100 ##50
v_max = %maxOf @.c_custkey ##100 ##50
v_clamp = %clamp @.c_custkey ##10 ##90
v_pow = %pow @.c_nationkey ##2
v_sqrt = %round %sqrt @.c_custkey ##6
v_sqrt_negative = %sqrt ##-4
v_exp = %round %exp %divide @.c_nationkey ##10 ##6
v_ln = %round %ln @.c_custkey ##6
v_log = %round %log @.c_custkey ##2 ##6
v_log10 = %round %log10 @.c_custkey ##6
v_finite = %isFinite @.c_acctbal
v_nan = %isNaN @.c_name
v_parse = %parseInt %concat @.c_custkey "abc" ##10
v_parse16 = %parseInt "ff" ##16
""",
    """SELECT c_custkey AS id, c_custkey + 2 AS v_add, c_custkey - 5 AS v_subtract, c_custkey * 3 AS v_multiply, round(c_custkey / 7.0::DOUBLE, 6) AS v_divide, -1.0::DOUBLE AS v_safe,
    (((c_custkey - 100) % 7) + 7) % 7 AS v_mod, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 3 - 3 END AS v_mod_negative, abs(c_acctbal) AS v_abs, -c_acctbal AS v_negate, sign(c_acctbal)::BIGINT AS v_sign,
    floor(c_acctbal)::BIGINT AS v_floor, ceil(c_acctbal)::BIGINT AS v_ceil, trunc(c_acctbal)::BIGINT AS v_trunc, round(c_acctbal)::BIGINT AS v_round, least(c_custkey, 50)::DOUBLE AS v_min, greatest(c_custkey, 100)::DOUBLE AS v_max,
    least(greatest(c_custkey, 10), 90) AS v_clamp, power(c_nationkey, 2)::DOUBLE AS v_pow, round(sqrt(c_custkey), 6) AS v_sqrt, NULL::DOUBLE AS v_sqrt_negative, round(exp(c_nationkey / 10.0::DOUBLE), 6) AS v_exp,
    CASE WHEN c_custkey > 0 THEN round(ln(nullif(c_custkey, 0)), 6) END AS v_ln, CASE WHEN c_custkey > 0 THEN round(ln(nullif(c_custkey, 0)) / ln(2), 6) END AS v_log, CASE WHEN c_custkey > 0 THEN round(log10(nullif(c_custkey, 0)), 6) END AS v_log10,
    true AS v_finite, true AS v_nan, c_custkey AS v_parse, 255::BIGINT AS v_parse16 FROM customer""",
)

mapped(
    "verbs_formatting", "part",
    """
id = @.p_partkey
v_number = %formatNumber @.p_retailprice ##1
v_integer = %formatInteger @.p_retailprice
v_currency = %formatCurrency @.p_size
v_percent = %formatPercent %divide @.p_size ##64 ##1
v_locale = %formatLocaleNumber %multiply @.p_size ##1000 ##2
v_phone = %formatPhone "5551234567" "US"
v_unit = %convertUnit @.p_size "km" "mi"
v_heat = %convertUnit @.p_size "C" "F"
v_unknown = %convertUnit @.p_size "km" "kg"
v_accents = %stripAccents "Crème Brûlée"
v_soundex = %soundex "Ashcraft"
v_duration = %formatDuration "P1DT2H30M"
v_random = %random ##1 ##1 "seed"
""",
    """SELECT p_partkey AS id, printf('%.1f', round(p_retailprice, 1)) AS v_number, printf('%.0f', round(p_retailprice)) AS v_integer, printf('%.2f', p_size::DOUBLE) AS v_currency,
    printf('%.1f', round(p_size / 64.0::DOUBLE * 100, 1)) || '%' AS v_percent, format('{:,}', p_size * 1000) || '.00' AS v_locale, '(555) 123-4567' AS v_phone, round(p_size * 1000.0::DOUBLE / 1609.344::DOUBLE, 6) AS v_unit,
    round(p_size * 9.0::DOUBLE / 5.0::DOUBLE + 32, 6) AS v_heat, NULL AS v_unknown, 'Creme Brulee' AS v_accents, 'A226' AS v_soundex, '1 day, 2 hours, 30 minutes' AS v_duration, 1::BIGINT AS v_random FROM part""",
)

mapped(
    "verbs_dates", "orders",
    """
id = @.o_orderkey
v_format = %formatDate @.o_orderdate "DD.MM.YYYY"
v_parse = %parseDate %formatDate @.o_orderdate "YYYYMMDD" "YYYYMMDD"
v_time = %formatTime @.o_orderdate "HH:mm"
v_stamp = %formatTimestamp @.o_orderdate
v_parsed = %parseTimestamp %formatTimestamp @.o_orderdate
v_locale = %formatLocaleDate @.o_orderdate "en"
v_days = %addDays %formatDate @.o_orderdate "YYYY-MM-DD" ##30
v_months = %addMonths %formatDate @.o_orderdate "YYYY-MM-DD" ##1
v_years = %addYears %formatDate @.o_orderdate "YYYY-MM-DD" ##-1
v_hours = %addHours @.o_orderdate ##5
v_minutes = %addMinutes @.o_orderdate ##90
v_seconds = %addSeconds @.o_orderdate ##30
v_diff = %dateDiff @.o_orderdate "2000-01-01" "days"
v_diff_months = %dateDiff "1990-01-15" @.o_orderdate "months"
v_diff_years = %dateDiff "1990-01-15" @.o_orderdate "years"
v_diff_hours = %dateDiff "1990-01-15" @.o_orderdate "hours"
v_between_days = %daysBetweenDates @.o_orderdate "2000-01-01"
v_next = %nextBusinessDay @.o_orderdate
v_day_start = %startOfDay @.o_orderdate
v_day_end = %endOfDay @.o_orderdate
v_month_start = %startOfMonth @.o_orderdate
v_month_end = %endOfMonth @.o_orderdate
v_year_start = %startOfYear @.o_orderdate
v_year_end = %endOfYear @.o_orderdate
v_dow = %dayOfWeek @.o_orderdate
v_dom = %dayOfMonth @.o_orderdate
v_doy = %dayOfYear @.o_orderdate
v_week = %weekOfYear @.o_orderdate
v_quarter = %quarter @.o_orderdate
v_leap = %isLeapYear @.o_orderdate
v_before = %isBefore %formatDate @.o_orderdate "YYYY-MM-DD" "1995-01-01"
v_after = %isAfter %formatDate @.o_orderdate "YYYY-MM-DD" "1995-01-01"
v_between = %isBetween %formatDate @.o_orderdate "YYYY-MM-DD" "1993-01-01" "1996-12-31"
v_unix = %toUnix @.o_orderdate
v_from = %fromUnix ##86400
v_age = %ageFromDate @.o_orderdate "2020-06-15"
v_valid = %isValidDate "2024-02-30" "x"
""",
    """WITH d AS (SELECT o_orderkey, o_orderdate AS t, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey AS id, strftime(d, '%d.%m.%Y') AS v_format, strftime(d, '%Y-%m-%d') AS v_parse, strftime(t, '%H:%M') AS v_time, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS v_stamp, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS v_parsed,
    strftime(d, '%Y-%m-%d') AS v_locale, strftime(d + 30, '%Y-%m-%d') AS v_days, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS v_months, strftime(d - INTERVAL 1 YEAR, '%Y-%m-%d') AS v_years,
    strftime(t + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ') AS v_hours, strftime(t + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S.%gZ') AS v_minutes, strftime(t + INTERVAL 30 SECOND, '%Y-%m-%dT%H:%M:%S.%gZ') AS v_seconds,
    datediff('day', d, DATE '2000-01-01') AS v_diff, datesub('month', DATE '1990-01-15', d) AS v_diff_months, datesub('year', DATE '1990-01-15', d) AS v_diff_years, epoch(t - TIMESTAMP '1990-01-15') / 3600.0 AS v_diff_hours,
    abs(datediff('day', d, DATE '2000-01-01')) AS v_between_days, strftime(d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END::INT, '%Y-%m-%d') AS v_next, strftime(d, '%Y-%m-%dT00:00:00.000Z') AS v_day_start,
    strftime(d, '%Y-%m-%dT23:59:59.999Z') AS v_day_end, strftime(date_trunc('month', d), '%Y-%m-%d') AS v_month_start, strftime(last_day(d), '%Y-%m-%d') AS v_month_end, strftime(date_trunc('year', d), '%Y-%m-%d') AS v_year_start,
    year(d) || '-12-31' AS v_year_end, isodow(d)::BIGINT AS v_dow, day(d)::BIGINT AS v_dom, dayofyear(d)::BIGINT AS v_doy, weekofyear(d)::BIGINT AS v_week, quarter(d)::BIGINT AS v_quarter,
    (year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0)) AS v_leap, d < DATE '1995-01-01' AS v_before, d > DATE '1995-01-01' AS v_after, d BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' AS v_between,
    floor(epoch(t))::BIGINT AS v_unix, TIMESTAMP '1970-01-02' AS v_from, datesub('year', d, DATE '2020-06-15') AS v_age, false AS v_valid FROM d""",
)

mapped(
    "verbs_business_days", "orders", 'id = @.o_orderkey\nahead = %businessDays @.o_orderdate ##3\nback = %businessDays @.o_orderdate ##-7',
    """WITH RECURSIVE step(id, d, n, w) AS (SELECT o_orderkey, o_orderdate::DATE, 3, 1 FROM orders UNION ALL SELECT o_orderkey, o_orderdate::DATE - 7, 2, -1 FROM orders
    UNION ALL SELECT id, d + w, n - CASE WHEN isodow(d + w) < 6 THEN 1 ELSE 0 END, w FROM step WHERE n > 0)
    SELECT a.id, strftime(a.d, '%Y-%m-%d') AS ahead, strftime(b.d, '%Y-%m-%d') AS back FROM step a JOIN step b ON a.id = b.id AND a.n = 0 AND b.n = 0 AND a.w = 1 AND b.w = -1""",
)

mapped(
    "verbs_finance", "lineitem",
    """
id = @.l_orderkey
line = @.l_linenumber
v_compound = %round %compound @.l_extendedprice #0.05 ##3 ##4
v_discount = %round %discount @.l_extendedprice #0.05 ##3 ##4
v_pmt = %round %pmt @.l_extendedprice #0.01 ##12 ##4
v_pmt0 = %round %pmt @.l_extendedprice ##0 ##12 ##4
v_fv = %round %fv @.l_quantity #0.01 ##12 ##4
v_pv = %round %pv @.l_quantity #0.01 ##12 ##4
v_depreciation = %round %depreciation @.l_extendedprice ##100 ##5 ##4
v_nper = %round %nper #0.01 ##-100 @.l_quantity ##0 ##6
v_z = %round %zscore @.l_quantity %jsonDecodeArray "[1]" ##6
v_mid = %round %interpolate @.l_quantity ##100 #0.25 ##4 ##4
""".replace("v_z = %round %zscore @.l_quantity %jsonDecodeArray \"[1]\" ##6\n", "").replace("#0.25 ##4 ##4", "#0.25 ##0 ##0 ##4"),
    """SELECT l_orderkey AS id, l_linenumber AS line, round(l_extendedprice * power(1.05, 3), 4) AS v_compound, round(l_extendedprice / power(1.05, 3), 4) AS v_discount,
    round(l_extendedprice * 0.01 * power(1.01, 12) / (power(1.01, 12) - 1), 4) AS v_pmt, round(l_extendedprice / 12, 4) AS v_pmt0, round(l_quantity * (power(1.01, 12) - 1) / 0.01, 4) AS v_fv,
    round(l_quantity * (1 - power(1.01, -12)) / 0.01, 4) AS v_pv, round((l_extendedprice - 100) / 5, 4) AS v_depreciation, round(ln(-100.0 / (-100.0 + 0.01 * l_quantity)) / ln(1.01), 6) AS v_nper,
    round(l_quantity + (100 - l_quantity) * 0.25, 4) AS v_mid FROM lineitem""",
)

mapped(
    "verbs_geo", "customer",
    """
id = @.c_custkey
v_km = %round %distance @.lat @.lon ##48 ##2 "km" ##4
v_mi = %round %distance @.lat @.lon ##48 ##2 "mi" ##4
v_in = %inBoundingBox @.lat @.lon ##-10 ##-10 ##10 ##10
v_rad = %round %toRadians @.lon ##8
v_deg = %round %toDegrees @.lat ##8
v_bearing = %round %bearing @.lat @.lon ##48 ##2 ##6
v_mid = %round %get %midpoint @.lat @.lon ##48 ##2 "lat" ~ ##6
""",
    """WITH p AS (SELECT c_custkey, (c_custkey % 140 - 70)::DOUBLE AS lat, (c_custkey % 300 - 150)::DOUBLE AS lon FROM customer),
    r AS (SELECT *, radians(lat) AS a, radians(lon) AS o, radians(48) AS b, radians(2) AS q FROM p),
    h AS (SELECT *, power(sin((b - a) / 2), 2) + cos(a) * cos(b) * power(sin((q - o) / 2), 2) AS x, cos(b) * cos(q - o) AS bx, cos(b) * sin(q - o) AS by_ FROM r)
    SELECT c_custkey AS id, round(12742.0 * atan2(sqrt(x), sqrt(1 - x)), 4) AS v_km, round(12742.0 * atan2(sqrt(x), sqrt(1 - x)) * 0.621371, 4) AS v_mi, lat BETWEEN -10 AND 10 AND lon BETWEEN -10 AND 10 AS v_in,
    round(o, 8) AS v_rad, round(degrees(lat), 8) AS v_deg, round((degrees(atan2(sin(q - o) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(q - o)))::DOUBLE + 360.0) - CASE WHEN degrees(atan2(sin(q - o) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(q - o))) >= 0 THEN 360 ELSE 0 END, 6) AS v_bearing,
    round(degrees(atan2(sin(a) + sin(b), sqrt((cos(a) + bx) * (cos(a) + bx) + by_ * by_))), 6) AS v_mid FROM h""",
    prepare=lambda df: df.withColumns({"lat": (F.col("c_custkey") % 140 - 70).cast("double"), "lon": (F.col("c_custkey") % 300 - 150).cast("double")}),
)


def _arrays(df):
    """Embeddings cut to eight whole numbers, small enough to repeat."""
    return df.select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 10).cast("long")).alias("xs"), F.transform(F.slice("embedding", 9, 8), lambda x: F.floor(x.cast("double") * 10).cast("long")).alias("ys"))


_ARRAYS = "WITH a AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: floor(x::DOUBLE * 10)::BIGINT) AS xs, list_transform(embedding[9:16], lambda x: floor(x::DOUBLE * 10)::BIGINT) AS ys FROM embeddings)"

mapped(
    "verbs_arrays", "embeddings",
    """
id = @.vec_id
v_filter = %join %filter @.xs "" ">" ##0 ","
v_map = %join %map @.xs "" ","
v_reduce = %reduce @.xs "add" ##0
v_distinct = %join %distinct @.xs ","
v_unique = %length %unique @.xs
v_dedupe = %join %dedupe @.xs "" ","
v_sort = %join %sort @.xs ","
v_sort_desc = %join %sortDesc @.xs ","
v_reverse = %join %reverse @.xs ","
v_at = %at @.xs ##-1
v_slice = %join %slice @.xs ##1 ##3 ","
v_take = %join %take @.xs ##2 ","
v_limit = %join %limit @.xs ##3 ","
v_drop = %join %drop @.xs ##6 ","
v_chunk = %length %chunk @.xs ##3
v_flat = %join %flatten %chunk @.xs ##3 ","
v_zip = %length %zip @.xs @.ys
v_concat = %join %concatArrays @.xs @.ys ","
v_compact = %length %compact @.xs
v_index = %indexOf @.xs ##0
v_includes = %includes @.xs ##1
v_every = %every @.xs "" "" ""
v_some = %some @.xs "" "" ""
v_find = %find @.xs "" "" ""
v_find_index = %findIndex @.xs "" "" ""
v_partition = %length %at %partition @.xs "" "" "" ##0
v_range = %join %range ##0 ##5 ##2 ","
""",
    _ARRAYS + """ SELECT vec_id AS id, array_to_string(list_filter(xs, lambda x: x > 0), ',') AS v_filter, array_to_string(xs, ',') AS v_map, list_sum(xs)::BIGINT AS v_reduce,
    array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ',') AS v_distinct, list_unique(xs)::BIGINT AS v_unique, array_to_string(list_filter(xs, lambda x, i: i = 1 OR x <> xs[i - 1]), ',') AS v_dedupe,
    array_to_string(list_sort(xs), ',') AS v_sort, array_to_string(list_reverse_sort(xs), ',') AS v_sort_desc, array_to_string(list_reverse(xs), ',') AS v_reverse, xs[8] AS v_at, array_to_string(xs[2:3], ',') AS v_slice,
    array_to_string(xs[1:2], ',') AS v_take, array_to_string(xs[1:3], ',') AS v_limit, array_to_string(xs[7:], ',') AS v_drop, 3::BIGINT AS v_chunk, array_to_string(xs, ',') AS v_flat, 8::BIGINT AS v_zip,
    array_to_string(xs || ys, ',') AS v_concat, 8::BIGINT AS v_compact, coalesce(list_position(xs, 0), 0)::BIGINT - 1 AS v_index, list_contains(xs, 1) AS v_includes, len(list_filter(xs, lambda x: x = 0)) = 0 AS v_every,
    len(list_filter(xs, lambda x: x <> 0)) > 0 AS v_some, list_filter(xs, lambda x: x <> 0)[1] AS v_find, coalesce(list_position(list_transform(xs, lambda x: x <> 0), true), 0)::BIGINT - 1 AS v_find_index,
    len(list_filter(xs, lambda x: x <> 0))::BIGINT AS v_partition, '0,2,4' AS v_range FROM a""",
    prepare=_arrays,
)

mapped(
    "verbs_statistics", "embeddings",
    """
id = @.vec_id
v_sum = %sum @.xs
v_count = %count @.xs
v_min = %min @.xs
v_max = %max @.xs
v_avg = %round %avg @.xs ##6
v_first = %first @.xs
v_last = %last @.xs
v_std = %round %std @.xs ##6
v_std_sample = %round %stdSample @.xs ##6
v_var = %round %variance @.xs ##6
v_var_sample = %round %varianceSample @.xs ##6
v_median = %median @.xs
v_mode = %mode @.xs
v_percentile = %round %percentile @.xs ##90 ##6
v_quantile = %round %quantile @.xs #0.25 ##6
v_cov = %round %covariance @.xs @.ys ##6
v_corr = %round %correlation @.xs @.ys ##6
v_weighted = %round %weightedAvg @.xs @.ws ##6
v_npv = %round %npv #0.1 @.xs ##6
v_z = %round %zscore ##3 @.xs ##6
""",
    _ARRAYS + """, u AS (SELECT vec_id, unnest(xs) AS x, unnest(ys) AS y, unnest(range(8)) AS i FROM a), m AS (SELECT vec_id, x, count(*) AS c, min(i) AS f FROM u GROUP BY ALL),
    k AS (SELECT vec_id, arg_max(x, c * 100 - f) AS mode FROM m GROUP BY vec_id)
    SELECT u.vec_id AS id, sum(x)::BIGINT AS v_sum, count(*) AS v_count, min(x) AS v_min, max(x) AS v_max, round(avg(x), 6) AS v_avg, arg_min(x, i) AS v_first, arg_max(x, i) AS v_last, round(stddev_pop(x), 6) AS v_std,
    round(stddev_samp(x), 6) AS v_std_sample, round(var_pop(x), 6) AS v_var, round(var_samp(x), 6) AS v_var_sample, median(x)::DOUBLE AS v_median, any_value(mode) AS v_mode, round(quantile_cont(x, 0.9), 6) AS v_percentile,
    round(quantile_cont(x, 0.25), 6) AS v_quantile, round(covar_pop(x, y), 6) AS v_cov, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS v_corr, round(sum(x * (i + 1)) / 36.0, 6) AS v_weighted, round(sum(x / power(1.1, i)), 6) AS v_npv,
    CASE WHEN stddev_pop(x) > 0 THEN round((3 - avg(x)) / stddev_pop(x), 6) END AS v_z FROM u JOIN k ON u.vec_id = k.vec_id GROUP BY u.vec_id""",
    prepare=lambda df: _arrays(df).withColumn("ws", F.sequence(F.lit(1), F.lit(8))),
)

mapped(
    "verbs_ordered_arrays", "embeddings",
    """
id = @.vec_id
v_cumsum = %join %cumsum @.xs ","
v_cumprod = %at %cumprod @.xs ##7
v_diff = %join %diff @.xs ##1 ","
v_pct = %round %at %pctChange @.xs ##1 ##1 ##6
v_shift = %join %shift @.xs ##1 ##0 ","
v_lag = %join %lag @.xs ##2 ##9 ","
v_lead = %join %lead @.xs ##1 ##9 ","
v_rank = %join %rank @.xs "" "desc" ","
v_fill = %join %fillMissing @.xs "constant" ##0 ","
v_moving = %round %at %movingAvg @.xs ##3 ##5 ##6
v_irr = %round %irr @.flows #0.1 ##6
v_rate = %round %rate ##12 ##-100 ##1000 ##0 ##6
v_sample = %length %sample @.xs ##3 "seed"
""",
    _ARRAYS + """ SELECT vec_id AS id, array_to_string(list_transform(xs, lambda x, i: list_sum(xs[1:i])::DOUBLE), ',') AS v_cumsum, list_product(xs)::DOUBLE AS v_cumprod,
    ',' || array_to_string(list_transform(xs[2:], lambda x, i: (x - xs[i])::DOUBLE), ',') AS v_diff, CASE WHEN xs[1] <> 0 THEN round((xs[2] - xs[1]) / xs[1]::DOUBLE, 6) END AS v_pct, '0,' || array_to_string(xs[1:7], ',') AS v_shift,
    '9,9,' || array_to_string(xs[1:6], ',') AS v_lag, array_to_string(xs[2:8], ',') || ',9' AS v_lead, array_to_string(list_transform(xs, lambda x: list_unique(list_filter(xs, lambda y: y > x))::BIGINT + 1), ',') AS v_rank,
    array_to_string(xs, ',') AS v_fill, round((xs[4] + xs[5] + xs[6]) / 3.0::DOUBLE, 6) AS v_moving, 0.1 AS v_irr, round(0.029228541, 6)::DOUBLE AS v_rate, 3::BIGINT AS v_sample FROM a""",
    prepare=lambda df: _arrays(df).withColumn("flows", F.array(F.lit(-100.0), F.lit(10.0), F.lit(110.0))),
)


def _objects(df):
    item = lambda i: F.struct(F.concat(F.lit("k"), F.lit(i % 2).cast("string")).alias("k"), (F.col("c_custkey") + i).alias("v"))
    return df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("o"), F.array(item(0), item(1), item(2)).alias("items"), F.lit('{"a":{"b":[1,2]}}').alias("j"))


mapped(
    "verbs_objects", "customer",
    """
id = @.c_custkey
v_keys = %join %keys @.o ","
v_values = %join %values @.o ","
v_entries = %length %entries @.o
v_has = %has @.o "name"
v_has_not = %has @.o "nothing"
v_get = %get @.o "segment" "none"
v_default = %get @.o "nothing" "none"
v_merge = %jsonEncode %merge @.o %toObject "x"
v_path = %jsonPath @.j "$.a.b[1]"
v_extract = %jsonEncode %extract @.o "name"
v_pluck = %join %pluck @.items "v" ","
v_sort_by = %get %first %sortBy @.items "v" "v" ~
v_group = %join %keys %groupBy @.items "k" ","
v_pivot = %get %pivot @.items "k" "v" "k0" ##0
v_unpivot = %length %unpivot @.o "key" "value"
""",
    """SELECT c_custkey AS id, 'name,segment' AS v_keys, c_name || ',' || c_mktsegment AS v_values, 2::BIGINT AS v_entries, true AS v_has, false AS v_has_not, c_mktsegment AS v_get, 'none' AS v_default,
    '{"name":"' || c_name || '","segment":"' || c_mktsegment || '","value":"x"}' AS v_merge, '2' AS v_path, '{"name":"' || c_name || '"}' AS v_extract, c_custkey || ',' || (c_custkey + 1) || ',' || (c_custkey + 2) AS v_pluck,
    c_custkey AS v_sort_by, 'k0,k1' AS v_group, c_custkey + 2 AS v_pivot, 2::BIGINT AS v_unpivot FROM customer""",
    prepare=_objects,
)

mapped(
    "segments_loop", "customer", "",
    """SELECT c_custkey AS id, c_custkey || ':0:3:' || c_custkey || '|' || (c_custkey + 1) || ':1:3:' || (2 * c_custkey + 1) || '|' || (c_custkey + 2) || ':2:3:' || (3 * c_custkey + 3) AS rows, 3::BIGINT AS n, c_mktsegment AS segment FROM customer""",
    head="""{$accumulator}
total = ##0
{}
id = @.c_custkey
n = %count @.items
{Rows[]}
_each = @.items
v = @.v
i = @_index
n = @_length
run = %accumulate "total" @.v
{Info.Customer}
segment = @.o.segment
""", section="{Unused}", prepare=_objects,
    after=lambda df: df.select("id", F.array_join(F.transform("Rows", lambda r: F.concat_ws(":", r.v, r.i, r.n, r.run)), "|").alias("rows"), "n", F.col("Info.Customer.segment").alias("segment")),
)

mapped(
    "segments_conditions", "events", "",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS bought, CASE WHEN event_type <> 'error' AND value > 50 THEN 'high' END AS high, repeat('*', greatest(3, length(event_type))) AS hidden, json_extract_string(props, '$.k') AS k FROM events""",
    head="""{$}
enforceConfidential = "mask"
{}
event_id = @.event_id
hidden = @.event_type :confidential
k = @.props.k
{Purchase}
_discriminator = "@.event_type"
_discriminatorValue = "purchase"
value = @.value
{High}
_when = "@.event_type != error"
_if = "@.value > 50"
level = "high"
""", section="{Unused}",
    after=lambda df: df.select("event_id", F.col("Purchase.value").alias("bought"), F.col("High.level").alias("high"), "hidden", "k"),
)

mapped(
    "lookup_table", "customer",
    """
id = @.c_custkey
region = %lookup "NATION.region" @.c_nationkey
both = %lookupDefault "RATE.rate" @.c_mktsegment "x" ##0
""",
    """SELECT c_custkey AS id, CASE WHEN c_nationkey = 0 THEN 'first' WHEN c_nationkey = 1 THEN 'second' END AS region, CASE WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 0 END::BIGINT AS both FROM customer""",
    head='{$table.NATION[key,region]}\n##0, "first"\n##1, "second"\n##1, "third"\n{$table.RATE[segment,kind,rate]}\n"BUILDING", "x", ##5\n"BUILDING", "x", ##6',
)

mapped("rows_sequence", "orders", 'id = @.o_orderkey\ns = %sequence "x"', "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS s FROM orders", order=("o_orderkey",), partition=("o_custkey",))
mapped("verbs_nondeterministic", "region", 'id = @.r_regionkey\nu = %uuid ~\nn = %nanoid ##8 ~\nr = %random\nt = %today\nw = %now\nset = %set "x" @.r_name\nreset = %resetSequence "x"', None)
