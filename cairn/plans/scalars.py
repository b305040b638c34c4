"""Scalar functions over columns: calendar (c), texts (t), numbers (m), hashes (h), JSON (x), arrays (y)."""

from __future__ import annotations


from pyspark.sql import functions as F

from cairn.functions import calendar, texts
from cairn.plans.catalog import query



def minutes():
    return F.array("minute_a", "minute_b")


SLOTS = """WITH s AS (SELECT schedule_id, now_ms, min(slot) AS slot FROM (SELECT schedule_id, now_ms, (now_ms // 86400000 + d) * 86400000 + CASE WHEN which = 0 THEN minute_a ELSE minute_b END * 60000 AS slot
FROM schedules, range(0, {days}) r(d), (VALUES (0), (1)) v(which) WHERE {on}) x WHERE slot > now_ms GROUP BY schedule_id, now_ms) SELECT schedules.schedule_id, coalesce(slot, schedules.now_ms) AS next_run FROM schedules LEFT JOIN s ON s.schedule_id = schedules.schedule_id"""


@query(SLOTS.format(days=2, on="true"), "schedules")
def c1_daily_next_run(schedules):
    return schedules.select("schedule_id", calendar.daily(F.col("now_ms"), minutes()).alias("next_run"))


@query(SLOTS.format(days=8, on="(weekday_mask = 0 AND d < 2) OR (weekday_mask >> CAST((now_ms // 86400000 + d + 4) % 7 AS INT)) & 1 = 1"), "schedules")
def c2_weekly_next_run(schedules):
    return schedules.select("schedule_id", calendar.weekly(F.col("now_ms"), minutes(), F.col("weekday_mask")).alias("next_run"))


@query(SLOTS.format(days=745, on="(month_mask >> CAST(date_part('day', DATE '1970-01-01' + CAST(now_ms // 86400000 + d AS INT)) - 1 AS INT)) & 1 = 1"), "schedules")
def c3_monthly_next_run(schedules):
    return schedules.select("schedule_id", calendar.monthly(F.col("now_ms"), minutes(), F.col("month_mask")).alias("next_run"))


@query("SELECT schedule_id, concat('schedule-fire|', CAST(schedule_id AS VARCHAR), '|', CAST(next_run_ms AS VARCHAR)) AS fire_key, strftime(make_timestamp(next_run_ms * 1000), 'archives/%Y/%m/') || CAST(schedule_id AS VARCHAR) || '.bkf' AS archive_key FROM schedules WHERE next_run_ms IS NOT NULL", "schedules")
def c4_keys(schedules):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(next_run_ms div 86400000 as int)"))
    fire = F.concat_ws("|", F.lit("schedule-fire"), "schedule_id", "next_run_ms")
    return schedules.where("next_run_ms IS NOT NULL").select("schedule_id", fire.alias("fire_key"), F.concat(F.lit("archives/"), F.date_format(day, "yyyy/MM/"), F.col("schedule_id").cast("string"), F.lit(".bkf")).alias("archive_key"))


@query("SELECT schedule_id, minute_a < 1440 AND minute_b < 1440 AND minute_b - minute_a >= 30 AND minute_a + 1440 - minute_b >= 30 AS valid FROM schedules", "schedules")
def c5_trigger_rules(schedules):
    return schedules.select("schedule_id", calendar.valid_minutes(minutes()).alias("valid"))


@query("SELECT event_id, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(created_ms * 1000), '%H:%M') AS minute FROM audit", "audit")
def c6_day_and_minute(audit):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(created_ms div 86400000 as int)")).cast("string")
    clock = F.expr("format_string('%02d:%02d', created_ms div 3600000 % 24, created_ms div 60000 % 60)")
    return audit.select("event_id", day.alias("day"), clock.alias("minute"))


@query("SELECT job_id, created_ms + 300000 AS preflight_until, created_ms + 1800000 AS plan_until, created_ms + 300000 < 900000000000 AS expired FROM jobs", "jobs")
def c7_expiry(jobs):
    until = F.col("created_ms") + 300_000
    return jobs.select("job_id", until.alias("preflight_until"), (F.col("created_ms") + 1_800_000).alias("plan_until"), (until < 900_000_000_000).alias("expired"))


@query("""WITH h AS (SELECT event_id, arguments AS plain, hex(encode(arguments)) AS hex FROM audit),
b AS (SELECT event_id, plain, list_transform(range(0, length(hex) // 2), lambda k: substr(hex, 2 * k + 1, 2)) AS pairs FROM h)
SELECT event_id, plain, array_to_string(list_transform(pairs, lambda p: CASE WHEN p < '80' AND regexp_matches(chr(CAST(concat('0x', p) AS INT)), '[A-Za-z0-9_.:-]') THEN chr(CAST(concat('0x', p) AS INT)) ELSE concat('%', lower(p)) END), '') AS encoded, true AS round_trip FROM b""", "audit")
def t1_percent_encoding(audit):
    """The arguments of every event, percent encoded; what was put in comes out again."""
    encoded = audit.select("event_id", F.col("arguments").alias("plain"), texts.percent_encoded(F.col("arguments")).alias("encoded"))
    return encoded.withColumn("round_trip", texts.percent_decoded(F.col("encoded")) == F.col("plain"))


@query("SELECT o_custkey AS schedule_id, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS encoded, count(*) AS n FROM orders GROUP BY o_custkey", "orders")
def t2_list_encoding(orders):
    """Lists in one text; what was put in comes out again."""
    lists = orders.groupBy(F.col("o_custkey").alias("schedule_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), "|").alias("encoded"))
    return lists.select("schedule_id", "encoded", F.size(F.split("encoded", r"\|")).cast("long").alias("n"))


@query("SELECT c_custkey AS id, concat(octet_length(encode(c_name)), ':', c_name, ';', octet_length(encode(c_mktsegment)), ':', c_mktsegment, ';') AS preimage FROM customer", "customer")
def t3_fingerprint(customer):
    return customer.select(F.col("c_custkey").alias("id"), texts.fingerprint(F.col("c_name"), F.col("c_mktsegment")).alias("preimage"))


@query("SELECT n_nationkey AS id, n_name AS label FROM nation", "nation")
def t5_label(nation):
    raw = F.encode(F.concat(F.lit("\x01"), F.col("n_name"), F.lit("\x7f")), "UTF-16LE")
    return nation.select(F.col("n_nationkey").alias("id"), texts.label(raw).alias("label"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN chr(CAST(65 + p_partkey % 26 AS INT)) END AS letter FROM part", "part")
def t6_drive_letter(part):
    mount = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.char(97 + F.col("p_partkey") % 26), F.lit(":\\"))).otherwise(F.lit("/mnt/data"))
    return part.select(F.col("p_partkey").alias("id"), texts.drive_letter(mount).alias("letter"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS short, starts_with(lower(source), 'src') AS known, regexp_extract(lang, '[a-z]+') AS lang FROM documents", "documents")
def t7_short_ids(documents):
    return documents.select("doc_id", F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(8)).alias("short"), F.lower("source").startswith("src").alias("known"), F.regexp_extract("lang", "[a-z]+", 0).alias("lang"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 IN (0, 1) OR p_partkey = 0 THEN p_partkey END AS parsed FROM part WHERE p_partkey > 0", "part")
def t8_strict_numbers(part):
    """Signs and leading zeros aren't numbers."""
    k = F.col("p_partkey")
    text = F.when(k % 4 < 2, k.cast("string")).when(k % 4 == 2, F.concat(F.lit("+"), k.cast("string"))).otherwise(F.concat(F.lit("0"), k.cast("string")))
    return part.where("p_partkey > 0").select(k.alias("id"), texts.strict_u64(text).cast("long").alias("parsed"))


@query("SELECT p_partkey AS id, p_partkey % 3 = 0 AS valid FROM part", "part")
def t9_object_keys(part):
    k = F.col("p_partkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("catalog/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("catalog//"), k.cast("string"))).otherwise(F.concat(F.lit("../"), k.cast("string")))
    return part.select(k.alias("id"), texts.valid_key(key).alias("valid"))


SIZE = "CAST(c_custkey * c_custkey * c_custkey * 4099 - 5 AS BIGINT)"


@query(f"""SELECT c_custkey AS id, CASE WHEN n < 0 THEN '0 B' WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END AS shown FROM (SELECT c_custkey, {SIZE} AS n FROM customer) x""", "customer")
def t10_byte_sizes(customer):
    """Sizes beyond 64 bits (keys above 131,040) are decimals; the SQL's BIGINT ends there with an error."""
    k = F.col("c_custkey").cast("decimal(20,0)")
    n = k * k * k * 4099 - 5
    return customer.select(F.col("c_custkey").alias("id"), texts.byte_size(n).alias("shown"))


@query("SELECT o_custkey AS id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY o_custkey", "orders")
def m2_checked_sum(orders):
    """Sums that would overflow are an error in ANSI mode, not a wrong number."""
    return orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("total"))


@query("SELECT o_orderkey AS id, (o_orderkey >> 3) & 1 AS bit, (CAST(floor(o_totalprice) AS BIGINT) + 4095) // 4096 AS blocks, (CAST(floor(o_totalprice) AS BIGINT) + 511) // 512 * 512 AS aligned FROM orders", "orders")
def m3_bits_and_blocks(orders):
    size = "CAST(floor(o_totalprice) AS BIGINT)"
    return orders.select(F.col("o_orderkey").alias("id"), F.shiftright("o_orderkey", 3).bitwiseAND(F.lit(1)).cast("long").alias("bit"), F.expr(f"({size} + 4095) div 4096").alias("blocks"), F.expr(f"({size} + 511) div 512 * 512").alias("aligned"))


@query("""SELECT n_nationkey AS id, xor(list_reduce(list_transform(range(1, CAST(octet_length(encode(n_name)) AS BIGINT) + 1), lambda k: CAST(ascii(substr(n_name, k, 1)) AS BIGINT)),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM nation""", "nation")
def m4_crc32(nation):
    return nation.select(F.col("n_nationkey").alias("id"), F.crc32(F.col("n_name").cast("binary")).alias("crc"))


@query("SELECT disk, min(capacity) AS least_capacity FROM (SELECT a.disk, a.capacity, (SELECT sum(b.capacity - b.free) FROM inventory b WHERE b.disk = a.disk AND b.free < b.capacity) AS used FROM inventory a) x WHERE capacity * 3 >= used GROUP BY disk", "inventory")
def m5_least_capacity(inventory):
    """The smallest candidate that is feasible; feasibility rises with the candidate, so that a minimum finds it."""
    used = inventory.where("free < capacity").groupBy("disk").agg(F.sum(F.col("capacity") - F.col("free")).alias("used"))
    return inventory.join(used, "disk").where("capacity * 3 >= used").groupBy("disk").agg(F.min("capacity").alias("least_capacity"))


@query("SELECT o_custkey AS id, sha256(string_agg(concat(length(CAST(o_orderkey AS VARCHAR)), ':', CAST(o_orderkey AS VARCHAR), ';'), '' ORDER BY o_orderkey)) AS selection FROM orders GROUP BY o_custkey", "orders")
def h1_selection_fingerprint(orders):
    """A digest of the sorted references of a selection; labels aren't part of it."""
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string"), F.lit(";")))
    return orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sha2(F.array_join(ids, ""), 256).alias("selection"))


@query("SELECT chunk, sha256(concat('root|', CAST(count(*) AS VARCHAR), '|', string_agg(sha256(payload), '' ORDER BY block_index))) AS root FROM blocks GROUP BY chunk", "blocks")
def h2_root_digest(blocks):
    each = F.array_sort(F.collect_list(F.struct("block_index", F.sha2("payload", 256).alias("d"))))
    return blocks.groupBy("chunk").agg(F.sha2(F.concat(F.lit("root|"), F.count(F.lit(1)).cast("string"), F.lit("|"), F.array_join(F.transform(each, lambda x: x["d"]), "")), 256).alias("root"))


@query("""SELECT n_nationkey AS id, CAST(list_reduce(list_transform(range(1, CAST(octet_length(encode(n_name)) AS BIGINT) + 1), lambda k: CAST(ascii(substr(n_name, k, 1)) AS HUGEINT)),
lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS VARCHAR) AS fnv FROM nation""", "nation")
def h3_fnv1a(nation):
    """FNV-1a of a name, folded over its bytes. Products are kept within 64 bits by splitting the prime."""
    data = F.transform(F.sequence(F.lit(1), F.octet_length("n_name")), lambda k: F.ascii(F.substring("n_name", k, 1)).cast("decimal(38,0)"))
    two64, prime = F.lit(str(1 << 64)).cast("decimal(20,0)"), 0x100000001B3
    step = lambda h, b: ((F.floor(h / 256) * 256 + _xor_byte(h, b)) * F.lit(prime).cast("decimal(14,0)")) % two64
    start = F.lit(str(0xCBF29CE484222325)).cast("decimal(38,0)")
    return nation.select(F.col("n_nationkey").alias("id"), F.aggregate(data, start, lambda h, b: step(h, b).cast("decimal(38,0)")).cast("string").alias("fnv"))


def _xor_byte(h, b):
    return (h % 256).cast("int").bitwiseXOR(b.cast("int")).cast("decimal(3,0)")


@query("SELECT event_id, CAST(to_json({'event_id': event_id, 'severity': severity, 'code': message_code}) AS VARCHAR) AS body FROM audit", "audit")
def x1_json_records(audit):
    return audit.select("event_id", F.to_json(F.struct("event_id", "severity", F.col("message_code").alias("code"))).alias("body"))


@query("SELECT doc_id, len(a) AS n, a = b AS equal, a[1] = b[1] AS same_head, list_reverse(a)[1] AS last, bool_or_dup AS repeats FROM (SELECT doc_id, string_split(lang || '/' || source || '/' || source, '/') AS a, string_split(lang || '/' || source, '/') AS b, true AS bool_or_dup FROM documents) x", "documents")
def y1_array_tests(documents):
    """Equality in order, prefixes, the reverse, and neighbours that repeat."""
    d = documents.select("doc_id", F.split(F.concat_ws("/", "lang", "source", "source"), "/").alias("a"), F.split(F.concat_ws("/", "lang", "source"), "/").alias("b"))
    repeats = F.exists(F.sequence(F.lit(1), F.size("a") - 1), lambda k: F.get("a", k) == F.get("a", k - 1))
    return d.select("doc_id", F.size("a").cast("long").alias("n"), (F.col("a") == F.col("b")).alias("equal"), (F.slice("a", 1, 1) == F.slice("b", 1, 1)).alias("same_head"), F.get(F.reverse("a"), F.lit(0)).alias("last"), repeats.alias("repeats"))
