"""Queries over event time: channels, clocks, windows, intervals and annotations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktide.functions import channels, clock
from sparktide.operators import coverage, intervals
from sparktide.plans.mapping import HOUR, STRIDE, WINDOW, episodes, events, recordings, utc, with_
from sparktide.plans.registry import query
from sparktide.sources import annotations

TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT event_id, upper(trim(replace(replace('EEG ' || event_type || ' ', 'EEG ', ''), 'eeg ', ''))) AS channel FROM events")
def q01_channel_normalise(spark, sf_dir):
    raw = F.concat(F.lit("EEG "), "event_type", F.lit(" "))
    return utc(spark, sf_dir, "events").select("event_id", channels.normalised_name(raw).alias("channel"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) FILTER (event_type IN ('click', 'error', 'purchase', 'signup', 'view')) = 5")
def q02_required_set_division(spark, sf_dir):
    days = utc(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("held"), F.count("*").alias("n"))
    return days.where(channels.has_all(F.col("held"), TYPES)).select("user_id", "day", "n")


@query("""
SELECT vec_id, n_channels, round(CASE WHEN n_channels = 3 THEN list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)) ELSE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) END, 6) + 0.0 AS total,
       CASE WHEN n_channels = 3 THEN 48 ELSE 96 END AS n_samples FROM embeddings, (VALUES (3), (6)) c(n_channels)""")
def q03_pad_truncate_array(spark, sf_dir):
    signal = channels.as_matrix(F.col("embedding"), 4, 16)
    out = None
    for n in (3, 6):
        flat = F.flatten(channels.harmonised(signal, n, 16))
        part = utc(spark, sf_dir, "embeddings").select("vec_id", F.lit(n).alias("n_channels"), (F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x.cast("double")), 6) + 0.0).alias("total"), F.size(flat).alias("n_samples"))
        out = part if out is None else out.union(part)
    return out


@query(f"""
WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H.%M.%S') WHEN 1 THEN strftime(ts, '%H:%M.%S') WHEN 2 THEN strftime(ts, '%H:%M:%S') ELSE 'at ' || strftime(ts, '%H. %M.%S') END AS clock FROM events)
SELECT event_id, clock, CASE WHEN event_id % 4 = 2 THEN NULL ELSE split_part(p, '.', 1)::INTEGER * 3600 + split_part(p, '.', 2)::INTEGER * 60 + split_part(p, '.', 3)::INTEGER END AS seconds
FROM (SELECT event_id, clock, replace(replace(replace(clock, ' ', ''), 'at', ''), ':', '.') AS p FROM c)""")
def q04_clock_parse(spark, sf_dir):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "HH.mm.ss")).when(kind == 1, F.date_format("ts", "HH:mm.ss")).when(kind == 2, F.date_format("ts", "HH:mm:ss")).otherwise(F.concat(F.lit("at "), F.date_format("ts", "HH. mm.ss")))
    return utc(spark, sf_dir, "events").select("event_id", text.alias("clock")).withColumn("seconds", clock.clock_seconds(F.col("clock")))


@query("""
WITH c AS (SELECT user_id, event_id, ts, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events), d AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM c)
SELECT event_id, (CASE WHEN s - p >= 0 THEN s - p ELSE s - p + 86400 END)::INTEGER AS diff FROM d WHERE p IS NOT NULL""")
def q05_wrap_diff(spark, sf_dir):
    seconds = clock.clock_seconds(F.date_format("ts", "HH.mm.ss"))
    rows = utc(spark, sf_dir, "events").withColumn("s", seconds).withColumn("p", F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.where("p IS NOT NULL").select("event_id", clock.wrapped_difference(F.col("s"), F.col("p")).alias("diff"))


@query("SELECT o_custkey, unnest(generate_series(0, n - 4, 2)) AS start FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 4")
def q06_hop_segments(spark, sf_dir):
    lengths = utc(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return intervals.hop_starts(lengths, "n", 4, 2).select("o_custkey", "start")


@query("""
WITH w AS (SELECT user_id, epoch_us(ts) // 3600000000 * 3600 - k * 3600 AS start_s, ts FROM events, (VALUES (0), (1)) h(k)),
     lim AS (SELECT user_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1)
SELECT user_id, start_s, count(*) AS n FROM w JOIN lim USING (user_id) WHERE start_s * 1000000 >= lo AND (start_s + 7200) * 1000000 <= hi GROUP BY 1, 2""")
def q07_event_time_hops(spark, sf_dir):
    hops = intervals.event_time_hops(utc(spark, sf_dir, "events"), ["user_id"], "ts", "2 hours", "1 hour")
    return hops.select("user_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "n")


@query(with_("ev", "rec", "epi") + f"""
SELECT w.user_id, w.start, max(CASE WHEN epi.b IS NULL THEN 0 ELSE 1 END) AS label
FROM (SELECT user_id, unnest(generate_series(0, n - {WINDOW}, {STRIDE})) AS start FROM rec WHERE n >= {WINDOW}) w LEFT JOIN epi ON epi.user_id = w.user_id AND w.start < epi.e AND w.start + {WINDOW} > epi.b GROUP BY 1, 2""")
def q08_overlap_label(spark, sf_dir):
    ev = events(spark, sf_dir)
    hops = intervals.hop_starts(recordings(ev), "n", WINDOW, STRIDE)
    return intervals.label_by_overlap(hops, episodes(ev), ["user_id"], WINDOW, STRIDE).select("user_id", "start", "label")


def _gaps(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev, intervals.gaps(episodes(ev), recordings(ev), ["user_id"], "n", WINDOW)


@query(with_("ev", "rec", "epi", "gap") + ' SELECT user_id, b AS "begin", e AS "end" FROM gap')
def q09_interval_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir)[1]


@query(with_("ev", "rec", "epi", "gap") + f" SELECT user_id, count(*) AS n_gaps, sum(1 + (e - b - {WINDOW}) // {STRIDE})::BIGINT AS n_windows FROM gap GROUP BY 1")
def q10_windows_per_interval(spark, sf_dir):
    return _gaps(spark, sf_dir)[1].withColumn("w", intervals.windows_per_interval(WINDOW, STRIDE)).groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.sum("w").alias("n_windows"))


@query(with_("ev", "rec", "epi", "gap") + f" SELECT user_id, unnest(generate_series(b, e - {WINDOW}, {STRIDE})) AS start FROM gap")
def q11_windows_in_intervals(spark, sf_dir):
    return intervals.windows_in_intervals(_gaps(spark, sf_dir)[1], WINDOW, STRIDE).select("user_id", "start")


_TEN = HOUR // 6


@query(with_("ev", "rec", "epi", "gap") + f"""
SELECT user_id, p AS n_positive, n AS n_negative, round(coalesce(p::DOUBLE / nullif(p + n, 0), 0), 9) AS rate FROM (
  SELECT user_id, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n FROM (SELECT user_id, (e - b) // {_TEN} AS p, 0 AS n FROM epi UNION ALL SELECT user_id, 0, (e - b) // {_TEN} FROM gap) GROUP BY 1)""")
def q12_subject_rates(spark, sf_dir):
    ev, free = _gaps(spark, sf_dir)
    return intervals.subject_rates(episodes(ev), free, ["user_id"], _TEN).withColumn("rate", F.round("rate", 9))


@query("""
WITH t AS (SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type FROM events GROUP BY 1, 2, 3), g AS (SELECT DISTINCT user_id, week FROM t), n AS (SELECT count(*) AS all_ FROM g),
     c AS (SELECT event_type AS channel, count(*) AS n FROM t GROUP BY 1), m AS (SELECT c.channel, count(*) FILTER (t.event_type IS NULL) AS missing FROM c CROSS JOIN g LEFT JOIN t ON t.event_type = c.channel AND t.user_id = g.user_id AND t.week = g.week GROUP BY 1)
SELECT channel, c.n AS n, missing, c.n = all_ AS in_all, c.n >= all_ - 2 AND c.n < all_ AS nearly FROM c JOIN m USING (channel), n""")
def q41_channel_coverage(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("week")
    held = utc(spark, sf_dir, "events").select("user_id", week, F.col("event_type").alias("channel")).distinct()
    return coverage.channel_coverage(held, ["user_id", "week"], "channel")


@query("""
WITH k AS (SELECT user_id, count(DISTINCT event_type) AS channels, min(event_id) AS first FROM events GROUP BY user_id, date_trunc('day', ts)), c AS (SELECT channels, count(*) AS n, min(first) AS seen FROM k GROUP BY 1)
SELECT channels::BIGINT AS channels, n, row_number() OVER (ORDER BY n DESC, seen) = 1 AS modal FROM c""")
def q42_modal_count(spark, sf_dir):
    per_day = utc(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp"))).agg(F.countDistinct("event_type").alias("channels"), F.min("event_id").alias("first"))
    return coverage.modal(per_day, "channels", "first")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events WHERE event_type = 'error')
SELECT user_id, (r * 3 - 2)::INTEGER AS line, s::INTEGER AS start_s, (s + 90)::INTEGER AS end_s FROM e WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def q59_annotation_lookahead(spark, sf_dir):
    """Each error event writes a start line, a filler and an end line 90 seconds later; some ends are unreadable and some come too early."""
    err = utc(spark, sf_dir, "events").where("event_type = 'error'").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("s", clock.clock_seconds(F.date_format("ts", "HH.mm.ss")))
    stamp = lambda s: F.concat_ws(".", F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string"))
    end = F.when(F.col("event_id") % 5 == 0, F.lit("unknown")).otherwise(stamp(F.col("s") + F.when(F.col("event_id") % 7 == 0, -90).otherwise(90)))
    lines = F.array(F.concat(F.lit("Seizure start time: "), stamp(F.col("s"))), F.lit("note"), F.concat(F.lit("seizure END time: "), end))
    rows = err.select("user_id", F.col("r"), F.posexplode(lines).alias("k", "text")).select("user_id", ((F.col("r") - 1) * 3 + F.col("k") + 1).cast("int").alias("line"), "text")
    return annotations.start_end_pairs(rows, ["user_id"], "line", "text").select("user_id", "line", "start_s", "end_s")


def _block_lines(spark, sf_dir):
    """The annotation text that each error event writes, line by line; an event is a file."""
    err = utc(spark, sf_dir, "events").where("event_type = 'error'").withColumn("s", clock.clock_seconds(F.date_format("ts", "HH.mm.ss")))
    stamp = lambda s: F.concat_ws(".", F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string"))
    lines = F.array(F.lit("Sampling Rate: 256 Hz"), F.concat(F.lit("File name: u"), F.col("event_id").cast("string"), F.lit(".edf")), F.lit("Registration start time: 10.00.00"), F.lit("Registration end time:  20.00.00"),
                    F.concat(F.lit("Seizure start time: "), stamp(F.col("s"))), F.concat(F.lit("Seizure end time: "), stamp((F.col("s") + 30) % 86400)))
    return err.select("user_id", "event_id", F.posexplode(lines).alias("k", "text"))


_BLOCKS = """
WITH e AS (SELECT user_id, event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events WHERE event_type = 'error')
SELECT KEY, 'u' || event_id || '.edf' AS file_name, 72000 - 36000 + 0.0::DOUBLE AS reg_end_s, (CASE WHEN s >= 36000 THEN s - 36000 ELSE s + 50400 END)::DOUBLE AS start_s,
       (CASE WHEN (s + 30) % 86400 >= 36000 THEN (s + 30) % 86400 - 36000 ELSE (s + 30) % 86400 + 50400 END)::DOUBLE AS end_s, 256.0::DOUBLE AS sample_rate FROM e"""


@query(_BLOCKS.replace("KEY", "user_id"))
def q60_annotation_blocks(spark, sf_dir):
    """Each error event writes a whole block of a subject's annotation text."""
    found = annotations.blocks(_block_lines(spark, sf_dir), ["user_id", "event_id"], ["k"], "text")
    return found.select("user_id", "file_name", "reg_end_s", "start_s", "end_s", "sample_rate")


@query(_BLOCKS.replace("KEY", "event_id"))
def q90_annotation_files(spark, sf_dir):
    """The same texts by the parser for files whose blocks may be incomplete."""
    return annotations.blocks_exact(_block_lines(spark, sf_dir).drop("user_id"), "event_id", "k", "text")


@query("""
SELECT user_id, event_type AS channel, count(*) AS n FROM events WHERE event_type NOT IN ('click') GROUP BY 1, 2""")
def q61_channel_list_extract(spark, sf_dir):
    """Channel lines of every event; one channel is of a kind to leave out."""
    text = F.concat(F.lit("header\nChannel 1: "), F.when(F.col("event_type") == "click", F.lit("EKG")).otherwise(F.col("event_type")), F.lit("\nChannel  2: 1\nend"))
    return annotations.channel_names(utc(spark, sf_dir, "events").select("user_id", text.alias("text")), ["user_id"], "text").groupBy("user_id", "channel").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT user_id, week, max(v) FILTER (event_type = 'click') AS c0, max(v) FILTER (event_type = 'error') AS c1, max(v) FILTER (event_type = 'purchase') AS c2, max(v) FILTER (event_type = 'signup') AS c3, max(v) FILTER (event_type = 'view') AS c4 FROM w GROUP BY 1, 2""")
def q62_reorder_channels(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("week")
    top = utc(spark, sf_dir, "events").groupBy("user_id", week, "event_type").agg(F.max("value").alias("v"))
    rows = top.groupBy("user_id", "week").agg(F.collect_list(F.struct(F.col("event_type").alias("key"), F.col("v").alias("value"))).alias("e"))
    slots = rows.select("user_id", "week", channels.reordered(F.col("e"), TYPES).alias("s"))
    return slots.select("user_id", "week", *[F.col("s")[k].alias(f"c{k}") for k in range(5)])


@query("""
WITH f AS (SELECT *, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rate FROM orders)
SELECT o_custkey, rate, count(*) FILTER (o_orderpriority = rate) AS kept, count(*) FILTER (o_orderpriority <> rate) AS rejected FROM f GROUP BY 1, 2""")
def q63_rate_consistency(spark, sf_dir):
    first = F.first("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    same = F.col("o_orderpriority") == F.col("rate")
    return utc(spark, sf_dir, "orders").withColumn("rate", first).groupBy("o_custkey", "rate").agg(F.count_if(same).alias("kept"), F.count_if(~same).alias("rejected"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 2)")
def q64_valid_subject_semi(spark, sf_dir):
    valid = utc(spark, sf_dir, "customer").where("c_nationkey = 2").select(F.col("c_custkey").alias("o_custkey"))
    return coverage.only_valid(utc(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), valid, "o_custkey")


@query(with_("ev", "epi") + f" SELECT user_id, count(*) AS n, sum(e - b)::BIGINT AS total, min(b) AS first_begin, arg_min(e, b) AS first_end FROM epi GROUP BY 1")
def q65_file_metadata_nest(spark, sf_dir):
    return annotations.file_metadata(episodes(events(spark, sf_dir)), ["user_id"])


@query(with_("ev") + " SELECT event_id, round_even(us / 1e6 * 256, 0)::BIGINT AS sample FROM ev")
def q66_seconds_to_samples(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", clock.to_samples(F.col("us") / F.lit(1e6), 256).alias("sample"))
