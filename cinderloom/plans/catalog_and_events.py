"""Queries: scans, predicates, windowed features, catalog pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.operators import ranking as R
from cinderloom.operators import recall as C
from cinderloom.plans.registry import query
from cinderloom.sources import tables as T

WEIGHT = """case when event_type in ('order','purchase') then 8 when event_type = 'like' then 3 when event_type = 'rating' then 0
 when event_type = 'click' then 2 when event_type in ('view','watch') and watch_ms >= 30000 then 1 when event_type = 'dwell' and watch_ms >= 10000 then 1 else 0 end"""
HISTORY = """(movie_id > 0 and (event_type in ('click','like','rating','order','purchase') or (event_type in ('view','watch') and watch_ms >= 30000)
 or (event_type = 'dwell' and watch_ms >= 10000)))"""
METRIC = """case when movie_id > 0 then case when event_type in ('order','purchase') then 'orders_1h' when event_type = 'like' then 'likes_1h' when event_type = 'rating' then 'ratings_1h'
 when event_type = 'click' then 'clicks_1h' when event_type = 'dwell' then 'dwells_1h' when event_type in ('view','watch') then 'views_1h' end end"""
LABEL = """case when event_type in ('order','purchase') then 3 when event_type = 'like' then 2 when event_type in ('click','search') or (event_type in ('view','watch') and watch_ms >= 30000)
 or (event_type = 'dwell' and watch_ms >= 10000) then 1 else 0 end"""
HOUR = 3_600_000


@query("ratings movies", "select r.item_id, title, avg_rating, n from (select item_id, avg(rating) avg_rating, count(*) n from ratings group by 1) r join movies m on r.item_id = m.item_id order by avg_rating desc, r.item_id limit 50")
def a1_w5_top_rated(spark, sf):
    """A top-k report: the limit is the feature."""
    avg = T.ratings(spark, sf).groupBy("item_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("n"))
    return avg.join(T.movies(spark, sf).select("item_id", "title"), "item_id").orderBy(F.desc("avg_rating"), "item_id").limit(50).select("item_id", "title", "avg_rating", "n")


@query("movies", "select item_id, title, year, array_to_string(genres, '|') genres from movies")
def s1_movies(spark, sf):
    return T.movies(spark, sf).withColumn("genres", F.array_join("genres", "|"))


@query("ratings", "select user_id, item_id, rating, ts from ratings")
def s3_ratings(spark, sf):
    return T.ratings(spark, sf)


@query("", "select c_custkey user_id, c_name \"name\" from customer")
def s2_users(spark, sf):
    return T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


@query("", "select p_partkey id, case when p_partkey % 3 = 0 then upper(p_name) else p_name end title from part")
def s10_catalog_overlay(spark, sf):
    from cinderloom.sources.files import merged_catalog

    base = T.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return merged_catalog(base, base.filter("id % 3 = 0").withColumn("title", F.upper("title")))


@query("ratings movies", """select genre, g.item_id, coalesce(a, 0.0) avg_rating, row_number() over (partition by genre order by coalesce(a, 0.0) desc, g.item_id) as "rank"
 from (select distinct item_id, unnest(genres) genre from movies) g left join (select item_id, avg(rating) a from ratings group by 1) r on g.item_id = r.item_id""")
def a3_genre_index(spark, sf):
    avg = T.ratings(spark, sf).groupBy("item_id").agg(F.avg("rating").alias("a"))
    g = T.movies(spark, sf).select("item_id", F.explode("genres").alias("genre")).distinct().join(avg, "item_id", "left").withColumn("avg_rating", F.coalesce("a", F.lit(0.0)))
    return R.placed(g, F.desc("avg_rating"), F.asc("item_id"), by=("genre",)).select("genre", "item_id", "avg_rating", F.col("rank").cast("long").alias("rank"))


@query("ratings", "select user_id, string_agg(item_id, ',' order by ts, item_id) items, count(*) n from ratings where rating >= 3.5 group by 1")
def a4_s5_f15_item_sequences(spark, sf):
    s = T.ratings(spark, sf).filter("rating >= 3.5").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "item_id"))).alias("s"))
    return s.select("user_id", F.array_join(F.transform("s", lambda x: x["item_id"].cast("string")), ",").alias("items"), F.size("s").cast("long").alias("n"))


@query("catalog", "select genre, id, year, row_number() over (partition by genre order by year desc, id) as \"rank\" from catalog")
def w6_latest(spark, sf):
    return R.placed(T.catalog(spark, sf), F.desc("year"), F.asc("id"), by=("genre",)).select("genre", "id", "year", F.col("rank").cast("long").alias("rank"))


@query("ev", f"""select event_id, user_id > 0 and trim(event_id) <> '' valid, {HISTORY} history, cast({WEIGHT} as bigint) weight, {LABEL} label,
 case when lower(trim(event_type)) in ('view','watch','click','like','rating','order','purchase','search','dwell') then lower(trim(event_type)) end known_type, {METRIC} metric from ev""")
def f1_f7_event_flags(spark, sf):
    return T.events(spark, sf).select("event_id", E.valid().alias("valid"), E.updates_history().alias("history"), E.engagement_weight().alias("weight"), E.training_label().alias("label"), E.known_type().alias("known_type"), E.metric_kind().alias("metric"))


@query("ev", "with m as (select min(ts_ms) lo, max(ts_ms) hi from ev) select event_id, ts_ms > 0 and ts_ms >= lo + 86400000 replayed, ts_ms + 86400 * 1000 > hi alive from ev, m")
def f8_f9_replay(spark, sf):
    e = T.events(spark, sf)
    e = e.join(F.broadcast(e.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))))  # one row
    return e.select("event_id", ((F.col("ts_ms") > 0) & (F.col("ts_ms") >= F.col("lo") + 86_400_000)).alias("replayed"), E.alive_at(F.col("hi"), 86_400).alias("alive"))


@query("ev", f"select movie_id, metric, w as window_start, count(*) n from (select movie_id, {METRIC} metric, ts_ms // 10000 * 10000 w from ev) where metric is not null group by all")
def a8_t6_window_counts(spark, sf):
    e = T.events(spark, sf).select("movie_id", E.metric_kind().alias("metric"), (F.floor(F.col("ts_ms") / 10_000) * 10_000).alias("window_start"))
    return e.filter("metric is not null").groupBy("movie_id", "metric", "window_start").agg(F.count(F.lit(1)).alias("n"))


@query("ev", f"""select window_start, movie_id, score, "rank" from (select *, row_number() over (partition by window_start order by score desc, movie_id) as "rank"
 from (select ts_ms // 3600000 * 3600000 window_start, movie_id, cast(sum({WEIGHT}) as bigint) score from ev where movie_id > 0 and user_id > 0 group by all) where score > 0) where "rank" <= 10""")
def a9_a10_w1_t7_t8_trending_windows(spark, sf):
    e = T.events(spark, sf).filter((F.col("movie_id") > 0) & E.valid()).withColumn("window_start", F.floor(F.col("ts_ms") / HOUR) * HOUR)
    s = e.groupBy("window_start", "movie_id").agg(F.sum(E.engagement_weight()).alias("score")).filter("score > 0")
    return R.top_k(s, ["window_start"], 10, F.desc("score"), F.asc("movie_id")).withColumn("rank", F.col("rank").cast("long"))


@query("ev", """with d as (select * from ev union all select event_id, user_id, movie_id, event_type, watch_ms, ts_ms + 3600000, session_id from ev where cast(substr(event_id, 5) as bigint) % 10 = 0)
 select user_id, event_id, min(ts_ms) ts_ms, count(*) - 1 dropped from d group by all""")
def t2_dedup(spark, sf):
    """Events and a tenth of them again an hour later: the first of each user and event id stays."""
    e = T.events(spark, sf).select("user_id", "event_id", "ts_ms")
    again = e.filter(F.substring("event_id", 5, 30).cast("long") % 10 == 0).withColumn("ts_ms", F.col("ts_ms") + HOUR)
    return e.union(again).groupBy("user_id", "event_id").agg(F.min("ts_ms").alias("ts_ms"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("ev", f"""select user_id, 'user:' || user_id || ':recent_movies' key, string_agg(movie_id, ',' order by r desc) movies from (
 select *, row_number() over (partition by user_id order by ts_ms desc, event_id desc) r from (
 select *, row_number() over (partition by user_id, movie_id order by ts_ms desc, event_id desc) k from ev where user_id > 0 and {HISTORY}) where k = 1) where r <= 3 group by 1""")
def t3_w25_p1_recent_movies(spark, sf):
    e = T.events(spark, sf).filter(E.valid() & E.updates_history()).withColumnRenamed("movie_id", "item_id")
    r = C.recent_items(e, 3).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("o"), "item_id"))).alias("s"))
    return r.select("user_id", F.format_string("user:%d:recent_movies", "user_id").alias("key"), F.array_join(F.transform("s", lambda x: x["item_id"].cast("string")), ",").alias("movies"))


@query("ev", f"""select user_id, session_id, 'eventCount=' || count(*) || ',clicks=' || sum(cast(event_type = 'click' as int)) || ',watches=' || sum(cast(event_type in ('view','watch') as int))
 || ',likes=' || sum(cast(event_type = 'like' as int)) || ',searches=' || sum(cast(event_type = 'search' as int)) || ',engagement=' || cast(sum({WEIGHT}) as bigint) || ',lastMovie=' || arg_max(movie_id, (ts_ms, event_id))
 || ',lastType=' || arg_max(event_type, (ts_ms, event_id)) features from ev where user_id > 0 group by all""")
def t5_a11_p2_session_features(spark, sf):
    count = lambda c: F.count_if(c)
    t, last = F.col("event_type"), F.struct("ts_ms", "event_id")
    s = T.events(spark, sf).filter(E.valid()).groupBy("user_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"), count(t == "click").alias("c"), count(t.isin("view", "watch")).alias("w"), count(t == "like").alias("l"), count(t == "search").alias("s"),
        F.sum(E.engagement_weight()).alias("e"), F.max_by("movie_id", last).alias("m"), F.max_by("event_type", last).alias("t"),
    )
    text = F.format_string("eventCount=%d,clicks=%d,watches=%d,likes=%d,searches=%d,engagement=%d,lastMovie=%d,lastType=%s", "n", "c", "w", "l", "s", "e", "m", "t")
    return s.select("user_id", "session_id", text.alias("features"))


@query("ev", f"""with b as (select user_id, movie_id % 16 dim, sum(greatest(1, {WEIGHT})) v from ev where user_id > 0 and {HISTORY} group by all)
 select user_id, dim, round(v / sqrt(sum(v * v) over (partition by user_id)), 6) x from b""")
def v18_t4_x32_user_vectors(spark, sf):
    from pyspark.sql import Window

    e = T.events(spark, sf).filter(E.valid() & E.updates_history())
    b = e.groupBy("user_id", F.pmod("movie_id", F.lit(16)).alias("dim")).agg(F.sum(F.greatest(F.lit(1), E.engagement_weight())).alias("v"))
    return b.select("user_id", "dim", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("user_id"))), 6).alias("x"))


@query("ev", "select user_id, arg_max(event_type, (ts_ms, event_id)) as \"value\", max(ts_ms) updated_ms from ev group by 1")
def k1_k3_latest_value(spark, sf):
    v = C.last_value(T.events(spark, sf), ["user_id"], F.col("event_type"), "ts_ms", "event_id")
    return v.select("user_id", "value", F.col("version.ts_ms").alias("updated_ms"))


@query("ev", "select user_id, string_agg(event_id, ',' order by ts_ms, event_id) history from (select *, row_number() over (partition by user_id order by ts_ms desc, event_id desc) r from ev) where r <= 5 group by 1")
def k2_lineage(spark, sf):
    top = R.top_k(T.events(spark, sf).select("user_id", "event_id", "ts_ms"), ["user_id"], 5, F.desc("ts_ms"), F.desc("event_id"))
    s = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "event_id"))).alias("s"))
    return s.select("user_id", F.array_join(F.transform("s", lambda x: x["event_id"]), ",").alias("history"))


@query("ev", """select shard, seq, user_id, event_id from (select user_id % 16 shard, user_id, event_id, row_number() over (partition by user_id % 16 order by ts_ms, event_id) seq from ev)""")
def k7_u7_shard_log(spark, sf):
    e = T.events(spark, sf).groupBy("user_id", "event_id").agg(F.min("ts_ms").alias("ts_ms")).withColumn("shard", F.pmod("user_id", F.lit(16)))
    return R.placed(e, F.asc("ts_ms"), F.asc("event_id"), by=("shard",), name="seq").select("shard", F.col("seq").cast("long").alias("seq"), "user_id", "event_id")


@query("catalog", "with a as (select score s, id i from catalog order by score desc, id desc limit 1 offset 100) select id, title, cast(c.score as varchar) score, has_more from (select *, count(*) over () > 20 has_more, row_number() over (order by score desc, id desc) r from (select c.* from catalog c, a where c.score < s or (c.score = s and id < i) order by score desc, id desc limit 21) c) c where r <= 20")
def w16_w17_keyset_page(spark, sf):
    c = T.catalog(spark, sf)
    a = c.orderBy(F.desc("score"), F.desc("id")).offset(100).limit(1).first()
    return R.keyset_page(c, "score", "id", 20, after=(a["score"], a["id"])).select("id", "title", F.col("score").cast("string").alias("score"), "has_more")


@query("catalog", "with a as (select score s, id i from catalog order by score desc, id desc limit 1 offset 100) select id, cast(score as varchar) score from (select c.* from catalog c, a where c.score > s or (c.score = s and id > i) order by score, id limit 20)")
def w16_keyset_before(spark, sf):
    c = T.catalog(spark, sf)
    a = c.orderBy(F.desc("score"), F.desc("id")).offset(100).limit(1).first()
    return R.keyset_page(c, "score", "id", 20, before=(a["score"], a["id"])).select("id", F.col("score").cast("string").alias("score"))


@query("catalog", "select id, title, year, genre from catalog order by score desc, id desc limit 30 offset 60")
def j5_w19_deferred_page(spark, sf):
    return R.deferred_page(T.catalog(spark, sf), "id", [F.desc("score"), F.desc("id")], 60, 30).select("id", "title", "year", "genre")


@query("catalog", "select genre, count(*) n, count(*) filter (year >= 2000) recent from catalog group by 1")
def a28_catalog_counts(spark, sf):
    return T.catalog(spark, sf).groupBy("genre").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year") >= 2000).alias("recent"))


@query("catalog", "select id, rtrim(replace(replace(to_base64(encode(cast(score as varchar) || chr(10) || id)), '+', '-'), '/', '_'), '=') \"cursor\" from catalog")
def x28_seek_cursors(spark, sf):
    raw = F.base64(F.concat(F.col("score").cast("string"), F.lit("\n"), F.col("id").cast("string")).cast("binary"))
    return T.catalog(spark, sf).select("id", F.rtrim(F.translate(raw, "+/", "-_"), F.lit("=")).alias("cursor"))


@query("", "select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), ' '), lambda x: x <> ''))), ' ') words from documents")
def x1_x2_text_sets(spark, sf):
    t = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")))
    return T.load(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(t, " "), lambda x: x != ""))), " ").alias("words"))


@query("ev", "select event_id, session_id, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') \"day\", cast(ceil((max(ts_ms) over () - ts_ms) / 86400000.0) as bigint) lookback_days from ev")
def x5_day_buckets(spark, sf):
    e = T.events(spark, sf)
    e = e.join(F.broadcast(e.agg(F.max("ts_ms").alias("hi"))))  # one row
    return e.select("event_id", "session_id", F.date_format(F.timestamp_millis("ts_ms"), "yyyyMMdd").alias("day"), F.ceil((F.col("hi") - F.col("ts_ms")) / 86_400_000.0).cast("long").alias("lookback_days"))


@query("ratings", """with p as (select user_id, ts // 86400 as day, string_agg(item_id, ',' order by ts desc, item_id) items, string_agg(rating, ',' order by ts desc, item_id) rs from ratings group by all),
 u as (select user_id, day, unnest(string_split(items, ',')) item_id, unnest(string_split(rs, ',')) rating, unnest(range(1, len(string_split(items, ',')) + 1)) place from p)
 select user_id, cast(item_id as bigint) item_id, cast(rating as double) rating, "rank" from (select *, row_number() over (partition by user_id order by day desc, place) as "rank" from u) where "rank" <= 50""")
def x4_j15_w22_packed_sequences(spark, sf):
    """Columns packed by user and day, unpacked again, the newest 50 of each user."""
    r = T.ratings(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400))
    p = r.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct((-F.col("ts")).alias("t"), "item_id", "rating"))).alias("s"))
    p = p.select("user_id", "day", F.array_join(F.transform("s", lambda x: x["item_id"].cast("string")), ",").alias("items"), F.array_join(F.transform("s", lambda x: x["rating"].cast("string")), ",").alias("rs"))
    u = p.select("user_id", "day", F.posexplode(F.arrays_zip(F.split("items", ",").alias("i"), F.split("rs", ",").alias("r"))).alias("place", "x"))
    top = R.top_k(u, ["user_id"], 50, F.desc("day"), F.asc("place"))
    return top.select("user_id", F.col("x.i").cast("long").alias("item_id"), F.col("x.r").cast("double").alias("rating"), F.col("rank").cast("long").alias("rank"))
