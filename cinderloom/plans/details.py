"""Queries: rows of the survey whose own semantics the broader queries leave out."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.functions import scores as S
from cinderloom.operators import folds
from cinderloom.operators import ranking as R
from cinderloom.operators import recall as C
from cinderloom.operators import vectors as V
from cinderloom.operators.lineage import written
from cinderloom.plans.catalog_and_events import HISTORY, LABEL, WEIGHT
from cinderloom.plans.recall_and_rank import ARMS, BONUS, CO, OUT, POST, _arms, long
from cinderloom.plans.registry import query
from cinderloom.plans.serving_chain import DAY, _listed, _text
from cinderloom.sources import tables as T
from cinderloom.streaming import sinks

HOUR = 3_600_000
RATED = """re as (select event_id, case when event_type = 'error' then 'Rating' else event_type end raw_type, watch_ms, movie_id, user_id, (movie_id % 10 + 1) / 2.0 rating from ev)"""


def _ladder(kind: str, like: str, good: str, click: str, view: str) -> str:
    return f"case when {kind} in ('order','purchase') then {like} when {kind} = 'like' or ({kind} = 'rating' and rating >= 4) then {good} when {kind} in ({click}) or ({kind} in ('view','watch') and watch_ms >= 30000) or ({kind} = 'dwell' and watch_ms >= 10000) then {view} else 0 end"


@query("ev", f"""with {RATED} select event_id, cast(case when lower(raw_type) in ('order','purchase') then 8 when lower(raw_type) = 'like' then 3 when lower(raw_type) = 'rating' then case when rating >= 4 then 4 else 0 end when lower(raw_type) = 'click' then 2
 when (lower(raw_type) in ('view','watch') and watch_ms >= 30000) or (lower(raw_type) = 'dwell' and watch_ms >= 10000) then 1 else 0 end as bigint) weight, {_ladder('lower(raw_type)', '3', '2', "'click','search'", '1')} label, {_ladder('raw_type', '3', '2', "'click','search'", '1')} log_label from re""")
def f3_f4_f5_rated_events(spark, sf):
    """Weights and labels where events carry ratings: streams know types in any case, the log only as they are written."""
    raw = F.when(F.col("event_type") == "error", "Rating").otherwise(F.col("event_type"))
    e = T.events(spark, sf).select("event_id", "user_id", "movie_id", "watch_ms", ((F.col("movie_id") % 10 + 1) / 2.0).alias("rating"), raw.alias("event_type"))
    log = e.withColumn("log_label", E.training_label(F.col("rating")))
    known = log.withColumn("event_type", E.known_type())
    return known.select("event_id", E.engagement_weight(F.col("rating")).alias("weight"), E.training_label(F.col("rating")).alias("label"), "log_label")


@query("ev", f"""with n as (select movie_id, count(*) impressions from ev group by 1), s as (select event_type, {LABEL} l, max({LABEL}) over (partition by user_id, ts_ms // {DAY}) best, 1.0::double / (impressions + 1) novelty from ev join n using (movie_id))
 select event_type algorithm, round(avg((best - l) / 3.0::double), 6) regret, round(avg(novelty), 9) novelty from s group by 1""")
def a17_regret_and_novelty(spark, sf):
    """How far a served item's label is behind the best of its slate (a user's day), and how rare the served items are."""
    e = T.events(spark, sf).withColumn("l", E.training_label()).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    best = e.groupBy("user_id", "day").agg(F.max("l").alias("best"))
    n = e.groupBy("movie_id").agg(F.count(F.lit(1)).alias("impressions"))
    j = e.join(best, ["user_id", "day"]).join(n, "movie_id")
    return j.groupBy(F.col("event_type").alias("algorithm")).agg(F.round(F.avg((F.col("best") - F.col("l")) / 3.0), 6).alias("regret"), F.round(F.avg(1.0 / (F.col("impressions") + 1)), 9).alias("novelty"))


@query("ev", """with m as (select user_id % 3 strategy, ts_ms // 600000 slot, count(*) n, count(*) filter (event_type = 'error') bad, cast(sum(watch_ms) as bigint) ms from ev group by all)
 select strategy, slot, n, round(sum(bad) over w / sum(n) over w::double, 9) failure_rate, round(sum(ms) over w / sum(n) over w::double, 4) mean_ms from m window w as (partition by strategy order by slot range between 5 preceding and current row)""")
def a23_rolling_rates(spark, sf):
    """Failure rate and mean latency of each strategy over the last hour, in slots of ten minutes; days are windowed apart, each with the hour before it."""
    e = T.events(spark, sf).groupBy(F.pmod("user_id", F.lit(3)).alias("strategy"), F.floor(F.col("ts_ms") / 600_000).alias("slot"))
    m = e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.sum("watch_ms").alias("ms"))
    own = F.floor(F.col("slot") / 144)
    m = m.withColumn("part", F.explode(F.array_distinct(F.array(own, F.floor((F.col("slot") + 5) / 144)))))
    w = Window.partitionBy("strategy", "part").orderBy("slot").rangeBetween(-5, 0)
    total = F.sum("n").over(w)
    r = m.withColumn("failure_rate", F.round(F.sum("bad").over(w) / total, 9)).withColumn("mean_ms", F.round(F.sum("ms").over(w) / total, 4))
    return r.filter(F.col("part") == own).select("strategy", "slot", "n", "failure_rate", "mean_ms")


@query("ev", """with r as (select event_type strategy, watch_ms from (select *, row_number() over (partition by event_type order by md5(event_id), event_id) k from ev) where k <= 512)
 select strategy, count(*) n, quantile_disc(watch_ms, 0.5) p50, quantile_disc(watch_ms, 0.95) p95 from r group by 1""")
def a24_reservoir(spark, sf):
    """Nearest-rank percentiles of a reservoir of 512 latencies a strategy, those of least hash; 512 a strategy leave each task."""
    r = R.top_k(T.events(spark, sf).select("event_type", "event_id", "watch_ms"), ["event_type"], 512, F.md5("event_id"), F.asc("event_id"))
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by watch_ms)").cast("long")
    return r.groupBy(F.col("event_type").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query("ev", f"""with c as (select user_id, ts_ms // {HOUR} w, count(*) n from ev group by all), b as (select user_id, w, n cur, 0 prev from c union all select user_id, w + 1, 0, n from c),
 s as (select user_id, w, sum(cur) + 0.5::double * sum(prev) rate from b group by all) select user_id, w bucket, rate from (select *, row_number() over (partition by w order by rate desc, user_id) k from s) where k <= 3""")
def a30_two_bucket_hot_keys(spark, sf):
    """The hottest keys of each hour by a sliding rate: the hour's accesses and half of the hour's before."""
    c = T.events(spark, sf).groupBy("user_id", F.floor(F.col("ts_ms") / HOUR).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct("bucket", F.col("n").cast("double").alias("x")), F.struct((F.col("bucket") + 1).alias("bucket"), (0.5 * F.col("n")).alias("x")))
    s = c.select("user_id", F.explode(both).alias("b")).groupBy("user_id", "b.bucket").agg(F.sum("b.x").alias("rate"))
    return R.top_k(s, ["bucket"], 3, F.desc("rate"), F.asc("user_id")).select("user_id", "bucket", "rate")


@query("ev", """with a as (select *, case when user_id % 10 < 3 then 'A' when user_id % 10 < 6 then 'B' else 'default' end assigned from ev), s as (select *, case when event_type = 'error' then 'default' else assigned end served from a)
 select assigned, served, assigned <> served fallback, count(*) n, count(distinct user_id) users from s group by all""")
def a31_exposures(spark, sf):
    """Exposures by assigned and served variant: a failed one is served the default."""
    assigned = F.when(F.col("user_id") % 10 < 3, "A").when(F.col("user_id") % 10 < 6, "B").otherwise("default")
    s = T.events(spark, sf).withColumn("assigned", assigned).withColumn("served", F.when(F.col("event_type") == "error", "default").otherwise(F.col("assigned")))
    return s.groupBy("assigned", "served", (F.col("assigned") != F.col("served")).alias("fallback")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("outbox", """with o as (select *, created_ms + event_id % 12 * 86400000 next_ms from outbox where status = 'PENDING'), now as (select min(next_ms) + 30 * 86400000::bigint t from o)
 select event_id, created_ms, next_ms from o, now where next_ms <= t order by next_ms, created_ms, event_id limit 100""")
def w20_due_claims(spark, sf):
    """The hundred due first: pending, next attempt not after now, in order of next attempt and creation. A claim is a top-k report."""
    o = T.outbox(spark, sf).filter("status = 'PENDING'").withColumn("next_ms", F.col("created_ms") + F.col("event_id") % 12 * DAY)
    due = o.join(F.broadcast(o.agg((F.min("next_ms") + 30 * DAY).alias("now")))).filter("next_ms <= now")  # one row
    return due.orderBy("next_ms", "created_ms", "event_id").limit(100).select("event_id", "created_ms", "next_ms")


@query("outbox", """with o as (select event_id, created_ms + event_id % 1000 ack_ms from outbox where status = 'DELIVERED'), r as (select min(ack_ms) + 30 * 86400000::bigint f, min(ack_ms) + 90 * 86400000::bigint t from o)
 select event_id, ack_ms, row_number() over (order by ack_ms, event_id) place from o, r where ack_ms >= f and ack_ms < t""")
def w21_delivered_scan(spark, sf):
    """Delivered events acknowledged in [from, to), numbered by acknowledgement and id."""
    o = T.outbox(spark, sf).filter("status = 'DELIVERED'").select("event_id", (F.col("created_ms") + F.col("event_id") % 1000).alias("ack_ms"))
    o = o.join(F.broadcast(o.agg(F.min("ack_ms").alias("lo")))).filter((F.col("ack_ms") >= F.col("lo") + 30 * DAY) & (F.col("ack_ms") < F.col("lo") + 90 * DAY))  # one row
    return R.placed(o.select("event_id", "ack_ms"), F.asc("ack_ms"), F.asc("event_id"), name="place").withColumn("place", F.col("place").cast("long"))


@query("ev", """with n as (select *, cast(substr(event_id, 5) as bigint) i from ev), c as (select event_id, user_id % 16 shard, ts_ms, 1 g from n where i % 3 <> 0), p as (select event_id, user_id % 8 shard, ts_ms, 0 g from n where i % 3 <> 2),
 m as (select event_id, arg_max(shard, g) shard, arg_max(ts_ms, g) ts_ms, max(g) g from (select * from c union all select * from p) group by 1)
 select event_id, case g when 1 then 'current' else 'previous' end generation, shard, row_number() over (partition by g, shard order by ts_ms, event_id) seq from m""")
def u7_generations(spark, sf):
    """Records of the current (16) and the previous generation (8 shards) in one log: of a record in both the current one counts."""
    n = T.events(spark, sf).withColumn("i", F.substring("event_id", 5, 30).cast("long"))
    part = lambda cond, shards, g: n.filter(cond).select("event_id", F.pmod("user_id", F.lit(shards)).alias("shard"), "ts_ms", F.lit(g).alias("g"))
    m = part("i % 3 <> 0", 16, 1).union(part("i % 3 <> 2", 8, 0)).groupBy("event_id").agg(F.max(F.struct("g", "shard", "ts_ms")).alias("x")).select("event_id", "x.*")
    m = R.placed(m, F.asc("ts_ms"), F.asc("event_id"), by=("g", "shard"), name="seq")
    return m.select("event_id", F.when(F.col("g") == 1, "current").otherwise("previous").alias("generation"), "shard", long("seq"))


@query("ratings vectors", f"""with {CO}, nb as (select item_id, other_id from (select *, row_number() over (partition by item_id order by n desc, other_id) k from co join (select id from vectors) v on other_id = v.id) where k <= 3),
 tk as (select id item_id, vec from vectors union all select item_id, vec from nb join vectors on other_id = id where item_id in (select id from vectors)),
 q as (select * from tk where item_id % 50 = 0), s as (select q.item_id query_id, d.item_id id, q.vec qv, max(list_inner_product(q.vec, d.vec)) best from q join tk d on q.item_id <> d.item_id group by all),
 t as (select query_id, id, round(sum(best), 6) score from s group by all) select query_id, id, score, "rank" from (select *, row_number() over (partition by query_id order by score desc, id) as "rank" from t) where "rank" <= 10""")
def v9_v10_co_rated_bags(spark, sf):
    """Items as bags of their own vector and those of the three most co-rated items; the ten of highest MaxSim for each item whose id is divisible by 50."""
    v = T.vectors(spark, sf).select("id", "vec")
    some = v.select(F.col("id").alias("item_id"))
    near = C.similar_items(T.ratings(spark, sf), 3, of=some, among=some).select(F.col("item_id").alias("owner"), F.col("other_id").alias("id"))
    tokens = v.select(F.col("id").alias("owner"), "vec").union(near.join(v, "id").select("owner", "vec"))
    bags = tokens.groupBy("owner").agg(F.collect_list("vec").alias("bag"))  # four vectors at most
    q = bags.filter("owner % 50 = 0").select(F.col("owner").alias("query_id"), F.col("bag").alias("qbag"))
    return V.max_sim_top_k(q, bags.withColumnRenamed("owner", "id"), 10).select("query_id", "id", "score", long("rank"))


@query("ratings movies", """with w as (select user_id, string_agg(item_id, ',' order by k) watched from (select *, row_number() over (partition by user_id order by ts desc, item_id) k from ratings) where k <= 50 group by 1),
 r as (select user_id, string_agg(item_id, ',' order by k) rated from (select *, row_number() over (partition by user_id order by ts desc, item_id) k from ratings where rating >= 4) where k <= 50 group by 1),
 g as (select user_id, genre, round(least(1.0::double, avg(rating) / 4.0), 6) w from ratings join (select item_id, unnest(genres) genre from movies) using (item_id) group by all),
 p as (select user_id, string_agg(genre || '=' || cast(cast(round(w * 1e6) as bigint) as varchar), ',' order by k) prefs from (select *, row_number() over (partition by user_id order by w desc, genre) k from g) where k <= 5 group by 1)
 select c_custkey user_id, coalesce(watched, '') watched, coalesce(rated, '') rated, coalesce(prefs, '') prefs from customer left join w on c_custkey = w.user_id left join r on c_custkey = r.user_id left join p on c_custkey = p.user_id""")
def h7_h12_histories(spark, sf):
    """The newest 50 watched and the newest 50 well rated items of each user, and the five strongest preferences, none over 1."""
    r = written(T.ratings(spark, sf), "ratings")
    newest = [F.desc("ts"), F.asc("item_id")]
    g = r.join(T.movies(spark, sf).select("item_id", "genres"), "item_id").select("user_id", "rating", "genres").repartition("user_id")
    g = g.select("user_id", "rating", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.round(F.least(F.lit(1.0), F.avg("rating") / 4.0), 6).alias("w"))
    g = g.withColumn("pref", F.concat("genre", F.lit("="), F.round(F.col("w") * 1e6).cast("long").cast("string")))
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    for part in (_listed(r, "user_id", newest, 50, "item_id", "watched"), _listed(r.filter("rating >= 4"), "user_id", newest, 50, "item_id", "rated"), _listed(g, "user_id", [F.desc("w"), F.asc("genre")], 5, "pref", "prefs")):
        u = u.join(part, "user_id", "left")
    return u.fillna("", ["watched", "rated", "prefs"])


@query("ev", f"""with p as (select event_type, case when {LABEL} > 0 then 1 else 0 end y, greatest(1e-12::double, least(1 - 1e-12::double, 1.0 / (1.0 + exp(-(watch_ms / 60000.0 - 1))))) p from ev)
 select event_type, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) loss from p group by 1""")
def x6_logistic_loss(spark, sf):
    """Mean logistic loss of a score against the label, probabilities kept 1e-12 away from 0 and 1."""
    y = F.when(E.training_label() > 0, 1).otherwise(0)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), S.sigmoid(F.col("watch_ms") / 60000.0 - 1)))
    return T.events(spark, sf).groupBy("event_type").agg(F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 6).alias("loss"))


@query("ev", """with n as (select *, coalesce(lead(watch_ms / (watch_ms + 30000.0)) over (partition by user_id order by ts_ms, event_id), 0.0::double) ahead from ev),
 l as (select movie_id state, event_type as "action", list({'r': case when event_type = 'purchase' then 1.0::double when event_type = 'click' then 0.5::double else 0.0::double end, 'm': ahead} order by ts_ms, event_id) s from n group by all)
 select state, "action", round(list_reduce(list_prepend({'r': 0.0::double, 'm': 0.0::double}, s), lambda q, x: {'r': q.r + 0.1 * (x.r + 0.9 * x.m - q.r), 'm': 0.0::double}).r, 6) q from l""")
def x14_sarsa(spark, sf):
    """Values after on-policy steps: what follows counts by the action that the user took next, not by the best one."""
    t, gain = F.col("event_type"), F.col("watch_ms") / (F.col("watch_ms") + 30000.0)
    ahead = F.coalesce(F.lead(gain).over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id")), F.lit(0.0))
    e = T.events(spark, sf).select(F.col("movie_id").alias("state"), t.alias("action"), "ts_ms", "event_id", F.when(t == "purchase", 1.0).when(t == "click", 0.5).otherwise(0.0).alias("reward"), ahead.alias("next_max"))
    return folds.q_values(e).withColumn("q", F.round("q", 6))


@query("ev", """with l as (select user_id, movie_id, max((ts_ms, event_id)) m from ev where movie_id > 0 and user_id > 0 group by all), k as (select *, row_number() over (partition by user_id order by m desc) k from l)
 select user_id, string_agg(movie_id, ',' order by k) filter (k <= 50) actions, string_agg(movie_id, ',' order by k) filter (k <= 100) retrieval, string_agg(movie_id, ',' order by k) filter (k <= 20) scoring, count(*) filter (k <= 500) impressed, count(*) filter (k <= 200) served from k group by 1""")
def x34_w26_distinct_sequences(spark, sf):
    """Each user's items newest first, each once, then cut: to 50, 100 and 20 for the three sequences, to 500 impressed and 200 served."""
    e = T.events(spark, sf).filter("movie_id > 0 and user_id > 0").withColumnRenamed("movie_id", "item_id")
    s = C.recent_items(e, 500).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("s"))
    cut = lambda k: _text(F.slice("s", 1, k), "item_id")
    size = F.size("s")
    return s.select("user_id", cut(50).alias("actions"), cut(100).alias("retrieval"), cut(20).alias("scoring"), size.cast("long").alias("impressed"), F.least(size, F.lit(200)).cast("long").alias("served"))


@query("ratings vectors", "select c_custkey user_id, count(id) = 0 cold, count(id) known from customer left join ratings on c_custkey = user_id left join vectors on item_id = id group by 1")
def c9_without_embedding(spark, sf):
    """Whether a user is cold: none of the items they rated has a vector, so they have none either."""
    known = T.ratings(spark, sf).join(T.vectors(spark, sf).select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("known"))
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(known, "user_id", "left")
    return u.select("user_id", F.col("known").isNull().alias("cold"), F.coalesce("known", F.lit(0)).alias("known"))


@query("ev", f"""with s as (select movie_id % 5 key, ts_ms // {DAY} as day, movie_id, cast(sum({WEIGHT}) as bigint) score, max((ts_ms, event_id)) v from ev where movie_id > 0 group by all), l as (select key, day, max(v) over (partition by key, day) v, movie_id, score, row_number() over (partition by key, day order by score desc, movie_id) k from s where score > 0),
 n as (select key, max(v) v from l group by 1) select l.key, string_agg(movie_id || ':' || score, ',' order by k) top from l join n on l.key = n.key and l.v = n.v where k <= 3 group by 1""")
def k3_versioned_top(spark, sf):
    """A list for each key and day comes with a version (time, event id); the newest version of a key stands, older ones are refused."""
    e = T.events(spark, sf).filter("movie_id > 0").withColumn("key", F.pmod("movie_id", F.lit(5))).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    s = e.groupBy("key", "day", "movie_id").agg(F.sum(E.engagement_weight()).alias("score"), F.max(F.struct("ts_ms", "event_id")).alias("v")).filter("score > 0")
    version = s.groupBy("key", "day").agg(F.max("v").alias("version"))
    top = R.top_k(s, ["key", "day"], 3, F.desc("score"), F.asc("movie_id"))
    lists = top.groupBy("key", "day").agg(F.sort_array(F.collect_list(F.struct("rank", F.format_string("%d:%d", "movie_id", "score").alias("x")))).alias("l"))
    newest = lists.join(version, ["key", "day"]).groupBy("key").agg(F.max_by("l", "version").alias("l"))
    return newest.select("key", _text(F.col("l"), "x").alias("top"))


#: A double in [0, 1000) of six decimals as text: plain from a thousandth on, below that with an exponent.
SHORT = lambda x: f"""(case when {x} = 0 or {x} >= 0.001 then cast({x} as varchar) else cast(cast(round({x} * 1e6) as bigint) / (case when {x} >= 0.0001 then 100.0::double when {x} >= 0.00001 then 10.0::double else 1.0::double end) as varchar)
 || case when {x} >= 0.0001 then 'E-4' when {x} >= 0.00001 then 'E-5' else 'E-6' end end)"""  # noqa: E731


@query("ev", f"""with {ARMS}, f as (select item_id, [1.0::double, {POST}, least(1.0::double, greatest(0.0::double, 0.65 * {POST} + 0.35 * {OUT})), con, {BONUS}, case when cold then 1.0::double else 0.0::double end, ln(1 + impressions), ln(1 + clicks), clicks / (impressions + 1)::double] x from arm),
 g as (select item_id, list_transform(x, lambda v: round(v, 6)) x from f) select item_id, 'v2:' || {" || ',' || ".join(SHORT(f"x[{i}]") for i in range(1, 10))} packed from g""")
def p4_packed_features(spark, sf):
    """Nine features as one text with the version of their order: bias, bandit score, estimated reward, online score (here the click rate), exploration
    bonus, cold start, log impressions, log clicks, smoothed click rate. Rounded to six decimals before they are written, so that both engines write the same."""
    c, a = F.col, _arms(spark, sf)
    post = S.posterior_mean(c("rel"), c("clicks"), c("impressions"), c("cold"))
    reward = S.estimated_reward(post, S.weighted_outcome(c("rel"), c("con"), c("pop"), c("clicks"), c("impressions")))
    bonus = S.ucb_bonus(c("impressions"), c("total"), c("cold"))
    x = [F.lit(1.0), post, reward, c("con"), bonus, c("cold").cast("double"), F.log1p("impressions"), F.log1p("clicks"), c("clicks") / (c("impressions") + 1)]
    return a.select("item_id", S.packed(F.array(*[F.round(v, 6) for v in x])).alias("packed"))


@query("ev", f"""with k as (select event_id, unnest(list_concat(['feature:user:' || user_id || ':session:' || session_id], case when {HISTORY} then ['user:' || user_id || ':recent_movies', 'user:' || user_id || ':embedding'] else [] end)) key from ev where user_id > 0)
 select event_id, string_agg(distinct key, ',' order by key) keys from k group by 1""")
def k2_event_index(spark, sf):
    """The reverse index of lineage: the keys that an event wrote."""
    return sinks.event_keys(_written_keys(T.events(spark, sf)))


@query("ev", f"""with k as (select event_id, ts_ms, event_type, unnest(list_concat(['feature:user:' || user_id || ':session:' || session_id], case when {HISTORY} then ['user:' || user_id || ':recent_movies', 'user:' || user_id || ':embedding'] else [] end)) key from ev where user_id > 0)
 select key, arg_max(event_type, (ts_ms, event_id)) as "value", arg_max(event_id, (ts_ms, event_id)) last_event, max(ts_ms) updated_ms from k group by 1""")
def k2_last_event(spark, sf):
    """Of each key the value, the event that wrote it and its time."""
    last = F.max(F.struct("ts_ms", "event_id", "value")).alias("x")
    return _written_keys(T.events(spark, sf)).groupBy("key").agg(last).select("key", "x.value", F.col("x.event_id").alias("last_event"), F.col("x.ts_ms").alias("updated_ms"))


def _written_keys(e):
    """(key, ts_ms, event_id, value): what valid events write."""
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    session = F.concat(F.lit("feature:"), user, F.lit(":session:"), F.col("session_id"))
    history = F.when(E.updates_history(), F.array(F.concat(user, F.lit(":recent_movies")), F.concat(user, F.lit(":embedding")))).otherwise(F.array().cast("array<string>"))
    return e.filter(E.valid()).select(F.explode(F.concat(F.array(session), history)).alias("key"), "ts_ms", "event_id", F.col("event_type").alias("value"))
