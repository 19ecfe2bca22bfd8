"""Queries: recall channels, merges, vectors, scoring chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.functions import scores as S
from cinderloom.operators import inverted_file as I
from cinderloom.operators import ranking as R
from cinderloom.operators import recall as C
from cinderloom.operators import vectors as V
from cinderloom.operators.lineage import written
from cinderloom.operators.products import in_order
from cinderloom.plans.catalog_and_events import WEIGHT
from cinderloom.plans.registry import query
from cinderloom.sources import tables as T

long = lambda c: F.col(c).cast("long").alias(c)

CO = """co as (select x.item_id, y.item_id other_id, count(*) n from (select *, row_number() over (partition by user_id order by ts desc, item_id) k from ratings) x
 join (select *, row_number() over (partition by user_id order by ts desc, item_id) k from ratings) y on x.user_id = y.user_id and x.item_id <> y.item_id and x.k <= 500 and y.k <= 500 group by all)"""
NB = """nr as (select user_id, sqrt(sum(rating * rating)) norm from ratings group by 1),
 nb as (select * from (select *, row_number() over (partition by user_id order by sim desc, other_id) k from (
 select d.user_id, d.other_id, round(dot / (a.norm * b.norm), 9) sim from (select x.user_id, y.user_id other_id, sum(x.rating * y.rating) dot from ratings x join ratings y on x.item_id = y.item_id and x.user_id <> y.user_id group by all) d
 join nr a on d.user_id = a.user_id join nr b on d.other_id = b.user_id) where sim > 0) where k <= 50)"""
POP = """pop as (select movie_id item_id, count(*) n, row_number() over (order by count(*) desc, movie_id) r from ev where movie_id > 0 group by 1)"""


@query("ratings", f"with {CO} select item_id, other_id, n, \"rank\" from (select *, row_number() over (partition by item_id order by n desc, other_id) as \"rank\" from co) where \"rank\" <= 5")
def a2_j2_w4_similar_items(spark, sf):
    return C.similar_items(T.ratings(spark, sf, by_user=True)).select("item_id", "other_id", "n", long("rank"))


@query("ratings", f"with {NB} select user_id, other_id, sim, k as \"rank\" from nb")
def j3_a5_w7_neighbours(spark, sf):
    return C.neighbours(T.ratings(spark, sf, by_user=True)).select("user_id", "other_id", "sim", long("rank"))


@query("ratings", f"""with {NB}, c as (select nb.user_id, r.item_id, cast(sum(cast(round(sim * 1e9) as bigint) * cast(rating * 2 as bigint)) as bigint) / 2e9 score, count(*) n_neighbours from nb join ratings r on nb.other_id = r.user_id group by all)
 select user_id, item_id, score, n_neighbours from (select *, row_number() over (partition by user_id order by score desc, item_id) k from c anti join ratings using (user_id, item_id)) where k <= 20""")
def c5_j4_a6_user_similarity(spark, sf):
    return C.from_similar_users(T.ratings(spark, sf, by_user=True), best=20)


@query("ratings", "select item_id, count(*) n, sum(rating) total, avg(rating) mean, row_number() over (order by count(*) desc, item_id) as \"rank\" from ratings group by 1")
def a14_w24_popularity(spark, sf):
    p = T.ratings(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"), F.avg("rating").alias("mean"))
    return R.placed(p, F.desc("n"), F.asc("item_id")).withColumn("rank", F.col("rank").cast("long"))


@query("ratings movies", """with h as (select distinct user_id, genre from ratings join (select item_id, unnest(genres) genre from movies) g using (item_id) where rating >= 3.5)
 select user_id, count(*) genres, min(genre) first_genre from h group by 1""")
def j1_genres_of_history(spark, sf):
    g = T.movies(spark, sf).select("item_id", F.explode("genres").alias("genre"))
    h = T.ratings(spark, sf).filter("rating >= 3.5").join(g, "item_id").select("user_id", "genre").distinct()
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("genres"), F.min("genre").alias("first_genre"))


HIST = """top100 as (select item_id from (select item_id, avg(rating) a from ratings group by 1) order by a desc, item_id limit 100), latest100 as (select item_id from movies order by year desc, item_id limit 100),
 gr as (select genre, g.item_id, row_number() over (partition by genre order by coalesce(a, 0.0) desc, g.item_id) k from (select distinct item_id, unnest(genres) genre from movies) g left join (select item_id, avg(rating) a from ratings group by 1) using (item_id)),
 ug as (select distinct user_id, genre from ratings join (select item_id, unnest(genres) genre from movies) using (item_id) where rating >= 4.5),
 cand as (select user_id, item_id from ug join gr using (genre) where k <= 10 union select user_id, item_id from (select distinct user_id from ratings), top100 union select user_id, item_id from (select distinct user_id from ratings), latest100)"""


@query("ratings movies", f"with {HIST} select user_id, item_id, 0.5::double score from cand anti join ratings using (user_id, item_id)")
def c2_u3_u5_u8_genre_history(spark, sf):
    """Best items of each liked genre, the top and the latest 100 lists, without what was rated. The two lists are 100 rows by
    definition and go to every user."""
    r, m = T.ratings(spark, sf), T.movies(spark, sf)
    r = written(r, "ratings")
    avg = r.groupBy("item_id").agg(F.avg("rating").alias("a"))
    g = m.select("item_id", F.explode("genres").alias("genre")).distinct()
    best = R.top_k(g.join(avg, "item_id", "left").withColumn("a", F.coalesce("a", F.lit(0.0))), ["genre"], 10, F.desc("a"), F.asc("item_id")).select("genre", "item_id")
    top = avg.orderBy(F.desc("a"), "item_id").limit(100).select("item_id")
    lists = top.union(m.orderBy(F.desc("year"), "item_id").limit(100).select("item_id")).distinct().agg(F.collect_list("item_id").alias("items"))  # 200 items
    u = C.genre_histories(r, m, best, F.col("rating") >= 4.5).join(F.broadcast(lists))  # one row
    return u.select("user_id", F.explode(F.array_except(F.array_union("own", "items"), "seen")).alias("item_id"), F.lit(0.5).alias("score"))


TREND = f"""hi as (select max(ts_ms) hi from ev), win as (select w, weight, movie_id, sum({WEIGHT}) s from ev, hi, (values ('last_hour', 1.0::double, 3600000), ('last_day', 0.6::double, 86400000), ('last_month', 0.4::double, 2592000000)) t(w, weight, span)
 where movie_id > 0 and ts_ms > hi - span group by all), rk as (select *, row_number() over (partition by w order by s desc, movie_id) k from win where s > 0)"""


def _windows(spark, sf, spans):
    e = T.events(spark, sf).filter("movie_id > 0")
    e = e.join(F.broadcast(e.agg(F.max("ts_ms").alias("hi"))))  # one row
    named = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(x)).alias("weight"), F.lit(int(s)).alias("span")) for w, x, s in spans]))
    c = e.select("*", named.alias("t")).filter(F.col("ts_ms") > F.col("hi") - F.col("t.span")).groupBy("t.w", "t.weight", "movie_id").agg(F.sum(E.engagement_weight()).alias("s")).filter("s > 0")
    return R.placed(c, F.desc("s"), F.asc("movie_id"), by=("w",))


SPANS = [("last_hour", 1.0, 3_600_000), ("last_day", 0.6, 86_400_000), ("last_month", 0.4, 2_592_000_000)]


@query("ev", f"with {TREND} select movie_id, round(sum(weight / k), 9) score from rk group by 1")
def c4_a7_w8_trending(spark, sf):
    return C.rank_decay(_windows(spark, sf, SPANS), F.col("weight"), ["movie_id"]).withColumn("score", F.round("score", 9))


@query("ev", f"""with {TREND.replace("('last_hour', 1.0::double, 3600000), ('last_day', 0.6::double, 86400000), ('last_month', 0.4::double, 2592000000)", "('last_day', 0.7::double, 86400000), ('last_month', 0.5::double, 2592000000), ('popularity', 0.4::double, 10000000000000)")}
 select movie_id, round(sum(weight / k), 9) score from rk group by 1""")
def c7_cold_start(spark, sf):
    spans = [("last_day", 0.7, 86_400_000), ("last_month", 0.5, 2_592_000_000), ("popularity", 0.4, 10**13)]
    return C.rank_decay(_windows(spark, sf, spans), F.col("weight"), ["movie_id"]).withColumn("score", F.round("score", 9))


@query("ev", f"with {POP} select item_id, n, 1.0::double / r score from pop")
def c3_popularity(spark, sf):
    p = T.events(spark, sf).filter("movie_id > 0").groupBy(F.col("movie_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    return R.placed(p, F.desc("n"), F.asc("item_id")).select("item_id", "n", (1.0 / F.col("rank")).alias("score"))


RECENT = """rec as (select user_id, item_id, row_number() over (partition by user_id order by ts, item_id) - 1 i from (select *, row_number() over (partition by user_id order by ts desc, item_id desc) k from ratings) where k <= 3)"""


@query("ratings", f"""with {CO}, {RECENT}, sm as (select item_id, other_id, k from (select *, row_number() over (partition by item_id order by n desc, other_id) k from co) where k <= 12),
 b as (select user_id, other_id item_id, cast(sum(30 + 8 * i - (k - 1)) as bigint) boost from rec join sm using (item_id) group by all)
 select user_id, b.item_id, boost, 1.0::double / row_number() over (partition by user_id order by boost desc, b.item_id) score from b anti join rec using (user_id, item_id)""")
def c6_w9_recent_history(spark, sf):
    """The last three items of a user and the twelve most co-rated ones of each; lists meet by item and by user, and become rows where a user's are."""
    own = C.newest_items(T.ratings(spark, sf, by_user=True), last=3)
    near = in_order(C.similar_of(own, 12), 12).select(F.col("row").alias("item_id"), F.col("best.id").alias("near"))
    rec = own.select("user_id", F.array_compact("last").alias("mine"), (F.size("last") - 1).alias("newest"), F.posexplode("last").alias("pos", "item_id"))
    b = rec.select("user_id", "mine", "item_id", (F.col("newest") - F.col("pos")).cast("long").alias("i")).join(near, "item_id").select("user_id", "mine", "i", "near").repartition("user_id")
    b = b.select("user_id", "mine", "i", F.posexplode("near").alias("k", "item_id")).filter(F.col("user_id").isNull() | ~F.array_contains("mine", F.col("item_id")))
    b = b.groupBy("user_id", "item_id").agg(F.sum(30 + 8 * F.col("i") - F.col("k")).alias("boost"))
    return R.ranked(b, ["user_id"], F.desc("boost"), F.asc("item_id")).select("user_id", "item_id", "boost", (1.0 / F.col("rank")).alias("score"))


CAND = """cand as (select user_id request_id, item_id, rating / 5.0 score, 'embedding' channel from ratings where item_id % 2 = 0 union all
 select user_id, item_id, rating / 6.0, 'trending' from ratings where item_id % 3 = 0 union all select user_id, item_id, rating / 7.0, 'popularity' from ratings)"""


def _candidates(spark, sf):
    r = T.ratings(spark, sf).withColumnRenamed("user_id", "request_id")
    part = lambda d, name: F.struct((F.col("rating") / d).alias("score"), F.lit(name).alias("channel"))
    given = F.array(F.when(F.expr("item_id % 2 = 0"), part(5.0, "embedding")), F.when(F.expr("item_id % 3 = 0"), part(6.0, "trending")), part(7.0, "popularity"))
    return r.select("request_id", "item_id", F.explode(F.array_compact(given)).alias("x")).select("request_id", "item_id", "x.*")


@query("ratings", f"with {CAND} select request_id, item_id, max(score) score, arg_min(channel, (-score, channel)) channel from cand group by all")
def u1_u4_merged_max(spark, sf):
    return C.merged_max(_candidates(spark, sf), ["request_id", "item_id"])


def _slot(channel: str, before: str, n: int) -> str:
    less = f"and (request_id, item_id) not in (select (request_id, item_id) from {before})" if before else ""
    return f"(select request_id, item_id, score from (select *, row_number() over (partition by request_id order by score desc, cast(item_id as varchar)) k from cand where channel = '{channel}' {less}) where k <= {n})"


@query("ratings", f"""with {CAND}, s1 as {_slot('embedding', '', 9)}, s2 as (select * from s1 union all select * from {_slot('trending', 's1', 3)}), s3 as (select * from s2 union all select * from {_slot('popularity', 's2', 8)}),
 rest as (select request_id, item_id, score, row_number() over (partition by request_id order by score desc, cast(item_id as varchar)) k from (select request_id, item_id, max(score) score from cand group by all) c
 where (request_id, item_id) not in (select (request_id, item_id) from s3)), hv as (select request_id, count(*) have from s3 group by 1),
 al as (select request_id, item_id, score from s3 union all select rest.request_id, item_id, score from rest left join hv using (request_id) where k <= 20 - coalesce(have, 0))
 select request_id, item_id, score, "rank" from (select *, row_number() over (partition by request_id order by score desc, cast(item_id as varchar)) as "rank" from al) where "rank" <= 20""")
def u2_c8_w2_w3_quota_merge(spark, sf):
    slots = C.quota_slots([("embedding", 0.45), ("trending", 0.15)], "popularity", 20)
    return C.quota_merge(_candidates(spark, sf), slots, 20).select("request_id", "item_id", "score", long("rank"))


@query("ratings", "select c_custkey user_id, n is null as \"cold\", coalesce(n, 0) n from customer left join (select user_id, count(*) n from ratings group by 1) on c_custkey = user_id")
def c9_cold_users(spark, sf):
    n = T.ratings(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(n, "user_id", "left")
    return u.select("user_id", F.col("n").isNull().alias("cold"), F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = "q as (select id query_id, vec qv from vectors where id % 50 = 0)"


def _queries(v):
    """The stated query set: every row whose id is divisible by 50, against all rows."""
    return v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")


@query("vectors", f"""with {QUERIES} select query_id, id, score, "rank" from (select *, row_number() over (partition by query_id order by score desc, id) as "rank" from (
 select query_id, id, round(list_inner_product(qv, vec), 6) score from q, vectors where id <> query_id)) where "rank" <= 10""")
def v1_v2_j14_exact_top_k(spark, sf):
    v = T.vectors(spark, sf)
    return V.exact_top_k(v, _queries(v), 10).select("query_id", "id", "score", long("rank"))


#: Postings of the query's index, small since the given vectors have no clusters, and clusters probed.
FINE, PROBED = 24, 128


@query()
def v3_v4_lsh_top_k(spark, sf):
    v = T.vectors(spark, sf)
    return V.lsh_top_k(v, _queries(v), 64, 10).select("query_id", "id", "score", long("rank"))


@query()
def v5_v7_clustered_top_k(spark, sf):
    v = T.vectors(spark, sf)
    return I.search(I.build(v, FINE), _queries(v), 10, PROBED).select("query_id", "id", "score", long("rank"))


@query("vectors", """with c as (select label, list(vec order by id)[1:3] qs from vectors group by 1)
 select id, v.label, round(list_inner_product(vec, qs[1]) , 6) first_dot, round(greatest(list_inner_product(vec, qs[1]), list_inner_product(vec, qs[2]), list_inner_product(vec, qs[3])), 6) max_sim from vectors v join c on v.label = c.label""")
def v8_v9_v10_max_sim(spark, sf):
    """Each vector against the bag of its label's first three vectors."""
    v = T.vectors(spark, sf)
    bag = R.top_k(v, ["label"], 3, F.asc("id")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("s")).select("label", F.transform("s", lambda x: x["vec"]).alias("bag"))
    b = v.join(bag, "label").withColumn("own", F.array("vec"))
    return b.select("id", "label", F.round(S.dot(F.col("vec"), F.col("bag")[0]), 6).alias("first_dot"), F.round(V.max_sim("own", "bag"), 6).alias("max_sim"))


@query("ratings vectors", """with w as (select user_id, unnest(generate_series(0, 63)) d, unnest(vec) x, case when rating >= 4 then 2.0::double else 1.0::double end w from ratings join vectors on item_id = id)
 select user_id, d, round(sum(x * w) / sum(w), 6) x from w group by all""")
def v14_user_vectors(spark, sf):
    v = T.vectors(spark, sf)
    r = T.ratings(spark, sf).join(v, F.col("item_id") == F.col("id")).select("user_id", F.when(F.col("rating") >= 4, 2.0).otherwise(1.0).alias("w"), "vec")
    return V.weighted_means(r, v, "user_id").select("user_id", "d", F.round("x", 6).alias("x"))


@query("vectors", """with c as (select label, d, avg(x) m from (select label, unnest(generate_series(1, 64)) d, unnest(vec) x from vectors) group by all), l as (select label, list(m order by d) cv from c group by 1)
 select id, v.label, round(list_inner_product(vec, cv) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(cv, cv))), 6) relevance from vectors v join l on v.label = l.label""")
def v13_x9_cosine(spark, sf):
    v = T.vectors(spark, sf)
    c = v.select("label", F.posexplode("vec").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    c = c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("s")).select("label", F.transform("s", lambda x: x["m"]).alias("cv"))
    cos = S.dot(F.col("vec"), F.col("cv")) / (F.sqrt(S.dot(F.col("vec"), F.col("vec"))) * F.sqrt(S.dot(F.col("cv"), F.col("cv"))))
    return v.join(c, "label").select("id", "label", F.round(cos, 6).alias("relevance"))


ARMS = """st as (select movie_id item_id, count(*) impressions, count(*) filter (event_type = 'click') clicks from ev where movie_id > 0 group by 1),
 tot as (select sum(impressions) total, max(impressions) top from st),
 arm as (select item_id, impressions, clicks, total, impressions / top::double rel, clicks / impressions::double con, ln(1 + impressions) / ln(1 + top) pop, item_id % 7 = 0 cold from st, tot)"""


def _arms(spark, sf):
    e = T.events(spark, sf).filter("movie_id > 0")
    st = e.groupBy(F.col("movie_id").alias("item_id")).agg(F.count(F.lit(1)).alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    st = st.join(F.broadcast(st.agg(F.sum("impressions").alias("total"), F.max("impressions").alias("top"))))  # one row
    return st.select("item_id", "impressions", "clicks", "total", (F.col("impressions") / F.col("top").cast("double")).alias("rel"), (F.col("clicks") / F.col("impressions")).alias("con"),
                     (F.log1p("impressions") / F.log1p("top")).alias("pop"), (F.col("item_id") % 7 == 0).alias("cold"))


SIG = lambda x: f"(1.0 / (1.0 + exp(-({x}))))"
BASE = "(-1.15 + 1.20 * rel + 0.85 * con + 0.65 * pop + 0.55 * ((clicks + 1.0) / (impressions + 4.0)) + 0.20 * (1.0 / (impressions + 1.0)))"
OUT = f"""greatest(0, least(1, 0.30 * {SIG(BASE + ' - 0.05 + 0.20 * rel')} + 0.22 * {SIG(BASE + ' - 0.15 + 0.15 * con')} + 0.18 * {SIG(BASE + ' + 0.35 * (clicks / impressions::double)')} + 0.22 * {SIG(BASE + ' + 0.10 + 0.25 * con')}
 + 0.08 * {SIG(BASE + ' - 0.70 + 0.20 * (1.0 / (impressions + 1.0))')} - 0.35 * {SIG('-' + BASE + ' - 0.40 + 0.25 * greatest(0, 0.08 - (clicks + 1.0) / (impressions + 4.0))')}))"""
PRIOR = "(case when cold then 5.4::double else 2.0::double end)"
POST = f"((1.0 + rel * {PRIOR} + clicks) / (1.0 + rel * {PRIOR} + clicks + 1.0 + (1.0 - rel) * {PRIOR} + greatest(impressions - clicks, 0)))"
BONUS = f"least((case when cold then 1.35::double else 1.0::double end) * 0.75 * sqrt(ln(total + 2.0) / (2.0 * (impressions + {PRIOR} + 1.0))), 0.25)"


def _scored(spark, sf):
    a = _arms(spark, sf)
    c = F.col
    a = a.withColumn("outcome", S.weighted_outcome(c("rel"), c("con"), c("pop"), c("clicks"), c("impressions"))).withColumn("posterior", S.posterior_mean(c("rel"), c("clicks"), c("impressions"), c("cold")))
    a = a.withColumn("bonus", S.ucb_bonus(c("impressions"), c("total"), c("cold")))
    return a.withColumn("prediction", S.prediction(c("posterior") + c("bonus"), c("outcome"), c("con"), c("bonus"))).withColumn("reward", S.estimated_reward(c("posterior"), c("outcome")))


SCORED = f"""{ARMS}, sc as (select *, {OUT}::double outcome, {POST}::double posterior, {BONUS}::double bonus from arm),
 sd as (select *, greatest(0, least(1, 0.55 * (posterior + bonus) + 0.25 * outcome + 0.05 * con + bonus))::double prediction, greatest(0, least(1, 0.65 * posterior + 0.35 * outcome))::double reward from sc)"""


@query("ev", f"with {SCORED} select item_id, round(outcome, 6) outcome, round(posterior, 6) posterior, round(bonus, 6) bonus, round(prediction, 6) prediction, round(reward, 6) reward from sd")
def x6_x7_x10_x11_x15_x16_scores(spark, sf):
    return _scored(spark, sf).select("item_id", *[F.round(c, 6).alias(c) for c in ("outcome", "posterior", "bonus", "prediction", "reward")])


@query("ev", f"with {ARMS} select item_id, round(greatest(0, least(1, 0.6 * rel + 0.25 * con + 0.15 * pop)), 6) blend, round(1.0 / (impressions + 1), 9) novelty, round((clicks + 0.0) / (impressions + 1), 9) ctr from arm")
def x8_x20_x21_blend(spark, sf):
    a = _arms(spark, sf)
    return a.select("item_id", F.round(S.offline_blend(F.col("rel"), F.col("con"), F.col("pop")), 6).alias("blend"), F.round(1.0 / (F.col("impressions") + 1), 9).alias("novelty"), F.round(F.col("clicks") / (F.col("impressions") + 1), 9).alias("ctr"))


@query("ev", f"""with {SCORED}, dv as (select item_id, item_id % 6 grp, round(prediction, 6) pre, row_number() over (partition by item_id % 6 order by round(prediction, 6) desc, item_id) - 1 place from sd)
 select item_id, grp, place, round(pre * ((1.0 - 0.55) * pow(0.72, place) + 0.55), 9) final_score from dv""")
def w12_diversity(spark, sf):
    s = _scored(spark, sf).select("item_id", (F.col("item_id") % 6).alias("grp"), F.round("prediction", 6).alias("pre"))
    return R.diversified(s, [], "grp", "pre", "item_id").select("item_id", "grp", F.col("place").cast("long").alias("place"), F.round("final_score", 9).alias("final_score"))


@query("ev", f"""with {SCORED}, t as (select item_id % 5 slate, item_id, round(prediction, 6) p, round(reward, 6) r from sd), k as (select *, row_number() over (partition by slate order by p desc, item_id) kp, row_number() over (partition by slate order by r desc, item_id) kr from t)
 select slate, round(greatest(0, sum(case when kr <= 10 then r else 0 end) - sum(case when kp <= 10 then r else 0 end)), 6) regret from k group by 1""")
def a33_w10_regret(spark, sf):
    t = _scored(spark, sf).select((F.col("item_id") % 5).alias("slate"), "item_id", F.round("prediction", 6).alias("p"), F.round("reward", 6).alias("r"))
    best = R.top_k(t, ["slate"], 10, F.desc("r"), F.asc("item_id")).groupBy("slate").agg(F.sum("r").alias("best"))
    own = R.top_k(t, ["slate"], 10, F.desc("p"), F.asc("item_id")).groupBy("slate").agg(F.sum("r").alias("own"))
    return best.join(own, "slate").select("slate", F.round(F.greatest(F.lit(0.0), F.col("best") - F.col("own")), 6).alias("regret"))


@query("ev", f"""with {SCORED}, t as (select item_id % 5 slate, item_id, round(prediction, 6) p, round(reward, 6) r from sd), k as (select *, row_number() over (partition by slate order by p desc, item_id) i from t)
 select x.slate, round(avg(case when x.r > y.r then 1.0::double when x.r = y.r then 0.5::double else 0.0::double end), 9) concordance from k x join k y on x.slate = y.slate and x.i < y.i where x.i <= 10 and y.i <= 10 group by 1""")
def a32_z8_concordance(spark, sf):
    t = _scored(spark, sf).select((F.col("item_id") % 5).alias("slate"), "item_id", F.round("prediction", 6).alias("p"), F.round("reward", 6).alias("r"))
    k = R.top_k(t, ["slate"], 10, F.desc("p"), F.asc("item_id")).select("slate", F.col("rank").alias("i"), "r")
    pairs = k.join(k.select("slate", F.col("i").alias("j"), F.col("r").alias("s")), "slate").filter("i < j")
    return pairs.groupBy("slate").agg(F.round(F.avg(F.when(F.col("r") > F.col("s"), 1.0).when(F.col("r") == F.col("s"), 0.5).otherwise(0.0)), 9).alias("concordance"))


@query("ev", f"""with {SCORED}, t as (select item_id, round(0.4 * posterior + 0.3 * reward + 0.1 * bonus + 0.05 * ln(1 + impressions), 6) raw, round(prediction, 6) fin from sd), m as (select min(raw) lo, max(raw) hi from t)
 select item_id, round(0.9 * fin + 0.1 * (raw - lo) / (hi - lo), 6) adjusted from t, m""")
def w13_p4_policy_rerank(spark, sf):
    raw = 0.4 * F.col("posterior") + 0.3 * F.col("reward") + 0.1 * F.col("bonus") + 0.05 * F.log1p("impressions")
    t = _scored(spark, sf).select("item_id", F.round(raw, 6).alias("raw"), F.round("prediction", 6).alias("fin"))
    t = t.join(F.broadcast(t.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))))  # one row
    return t.select("item_id", F.round(0.9 * F.col("fin") + 0.1 * (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("adjusted"))
