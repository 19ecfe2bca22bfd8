"""Queries: the serving chain around the channels - embedding recall, cascades, two-tier rank, pools, hydration, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.functions import scores as S
from cinderloom.operators import folds
from cinderloom.operators import ranking as R
from cinderloom.operators import recall as C
from cinderloom.operators import vectors as V
from cinderloom.operators.lineage import written
from cinderloom.plans.catalog_and_events import HISTORY, HOUR, LABEL, WEIGHT
from cinderloom.plans.learning_and_operations import e2_e6_a15_w23_policy_evaluation
from cinderloom.plans.recall_and_rank import CAND, CO, _candidates, long
from cinderloom.plans.registry import SQL, query
from cinderloom.sources import tables as T

DAY = 86_400_000


def _text(rows: Column, field: str) -> Column:
    """A field of sorted structs as one text."""
    return F.array_join(F.transform(rows, lambda x: x[field].cast("string")), ",")


def _listed(df: DataFrame, by: str, order: list[Column], k: int, value: str, name: str) -> DataFrame:
    """(by, name): the first k values of each key in order, as one text; k rows a key are gathered at most."""
    top = R.top_k(df, [by], k, *order)
    return top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", value))).alias("s")).select(by, _text(F.col("s"), value).alias(name))


AVG = "av as (select item_id, avg(rating) a from ratings group by 1)"


@query("ratings vectors", """with w as (select user_id, unnest(generate_series(1, 64)) d, unnest(vec) x, case when rating >= 4 then 2.0::double else 1.0::double end w from ratings join vectors on item_id = id where user_id % 50 = 0),
 uv as (select user_id, list(x order by d) uv from (select user_id, d, sum(x * w) / sum(w) x from w group by all) group by 1),
 s as (select user_id, id item_id, round(list_inner_product(uv, vec), 6) sim from uv, vectors where (user_id, id) not in (select (user_id, item_id) from ratings))
 select user_id, item_id, sim, 1.0::double / k score from (select *, row_number() over (partition by user_id order by sim desc, item_id) k from s) where k <= 10""")
def c1_v12_embedding_recall(spark, sf):
    """Items nearest to a user's vector, without what the user rated; a user without a vector gets none. The stated queries are users whose id is divisible by 50."""
    v, r = T.vectors(spark, sf), T.ratings(spark, sf).filter("user_id % 50 = 0")
    w = r.join(v, F.col("item_id") == F.col("id")).select("user_id", F.when(F.col("rating") >= 4, 2.0).otherwise(1.0).alias("w"), F.posexplode("vec").alias("d", "x"))
    u = w.groupBy("user_id", "d").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("s"))
    seen = r.groupBy("user_id").agg(F.collect_set("item_id").alias("seen"))
    q = u.join(seen, "user_id").select((-F.col("user_id")).alias("query_id"), F.transform("s", lambda x: x["x"]).alias("vec"), "seen")  # below zero: no user is an item
    return V.exact_top_k(v, q, 10, skip="seen").select((-F.col("query_id")).alias("user_id"), F.col("id").alias("item_id"), F.col("score").alias("sim"), (1.0 / F.col("rank")).alias("score"))


@query("ratings movies vectors", f"""with {CO}, {AVG}, sm as (select item_id seed, other_id cand, 0 stage, 0 pos, k from (select *, row_number() over (partition by item_id order by n desc, other_id) k from co) where k <= 5),
 sd as (select item_id seed, genres from movies join vectors on item_id = id),
 ge as (select genre, g.item_id, row_number() over (partition by genre order by coalesce(a, 0.0) desc, g.item_id) k from (select distinct item_id, unnest(genres) genre from movies) g left join av using (item_id)),
 gn as (select seed, ge.item_id cand, 1 stage, pos, k from (select seed, unnest(genres) genre, generate_subscripts(genres, 1) pos from sd) join ge using (genre) where k <= 50),
 tp as (select item_id, row_number() over (order by a desc, item_id) k from av qualify k <= 50),
 al as (select * from sm where seed in (select seed from sd) union all select * from gn union all select seed, item_id, 2, 0, k from sd, tp),
 fo as (select seed, cand, min((stage, pos, k)) o from al where seed <> cand group by seed, cand), fs as (select seed, cand, row_number() over (partition by seed order by o, cand) p from fo),
 sc as (select seed, cand, round(list_inner_product(x.vec, y.vec), 6) score from fs join vectors x on seed = x.id join vectors y on cand = y.id where p <= 50)
 select seed, cand item_id, score, "rank" from (select *, row_number() over (partition by seed order by score desc, cand) as "rank" from sc) where "rank" <= 10""")
def u6_v11_similar_items(spark, sf):
    """Candidates of every item with a vector: co-rated ones, then its genres' best in order of its genres, then the top rated, the first 50 seen; ranked by inner product."""
    r, m, v = T.ratings(spark, sf), T.movies(spark, sf), T.vectors(spark, sf)
    seeds = m.join(v, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("seed"), "genres")
    avg = r.groupBy("item_id").agg(F.avg("rating").alias("a"))
    near = C.similar_items(r, 5, of=seeds.select(F.col("seed").alias("item_id"))).select(F.col("item_id").alias("seed"), F.col("other_id").alias("cand"), F.lit(0).alias("stage"), F.lit(0).alias("pos"), F.col("rank").alias("k"))
    g = m.select("item_id", F.explode("genres").alias("genre")).distinct().join(avg, "item_id", "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    best = R.top_k(g, ["genre"], 50, F.desc("a"), F.asc("item_id")).select("genre", F.col("item_id").alias("cand"), F.col("rank").alias("k"))
    alike = seeds.select("seed", F.posexplode("genres").alias("pos", "genre")).join(best, "genre").select("seed", "cand", F.lit(1).alias("stage"), "pos", "k")
    first = avg.orderBy(F.desc("a"), "item_id").limit(50).select(F.struct((-F.col("a")).alias("o"), "item_id").alias("x")).agg(F.sort_array(F.collect_list("x")).alias("top"))
    top = seeds.select("seed").join(F.broadcast(first)).select("seed", F.posexplode("top").alias("k", "x"))  # one row of 50 items
    top = top.select("seed", F.col("x.item_id").alias("cand"), F.lit(2).alias("stage"), F.lit(0).alias("pos"), "k")
    seen = near.unionByName(alike).unionByName(top).filter("seed <> cand").groupBy("seed", "cand").agg(F.min(F.struct("stage", "pos", "k")).alias("o"))
    kept = R.top_k(seen, ["seed"], 50, F.asc("o"), F.asc("cand")).select("seed", "cand")
    pairs = kept.join(v.select(F.col("id").alias("seed"), F.col("vec").alias("x")), "seed").join(v.select(F.col("id").alias("cand"), F.col("vec").alias("y")), "cand")
    s = pairs.select("seed", F.col("cand").alias("item_id"), F.round(S.dot(F.col("x"), F.col("y")), 6).alias("score"))
    return R.top_k(s, ["seed"], 10, F.desc("score"), F.asc("item_id")).select("seed", "item_id", "score", long("rank"))


@query("ratings vectors", f"""with {CAND}, m as (select request_id, item_id, max(score) score from cand group by all),
 t as (select request_id, item_id, case when id is null then 2 else 1 end tier, round(case when id is null then score else 1.0 / (1.0 + exp(-10 * vec[1])) end, 6) score from m left join vectors on item_id = id),
 o as (select *, row_number() over (partition by request_id, tier order by score desc, item_id) p from t)
 select request_id, item_id, tier, score, "rank" from (select *, row_number() over (partition by request_id order by tier, p) as "rank" from o where p <= 20) where "rank" <= 20""")
def w11_j8_two_tier(spark, sf):
    """Items the model knows by its score, all ahead of the others by their recall score."""
    known = T.vectors(spark, sf).select(F.col("id").alias("item_id"), (1.0 / (1.0 + F.exp(-10 * F.col("vec")[0]))).alias("model"))
    m = _candidates(spark, sf).groupBy("request_id", "item_id").agg(F.max("score").alias("recall")).join(known, "item_id", "left")
    t = m.select("request_id", "item_id", F.when(F.col("model").isNull(), 2).otherwise(1).alias("tier"), F.round(F.coalesce("model", "recall"), 6).alias("score"))
    return R.top_k(t, ["request_id"], 20, F.asc("tier"), F.desc("score"), F.asc("item_id")).select("request_id", "item_id", "tier", "score", long("rank"))


@query("ratings movies", f"""with {AVG}, ge as (select genre, g.item_id, row_number() over (partition by genre order by coalesce(a, 0.0) desc, g.item_id) k from (select distinct item_id, unnest(genres) genre from movies) g left join av using (item_id)),
 ug as (select distinct user_id, genre from ratings join (select item_id, unnest(genres) genre from movies) using (item_id)),
 gp as (select distinct user_id, item_id from ug join ge using (genre) where k <= 50 and (user_id, item_id) not in (select (user_id, item_id) from ratings)),
 ls as (select item_id from (select item_id from av order by a desc, item_id limit 100) union select item_id from (select item_id from movies order by year desc, item_id limit 100)),
 pool as (select user_id, item_id from gp union select user_id, item_id from (select distinct user_id from ratings), ls)
 select user_id, count(*) n, cast(sum(item_id) as bigint) total from pool join movies using (item_id) where year >= 1975 group by 1""")
def c12_fallback_pool(spark, sf):
    """Size and sum of ids of each user's pool: 50 unseen items of each genre met, the top and the latest 100, those available (of 1975 or later).

    The two lists are alike for all users, so they are counted once, and a user's own items only where no list has them.
    """
    r, m = written(T.ratings(spark, sf), "ratings"), T.movies(spark, sf)
    open_ = m.filter("year >= 1975").select("item_id")
    avg = r.groupBy("item_id").agg(F.avg("rating").alias("a"))
    g = m.select("item_id", F.explode("genres").alias("genre")).distinct()
    best = R.top_k(g.join(avg, "item_id", "left").withColumn("a", F.coalesce("a", F.lit(0.0))), ["genre"], 50, F.desc("a"), F.asc("item_id")).select("genre", "item_id")
    lists = avg.orderBy(F.desc("a"), "item_id").limit(100).select("item_id").union(m.orderBy(F.desc("year"), "item_id").limit(100).select("item_id")).distinct().join(open_, "item_id", "left_semi")
    every = lists.agg(F.collect_list("item_id").alias("items"), F.count(F.lit(1)).alias("ln"), F.coalesce(F.sum("item_id"), F.lit(0)).alias("lt"))
    u = C.genre_histories(r, m, best.join(open_, "item_id", "left_semi")).join(F.broadcast(every))  # one row
    u = u.withColumn("own", F.array_except(F.array_except("own", "items"), "seen"))
    return u.select("user_id", (F.size("own") + F.col("ln")).alias("n"), (F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x) + F.col("lt")).alias("total")).filter("n > 0")


RECENT3 = f"""rc as (select user_id, movie_id item_id from (select *, row_number() over (partition by user_id order by ts_ms desc, event_id desc) r from (
 select *, row_number() over (partition by user_id, movie_id order by ts_ms desc, event_id desc) k from ev where user_id > 0 and {HISTORY}) where k = 1) where r <= 3)"""
BIAS = f"""bi as (select movie_id item_id, list_reduce(list_prepend(0.0::double, list({LABEL} / 3.0::double order by ts_ms, event_id)), lambda b, t: greatest(-2.0::double, least(2.0::double, b + 0.08 * (t - 1.0 / (1.0 + exp(-b)) - 0.001 * b)))) bias
 from ev where movie_id > 0 group by 1)"""


@query("ratings ev", f"""with {CAND}, {RECENT3}, {BIAS}, m as (select request_id user_id, item_id, max(score) score from cand group by all),
 s as (select m.user_id, m.item_id, round(score + coalesce(bias, 0), 6) score from m left join bi on m.item_id = bi.item_id where (m.user_id, m.item_id) not in (select (user_id, item_id) from rc))
 select user_id, item_id, score, "rank" from (select *, row_number() over (partition by user_id order by score desc, item_id) as "rank" from s) where "rank" <= 10""")
def c13_online_rerank(spark, sf):
    """Candidates by their score and what was learnt of the item, without the user's last three."""
    e = T.events(spark, sf)
    m = _candidates(spark, sf).groupBy(F.col("request_id").alias("user_id"), "item_id").agg(F.max("score").alias("score"))
    recent = C.recent_items(e.filter(E.valid() & E.updates_history()).withColumnRenamed("movie_id", "item_id"), 3).select("user_id", "item_id")
    bias = folds.item_bias(e.filter("movie_id > 0"), E.training_label()).select(F.col("movie_id").alias("item_id"), "bias")
    s = m.join(recent, ["user_id", "item_id"], "left_anti").join(bias, "item_id", "left").withColumn("score", F.round(F.col("score") + F.coalesce("bias", F.lit(0.0)), 6))
    return R.top_k(s, ["user_id"], 10, F.desc("score"), F.asc("item_id")).select("user_id", "item_id", "score", long("rank"))


@query("ratings", """with rc as (select user_id, item_id from (select *, row_number() over (partition by user_id order by ts desc, item_id) k from ratings) where k <= 20)
 select user_id, item_id, rating, "rank" from (select *, row_number() over (partition by user_id order by rating desc, item_id) as "rank" from ratings where (user_id, item_id) not in (select (user_id, item_id) from rc)) where "rank" <= 10""")
def c14_model_recall(spark, sf):
    """The best of a user's items that are not among the 20 most recent."""
    r = T.ratings(spark, sf)
    recent = R.top_k(r, ["user_id"], 20, F.desc("ts"), F.asc("item_id")).select("user_id", "item_id")
    return R.top_k(r.join(recent, ["user_id", "item_id"], "left_anti"), ["user_id"], 10, F.desc("rating"), F.asc("item_id")).select("user_id", "item_id", "rating", long("rank"))


@query("ratings", """with p as (select item_id, count(*) n, avg(rating) / 5.0 content from ratings group by 1), t as (select max(n) top from p)
 select item_id, round(0.375 * (n / top::double) + 0.625 * content, 6) pre from p, t order by pre desc, item_id limit 100""")
def w14_content_pool(spark, sf):
    """The pool that ranking sees: five times 20 items by popularity and content, their weights 0.15 and 0.25 scaled to one."""
    p = T.ratings(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("rating") / 5.0).alias("content"))
    p = p.join(F.broadcast(p.agg(F.max("n").alias("top"))))  # one row
    pre = F.round(0.375 * (F.col("n") / F.col("top")) + 0.625 * F.col("content"), 6)
    return p.select("item_id", pre.alias("pre")).orderBy(F.desc("pre"), "item_id").limit(100)


@query("ratings movies", f"with {AVG} select item_id, year >= 2015 as new_release, round(coalesce(a, 0) / 5.0, 6) content from movies left join av using (item_id) order by new_release desc, content desc, item_id limit 50")
def w15_cold_start_probe(spark, sf):
    a = T.ratings(spark, sf).groupBy("item_id").agg(F.avg("rating").alias("a"))
    m = T.movies(spark, sf).join(a, "item_id", "left").select("item_id", (F.col("year") >= 2015).alias("new_release"), F.round(F.coalesce("a", F.lit(0.0)) / 5.0, 6).alias("content"))
    return m.orderBy(F.desc("new_release"), F.desc("content"), "item_id").limit(50)


@query("ratings", f"""with {CAND}, m as (select request_id, item_id, max(score) score from cand group by all), t as (select *, row_number() over (partition by request_id order by score desc, item_id) k from m),
 a as (select request_id, score s, item_id i from t where k = 5), p as (select t.*, row_number() over (partition by t.request_id order by score desc, item_id) j, count(*) over (partition by t.request_id) left_over from t join a on t.request_id = a.request_id where k <= 20 and (score < s or (score = s and item_id > i)))
 select request_id, string_agg(item_id, ',' order by j) items, max(left_over) > 6 has_more from p where j <= 6 group by 1""")
def w18_ranked_cursor(spark, sf):
    """The page of six behind the fifth of each ranked list of 20; a list out of order (score falling, then id rising) is an error."""
    m = _candidates(spark, sf).groupBy("request_id", "item_id").agg(F.max("score").alias("score"))
    top = R.top_k(m, ["request_id"], 20, F.desc("score"), F.asc("item_id"))
    lists = top.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "item_id"))).alias("l"))
    return R.cursor_page(lists.filter(F.size("l") >= 5).withColumn("anchor", F.col("l")[4]), "l", "anchor", 6).filter(F.size("page") > 0).select("request_id", _text(F.col("page"), "item_id").alias("items"), "has_more")


@query("ratings movies", """with g as (select user_id, genre, avg(rating) a from ratings join (select item_id, unnest(genres) genre from movies) using (item_id) group by all), v as (select user_id, upper(genre) nm, a - 2.5 s from g union all select user_id, ' ' || lower(genre) || ' ', a - 3.0 from g),
 n as (select user_id, lower(trim(nm)) nm, max(s) s from v where s > 0 and trim(nm) <> '' group by all) select user_id, string_agg(nm || ':' || cast(round(s * 1e6) as bigint), ',' order by s desc, nm) prefs from n group by 1""")
def f18_preferences(spark, sf):
    """Preferences under messy names: what is not finite or not above 0 goes, names are trimmed and lower-cased, the highest of a name stays."""
    g = T.ratings(spark, sf).join(T.movies(spark, sf).select("item_id", "genres"), "item_id").select("user_id", "rating", "genres").repartition("user_id")
    g = g.select("user_id", "rating", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.avg("rating").alias("a"))
    messy = F.array(F.struct(F.upper("genre").alias("name"), (F.col("a") - 2.5).alias("score")), F.struct(F.concat(F.lit(" "), F.lower("genre"), F.lit(" ")).alias("name"), (F.col("a") - 3.0).alias("score")))
    p = C.preferences(g.select("user_id", F.explode(messy).alias("x")).select("user_id", "x.*"), ["user_id"])
    s = p.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "name"))).alias("s"))
    return s.select("user_id", F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.lit(":"), F.round(-x["o"] * 1e6).cast("long").cast("string"))), ",").alias("prefs"))


@query("ev", f"""with s as (select ts_ms // {HOUR} * {HOUR} window_start, movie_id, cast(sum({WEIGHT}) as bigint) score from ev where movie_id > 0 and user_id > 0 group by all), t as (select *, row_number() over (partition by window_start order by score desc, movie_id) k from s where score > 0)
 select window_start, string_agg(movie_id || ':' || score, ',' order by k) trend from t where k <= 10 group by 1""")
def p3_trend_encoding(spark, sf):
    e = T.events(spark, sf).filter((F.col("movie_id") > 0) & E.valid()).withColumn("window_start", F.floor(F.col("ts_ms") / HOUR) * HOUR)
    s = e.groupBy("window_start", "movie_id").agg(F.sum(E.engagement_weight()).alias("score")).filter("score > 0").withColumn("pair", F.format_string("%d:%d", "movie_id", "score"))
    return _listed(s, "window_start", [F.desc("score"), F.asc("movie_id")], 10, "pair", "trend")


@query("ev", "with k as (select distinct 'user:' || user_id || ':segment' key from ev union select 'user:-1:segment'), f as (select 'user:' || c_custkey || ':segment' key, c_mktsegment \"value\" from customer) select key, \"value\" from k join f using (key)")
def s12_bulk_lookup(spark, sf):
    """Values of the keys asked for; a key that is not there is absent."""
    keys = T.events(spark, sf).select(F.format_string("user:%d:segment", "user_id").alias("key")).union(spark.createDataFrame([("user:-1:segment",)], "key string")).distinct()
    f = T.load(spark, sf, "customer").select(F.format_string("user:%d:segment", "c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return keys.join(f, "key")


@query("ev vectors", """select event_id, case when c_custkey is null then 'missing_user' when id is null then 'missing_item' else 'scored' end status,
 case when c_custkey is not null and id is not null then round(1.0 / (1.0 + exp(-c_acctbal / 10000 * vec[1] * 10)), 6) end score from ev left join customer on user_id = c_custkey left join vectors on movie_id = id""")
def j16_pair_scoring(spark, sf):
    """Explicit (user, item) instances; one whose user or item is not known says so and has no score."""
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("b"))
    i = T.vectors(spark, sf).select(F.col("id").alias("movie_id"), F.col("vec")[0].alias("x"))
    j = T.events(spark, sf).select("event_id", "user_id", "movie_id").join(u, "user_id", "left").join(i, "movie_id", "left")
    status = F.when(F.col("b").isNull(), "missing_user").when(F.col("x").isNull(), "missing_item").otherwise("scored")
    return j.select("event_id", status.alias("status"), F.when(status == "scored", F.round(1.0 / (1.0 + F.exp(-F.col("b") / 10000 * F.col("x") * 10)), 6)).alias("score"))


_UNIT = "(cast(('0x' || substr(md5({}), 1, 13)) as bigint) / 4503599627370496.0::double)"
_ST = "st as (select movie_id item_id, count(*) impressions, count(*) filter (event_type = 'click') clicks from ev where movie_id > 0 group by 1)"


def _unit(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def _arm_counts(spark, sf):
    e = T.events(spark, sf).filter("movie_id > 0")
    return e.groupBy(F.col("movie_id").alias("item_id")).agg(F.count(F.lit(1)).alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("ev", f"""with {_ST} select item_id, round(case when {_UNIT.format("'explore:' || item_id")} < 0.1 then {_UNIT.format("'score:' || item_id")} when clicks > 0 then least(1.0::double, clicks / impressions::double) else least(1.0::double, impressions / 100.0) end, 9) score from st""")
def x13_epsilon_greedy(spark, sf):
    """A tenth of the items explore with a random score; the others have their learnt value, or their prior where none is learnt."""
    a = _arm_counts(spark, sf)
    u, x = _unit(F.format_string("explore:%d", "item_id")), _unit(F.format_string("score:%d", "item_id"))
    learnt = F.when(F.col("clicks") > 0, S.clamp(F.col("clicks") / F.col("impressions"))).otherwise(S.clamp(F.col("impressions") / 100.0))
    return a.select("item_id", F.round(F.when(u < 0.1, x).otherwise(learnt), 9).alias("score"))


@query()
def x12_thompson(spark, sf):
    """A draw from each item's posterior, and how far from its mean it is (0.25 at most); the draw is the ranking score."""
    a = _arm_counts(spark, sf).withColumn("alpha", 1.0 + F.col("clicks")).withColumn("beta", 1.0 + F.col("impressions") - F.col("clicks"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    d = a.withColumn("sampled", folds.beta_draw(F.col("item_id"), F.col("alpha"), F.col("beta")))
    return d.select("item_id", "sampled", F.least(F.abs(F.col("sampled") - mean), F.lit(S.UCB_CAP)).alias("bonus"))


@query("ratings", """with x as (select user_id, string_agg(printf('%08X', strlen(cast(item_id as varchar))) || hex(cast(item_id as varchar)), '' order by cast(item_id as varchar)) parts, count(*) n from ratings where rating = 5 group by 1)
 select user_id, sha256(unhex('00000001' || printf('%08X', strlen(cast(user_id as varchar))) || hex(cast(user_id as varchar)) || printf('%08X', n) || parts)) fingerprint from x""")
def x26_query_fingerprints(spark, sf):
    """SHA-256 of version, user and excluded items in order of their bytes, each with its length before it."""
    part = lambda t: F.concat(F.lpad(F.hex(F.length(t)), 8, "0"), F.hex(t))
    x = T.ratings(spark, sf).filter("rating = 5").groupBy("user_id").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("s"))
    text = F.concat(F.lit("00000001"), part(F.col("user_id").cast("string")), F.lpad(F.hex(F.size("s").cast("long")), 8, "0"), F.array_join(F.transform("s", part), ""))
    return x.select("user_id", F.sha2(F.unhex(text), 256).alias("fingerprint"))


@query("", """select event_id, coalesce(json_extract_string(props, '$.k') = case when event_id % 3 = 0 then cast(event_id as varchar) else json_extract_string(props, '$.k') end, false) as "same" from events""")
def x30_semantic_equality(spark, sf):
    """Whether a re-sent event says the same: JSON objects are compared by content, whatever their spaces. Each third is sent with another value."""
    e = T.load(spark, sf, "events").select("event_id", "props")
    again = F.when(F.col("event_id") % 3 == 0, F.format_string('{ "k" : %d }', "event_id")).otherwise(F.regexp_replace("props", ":", " :  "))
    parsed = lambda c: F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    return e.select("event_id", F.coalesce(parsed(F.col("props")) == parsed(again), F.lit(False)).alias("same"))


@query("ev", f"""with s as (select *, ts_ms // {DAY} as day, row_number() over (partition by user_id, ts_ms // {DAY} order by ts_ms, event_id) p, count(*) over (partition by user_id, ts_ms // {DAY}) n from ev where user_id > 0)
 select event_id, cast(json_object('context', json_object('user', user_id, 'day', day), 'action', json_object('movie', movie_id, 'position', p), 'slate', n, 'propensity', printf('%.6f', 1.0 / n)) as varchar) body from s""")
def x31_replay_events(spark, sf):
    """Each served item as a replay event: nested context and action, and a propensity of one over its slate."""
    e = T.events(spark, sf).filter(E.valid()).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    s = R.ranked(e, ["user_id", "day"], F.asc("ts_ms"), F.asc("event_id"), name="p")
    n = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    body = F.struct(F.struct(F.col("user_id").alias("user"), "day").alias("context"), F.struct(F.col("movie_id").alias("movie"), F.col("p").alias("position")).alias("action"), F.col("n").alias("slate"), F.format_string("%.6f", 1.0 / F.col("n")).alias("propensity"))
    return s.join(n, ["user_id", "day"]).select("event_id", F.to_json(body).alias("body"))


@query("ratings movies", """with l as (select user_id, item_id, case when rating >= 4.5 then 1 when rating >= 3 then 2 else 3 end lv from ratings), f as (select user_id, min(lv) lv from l group by 1),
 g as (select user_id, lv, string_agg(genre, ',' order by genre) genres from (select distinct user_id, lv, lower(trim(unnest(genres))) genre from l join f using (user_id, lv) join movies using (item_id)) group by all),
 pop as (select string_agg(genre, ',' order by genre) genres from (select distinct lower(trim(unnest(genres))) genre from movies join (select item_id from ratings group by 1 order by count(*) desc, item_id limit 10) using (item_id)))
 select c_custkey user_id, coalesce(lv, 4) source, coalesce(g.genres, pop.genres) genres from customer left join g on c_custkey = user_id cross join pop""")
def x33_taste_profile(spark, sf):
    """Genres of the first of a user's histories that is not empty (loved, liked, rated), else of the ten most popular items."""
    r, m = written(T.ratings(spark, sf).select("user_id", "item_id", "rating"), "ratings"), T.movies(spark, sf)
    level = F.when(F.col("rating") >= 4.5, 1).when(F.col("rating") >= 3, 2).otherwise(3)
    names = m.select("item_id", F.explode("genres").alias("g")).select("item_id", F.lower(F.trim("g")).alias("genre"))
    text = F.array_join(F.sort_array(F.collect_set("genre")), ",")
    # Names of each level, and only the first level's are kept: a user's ratings come together once.
    genres = names.groupBy("item_id").agg(F.collect_set("genre").alias("genres"))
    of = r.join(genres, "item_id", "left").select("user_id", level.alias("level"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"))
    levels = [F.flatten(F.collect_set(F.when(F.col("level") == n, F.col("genres")))).alias(f"l{n}") for n in (1, 2, 3)]
    own = of.groupBy("user_id").agg(F.min("level").alias("level"), *levels)
    own = own.withColumn("g", F.array_sort(F.array_distinct(F.when(F.col("level") == 1, F.col("l1")).when(F.col("level") == 2, F.col("l2")).otherwise(F.col("l3")))))
    own = own.filter(F.size("g") > 0).select("user_id", "level", F.array_join("g", ",").alias("own"))
    popular = r.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(10)
    common = popular.join(names, "item_id").agg(text.alias("common"))
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(own, "user_id", "left").join(F.broadcast(common))  # one row
    return u.select("user_id", F.coalesce("level", F.lit(4)).alias("source"), F.coalesce("own", "common").alias("genres"))


@query("ev", """with lo as (select min(ts_ms) + 86400000 c from ev), p as (select user_id % 16 shard, ts_ms, event_id, row_number() over (partition by user_id % 16 order by ts_ms, event_id) k, count(*) over (partition by user_id % 16) n from ev, lo where ts_ms > c)
 select shard, event_id, k place, n > 10 has_more from p where k <= 10""")
def z11_shard_paging(spark, sf):
    """The ten records of each shard behind a cursor in time, and whether an eleventh is there; eleven rows a shard leave each task."""
    e = T.events(spark, sf)
    lo = e.agg((F.min("ts_ms") + DAY).alias("cursor"))
    after = e.join(F.broadcast(lo)).filter("ts_ms > cursor").withColumn("shard", F.pmod("user_id", F.lit(16)))  # one row
    seen = R.top_k(after, ["shard"], 11, F.asc("ts_ms"), F.asc("event_id"))
    more = seen.groupBy("shard").agg((F.count(F.lit(1)) > 10).alias("has_more"))
    return seen.filter("rank <= 10").join(more, "shard").select("shard", "event_id", F.col("rank").cast("long").alias("place"), "has_more")


NORMALS = [[float(x) for x in row] for row in V.planes(64, 3, 7).round(3)]
_ZERO_TABLES = " or ".join(f"floor(list_inner_product(vec, {n}::double[]) / 0.5) = 0" for n in NORMALS)


@query("vectors", f"select id, distance, row_number() over (order by distance, id) as \"rank\" from (select id, round(sqrt(list_inner_product(vec, vec)), 6) distance from vectors where {_ZERO_TABLES}) qualify \"rank\" <= 20")
def v17_euclidean_hashing(spark, sf):
    """The 20 nearest to the zero vector among those that share a bucket of width 0.5 with it in one of three tables."""
    return V.euclidean_near(T.vectors(spark, sf), [0.0] * 64, 20, NORMALS, 0.5).select("id", "distance", long("rank"))


@query("vectors", "select id, id % 3 = 0 and id % 7 <> 0 as \"applied\", case when id % 7 = 0 then 'skipped_width' when id % 3 = 0 then 'changed' else 'same' end status, round(vec[1] * case when id % 3 = 0 and id % 7 <> 0 then 2 else 1 end, 9) x0 from vectors")
def v19_embedding_refresh(spark, sf):
    """A new read against the last applied one: vectors of another width are skipped, those that changed are applied, the rest stays."""
    old = T.vectors(spark, sf).select("id", "vec")
    new = old.select("id", F.when(F.col("id") % 7 == 0, F.slice("vec", 1, 32)).when(F.col("id") % 3 == 0, F.transform("vec", lambda x: 2 * x)).otherwise(F.col("vec")).alias("new"))
    j = old.join(new, "id", "full")
    status = F.when(F.size("new") != 64, "skipped_width").when(F.col("new").eqNullSafe(F.col("vec")), "same").otherwise("changed")
    applied = status == "changed"
    return j.select("id", applied.alias("applied"), status.alias("status"), F.round(F.when(applied, F.col("new")[0]).otherwise(F.col("vec")[0]), 9).alias("x0"))


@query("", """with r as (select o_custkey u, l_partkey i, ceil(l_quantity / 5.0) / 2.0 x from lineitem join orders on l_orderkey = o_orderkey), p as (select u, i, count(*) n, bool_and(x between 0.5 and 5) fine from r group by all)
 select case when not fine then 'out_of_range' when n > 1 then 'duplicate_pair' else 'accepted' end reason, count(*) pairs, cast(sum(n) as bigint) "rows" from p group by 1""")
def e1_strict_load(spark, sf):
    """How many (user, item) pairs a strict load takes, and why it refuses the others."""
    o = T.load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    r = T.load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.ceil(F.col("l_quantity") / 5.0) / 2.0).alias("x")).join(o, "l_orderkey")
    p = r.groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x").between(0.5, 5)).alias("fine"))
    reason = F.when(~F.col("fine"), "out_of_range").when(F.col("n") > 1, "duplicate_pair").otherwise("accepted")
    return p.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("rows"))


_H = "md5('{}:' || user_id || ':' || item_id)"


@query("ratings", f"""with pop as (select item_id, row_number() over (order by count(*) desc, item_id) p from ratings group by 1), rn as (select user_id, count(*) rated from ratings group by 1),
 sl as (select user_id, least(rated, 10 - 5) rs, 10 - least(rated, 10 - 5) us from rn), a as (select user_id, item_id from (select r.*, row_number() over (partition by user_id order by {_H.format('rated')}, item_id) k from ratings r) join sl using (user_id) where k <= rs),
 un as (select user_id, us, pop.item_id, row_number() over (partition by user_id order by p) w from sl, pop where (user_id, pop.item_id) not in (select (user_id, item_id) from ratings)),
 b as (select user_id, item_id from (select *, row_number() over (partition by user_id order by {_H.format('unseen')}, item_id) k from un where w <= 2 * us) where k <= us),
 al as (select * from a union all select * from b) select user_id, string_agg(item_id, ',' order by {_H.format('pool')}, item_id) pool, count(*) n from al group by 1""")
def e2_candidate_pools(spark, sf):
    """Ten candidates a user: half of the rated, shuffled, the others from the most popular unseen, twice as many as are taken, shuffled.

    Unseen items are found by their places in the order of popularity that the user's own items leave free, so a user costs as much
    as their ratings and no pair of user and item is made to be thrown away.
    """
    r = written(T.ratings(spark, sf).select("user_id", "item_id"), "rated")
    h = lambda purpose, item=F.col("item_id"): F.md5(F.concat_ws(":", F.lit(purpose), F.col("user_id").cast("string"), item.cast("string")))
    pop = R.placed(r.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), F.asc("item_id"), name="place").select("item_id", "place")
    slots = r.join(pop, "item_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("rated"), F.sort_array(F.collect_list("place")).alias("taken"), F.collect_list("item_id").alias("items"))
    slots = slots.withColumn("rs", F.least("rated", F.lit(5))).withColumn("us", 10 - F.col("rs"))
    slots = slots.withColumn("a", F.slice(F.array_sort(F.transform("items", lambda x: F.struct(h("rated", x).alias("h"), x.alias("item_id")))), F.lit(1), F.col("rs").cast("int"))).drop("items")
    slots = written(slots.select("user_id", "us", "rated", "taken", F.transform("a", lambda x: x["item_id"]).alias("a")), "slots")
    a = slots.select("user_id", F.explode("a").alias("item_id"))
    free = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), 2 * F.col("us") + F.col("rated")), "taken"), F.lit(1), (2 * F.col("us")).cast("int"))
    b = slots.select("user_id", "us", F.explode(free).alias("place")).join(pop, "place")
    b = R.ranked(b, ["user_id"], h("unseen"), F.asc("item_id"), name="k").filter("k <= us").select("user_id", "item_id")
    s = a.union(b).withColumn("h", h("pool")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("h", "item_id"))).alias("s"))
    return s.select("user_id", _text(F.col("s"), "item_id").alias("pool"), F.size("s").cast("long").alias("n"))


@query("", "select c_custkey user_id, purpose, cast(('0x' || substr(md5('42:' || c_custkey || ':' || purpose), 1, 15)) as bigint) seed from customer, (select unnest(['pool', 'policy', 'bootstrap']) purpose)")
def e7_seeds(spark, sf):
    """A seed for each episode and purpose, from one base seed."""
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*map(F.lit, ("pool", "policy", "bootstrap")))).alias("purpose"))
    key = F.concat_ws(":", F.lit("42"), F.col("user_id").cast("string"), F.col("purpose"))
    return u.withColumn("seed", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))


_EVALUATION = SQL["e2_e6_a15_w23_policy_evaluation"]


@query("", f"""select printf('%s,%d,%.6f,%.6f,%.6f,%.6f,%.6f', policy, episodes, mean_return, mean_steps, se, low, high) line from ({_EVALUATION}) evaluation""")
def k6_evaluation_csv(spark, sf):
    """The evaluation table as lines of a CSV with six decimals."""
    e = e2_e6_a15_w23_policy_evaluation(spark, sf)
    return e.select(F.format_string("%s,%d,%.6f,%.6f,%.6f,%.6f,%.6f", "policy", "episodes", "mean_return", "mean_steps", "se", "low", "high").alias("line"))


def _slice(kind: str, k: int, name: str) -> str:
    return f"{name} as (select user_id, string_agg(movie_id, ',' order by k) {name}_ids from (select *, row_number() over (partition by user_id order by ts_ms desc, event_id desc) k from ev where event_type = '{kind}' and movie_id > 0) where k <= {k} group by 1)"


@query("ev", f"""with tm as (select user_id, string_agg(ts_ms, ',' order by k) times from (select *, row_number() over (partition by user_id order by ts_ms desc, event_id desc) k from ev) where k <= 20 group by 1), {_slice('view', 500, 'impressed')}, {_slice('click', 20, 'cached')}, {_slice('purchase', 200, 'served')}
 select c_custkey user_id, coalesce(times, '') request_times, coalesce(impressed_ids, '') impressed, coalesce(cached_ids, '') cached, cached_ids is not null has_cached, coalesce(served_ids, '') served from customer left join tm on c_custkey = tm.user_id
 left join impressed on c_custkey = impressed.user_id left join cached on c_custkey = cached.user_id left join served on c_custkey = served.user_id""")
def h3_h4_h5_h8_slices(spark, sf):
    """Request times, impressed, cached (with its flag) and served items of each user, the newest of each; a missing slice is empty."""
    e, newest = T.events(spark, sf), [F.desc("ts_ms"), F.desc("event_id")]
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(_listed(e, "user_id", newest, 20, "ts_ms", "request_times"), "user_id", "left")
    for kind, k, name in (("view", 500, "impressed"), ("click", 20, "cached"), ("purchase", 200, "served")):
        own = e.filter((F.col("event_type") == kind) & (F.col("movie_id") > 0))
        u = u.join(_listed(own, "user_id", newest, k, "movie_id", name), "user_id", "left")
    return u.select("user_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("request_times", "impressed", "cached", "served")], F.col("cached").isNotNull().alias("has_cached"))


@query("ratings movies ev", """with t as (select user_id, item_id, row_number() over (partition by user_id order by ts desc, item_id) k from ratings), g as (select user_id, string_agg(genre, ',' order by genre) genres from (select distinct user_id, lower(unnest(genres)) genre from t join movies using (item_id) where k <= 3) group by 1),
 c as (select user_id, movie_id item_id, row_number() over (partition by user_id order by ts_ms desc, event_id desc) k from ev where event_type in ('click', 'view') and movie_id > 0), al as (select user_id, item_id, 0 s, k from c where k <= 200 union all select user_id, item_id, 1, k from t where k <= 50),
 f as (select user_id, item_id, min((s, k)) o from al group by all), q as (select user_id, item_id, row_number() over (partition by user_id order by o) p from f), w as (select user_id, string_agg(item_id, ',' order by p) watched from q where p <= 50 group by 1)
 select c_custkey user_id, coalesce(genres, '') genres, coalesce(watched, '') watched from customer left join g on c_custkey = g.user_id left join w on c_custkey = w.user_id""")
def h9_h11_sequences(spark, sf):
    """Genres inferred from the last three items, and clicks and views (four times as many as are kept) ahead of the 50 last rated, each item once, 50 kept."""
    r, m, e = T.ratings(spark, sf), T.movies(spark, sf), T.events(spark, sf)
    last = R.top_k(r, ["user_id"], 50, F.desc("ts"), F.asc("item_id")).select("user_id", "item_id", F.col("rank").alias("k"))
    names = m.select("item_id", F.explode("genres").alias("g")).select("item_id", F.lower("g").alias("genre"))
    genres = last.filter("k <= 3").join(names, "item_id").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("genre")), ",").alias("genres"))
    clicks = R.top_k(e.filter(F.col("event_type").isin("click", "view") & (F.col("movie_id") > 0)), ["user_id"], 200, F.desc("ts_ms"), F.desc("event_id"))
    both = clicks.select("user_id", F.col("movie_id").alias("item_id"), F.lit(0).alias("s"), F.col("rank").alias("k")).unionByName(last.withColumn("s", F.lit(1)))
    once = both.groupBy("user_id", "item_id").agg(F.min(F.struct("s", "k")).alias("o"))
    watched = _listed(once, "user_id", [F.asc("o")], 50, "item_id", "watched")
    u = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(genres, "user_id", "left").join(watched, "user_id", "left")
    return u.select("user_id", F.coalesce("genres", F.lit("")).alias("genres"), F.coalesce("watched", F.lit("")).alias("watched"))
