"""Queries: serving counters, feedback, audits, sequence modes, and the file formats, over the logical tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.functions import scores as S
from cinderloom.operators import ranking as R
from cinderloom.operators import vectors as V
from cinderloom.operators.lineage import shared_dir, written
from cinderloom.plans.catalog_and_events import HISTORY, LABEL
from cinderloom.plans.recall_and_rank import SCORED, _scored
from cinderloom.plans.registry import query
from cinderloom.sources import files
from cinderloom.sources import tables as T

DAY = 86_400_000
PLACES, REPLAYED, MONTH_S = 3, 100, 2_592_000
#: Weights of the shadow policy over the nine packed features.
POLICY = [0.1, 0.4, 0.3, 0.2, 0.1, -0.05, 0.02, 0.05, 0.3]


def _first(df: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    return R.top_k(df, by, k, *order).drop("rank")


# Serving


@query("ev", f"""with {SCORED}, it as (select item_id, cast(round(reward * 1e6) as bigint) r, cast(round(prediction * 1e6) as bigint) p, round(1.0 / (impressions + 1), 9) nov, cold from sd),
 q as (select distinct user_id, ts_ms // {DAY} req, movie_id item_id from ev where user_id > 0 and movie_id > 0),
 k as (select user_id, req, it.*, row_number() over (partition by user_id, req order by p desc, it.item_id) served, row_number() over (partition by user_id, req order by r desc, it.item_id) ideal from q join it using (item_id)),
 g as (select user_id, req, count(*) filter (served <= {PLACES}) n, count(*) filter (served <= {PLACES} and item_id % 10 = 0) explored, count(*) filter (served <= {PLACES} and cold) colds, sum(case when served <= {PLACES} then r else 0 end) reward,
  greatest(0, sum(case when ideal <= {PLACES} then r else 0 end) - sum(case when served <= {PLACES} then r else 0 end)) regret, sum(case when served <= {PLACES} then cast(round(nov * 1e9) as bigint) else 0 end) novelty from k group by all)
 select case when user_id % 3 = 0 then 'bandit' when user_id % 3 = 1 then 'tabular' else 'blend' end "algorithm", count(*) requests, cast(sum(n) as bigint) recommendations_served, cast(sum(explored) as bigint) exploratory_impressions, cast(sum(colds) as bigint) cold_start_impressions,
  round(sum(reward) / 1e6, 6) estimated_reward_total, round(sum(regret) / 1e6, 6) pseudo_regret_total, round(sum(novelty) / 1e9, 9) novelty_total from g group by 1""")
def z13_serving_counters(spark, sf):
    """Seven totals of each algorithm over its requests, and what one request adds to them: its first three items by prediction, those that explore or start cold, their
    reward and novelty, and what the best three by reward would have given more. Sums are of whole millionths, so they have no order."""
    it = _scored(spark, sf).select("item_id", F.round(F.col("reward") * 1e6).cast("long").alias("r"), F.round(F.col("prediction") * 1e6).cast("long").alias("p"), F.round(F.round(1.0 / (F.col("impressions") + 1), 9) * 1e9).cast("long").alias("nov"), "cold")
    q = T.events(spark, sf).filter("user_id > 0 and movie_id > 0").select("user_id", F.floor(F.col("ts_ms") / DAY).alias("req"), F.col("movie_id").alias("item_id")).distinct().join(it, "item_id")
    of = ["user_id", "req"]
    served = _first(q, of, PLACES, F.desc("p"), F.asc("item_id")).groupBy(*of).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("item_id") % 10 == 0).alias("explored"), F.count_if("cold").alias("colds"), F.sum("r").alias("reward"), F.sum("nov").alias("novelty"))
    ideal = _first(q, of, PLACES, F.desc("r"), F.asc("item_id")).groupBy(*of).agg(F.sum("r").alias("best"))
    g = served.join(ideal, of).withColumn("regret", F.greatest(F.lit(0), F.col("best") - F.col("reward")))
    algorithm = F.when(F.col("user_id") % 3 == 0, "bandit").when(F.col("user_id") % 3 == 1, "tabular").otherwise("blend")
    total = lambda c: F.sum(c)
    return g.groupBy(algorithm.alias("algorithm")).agg(F.count(F.lit(1)).alias("requests"), total("n").alias("recommendations_served"), total("explored").alias("exploratory_impressions"), total("colds").alias("cold_start_impressions"),
                                                       F.round(total("reward") / 1e6, 6).alias("estimated_reward_total"), F.round(total("regret") / 1e6, 6).alias("pseudo_regret_total"), F.round(total("novelty") / 1e9, 9).alias("novelty_total"))


@query("ev", f"""with {SCORED}, s as (select item_id % 5 slate, item_id, round(prediction, 6) p, [1.0::double, posterior, reward, con, bonus, case when cold then 1.0::double else 0.0::double end, ln(1 + impressions), ln(1 + clicks), clicks / (impressions + 1)::double] x from sd),
 k as (select slate, row_number() over (partition by slate order by p desc, item_id) i, round(list_inner_product(x, {POLICY}::double[]), 6) score from s)
 select a.slate, max(b.i) slate_size, round(avg(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0.0::double end), 9) concordance from k a join k b on a.slate = b.slate and a.i < b.i where b.i <= 10 group by 1""")
def z8_shadow_slates(spark, sf):
    """Of each served slate the share of pairs that the shadow policy's weights put in the served order; slates of one item have no pair and no row."""
    c, a = F.col, _scored(spark, sf)
    x = F.array(F.lit(1.0), "posterior", "reward", "con", "bonus", c("cold").cast("double"), F.log1p("impressions"), F.log1p("clicks"), c("clicks") / (c("impressions") + 1))
    s = a.select((c("item_id") % 5).alias("slate"), "item_id", F.round("prediction", 6).alias("p"), F.round(S.dot(x, F.array(*[F.lit(float(w)) for w in POLICY])), 6).alias("score"))
    k = R.top_k(s, ["slate"], 10, F.desc("p"), F.asc("item_id")).select("slate", c("rank").alias("i"), "score")
    pairs = k.join(k.select("slate", c("i").alias("j"), c("score").alias("other")), "slate").filter("i < j")
    agree = F.when(c("score") > c("other"), 1.0).when(c("score") == c("other"), 0.5).otherwise(0.0)
    return pairs.groupBy("slate").agg(F.max("j").cast("long").alias("slate_size"), F.round(F.avg(agree), 9).alias("concordance"))


# Feedback


@query("ev", f"""select user_id % 3 "algorithm", count(*) received, count(*) filter (movie_id = 0 or movie_id is null) ignored, count(*) filter (movie_id > 0 and event_type = 'click') clicks,
 round(coalesce(sum(case when movie_id > 0 then {LABEL} end), 0) / 3.0, 9) reward_total, count(*) filter (movie_id > 0 and user_id % 3 = 1) q_updates, count(distinct case when movie_id > 0 then movie_id end) items from ev where user_id > 0 group by 1""")
def z12_feedback_totals(spark, sf):
    """What feedback adds to each algorithm's totals. Feedback without an item is ignored; only the tabular algorithm (here 1) has Q-values to update."""
    e = T.events(spark, sf).filter(E.valid()).withColumn("label", E.training_label()).withColumn("item", F.when(F.col("movie_id") > 0, F.col("movie_id")))
    item = F.col("item").isNotNull()
    return e.groupBy((F.col("user_id") % 3).alias("algorithm")).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(~item).alias("ignored"), F.count_if(item & (F.col("event_type") == "click")).alias("clicks"),
        F.round(F.coalesce(F.sum(F.when(item, F.col("label"))), F.lit(0)) / 3.0, 9).alias("reward_total"), F.count_if(item & (F.col("user_id") % 3 == 1)).alias("q_updates"), F.count_distinct("item").alias("items"))


@query("ev", f"""select place, event_id, user_id, movie_id item_id, {LABEL} / 3.0::double reward from (select *, row_number() over (order by ts_ms desc, event_id desc) place from ev where user_id > 0 and movie_id > 0) where place <= {REPLAYED}""")
def z12_replay_list(spark, sf):
    """The replay list after all feedback: its newest entries, the last first. It is as long as it may be, a setting of the served system."""
    e = T.events(spark, sf).filter(E.valid() & (F.col("movie_id") > 0))
    last = e.orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(REPLAYED).withColumn("all", F.lit(0))
    return R.ranked(last, ["all"], F.desc("ts_ms"), F.desc("event_id")).select(F.col("rank").cast("long").alias("place"), "event_id", "user_id", F.col("movie_id").alias("item_id"), (E.training_label() / 3.0).alias("reward"))


# Profiles and users


_PROFILES = f"""o as (select o_custkey user_id, max(epoch_ms(o_orderdate)) last_ms from orders group by 1), hi as (select max(last_ms) hi from o),
 u as (select c_custkey user_id, cast({MONTH_S} - (hi - last_ms) // 1000 as bigint) ttl from customer left join o on c_custkey = o.user_id, hi),
 pref as (select distinct user_id, p_type as "value", 'genre' kind from ratings join part on item_id = p_partkey where rating >= 4.5 union all select c_custkey, lower(c_mktsegment), 'tag' from customer),
 known as (select distinct p_type as "value", 'genre' kind from part where p_size >= 10 union select distinct split_part(lower(p_name), ' ', 1), 'tag' from part),
 un as (select pref.* from pref join u using (user_id) where ttl > 0 and not exists (select 1 from known where known.kind = pref.kind and known."value" = pref."value")),
 f as (select user_id, ttl, case when ttl is null then 'missing' when ttl <= 0 then 'expired' end reason, ttl > 0 and exists (select 1 from un where un.user_id = u.user_id) unmatched from u)"""


@query("ratings", f"""with {_PROFILES}
 select 'users' section, 'scanned' kind, '' as "value", count(*) n from f union all select 'users', 'with_profile', '', count(*) filter (reason is null) from f union all select 'users', 'healthy', '', count(*) filter (reason is null and not unmatched) from f
 union all select 'no_profile', reason, '', count(*) from f where reason is not null group by 2 union all select 'findings', 'unmatched_preference', '', count(*) filter (unmatched) from f
 union all select 'unmatched', kind, "value", count(distinct user_id) from un group by 2, 3 union all select 'ttl', 'least_seconds', '', coalesce(min(ttl) filter (ttl > 0), 0) from f""")
def a26_audit_summary(spark, sf):
    """The audit's summary, a row for each figure: users scanned, with a profile and healthy; those without one by reason; findings by type; users of each
    preference that the catalog does not know, by kind and value; the least time that a profile has left."""
    o = T.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("last_ms"))
    c = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    u = c.join(o, "user_id", "left").join(F.broadcast(o.agg(F.max("last_ms").alias("hi"))))  # one row
    u = u.withColumn("ttl", MONTH_S - F.floor((F.col("hi") - F.col("last_ms")) / 1000))
    part = T.load(spark, sf, "part")
    genres = T.ratings(spark, sf).filter("rating >= 4.5").join(part.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("value")), "item_id").select("user_id", "value").distinct().withColumn("kind", F.lit("genre"))
    prefs = genres.unionByName(c.select("user_id", F.lower("c_mktsegment").alias("value"), F.lit("tag").alias("kind")))
    known = part.filter("p_size >= 10").select(F.col("p_type").alias("value"), F.lit("genre").alias("kind")).unionByName(part.select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("value"), F.lit("tag").alias("kind"))).distinct()
    un = prefs.join(u.filter("ttl > 0").select("user_id"), "user_id").join(known, ["kind", "value"], "left_anti")
    f = u.join(un.select("user_id").distinct().withColumn("unmatched", F.lit(True)), "user_id", "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(False)))
    f = f.withColumn("reason", F.when(F.col("ttl").isNull(), "missing").when(F.col("ttl") <= 0, "expired"))
    whole = f.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("reason").isNull()).alias("with_profile"), F.count_if(F.col("reason").isNull() & ~F.col("unmatched")).alias("healthy"),
                  F.count_if("unmatched").alias("unmatched_preference"), F.coalesce(F.min(F.when(F.col("ttl") > 0, F.col("ttl"))), F.lit(0)).alias("least_seconds"))
    row = lambda section, kind: F.struct(F.lit(section).alias("section"), F.lit(kind).alias("kind"), F.lit("").alias("value"), F.col(kind).cast("long").alias("n"))
    figures = [row("users", "scanned"), row("users", "with_profile"), row("users", "healthy"), row("findings", "unmatched_preference"), row("ttl", "least_seconds")]
    out = whole.select(F.explode(F.array(*figures)).alias("r")).select("r.*")
    reasons = f.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_profile").alias("section"), F.col("reason").alias("kind"), F.lit("").alias("value"), "n")
    return out.unionByName(reasons).unionByName(un.groupBy("kind", "value").agg(F.count_distinct("user_id").alias("n")).select(F.lit("unmatched").alias("section"), "kind", "value", "n"))


@query("ratings ev vectors", f"""with i as (select user_id, movie_id item_id, 1.0::double w from ev where user_id > 0 and {HISTORY} union all select user_id, item_id, 2.0::double from ratings),
 m as (select user_id, item_id, max(w) w from i group by all), own as (select id user_id, vec from vectors where id % 10 = 0), us as (select distinct user_id from m),
 f as (select user_id, d, round(sum(x * w) / sum(w), 6) + 0.0::double x from (select user_id, w, unnest(generate_series(0, 63)) d, unnest(vec) x from m join vectors on item_id = id where user_id not in (select user_id from own)) group by all)
 select user_id, d, x, 'items' origin from f union all select user_id, unnest(generate_series(0, 63)), round(unnest(vec), 6) + 0.0::double, 'own' from us join own using (user_id)""")
def v14_vector_fallback(spark, sf):
    """A user's own vector (here those of ids divisible by ten), or the mean of item vectors: weight 1 for recent items, 2 for rated ones, the greater for both."""
    v = T.vectors(spark, sf)
    recent = T.events(spark, sf).filter(E.valid() & E.updates_history()).select("user_id", F.col("movie_id").alias("item_id"), F.lit(1.0).alias("w"))
    m = recent.unionByName(T.ratings(spark, sf).select("user_id", "item_id", F.lit(2.0).alias("w"))).groupBy("user_id", "item_id").agg(F.max("w").alias("w"))
    own = v.filter("id % 10 = 0").select(F.col("id").alias("user_id"), "vec")
    rest = m.join(own.select("user_id"), "user_id", "left_anti").join(v.select(F.col("id").alias("item_id"), "vec"), "item_id")
    f = V.weighted_means(rest.select("user_id", "w", "vec"), v, "user_id").select("user_id", "d", (F.round("x", 6) + 0.0).alias("x"))  # + 0.0: no negative zero
    kept = own.join(m.select("user_id").distinct(), "user_id", "left_semi").select("user_id", F.posexplode("vec").alias("d", "x"))
    return f.select("user_id", "d", "x", F.lit("items").alias("origin")).unionByName(kept.select("user_id", F.col("d").cast("long").alias("d"), (F.round("x", 6) + 0.0).alias("x"), F.lit("own").alias("origin")))


@query("ratings ev", f"""with old as (select user_id, list(item_id order by ts desc, item_id)[1:120] s from ratings group by 1),
 st as (select user_id, list(movie_id order by k desc, movie_id)[1:120] s from (select user_id, movie_id, max(ts_ms) k from ev where user_id > 0 and {HISTORY} group by all) group by 1),
 u as (select coalesce(old.user_id, st.user_id) user_id, coalesce(old.s, []) legacy, coalesce(st.s, []) stored from old full join st on old.user_id = st.user_id), m as (select unnest(['off', 'shadow', 'on']) "mode")
 select user_id, "mode", array_to_string((case when "mode" = 'on' then stored else legacy end)[1:50], ',') actions, len((case when "mode" = 'on' then stored else legacy end)[1:100]) retrieval, array_to_string((case when "mode" = 'on' then stored else legacy end)[1:20], ',') scoring,
  case when "mode" = 'shadow' then len(list_intersect(legacy, stored)) end overlap, case when "mode" = 'shadow' then len(stored) - len(list_intersect(legacy, stored)) end new from u, m""")
def h10_sequence_modes(spark, sf):
    """Action, retrieval and scoring sequences (50, 100, 20) of each user in the three modes: off reads the old ones, on the stored ones, shadow the old ones and reports
    how the stored ones differ. Sequences are a user's newest 120 different items."""
    def newest(df: DataFrame, time: str, name: str) -> DataFrame:
        top = R.top_k(df, ["user_id"], 120, F.desc(time), F.asc("item_id"))
        return top.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))

    stored = T.events(spark, sf).filter(E.valid() & E.updates_history()).groupBy("user_id", F.col("movie_id").alias("item_id")).agg(F.max("ts_ms").alias("ts"))
    none = F.array().cast("array<long>")
    u = newest(T.ratings(spark, sf), "ts", "legacy").join(newest(stored, "ts", "stored"), "user_id", "full").select("user_id", F.coalesce("legacy", none).alias("legacy"), F.coalesce("stored", none).alias("stored"))
    m = u.withColumn("mode", F.explode(F.array(F.lit("off"), F.lit("shadow"), F.lit("on")))).withColumn("s", F.when(F.col("mode") == "on", F.col("stored")).otherwise(F.col("legacy")))
    text = lambda n: F.array_join(F.transform(F.slice("s", 1, n), lambda x: x.cast("string")), ",")
    same = F.when(F.col("mode") == "shadow", F.size(F.array_intersect("legacy", "stored")))
    return m.select("user_id", "mode", text(50).alias("actions"), F.size(F.slice("s", 1, 100)).cast("long").alias("retrieval"), text(20).alias("scoring"), same.cast("long").alias("overlap"), (F.when(F.col("mode") == "shadow", F.size("stored")) - same).cast("long").alias("new"))


@query("ratings movies ev", f"""with g as (select item_id, unnest(genres) genre from (select distinct item_id, genres from movies)), gid as (select genre, row_number() over (order by genre) - 1 gid from (select distinct genre from g)),
 rg as (select user_id, genre, count(*) n, sum(rating) total from ratings join (select distinct item_id, genre from g) using (item_id) where rating >= 4 group by all),
 fav as (select user_id, string_agg(genre, ',' order by k) filter (k <= 3) favorite_genres, string_agg(genre || '=' || n, ',' order by k) filter (k <= 5) genre_preferences, string_agg(gid, ',' order by gid) filter (k <= 3) inferred_genres
  from (select *, row_number() over (partition by user_id order by n desc, genre) k from rg) join gid using (genre) group by 1),
 r as (select user_id, round(avg(rating), 6) avg_rating, count(*) rating_count, list(item_id order by ts desc, item_id)[1:100] s from ratings group by 1),
 im as (select user_id, movie_id, max(ts_ms) t from ev where movie_id > 0 and user_id > 0 group by all), iv as (select user_id, list(movie_id order by t desc, movie_id)[1:20] s from im group by 1),
 sv as (select user_id, list(movie_id order by t desc, movie_id)[1:10] s from (select user_id, movie_id, max(ts_ms) t from ev where movie_id > 0 and user_id > 0 and event_type = 'view' group by all) group by 1),
 pr as (select user_id, string_agg(d, ',' order by d desc) past_requests from (select distinct user_id, ts_ms // {DAY} * {DAY} d from ev where user_id > 0) group by 1)
 select c_custkey user_id, coalesce(favorite_genres, '') favorite_genres, coalesce(avg_rating, 0.0) avg_rating, coalesce(rating_count, 0) rating_count, coalesce(array_to_string(r.s[1:20], ','), '') recently_rated, coalesce(array_to_string(r.s[1:50], ','), '') action_sequence,
  coalesce(len(r.s), 0) retrieval_sequence, coalesce(array_to_string(r.s[1:20], ','), '') scoring_sequence, coalesce(array_to_string(sv.s, ','), '') served, coalesce(past_requests, '') past_requests, coalesce(inferred_genres, '') inferred_genres, coalesce(array_to_string(iv.s, ','), '') impressed,
  coalesce(array_to_string(list_filter(sv.s, lambda x: x % 2 = 0), ','), '') cached, coalesce(len(list_filter(sv.s, lambda x: x % 2 = 0)), 0) > 0 has_cached, c_mktsegment || '|' || coalesce(n_name, '') || '|' || case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'rich' end demographics,
  coalesce(genre_preferences, '') genre_preferences, lower(c_mktsegment) || '=1' tag_preferences
 from customer left join fav on c_custkey = fav.user_id left join r on c_custkey = r.user_id left join iv on c_custkey = iv.user_id left join sv on c_custkey = sv.user_id left join pr on c_custkey = pr.user_id left join nation on c_nationkey = n_nationkey""")
def h1_h2_user_record(spark, sf):
    """The feature record of every user, slice by slice by left joins, empty where a slice has nothing: genres, ratings, sequences, served, impressed and cached items,
    requests, demographics (here segment, nation and a band of the balance) and preferences. Lists are bounded, newest first, and shown as texts."""
    text = lambda a, n=1000: F.array_join(F.transform(F.slice(a, 1, n), lambda x: x.cast("string")), ",")

    def newest(df: DataFrame, n: int, time: str, item: str, name: str) -> DataFrame:
        top = R.top_k(df, ["user_id"], n, F.desc(time), F.asc(item))
        return top.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(item).alias("x")))), lambda x: x["x"]).alias(name))

    r, e = written(T.ratings(spark, sf), "ratings"), T.events(spark, sf).filter("user_id > 0")
    g = T.movies(spark, sf).select("item_id", F.explode("genres").alias("genre")).distinct()
    ids = R.placed(g.select("genre").distinct(), F.asc("genre"), name="gid").withColumn("gid", F.col("gid") - 1)
    names = g.groupBy("item_id").agg(F.collect_list("genre").alias("names"))
    liked = r.filter("rating >= 4").join(names, "item_id").select("user_id", "names").repartition("user_id").select("user_id", F.explode("names").alias("genre")).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    top = R.top_k(liked, ["user_id"], 5, F.desc("n"), F.asc("genre")).join(ids, "genre")
    fav = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "genre", "n", "gid"))).alias("f"))
    fav = fav.select("user_id", F.array_join(F.transform(F.slice("f", 1, 3), lambda x: x["genre"]), ",").alias("favorite_genres"), F.array_join(F.transform("f", lambda x: F.concat(x["genre"], F.lit("="), x["n"].cast("string"))), ",").alias("genre_preferences"),
                     F.array_join(F.transform(F.array_sort(F.transform(F.slice("f", 1, 3), lambda x: x["gid"])), lambda x: x.cast("string")), ",").alias("inferred_genres"))
    mean = r.groupBy("user_id").agg(F.round(F.avg("rating"), 6).alias("avg_rating"), F.count(F.lit(1)).alias("rating_count"))
    seen = e.filter("movie_id > 0").groupBy("user_id", "movie_id").agg(F.max("ts_ms").alias("t"), F.max(F.when(F.col("event_type") == "view", F.col("ts_ms"))).alias("v"))
    days = newest(e.select("user_id", (F.floor(F.col("ts_ms") / DAY) * DAY).alias("d")).distinct(), 1000, "d", "d", "days")
    nation = T.load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    u = T.load(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id").join(F.broadcast(nation), "c_nationkey", "left")  # 25 rows
    for part in (fav, mean, newest(r, 100, "ts", "item_id", "s"), newest(seen, 20, "t", "movie_id", "i"), newest(seen.filter("v is not null"), 10, "v", "movie_id", "w"), days):
        u = u.join(part, "user_id", "left")
    cached = F.filter("w", lambda x: x % 2 == 0)
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "some").otherwise("rich")
    empty = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return u.select(
        "user_id", empty(F.col("favorite_genres"), "favorite_genres"), F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"), F.coalesce("rating_count", F.lit(0)).cast("long").alias("rating_count"),
        empty(text("s", 20), "recently_rated"), empty(text("s", 50), "action_sequence"), F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("retrieval_sequence"), empty(text("s", 20), "scoring_sequence"), empty(text("w"), "served"),
        empty(text("days"), "past_requests"), empty(F.col("inferred_genres"), "inferred_genres"), empty(text("i"), "impressed"), empty(text(cached), "cached"), (F.coalesce(F.size(cached), F.lit(0)) > 0).alias("has_cached"),
        F.concat_ws("|", "c_mktsegment", F.coalesce("n_name", F.lit("")), band).alias("demographics"), empty(F.col("genre_preferences"), "genre_preferences"), F.concat(F.lower("c_mktsegment"), F.lit("=1")).alias("tag_preferences"),
    )


# Files


@query("vectors", "select id, len(vec) n, round(vec[1], 5) first_x, round(vec[64], 5) last_x, round(list_sum(list_transform(vec, lambda x: round(x, 8))), 4) total from vectors")
def s4_k4_embedding_files(spark, sf):
    """Vectors written as one CSV of eight decimals, sorted by id, and read back as the text form, cut at the first comma."""
    path = f"{shared_dir(T.vectors(spark, sf))}/embeddings-{uuid.uuid4().hex}"
    files.write_embeddings(T.vectors(spark, sf), path)
    v = files.embeddings_text(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select(F.col("id").cast("long").alias("id"), F.size("vec").cast("long").alias("n"), F.round(F.col("vec")[0].cast("double"), 5).alias("first_x"), F.round(F.col("vec")[63].cast("double"), 5).alias("last_x"), F.round(total, 4).alias("total"))


@query("ev", """select event_id, case when user_id % 4 = 3 then 0 else user_id end user_id, coalesce(movie_id, 0) movie_id, event_type, watch_ms, ts_ms from ev where cast(substr(event_id, 5) as bigint) % 7 <> 0""")
def s6_x3_event_lines(spark, sf):
    """Events written as lines under both spellings of their fields, some broken and some blank, and read back: ids are the digits behind the last underscore or 0, broken lines go."""
    e, n = T.events(spark, sf), F.substring("event_id", 5, 30).cast("long")
    old = F.struct("event_id", F.format_string("user_%d", "user_id").alias("user_id"), F.format_string("a_movie_%d", "movie_id").alias("item_id"), F.upper("event_type").alias("event_type"), F.col("watch_ms").alias("watchMs"), F.col("ts_ms").alias("timestamp_ms"))
    new = F.struct(F.col("event_id").alias("eventId"), F.col("user_id").alias("userId"), F.col("movie_id").alias("movieId"), F.concat(F.lit(" "), "event_type").alias("eventType"), F.col("watch_ms").alias("watchMs"), F.col("ts_ms").alias("eventTimeMillis"))
    odd = F.struct("event_id", F.format_string("user%d", "user_id").alias("user_id"), F.col("movie_id").alias("movieId"), "event_type", F.col("watch_ms").alias("watchMs"), F.col("ts_ms").alias("timestamp_ms"))
    line = F.when(n % 7 == 0, F.lit('{"event_id": "evt-broken", "user_id": ')).when(F.col("user_id") % 4 == 3, F.to_json(odd)).when(n % 2 == 0, F.to_json(old)).otherwise(F.to_json(new))
    path = f"{shared_dir(e)}/events-{uuid.uuid4().hex}"
    e.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return files.events_ndjson(spark, path).select("event_id", F.col("user_id").cast("long").alias("user_id"), F.col("movie_id").cast("long").alias("movie_id"), "event_type", "watch_ms", "ts_ms")
