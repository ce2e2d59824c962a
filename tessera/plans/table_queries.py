"""Queries over the relational tables: joins, merges, samples, statistics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels as L
from tessera.functions import score as S
from tessera.operators import relational as R
from tessera.operators import stats


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def left_join_suffix(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return R.left_with_suffix(docs, t(spark, sf_dir, "labels").withColumn("lang", F.lit("x")), "doc_id")


def inner_join_pairs(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_residual(spark, sf_dir):
    """Corrections: the label that is stored differs from the one predicted."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    return o.join(li, (o.o_orderkey == li.l_orderkey) & (o.o_orderstatus != li.l_linestatus)).groupBy("o_orderstatus", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def anti_join_new(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def semi_common(spark, sf_dir):
    docs, labels, events = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), t(spark, sf_dir, "events")
    return docs.select("doc_id").join(labels, "doc_id", "left_semi").join(events.select(F.col("event_id").alias("doc_id")), "doc_id", "left_semi")


def update_join(spark, sf_dir):
    base = t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("label"))
    changes = t(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), F.col("quality").alias("seq"))
    return R.update_from(base, changes, "doc_id", "label", "seq")


def candidate_cross(spark, sf_dir):
    """All combinations of the few kinds that three tables have."""
    kinds = lambda name, column, out: t(spark, sf_dir, name).select(F.col(column).alias(out)).filter(F.col(out).isNotNull()).distinct()
    return kinds("events", "event_type", "a").crossJoin(F.broadcast(kinds("documents", "lang", "b"))).crossJoin(F.broadcast(kinds("orders", "o_orderstatus", "c")))


def upsert_keep_last(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def dedupe_keep_first(spark, sf_dir):
    return R.keep_first(t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])


def insert_only_merge(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = t(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("NEW"))
    return R.insert_only(c, new, ["c_custkey"])


def merge_stats(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey")
    return R.merge_counts(c, t(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")), ["c_custkey"])


def union_by_name(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


def except_keys(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(t(spark, sf_dir, "orders").select("o_custkey"))


def intersect_keys(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).intersect(t(spark, sf_dir, "orders").select("o_custkey"))


def union_distinct(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).union(t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


def label_normalize(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, [" Phish", "LEGIT", "malicious", "1.0", "0", "benign", "1"])), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = t(spark, sf_dir, "documents").select("doc_id", text.alias("raw"), "source")
    return docs.select("doc_id", L.strict_label(F.col("raw")).alias("strict"), L.loose_label(F.col("raw")).alias("loose"), L.bucket(F.when(F.col("doc_id") % 3 > 0, F.col("source"))).alias("bucket"))


def labelled(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("mark", F.when(F.col("quality") == 1, F.col("lang")))


def impute_sentinel(spark, sf_dir):
    return L.impute_sentinel(labelled(spark, sf_dir), skip=("doc_id",))


def impute_median_mode(spark, sf_dir):
    table = labelled(spark, sf_dir).withColumn("quality", F.col("quality").cast("double"))
    return L.impute_fitted(table, ["quality"], ["mark"]).select("doc_id", "quality", "mark")


def factorize_first_seen(spark, sf_dir):
    return L.first_seen_codes(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", "code").select("event_id", "code")


def sorted_codes(spark, sf_dir):
    return L.sorted_codes(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "code").select("event_id", "code")


def list_string_count(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("['"), F.array_join(F.array_repeat(F.col("lang"), (F.col("doc_id") % 4).cast("int")), "', '"), F.lit("']")))
    return t(spark, sf_dir, "documents").select("doc_id", L.list_size(text).alias("n"))


def null_ratio(spark, sf_dir):
    table = labelled(spark, sf_dir).select("lang", "quality", "toxic", "mark")
    return stats.null_ratios(table).withColumn("null_ratio", F.round("null_ratio", 6))


def quality_gate(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    rules = [("value", "negative", "error", F.col("value") < 0), ("value", "over 90", "warning", F.col("value") > 90), ("event_type", "null", "error", F.col("event_type").isNull())]
    return stats.passes(stats.quality_issues(e, rules))


def value_counts(spark, sf_dir):
    return stats.value_counts(t(spark, sf_dir, "events"), "event_type")


def diversity_entropy(spark, sf_dir):
    out = stats.group_entropy(t(spark, sf_dir, "documents"), "source")
    return out.select("n_values", "n", F.round("entropy", 6).alias("entropy"), F.round(S.coverage(F.col("n_values"), 25), 6).alias("coverage"), S.grade(S.coverage(F.col("n_values"), 25)).alias("grade"))


def diversity_gini(spark, sf_dir):
    return stats.gini(t(spark, sf_dir, "orders"), "o_custkey").select(F.round("gini", 6).alias("gini"))


def classification_metrics(spark, sf_dir):
    out = stats.classification(t(spark, sf_dir, "labels"), "toxic", "quality")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr")))


def scored(spark, sf_dir):
    return t(spark, sf_dir, "labels").withColumn("p", (F.col("doc_id") * 37 % 101) / 101.0 * 0.5 + F.col("toxic") * 0.3 + 0.05)


def roc_auc_exact(spark, sf_dir):
    return stats.roc_auc(scored(spark, sf_dir), "toxic", "p").select(F.round("auc", 6).alias("auc"))


def logloss_brier(spark, sf_dir):
    return stats.log_loss(scored(spark, sf_dir), "toxic", "p").select(F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


def latency_percentiles(spark, sf_dir):
    out = stats.latency(t(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


def rate_per_hour(spark, sf_dir):
    return stats.rate_per_hour(t(spark, sf_dir, "events"), "ts", ["event_type"]).withColumn("per_hour", F.round("per_hour", 6))


def hit_rate(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))


def moments(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 6).alias("var_samp"), F.round(F.stddev_samp("value"), 6).alias("std_samp"), F.round(F.var_pop("value"), 6).alias("var_pop"), F.round(F.stddev_pop("value"), 6).alias("std_pop"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


def variants(spark, sf_dir):
    slot = F.col("event_id") % 100
    return t(spark, sf_dir, "events").withColumn("variant", F.when(slot < 50, "control").when(slot < 80, "candidate").otherwise("canary"))


def ab_metrics(spark, sf_dir):
    e = variants(spark, sf_dir)
    out = e.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    out = stats.with_percentiles(out, e, ["variant"], "value", {"p50": 0.5, "p95": 0.95})
    return out.select("variant", "n", "errors", "users", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def ab_gates(spark, sf_dir):
    """Promote or roll back each variant against the control."""
    m = variants(spark, sf_dir).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("err"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("good"))
    control = m.filter("variant = 'control'").select(F.col("good").alias("base"))
    decision = F.when(F.col("err") > 0.25, "rollback").when((F.col("n") >= 1000) & (F.col("good") - F.col("base") >= 0.0), "promote").otherwise("keep")
    return m.filter("variant <> 'control'").crossJoin(F.broadcast(control)).select("variant", "n", decision.alias("decision"))


def ensemble_scores(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", (F.col("value") % 1.0).alias("u"), F.when(F.col("event_id") % 3 > 0, (F.col("value") * 7) % 1.0).alias("d"), F.when(F.col("event_id") % 5 > 0, (F.col("value") * 13) % 1.0).alias("w"))
    p = S.weighted([(F.col("u"), 0.6), (F.col("d"), 0.15), (F.col("w"), 0.25)])
    scored_ = e.select("event_id", F.round(p, 6).alias("p"))
    c = F.col("p")
    return scored_.select("event_id", "p", S.verdict(c).alias("verdict"), S.user_verdict(c).alias("user_verdict"), F.round(S.confidence(c), 6).alias("confidence"), S.confidence_band(c).alias("band"), S.risk_level(c).alias("risk"))


def composite_score(spark, sf_dir):
    m = stats.classification(scored(spark, sf_dir).withColumn("yes", (F.col("p") >= 0.5).cast("int")).withColumn("part", F.col("doc_id") % 4), "toxic", "yes", ["part"])
    ms = F.col("part") * 100.0
    return m.select("part", F.round(S.composite(F.col("accuracy"), F.col("fpr"), ms, F.col("f1")), 6).alias("composite"), F.round(S.tradeoff(F.col("accuracy"), ms), 6).alias("tradeoff"))


def weight_grid(spark, sf_dir):
    """Best of all weights in tenths for three scores, by log loss; one pass over the rows for the whole grid."""
    rows = scored(spark, sf_dir).select("toxic", F.col("p").alias("a"), (1 - F.col("p")).alias("b"), F.lit(0.5).alias("c"))
    grid = [(i / 10, j / 10, (10 - i - j) / 10) for i in range(11) for j in range(11 - i)]
    losses = []
    for x, y, z in grid:
        p = F.least(F.greatest(F.col("a") * x + F.col("b") * y + F.col("c") * z, F.lit(1e-15)), F.lit(1 - 1e-15))
        losses.append(F.avg(-(F.col("toxic") * F.ln(p) + (1 - F.col("toxic")) * F.ln(1 - p))))
    one = rows.agg(*(v.alias(f"l{i}") for i, v in enumerate(losses)))
    listed = F.array(*(F.struct(F.lit(x).alias("wa"), F.lit(y).alias("wb"), F.lit(z).alias("wc"), F.round(f"l{i}", 6).alias("loss")) for i, (x, y, z) in enumerate(grid)))
    return one.select(F.inline(listed)).orderBy("loss", "wa", "wb").limit(1)


def feedback_corrections(spark, sf_dir):
    """The newest hundred rows, then those that disagree."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    joined = o.join(li, o.o_orderkey == li.l_orderkey).select("l_orderkey", "l_linenumber", "o_orderdate", "o_orderstatus", "l_linestatus")
    newest = joined.orderBy(F.desc("o_orderdate"), "l_orderkey", "l_linenumber").limit(100)
    return newest.filter("o_orderstatus <> l_linestatus").select("l_orderkey", "l_linenumber", "o_orderstatus", "l_linestatus")


def feedback_stats(spark, sf_dir):
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    joined = li.join(o, o.o_orderkey == li.l_orderkey, "left")
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") != F.col("l_linestatus")).alias("corrections"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.countDistinct("l_orderkey").alias("orders"))


def top_k(spark, sf_dir):
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def top_k_per_row(spark, sf_dir):
    """The three components of largest absolute value of each vector; of these, those of at least 0.05."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("i"), x.alias("v"))).alias("e"))
    return v.select("vec_id", F.inline(F.slice(F.array_sort("e"), 1, 3))).filter("k <= -0.05").select("vec_id", F.col("i").alias("component"), F.round(F.col("v").cast("double"), 6).alias("value"))


def argmax(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


def top_per_group(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return R.top_per_group(o, "o_orderpriority", 3, [F.desc("o_totalprice"), F.col("o_orderkey")])


def stratified_folds(spark, sf_dir):
    return R.folds(t(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id").select("doc_id", "fold")


def quota_sample(spark, sf_dir):
    return R.quota(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, "doc_id")


def cap_per_bucket(spark, sf_dir):
    return R.cap_per_group(t(spark, sf_dir, "documents").select("doc_id", "source"), "source", 20, "doc_id")


def rate_limit_window(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_timestamp("window.start").alias("start"), "n", (F.col("n") > 2).alias("limited"))


def ttl_cache(spark, sf_dir):
    """The entries of a cache of 24 hours that are alive at the end: the last write of each key, if it is not older."""
    e = t(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    end = e.agg(F.max("ts").alias("__end"))
    return last.crossJoin(F.broadcast(end)).filter(F.col("ts") + F.expr("INTERVAL 24 HOURS") > F.col("__end")).select("user_id", "event_id")


def json_props(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    k = F.from_json("props", "k INT")["k"]
    return e.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count(k).alias("k_n"))


_LAB = "SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.quality = 1 THEN d.lang END AS mark FROM documents d LEFT JOIN labels l USING (doc_id)"
_SC = "SELECT *, (doc_id * 37 % 101) / 101.0 * 0.5 + toxic * 0.3 + 0.05 AS p FROM labels"
_VAR = "SELECT *, CASE WHEN event_id % 100 < 50 THEN 'control' WHEN event_id % 100 < 80 THEN 'candidate' ELSE 'canary' END AS variant FROM events"
_CM = "count(*) FILTER (WHERE toxic = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND {p} = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND {p} = 0) AS tn"
SQL = {
    "left_join_suffix": "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN 'x' END AS lang_feature FROM documents d LEFT JOIN labels l USING (doc_id)",
    "inner_join_pairs": "SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "join_residual": "SELECT o_orderstatus, l_linestatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderstatus <> l_linestatus GROUP BY 1, 2",
    "anti_join_new": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "semi_common": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT event_id FROM events)",
    "update_join": "SELECT d.doc_id, CAST(coalesce(l.toxic, 0) AS INTEGER) AS label, CASE WHEN l.doc_id IS NULL THEN 'untouched' WHEN l.toxic = 0 THEN 'same' ELSE 'updated' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)",
    "candidate_cross": "SELECT DISTINCT a, b, c FROM (SELECT DISTINCT event_type AS a FROM events WHERE event_type IS NOT NULL), (SELECT DISTINCT lang AS b FROM documents WHERE lang IS NOT NULL), (SELECT DISTINCT o_orderstatus AS c FROM orders WHERE o_orderstatus IS NOT NULL)",
    "upsert_keep_last": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "dedupe_keep_first": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations) WHERE rn = 1",
    "insert_only_merge": "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT DISTINCT o_custkey * 2, 'NEW' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "merge_stats": "WITH n AS (SELECT o_custkey * 2 AS k FROM orders), a AS (SELECT count(DISTINCT k) AS added FROM n WHERE k NOT IN (SELECT c_custkey FROM customer)) SELECT (SELECT count(*) FROM customer) AS existing, (SELECT count(*) FROM n) AS incoming, added, (SELECT count(*) FROM n) - added AS duplicates FROM a",
    "union_by_name": "SELECT c_custkey AS key, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    "except_keys": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders",
    "intersect_keys": "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders",
    "union_distinct": "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier",
    "label_normalize": "SELECT doc_id, CASE CAST(doc_id % 7 AS INTEGER) WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 END AS strict, CASE WHEN doc_id % 7 = 6 THEN 1 ELSE 0 END AS loose, CASE WHEN doc_id % 3 > 0 THEN coalesce(source, 'unknown') ELSE 'unknown' END AS bucket FROM documents",
    "impute_sentinel": f"WITH x AS ({_LAB}) SELECT doc_id, coalesce(lang, 'MISSING') AS lang, coalesce(quality, -999) AS quality, coalesce(toxic, -999) AS toxic, coalesce(mark, 'MISSING') AS mark FROM x",
    "impute_median_mode": f"WITH x AS ({_LAB}), m AS (SELECT CAST(median(quality) AS DOUBLE) AS q FROM x), o AS (SELECT mark AS k FROM x WHERE mark IS NOT NULL GROUP BY mark ORDER BY count(*) DESC, mark LIMIT 1) SELECT doc_id, coalesce(CAST(quality AS DOUBLE), q) AS quality, coalesce(mark, k) AS mark FROM x, m, o",
    "factorize_first_seen": "WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type) SELECT event_id, CAST(code AS INTEGER) AS code FROM events JOIN f USING (event_type)",
    "sorted_codes": "WITH f AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM events GROUP BY event_type) SELECT event_id, CAST(code AS INTEGER) AS code FROM events JOIN f USING (event_type)",
    "list_string_count": "SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS n FROM documents",
    "null_ratio": f"WITH x AS ({_LAB}) SELECT 'lang' AS column_name, round(avg(CAST(lang IS NULL AS DOUBLE)), 6) AS null_ratio FROM x UNION ALL SELECT 'quality', round(avg(CAST(quality IS NULL AS DOUBLE)), 6) FROM x UNION ALL SELECT 'toxic', round(avg(CAST(toxic IS NULL AS DOUBLE)), 6) FROM x UNION ALL SELECT 'mark', round(avg(CAST(mark IS NULL AS DOUBLE)), 6) FROM x",
    "quality_gate": "SELECT count(*) FILTER (WHERE value < 0 OR event_type IS NULL) = 0 AS passed, CAST(count(*) FILTER (WHERE value < 0) + count(*) FILTER (WHERE value > 90) + count(*) FILTER (WHERE event_type IS NULL) AS BIGINT) AS n_issues FROM events",
    "value_counts": "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "diversity_entropy": "SELECT count(DISTINCT source) AS n_values, count(source) AS n, round(entropy(source), 6) AS entropy, round(least(count(DISTINCT source) / 25.0, 1.0) * 100, 6) AS coverage, CASE WHEN count(DISTINCT source) / 25.0 >= .85 THEN 'A' WHEN count(DISTINCT source) / 25.0 >= .7 THEN 'B' WHEN count(DISTINCT source) / 25.0 >= .55 THEN 'C' WHEN count(DISTINCT source) / 25.0 >= .4 THEN 'D' ELSE 'F' END AS grade FROM documents",
    "diversity_gini": "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM c) SELECT round(2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r",
    "classification_metrics": f"WITH c AS (SELECT {_CM.format(p='quality')} FROM labels), m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c) SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(prec, 6) AS \"precision\", round(rec, 6) AS recall, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1, round(fpr, 6) AS fpr FROM m",
    "roc_auc_exact": f"WITH s AS ({_SC}), a AS (SELECT p, toxic FROM s) SELECT round(sum(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM a x, a y WHERE x.toxic = 1 AND y.toxic = 0",
    "logloss_brier": f"WITH s AS ({_SC}) SELECT round(avg(-(toxic * ln(p) + (1 - toxic) * ln(1 - p))), 6) AS log_loss, round(avg((p - toxic) ** 2), 6) AS brier FROM s",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "rate_per_hour": "SELECT event_type, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6), 6) AS per_hour FROM events GROUP BY 1",
    "hit_rate": "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS hits, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS rate FROM events GROUP BY 1",
    "moments": "SELECT event_type, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var_samp, round(stddev_samp(value), 6) AS std_samp, round(var_pop(value), 6) AS var_pop, round(stddev_pop(value), 6) AS std_pop, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1",
    "ab_metrics": f"WITH v AS ({_VAR}) SELECT variant, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM v GROUP BY 1",
    "ab_gates": f"WITH v AS ({_VAR}), m AS (SELECT variant, count(*) AS n, avg(CAST(event_type = 'error' AS DOUBLE)) AS err, avg(CAST(event_type = 'purchase' AS DOUBLE)) AS good FROM v GROUP BY 1) SELECT m.variant, m.n, CASE WHEN m.err > 0.25 THEN 'rollback' WHEN m.n >= 1000 AND m.good - c.good >= 0 THEN 'promote' ELSE 'keep' END AS decision FROM m, m c WHERE c.variant = 'control' AND m.variant <> 'control'",
    "ensemble_scores": "WITH e AS (SELECT event_id, value % 1.0 AS u, CASE WHEN event_id % 3 > 0 THEN (value * 7) % 1.0 END AS d, CASE WHEN event_id % 5 > 0 THEN (value * 13) % 1.0 END AS w FROM events), s AS (SELECT event_id, round((coalesce(u * 0.6, 0) + coalesce(d * 0.15, 0) + coalesce(w * 0.25, 0)) / (0.6::DOUBLE + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END + CASE WHEN w IS NULL THEN 0 ELSE 0.25 END), 6) AS p FROM e) SELECT event_id, p, CASE WHEN p >= .5 THEN 'phishing' ELSE 'legit' END AS verdict, CASE WHEN p >= .5 THEN 'suspicious' ELSE 'safe' END AS user_verdict, round(abs(p - .5) * 2, 6) AS confidence, CASE WHEN abs(p - .5::DOUBLE) > .3::DOUBLE THEN 'high' WHEN abs(p - .5::DOUBLE) > .15::DOUBLE THEN 'medium' ELSE 'low' END AS band, CASE WHEN p >= .8 THEN 'critical' WHEN p >= .6 THEN 'high' WHEN p >= .4 THEN 'medium' WHEN p >= .2 THEN 'low' ELSE 'minimal' END AS risk FROM s",
    "composite_score": f"WITH s AS ({_SC}), y AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS yes, doc_id % 4 AS part FROM s), c AS (SELECT part, {_CM.format(p='yes')} FROM y GROUP BY part), m AS (SELECT part, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c) SELECT part, round(0.4 * accuracy + 0.3 * (1 - fpr) + 0.2 * (1 - least(part * 100.0 / 300, 1.0)) + 0.1 * coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS composite, round(accuracy - 0.3 * (part * 100.0 / 1000), 6) AS tradeoff FROM m",
    "weight_grid": f"WITH s AS ({_SC}), g AS (SELECT i.range / 10 AS wa, j.range / 10 AS wb, (10 - i.range - j.range) / 10 AS wc FROM range(11) i, range(11) j WHERE i.range + j.range <= 10), q AS (SELECT wa, wb, wc, toxic, least(greatest(p * wa + (1 - p) * wb + 0.5 * wc, 1e-15), 1 - 1e-15) AS r FROM s, g) SELECT wa, wb, wc, round(avg(-(toxic * ln(r) + (1 - toxic) * ln(1 - r))), 6) AS loss FROM q GROUP BY wa, wb, wc ORDER BY loss, wa, wb LIMIT 1",
    "feedback_corrections": "SELECT l_orderkey, l_linenumber, o_orderstatus, l_linestatus FROM (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, l_orderkey, l_linenumber LIMIT 100) WHERE o_orderstatus <> l_linestatus",
    "feedback_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> l_linestatus) AS corrections, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_orderkey) AS orders FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "top_k_per_row": "WITH e AS (SELECT vec_id, i AS component, embedding[i + 1] AS v FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding))) AS i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, component) AS rn FROM e) SELECT vec_id, CAST(component AS INTEGER) AS component, round(CAST(v AS DOUBLE), 6) AS value FROM r WHERE rn <= 3 AND abs(v) >= 0.05",
    "argmax": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "top_per_group": "SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "stratified_folds": "SELECT doc_id, CAST((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels",
    "quota_sample": "WITH s AS (SELECT lang, floor(100.0 * count(*) / (SELECT count(*) FROM documents)) AS q FROM documents GROUP BY lang), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT r.doc_id, r.lang FROM r JOIN s USING (lang) WHERE rn <= q",
    "cap_per_bucket": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20",
    "rate_limit_window": "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2",
    "ttl_cache": "WITH l AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM l WHERE rn = 1 AND ts + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS k_max, count(json_extract(props, '$.k')) AS k_n FROM events GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
