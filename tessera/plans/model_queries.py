"""Queries over tree contributions, fitted weights and networks of addresses."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.sql import functions as F

from tessera.functions import networks as N
from tessera.operators import enrichment, models, networks, random_trees, relational, runs, sgd, tree_shap, weight_fit
from tessera.plans.stream_queries import vectors
from tessera.plans.table_queries import scored, t
from tessera.sources import workdir

#: A tree with a feature that is asked twice on one path.
GIVEN_TREE = {
    0: tree_shap.Node(feature=0, threshold=0.0, left=1, right=2), 1: tree_shap.Node(feature=1, threshold=0.05, left=3, right=4), 2: tree_shap.Node(feature=0, threshold=0.1, left=5, right=6),
    3: tree_shap.Node(value=1.0), 4: tree_shap.Node(value=-2.0), 5: tree_shap.Node(value=0.5), 6: tree_shap.Node(feature=2, threshold=0.0, left=7, right=8), 7: tree_shap.Node(value=4.0), 8: tree_shap.Node(value=-1.0),
}


def tree_contributions(spark, sf_dir):
    """Contributions of three features to a given tree's value, with the shares of all vectors at its nodes."""
    v = vectors(spark, sf_dir).filter("embedding IS NOT NULL").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("x"))
    trees = tree_shap.covered([tree_shap.Tree(dict(GIVEN_TREE))], v, "x")
    out = tree_shap.contributions(v, trees, "x", 3)
    return out.select("vec_id", *(F.round(c, 6).alias(k) for k, c in {"base": F.col("base"), "margin": F.col("margin"), **{f"c{i}": F.col("contributions")[i] for i in range(3)}}.items()))


def forest_contributions(spark, sf_dir):
    """The ten features of a forest with the largest mean contributions, over all vectors."""
    v = models.assemble(vectors(spark, sf_dir), array_col="embedding")
    forest = C.RandomForestClassifier(numTrees=10, maxDepth=5, seed=42, labelCol="label", featuresCol="features").fit(v)
    explained = tree_shap.contributions(v.select("vec_id", "embedding"), tree_shap.from_model(spark, forest), "embedding", forest.numFeatures)
    return tree_shap.mean_contributions(explained, [f"e{i}" for i in range(forest.numFeatures)], 10)


def weight_fit_losses(spark, sf_dir):
    """Weights of two scores fitted under four losses."""
    rows = scored(spark, sf_dir).select("toxic", F.col("p").alias("a"), (F.col("doc_id") * 13 % 17 / 17.0).alias("b"))
    return weight_fit.fit(rows, "toxic", ["a", "b"]).select("loss", F.round("value", 6).alias("value"))


def weight_fit_folds(spark, sf_dir):
    """Weights of three models' scores on rows that they had not seen: whether the fit is as good as the grid of tenths under each loss."""
    v = relational.folds(models.assemble(vectors(spark, sf_dir), array_col="embedding"), "label", "vec_id", 3)
    zoo = {"a": C.LogisticRegression(regParam=0.01, labelCol="label"), "b": C.NaiveBayes(modelType="gaussian", labelCol="label"), "c": C.DecisionTreeClassifier(maxDepth=4, seed=1, labelCol="label")}
    out = None
    for name, estimator in zoo.items():
        own = models.cross_validate(v, estimator, 3, keep=["vec_id"]).select("vec_id", "label", F.col("p").alias(name))
        out = own if out is None else out.join(own.drop("label"), "vec_id")
    fitted = weight_fit.fit(out, "label", list(zoo))
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return fitted.select("loss", (F.col("value") <= F.col("grid_value")).alias("no_worse"), (F.abs(total - 1) < 1e-9).alias("adds_up"), F.forall("weights", lambda w: w >= 0).alias("none_negative"))


def extra_trees_cover(spark, sf_dir):
    """What the leaves of three trees with random cuts hold together: every vector once in each."""
    v = vectors(spark, sf_dir).filter("embedding IS NOT NULL")
    trees = random_trees.extra_trees(v, "label", "embedding", n_trees=3, max_depth=3)
    rows = [(k, float(sum(tree.nodes[leaf].cover for leaf, *_ in tree.paths)), len(tree.paths) > 1) for k, tree in enumerate(trees)]
    return spark.createDataFrame(rows, "tree int, n double, grown boolean")


def boosted_weights(spark, sf_dir):
    """One round of boosting on all vectors: whether the new weights add up to one, and the wrong rows to half of it."""
    v = models.assemble(vectors(spark, sf_dir).filter("embedding IS NOT NULL"), array_col="embedding").withColumn("w", F.lit(1.0))
    tree, _, moved = random_trees.boosted_round(v.select("vec_id", "label", "features", "w"), 1, 1)
    judged = tree.transform(moved)
    return judged.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("whole"), F.round(F.sum(F.when(F.col("prediction") != F.col("label"), F.col("w"))), 6).alias("wrong"))


def sgd_margins(spark, sf_dir):
    """Rows of each label with a score from a model fitted by mini-batches."""
    v = vectors(spark, sf_dir).filter("embedding IS NOT NULL")
    fitted = sgd.fit(v, "label", "embedding", "vec_id", epochs=3)
    return fitted.score(v, "embedding").groupBy("label").agg(F.count("p").alias("n"), F.bool_and((F.col("p") > 0) & (F.col("p") < 1)).alias("between"))


def training_run(spark, sf_dir):
    """A run over folds, two models, report, choice, refit, save and gate, and a second start of it that finds all stages whole."""
    v = models.assemble(vectors(spark, sf_dir), array_col="embedding")
    zoo = {"logreg": C.LogisticRegression(regParam=0.01, maxIter=10, labelCol="label"), "bayes": C.NaiveBayes(modelType="gaussian", labelCol="label")}
    path, ran = workdir.shared(spark, "training-run"), []
    names = [f"e{i}" for i in range(8)]
    first = runs.train(v, zoo, runs.Ledger(spark, path, ran.append), names).first()
    again = runs.train(v, zoo, runs.Ledger(spark, path, ran.append), names).first()
    rows = [(s, ran.count(s), first == again) for s in runs.stages_of(zoo)]
    return spark.createDataFrame(rows, "stage string, times int, same boolean")


def enrichment_batch(spark, sf_dir):
    """Counters of a batch of pages of which some have no URL, no record of their host, or a failed lookup."""
    k = F.col("page_id")
    pages = t(spark, sf_dir, "pages").select("page_id", F.when(k % 10 == 9, F.lit(None)).when(k % 10 == 8, "nothing here").otherwise(F.concat(F.lit("https://h"), (k % 97).cast("string"), F.lit(".example/x"))).alias("url"))
    number = F.col("s_suppkey") % 97
    records = t(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), number.cast("string"), F.lit(".example")).alias("host"), number.alias("records"), F.when(number % 7 == 0, "timed out").alias("error")).distinct()
    path = workdir.shared(spark, "enriched")
    counts = enrichment.enrich(pages, records, path, "1")
    failed = spark.read.parquet(f"{path}/batch=1").groupBy(F.col("failed").cast("boolean").alias("failed")).agg(F.count(F.lit(1)).alias("n"), F.count("records").alias("found"))
    told = spark.createDataFrame([(bool(f), counts["rows"] - counts["well"] if f else counts["well"]) for f in (True, False)], "failed boolean, observed long")
    return failed.join(told, "failed")


def page_addresses(spark, sf_dir):
    """Addresses of both families made from page numbers."""
    k = F.col("page_id")
    four = F.concat_ws(".", F.lit("10"), (k % 8).cast("string"), (k % 251).cast("string"), (k % 13).cast("string"))
    six = F.concat(F.lit("2a00:"), F.lower(F.hex(k % 16)), F.lit("::"), F.lower(F.hex(k % 4099)))
    return t(spark, sf_dir, "pages").select("page_id", F.when(k % 5 == 4, "no.address.example").when(k % 2 == 0, four).otherwise(six).alias("ip"))


def network_table(spark, sf_dir):
    """Networks of several lengths, owned by suppliers."""
    s = F.col("s_suppkey")
    cidr = F.when(s % 4 == 0, F.concat(F.lit("10."), (s % 8).cast("string"), F.lit(".0.0/16"))).when(s % 4 == 1, F.concat(F.lit("10.0.0.0/"), (s % 5 + 8).cast("string"))).when(s % 4 == 2, F.concat(F.lit("2a00:"), F.lower(F.hex(s % 16)), F.lit("::/32"))).otherwise("2a00::/16")
    own = t(spark, sf_dir, "supplier").select(cidr.alias("cidr"), s.alias("asn"), F.concat(F.lit("org "), (s % 7).cast("string")).alias("asn_org"), F.concat(F.lit("c"), (s % 3).cast("string")).alias("asn_country"))
    return own.groupBy("cidr").agg(*(F.min_by(c, "asn").alias(c) for c in ("asn_org", "asn_country")), F.min("asn").alias("asn")).select("cidr", "asn", "asn_org", "asn_country")


def longest_prefix(spark, sf_dir):
    """The narrowest network of each page's address."""
    pages = page_addresses(spark, sf_dir)
    found = networks.longest_prefix(pages, network_table(spark, sf_dir))
    return pages.join(found, "ip", "left").select("page_id", "ip", "cidr", "asn", N.category(F.col("ip")).alias("category"))


def host_networks(spark, sf_dir):
    """Owners of the addresses of hosts with several each; hosts that are addresses have themselves only."""
    pages = page_addresses(spark, sf_dir)
    host = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("10.0.0."), (F.col("page_id") % 200).cast("string"))).otherwise(F.concat(F.lit("h"), (F.col("page_id") % 40).cast("string"), F.lit(".example")))
    hosts = pages.filter("ip <> 'no.address.example'").select(host.alias("host"), "ip").groupBy("host").agg(F.collect_list("ip").alias("ips"))
    out = networks.host_networks(hosts, network_table(spark, sf_dir))
    return out.select("host", "num_distinct_ips", *(F.array_join(F.array_sort(F.array_distinct(F.array_compact(c))).cast("array<string>"), ",").alias(c) for c in ("asn_list", "asn_org_list", "asn_country_list", "cidr_list")))


_PAGES = (
    "pa AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'no.address.example' WHEN page_id % 2 = 0 THEN '10.' || page_id % 8 || '.' || page_id % 251 || '.' || page_id % 13 ELSE '2a00:' || lower(to_hex(page_id % 16)) || '::' || lower(to_hex(page_id % 4099)) END AS ip, "
    "CASE WHEN page_id % 5 = 4 THEN 0 WHEN page_id % 2 = 0 THEN 4 ELSE 6 END AS family, page_id % 8 AS second, page_id % 16 AS group2 FROM pages)"
)
_NETS = (
    "sn AS (SELECT s_suppkey AS asn, 'org ' || s_suppkey % 7 AS asn_org, 'c' || s_suppkey % 3 AS asn_country, CASE s_suppkey % 4 WHEN 0 THEN '10.' || s_suppkey % 8 || '.0.0/16' WHEN 1 THEN '10.0.0.0/' || (s_suppkey % 5 + 8) WHEN 2 THEN '2a00:' || lower(to_hex(s_suppkey % 16)) || '::/32' ELSE '2a00::/16' END AS cidr, "
    "CASE WHEN s_suppkey % 4 < 2 THEN 4 ELSE 6 END AS nf, CASE s_suppkey % 4 WHEN 0 THEN 16 WHEN 1 THEN s_suppkey % 5 + 8 WHEN 2 THEN 32 ELSE 16 END AS len, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 8 WHEN 2 THEN s_suppkey % 16 ELSE 0 END AS val FROM supplier), "
    "nets AS (SELECT cidr, any_value(nf) AS nf, any_value(len) AS len, any_value(val) AS val, min(asn) AS asn, arg_min(asn_org, asn) AS asn_org, arg_min(asn_country, asn) AS asn_country FROM sn GROUP BY cidr)"
)
#: Whether a network holds an address: the second octet's leading bits, or the second group.
_HELD = "nf = family AND ((nf = 4 AND (second >> (16 - len)) = (val >> (16 - len))) OR (nf = 6 AND (len = 16 OR group2 = val)))"
_TREE = (
    "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE <= 0 AS l, embedding[2]::DOUBLE <= 0.05::DOUBLE AS m, embedding[1]::DOUBLE <= 0.1::DOUBLE AS r, embedding[3]::DOUBLE <= 0 AS z FROM embeddings WHERE embedding IS NOT NULL), "
    "n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE l)::DOUBLE AS nl, count(*) FILTER (WHERE l AND m)::DOUBLE AS nlm, count(*) FILTER (WHERE NOT l)::DOUBLE AS nr, count(*) FILTER (WHERE NOT l AND r)::DOUBLE AS nrr, count(*) FILTER (WHERE NOT l AND NOT r)::DOUBLE AS no, count(*) FILTER (WHERE NOT l AND NOT r AND z)::DOUBLE AS noz FROM v), "
    # values under each subset of given features, by what is averaged over
    "s AS (SELECT vec_id, CASE WHEN m THEN 1.0 ELSE -2.0 END AS a1, (nlm * 1.0 - (nl - nlm) * 2.0) / nl AS a0, CASE WHEN z THEN 4.0 ELSE -1.0 END AS b1, (noz * 4.0 - (no - noz)) / no AS b0, l, r, n, nl, nr, nrr, no FROM v, n), "
    "e AS (SELECT *, CASE WHEN l THEN a0 WHEN r THEN 0.5 ELSE b0 END AS f100, CASE WHEN l THEN a1 WHEN r THEN 0.5 ELSE b0 END AS f110, CASE WHEN l THEN a0 WHEN r THEN 0.5 ELSE b1 END AS f101, CASE WHEN l THEN a1 WHEN r THEN 0.5 ELSE b1 END AS f111, "
    "(nl * a0 + nrr * 0.5 + no * b0) / n AS f000, (nl * a1 + nrr * 0.5 + no * b0) / n AS f010, (nl * a0 + nrr * 0.5 + no * b1) / n AS f001, (nl * a1 + nrr * 0.5 + no * b1) / n AS f011 FROM s) "
    "SELECT vec_id, round(f000, 6) AS base, round(f111, 6) AS margin, round((f100 - f000) / 3 + (f110 - f010) / 6 + (f101 - f001) / 6 + (f111 - f011) / 3, 6) AS c0, "
    "round((f010 - f000) / 3 + (f110 - f100) / 6 + (f011 - f001) / 6 + (f111 - f101) / 3, 6) AS c1, round((f001 - f000) / 3 + (f101 - f100) / 6 + (f011 - f010) / 6 + (f111 - f110) / 3, 6) AS c2 FROM e"
)
_FIT = (
    "WITH s AS (SELECT toxic AS y, (doc_id * 37 % 101) / 101.0 * 0.5 + toxic * 0.3 + 0.05 AS a, doc_id * 13 % 17 / 17.0 AS b FROM labels WHERE toxic IS NOT NULL AND doc_id IS NOT NULL), "
    "w AS (SELECT least(greatest(sum((a - b) * (y - b)) / sum((a - b) ** 2), 0), 1) AS w FROM s), brier AS (SELECT avg((w * a + (1 - w) * b - y) ** 2) AS value FROM s, w), "
    "grid AS (SELECT range / 2000.0 AS g FROM range(2001)), logs AS (SELECT avg(-(y * ln(least(greatest(g * a + (1 - g) * b, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(g * a + (1 - g) * b, 1e-15), 1 - 1e-15)))) AS value, g FROM s, grid GROUP BY g), "
    # the decisions change only where a row's blend is one half: one weight between each two such points tries them all
    "cuts AS (SELECT DISTINCT c FROM (SELECT (0.5 - b) / nullif(a - b, 0) AS c FROM s UNION ALL VALUES (0.0), (1.0)) WHERE c BETWEEN 0 AND 1), mids AS (SELECT (c + lead(c) OVER (ORDER BY c)) / 2 AS g FROM cuts), "
    "d AS (SELECT g, avg(CAST((g * a + (1 - g) * b >= 0.5) = (y = 1) AS INTEGER)) AS acc, 2.0 * count(*) FILTER (WHERE y = 1 AND g * a + (1 - g) * b >= 0.5) / (count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE g * a + (1 - g) * b >= 0.5)) AS f1 FROM s, mids WHERE g IS NOT NULL GROUP BY g) "
    "SELECT 'brier' AS loss, round(value, 6) AS value FROM brier UNION ALL SELECT 'log_loss', round(min(value), 6) FROM logs UNION ALL SELECT 'neg_accuracy', round(-max(acc), 6) FROM d UNION ALL SELECT 'neg_f1', round(-max(f1), 6) FROM d"
)
SQL = {
    "tree_contributions": _TREE,
    "weight_fit_losses": _FIT,
    "weight_fit_folds": "SELECT loss, count(*) > 0 AS no_worse, count(*) > 0 AS adds_up, count(*) > 0 AS none_negative FROM embeddings, (VALUES ('log_loss'), ('brier'), ('neg_accuracy'), ('neg_f1')) AS v(loss) GROUP BY loss",
    "extra_trees_cover": "SELECT CAST(range AS INTEGER) AS tree, count(*)::DOUBLE AS n, true AS grown FROM embeddings, range(3) WHERE embedding IS NOT NULL GROUP BY range",
    "boosted_weights": "SELECT count(*) AS n, 1.0::DOUBLE AS whole, 0.5::DOUBLE AS wrong FROM embeddings WHERE embedding IS NOT NULL",
    "sgd_margins": "SELECT CAST(label % 2 AS INTEGER) AS label, count(*) AS n, true AS between FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    "training_run": "SELECT stage, CAST(1 AS INTEGER) AS times, count(*) > 0 AS same FROM embeddings, (VALUES ('folds'), ('scores-logreg'), ('scores-bayes'), ('report'), ('saved'), ('gate')) AS v(stage) GROUP BY stage",
    "enrichment_batch": "WITH r AS (SELECT DISTINCT s_suppkey % 97 AS h FROM supplier), p AS (SELECT page_id, CASE WHEN page_id % 10 < 8 THEN page_id % 97 END AS h FROM pages), j AS (SELECT p.h IS NULL OR r.h IS NULL OR r.h % 7 = 0 AS failed FROM p LEFT JOIN r ON p.h = r.h) SELECT failed, count(*) AS n, count(*) FILTER (WHERE NOT failed) AS found, count(*) AS observed FROM j GROUP BY failed",
    "longest_prefix": f"WITH {_PAGES}, {_NETS}, m AS (SELECT page_id, cidr, asn, row_number() OVER (PARTITION BY page_id ORDER BY len DESC) AS place FROM pa JOIN nets ON {_HELD}) "
    "SELECT page_id, ip, cidr, asn, CASE family WHEN 0 THEN 'none' WHEN 4 THEN 'private' ELSE 'public' END AS category FROM pa LEFT JOIN (SELECT * FROM m WHERE place = 1) USING (page_id)",
    "host_networks": f"WITH {_PAGES}, {_NETS}, h AS (SELECT DISTINCT CASE WHEN page_id % 11 = 0 THEN '10.0.0.' || page_id % 200 ELSE 'h' || page_id % 40 || '.example' END AS host, CASE WHEN page_id % 11 = 0 THEN '10.0.0.' || page_id % 200 ELSE ip END AS ip, CASE WHEN page_id % 11 = 0 THEN 4 ELSE family END AS family, CASE WHEN page_id % 11 = 0 THEN 0 ELSE second END AS second, group2 FROM pa WHERE family > 0), "
    "u AS (SELECT DISTINCT host, ip, family, second, CASE WHEN family = 6 THEN group2 END AS group2 FROM h), m AS (SELECT host, ip, cidr, asn, asn_org, asn_country, row_number() OVER (PARTITION BY host, ip ORDER BY len DESC NULLS LAST) AS place FROM u LEFT JOIN nets ON " + _HELD + "), one AS (SELECT * FROM m WHERE place = 1) "
    "SELECT host, count(*) AS num_distinct_ips, " + ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list({c}))), ','), '') AS {c}_list" for c in ("asn", "asn_org", "asn_country", "cidr")) + " FROM one GROUP BY host",
}
QUERIES = {name: globals()[name] for name in SQL} | {"forest_contributions": forest_contributions}
