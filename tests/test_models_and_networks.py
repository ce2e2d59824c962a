"""Contributions against all subsets, fitted weights against dense search, networks against the standard library."""

import ipaddress
import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.functions import networks as N
from tessera.functions import url as U
from tessera.operators import ensembles, models, networks, ranks, relational, tree_shap, weight_fit


def subset_value(tree, x, given, at=0):
    """Path-dependent expectation of a tree when only some features are given."""
    node = tree.nodes[at]
    if node.feature < 0:
        return node.value
    left, right = (subset_value(tree, x, given, c) for c in (node.left, node.right))
    if node.feature in given:
        return left if node.goes_left(x[None])[0] else right
    a, b = tree.nodes[node.left].cover, tree.nodes[node.right].cover
    return (a * left + b * right) / (a + b) if a + b else (left + right) / 2


def brute_contributions(trees, x, n):
    phi = np.zeros(n)
    for tree in trees:
        for j in range(n):
            rest = [i for i in range(n) if i != j]
            for size in range(n):
                for s in combinations(rest, size):
                    weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                    phi[j] += tree.weight * weight * (subset_value(tree, x, {*s, j}) - subset_value(tree, x, set(s)))
    return phi


def rows_for(seed, n=400, d=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1] = rng.integers(0, 3, n)
    y = (x[:, 0] + 0.5 * (x[:, 1] == 2) * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]


@pytest.mark.parametrize("kind", ["forest", "boosted", "single"])
def test_contributions_equal_all_subsets_and_add_up(spark, kind):
    df = models.assemble(spark.createDataFrame(rows_for(1), "vec_id long, x array<double>, label int"), array_col="x")
    estimator = {"forest": C.RandomForestClassifier(numTrees=4, maxDepth=5, seed=1), "boosted": C.GBTClassifier(maxIter=4, maxDepth=4, seed=1), "single": C.DecisionTreeClassifier(maxDepth=6)}[kind]
    model = estimator.fit(df)
    trees = tree_shap.from_model(spark, model)
    got = tree_shap.contributions(df.drop("features"), trees, "x", 5).collect()
    if kind == "boosted":
        # half the log odds
        want = {r.vec_id: r.m for r in model.transform(df).select("vec_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    else:
        want = {r.vec_id: r.p for r in models.positive(model.transform(df)).select("vec_id", "p").collect()}
    for r in got:
        assert r.base + sum(r.contributions) == pytest.approx(r.margin, abs=1e-9)
        assert r.margin == pytest.approx(want[r.vec_id], abs=1e-9)
    for r in got[:6]:
        assert r.contributions == pytest.approx(brute_contributions(trees, np.array(r.x), 5), abs=1e-9)
    ranked = tree_shap.mean_contributions(tree_shap.contributions(df.drop("features"), trees, "x", 5), list("abcde"), 3).collect()
    sizes = np.abs(np.array([r.contributions for r in got])).mean(axis=0)
    assert [r["index"] for r in ranked] == np.argsort(-sizes, kind="stable")[:3].tolist()
    assert [r.mean_abs for r in ranked] == pytest.approx(sorted(sizes, reverse=True)[:3])


def test_contributions_of_missing_values_categories_and_unreached_nodes(spark):
    node = tree_shap.Node
    tree = tree_shap.Tree({0: node(feature=0, threshold=1.0, left=1, right=2), 1: node(feature=1, categories=frozenset([0.0, 2.0]), left=3, right=4), 2: node(feature=2, threshold=9.0, left=5, right=6), 3: node(value=1.0), 4: node(value=2.0), 5: node(value=3.0), 6: node(value=-4.0)}, 0.5)
    data = [(1, [0.0, 2.0, 0.0]), (2, [2.0, 1.0, 0.0]), (3, [float("nan"), 0.0, float("nan")]), (4, None), (5, [0.5, 1.0, 5.0])]
    df = spark.createDataFrame([(*d, 7.0) for d in data], "vec_id long, x array<double>, base double")
    trees = tree_shap.covered([tree], df.filter("vec_id <> 3"), "x")
    assert (trees[0].nodes[0].cover, trees[0].nodes[6].cover) == (3, 0)
    got = {r.vec_id: r for r in tree_shap.contributions(df, trees, "x", 3).collect()}
    assert got[4].contributions is None and got[3].margin == -2.0
    for i, x in data:
        if x:
            assert got[i].contributions == pytest.approx(brute_contributions(trees, np.array(x), 3), abs=1e-12)
    assert tree_shap.contributions(df.limit(0), trees, "x", 3).count() == 0


def plain_loss(loss, y, p):
    p = np.clip(p, 1e-15, 1 - 1e-15)
    if loss == "log_loss":
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    if loss == "brier":
        return float(((p - y) ** 2).mean())
    yes = p >= 0.5
    if loss == "neg_accuracy":
        return -float((yes == (y == 1)).mean())
    return -float(2 * (yes & (y == 1)).sum() / max(yes.sum() + (y == 1).sum(), 1))


@pytest.mark.parametrize("seed", [0, 1])
def test_weights_are_no_worse_than_any_grid(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 150)
    s = np.clip(np.stack([0.5 + (y - 0.5) * g + rng.normal(0, 0.3, 150) for g in (0.5, 0.3, 0.0)], axis=1), 0, 1)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, s, strict=True)] + [(None, 0.1, 0.2, 0.3), (1, None, 0.2, 0.3)], "y int, a double, b double, c double")
    found = {r.loss: r for r in weight_fit.fit(df, "y", ["a", "b", "c"]).collect()}
    fine = [np.array(w) for w in ensembles.simplex(3, 40)]
    for loss, r in found.items():
        w = np.array(r.weights)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        assert r.value == pytest.approx(plain_loss(loss, y, s @ w), abs=1e-12)
        assert r.value <= r.grid_value
        if loss in weight_fit.SMOOTH:
            assert r.value <= min(plain_loss(loss, y, s @ g) for g in fine) + 1e-9
        else:
            # no exchange between two scores is better
            for i, j in combinations(range(3), 2):
                for t in np.linspace(-w[i], w[j], 400):
                    other = w.copy()
                    other[[i, j]] += [t, -t]
                    assert r.value <= plain_loss(loss, y, s @ other) + 1e-12


def test_weights_of_out_of_fold_scores_and_of_nothing(spark):
    rows = spark.createDataFrame(rows_for(3, 300), "vec_id long, x array<double>, label int")
    v = relational.folds(models.assemble(rows, array_col="x"), "label", "vec_id", 3)
    a = models.cross_validate(v, C.LogisticRegression(labelCol="label"), 3, keep=["vec_id"]).withColumnRenamed("p", "a")
    b = models.cross_validate(v, C.DecisionTreeClassifier(labelCol="label", maxDepth=3), 3, keep=["vec_id"]).select("vec_id", F.col("p").alias("b"))
    for r in weight_fit.fit(a.join(b, "vec_id"), "label", ["a", "b"]).collect():
        assert r.value <= r.grid_value
    empty = weight_fit.fit(a.join(b, "vec_id").limit(0), "label", ["a", "b"]).collect()
    assert all(r.value is None and r.weights == [0.5, 0.5] for r in empty)


def standard_category(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return "none"
    return "private" if ip.is_private else "reserved" if ip.is_reserved else "loopback" if ip.is_loopback else "public"


def address_texts(seed, n=3000):
    rng = random.Random(seed)
    out = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "::", "::1", "1::", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "12345::", "g::", "1::2::3", ":1::", "1:", "::ffff:1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "fe80::1%", "1.2.3.4%x", "[::1]", "2001:DB8::A", "example.com", "1.2.3.4/8", "::1%a%b"]
    blocks = [ipaddress.ip_network(c) for v in N.SPECIAL.values() for c in v]
    for _ in range(n):
        if rng.random() < 0.5:
            net = rng.choice(blocks)
            span = net.num_addresses
            at = int(net.network_address) + rng.choice([0, span - 1, rng.randrange(span), -1, span])
            bits = 32 if net.version == 4 else 128
            out.append(str((ipaddress.IPv4Address if bits == 32 else ipaddress.IPv6Address)(at % (1 << bits))))
        elif rng.random() < 0.5:
            out.append(".".join(str(rng.randrange(256)) for _ in range(4)))
        else:
            ip = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))
            out.append(rng.choice([str(ip), ip.exploded]))
    return out


def test_categories_and_numbers_are_those_of_the_standard_library(spark):
    texts = address_texts(1)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.category(F.col("t")).alias("c"), N.address(F.col("t")).alias("a"), U.ip_category(F.col("t")).alias("u")).distinct().collect()
    assert len(got) == len(set(texts))
    for r in got:
        assert (r.t, r.c) == (r.t, standard_category(r.t)) and r.u == r.c
        try:
            ip = ipaddress.ip_address(r.t)
            assert (r.a.family, r.a.high, r.a.low) == (ip.version, *N.halves(int(ip)))
        except ValueError:
            assert r.a is None


@pytest.mark.parametrize("most", [200_000, 3])
def test_longest_prefix_against_all_networks(spark, monkeypatch, most):
    monkeypatch.setattr(networks, "MAX_BROADCAST", most)
    rng, nets = random.Random(5), []
    for i in range(150):
        four = rng.random() < 0.5
        base, length = (rng.randrange(1 << 10) << 22, rng.randint(0, 32)) if four else (rng.randrange(1 << 12) << 116, rng.choice([0, 4, 12, 13, 48, 64, 65, 128]))
        nets.append((str(ipaddress.ip_network((base, length), strict=False)), i))
    nets += [("nonsense", 900), ("1.2.3.4/33", 901), (None, 902), (nets[0][0], 903)]
    hosts = [str(ipaddress.IPv4Address(rng.randrange(1 << 32))) for _ in range(300)] + [str(ipaddress.IPv6Address(rng.randrange(1 << 12) << 116 | rng.randrange(4))) for _ in range(300)] + ["x", None]
    table = spark.createDataFrame(nets, "cidr string, n long")
    got = {r.ip: (r.cidr, r.n) for r in networks.longest_prefix(spark.createDataFrame([(h, 1) for h in hosts + hosts[:9]], "ip string, n int"), table).collect()}
    known = [(ipaddress.ip_network(c), c, n) for c, n in nets[:150]]
    for h in hosts[:-2]:
        ip = ipaddress.ip_address(h)
        held = [(net.prefixlen, c) for net, c, n in known if net.version == ip.version and ip in net]
        assert (got[h][0] if h in got else None) == (max(held)[1] if held else None)
    assert not {"x", None} & set(got)
    assert networks.longest_prefix(spark.createDataFrame([("1.1.1.1",)], "ip string"), table.limit(0)).count() == 0


def test_hosts_that_are_addresses_have_themselves_only(spark):
    table = spark.createDataFrame([("10.0.0.0/8", 1, "a", "x"), ("10.1.0.0/16", 2, "b", "y"), ("2001:db8::/32", 3, "c", "z")], "cidr string, asn long, asn_org string, asn_country string")
    hosts = spark.createDataFrame([("h", ["10.1.1.1", "10.2.2.2", None, "10.1.1.1", "8.8.8.8"]), ("10.9.9.9", ["2001:db8::1"]), ("2001:db8::5", None), ("e", [])], "host string, ips array<string>")
    got = {r.host: r for r in networks.host_networks(hosts, table).collect()}
    assert (got["h"].num_distinct_ips, got["h"].asn_list, got["h"].cidr_list) == (3, [2, 1, None], ["10.1.0.0/16", "10.0.0.0/8", None])
    assert (got["10.9.9.9"].num_distinct_ips, got["10.9.9.9"].asn_org_list) == (1, ["a"])
    assert got["2001:db8::5"].asn_country_list == ["z"]
    assert (got["e"].num_distinct_ips, got["e"].cidr_list) == (0, [])


@pytest.mark.parametrize(("small", "accuracy"), [(200_000, 100_000), (0, 300)])
def test_percentiles_from_slices(spark, monkeypatch, small, accuracy):
    """Whole groups and slices between sketched bounds give the same, exact percentiles."""
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=4000), "b": rng.integers(0, 5, 3000).astype(float), None: np.full(3000, 7.0), "c": np.concatenate([rng.exponential(size=5000), [1e9, -1e9]])}
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r.g: r for r in ranks.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert [got[g][k] for k in shares] == pytest.approx([np.quantile(values, q) for q in shares.values()], rel=1e-12)
    one = ranks.percentiles(df, [], "v", {"m": 0.5}).collect()
    assert one[0].m == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    assert ranks.percentiles(df.limit(0), ["g"], "v", shares).count() == 0
