"""Mixing, shards, vectors, pages and urls against brute force, with the odd rows."""

import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookfeel.llm import components, host_trust, html_text, mixing, near_vectors, sharding
from bookfeel.llm.queries import URL_RULES


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdef", k=3)) for _ in range(n))


def mixed_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _m_row int, taken int")


def water_fill(sizes, most=3):
    """Targets by repeated sharing; ``sizes`` by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("block", [256, 16])
def test_mix(spark, block):
    draw, rows = random.Random(2), []
    for i in range(400):
        source = "hot" if i % 3 == 0 else draw.choice(["a", "B", "é", "tiny", None]) if i % 50 else "rare"
        rows.append((i, words(draw.choice([0, 1, 5, 40, 300, 2500 if i % 90 == 0 else 20]), i), source, 1, 2, 3))
    rows += [rows[5], (None, None, None, None, None, None), (7, None, "only empty", 0, 0, 0)]
    docs = mixed_docs(spark, rows)
    plan = mixing.mix(docs, block=block)
    found = mixing.taken(plan).collect()
    assert len(found) == len(rows)
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target, taken = water_fill(size), dict.fromkeys(size, 0)
    for r in found:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in size)
    order = ["doc_id", "text", "taken"]
    again = mixing.taken(mixing.mix(docs.repartition(5), block=block))
    assert sorted(map(str, again.select(order).collect())) == sorted(map(str, mixing.taken(plan).select(order).collect()))
    # The schedule takes the same words, and spreads each source over the whole mix.
    parts = mixing.sequence(plan)
    by_doc = {r[0]: r[1] for r in parts.where("doc_id > 5").groupBy("doc_id").sum("words").collect()}
    assert all(by_doc.get(r["doc_id"], 0) == r["taken"] for r in found if (r["doc_id"] or 0) > 7)
    slots = [r["slot"] for r in parts.where("source = 'hot'").select("slot").distinct().orderBy("slot").collect()]
    n = parts.agg(F.max("slot")).first()[0] + 1
    assert np.abs(np.array(slots) / n - np.linspace(0, 1, len(slots))).max() < 0.15
    # One schedule, whatever the partitions; rows that are equal in key and text stand for one another.
    parallel = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    other = mixing.sequence(mixing.mix(docs.repartition(3), block=block))
    assert sorted(map(str, other.collect())) == sorted(map(str, parts.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", parallel)
    whole = mixing.repeated(plan)
    assert whole.columns == docs.columns
    longest = max(len((r[1] or "").split()) for r in rows)
    sums = {}
    for r in whole.collect():
        sums[r["source"]] = sums.get(r["source"], 0) + len((r["text"] or "").split())
    assert all(abs(sums.get(s, 0) - target[s]) <= longest for s in size)
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0


def test_shards(spark):
    draw, rows = random.Random(4), []
    for i in range(3000):
        text = "copy of a third" if i % 3 == 0 else words(draw.randint(0, 40), i % 700)
        rows.append((i, text, "x", 5, None))
    rows += [(None, None, None, None, None), (4, "twice", "y", 1, 1), (4, "twice", "y", 1, 1), (9999, words(2000, 1), None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, _s_hash int")
    text = F.coalesce("text", F.lit(""))
    how = dict(group=text, ident=F.col("doc_id"), size=F.octet_length(text) + 1, shards=16)
    keep = {"doc_id": F.col("doc_id"), "crc": F.crc32(text)}
    df = sharding.shard(docs, keep=keep, **how)
    assert "Python" not in plan_text(df)
    found = df.collect()
    assert len(found) == len(rows)
    size = {}
    for k in range(16):
        own = [r for r in found if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        size[k] = sum(r["size"] for r in own)
    mean, longest = sum(size.values()) / 16, max(r["size"] for r in found)
    assert all(abs(x - mean) <= longest + 0.04 * mean for x in size.values())
    # Copies stay together, but for groups that fill a good part of a shard.
    shards = {}
    for r in found:
        shards.setdefault(r["crc"], set()).add(r["shard"])
    hot = zlib.crc32(b"copy of a third")
    assert len(shards.pop(hot)) > 1 and all(len(x) == 1 for x in shards.values())
    key = lambda r: (str(r["doc_id"]), r["crc"], r["shard"], r["slot"])
    assert sorted(map(key, sharding.shard(docs.repartition(7), keep=keep, **how).collect())) == sorted(map(key, found))
    assert sharding.shard(docs.limit(0), keep=keep, **how).count() == 0
    one = sharding.shard(docs.where("doc_id = 4 AND text = 'twice'"), keep=keep, **how)
    assert one.count() == 2


def test_shard_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, words(5, i)) for i in range(200)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), group=F.col("text"), ident=F.col("doc_id"),
                          size=F.octet_length("text"), shards=4, keep={"doc_id": F.col("doc_id"), "text": F.col("text")})
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


@pytest.mark.parametrize("broadcast", [True, False])
def test_components(spark, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    draw = random.Random(6)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 5000 + i) for i in range(300)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r["node"], r["root"]) for r in found.collect()} == {(x, root(x)) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows():
    draw = np.random.default_rng(9)
    x = list(draw.standard_normal((500, 64)))
    for i in range(200):
        x.append(x[i % 40] * draw.uniform(0.1, 9) + draw.standard_normal(64) * draw.uniform(0, 0.3))
    centre = draw.standard_normal(64)
    x += [centre + draw.standard_normal(64) * 0.15 for _ in range(300)]  # one dense cluster
    x += [x[3], x[3], x[4]]
    rows = [(i, [float(v) for v in np.float32(v)], 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [None] + [1.0] * 63, 0),
             (n + 4, [float("inf")] + [1.0] * 63, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], None), (n + 7, [2.0, 4.0], 2),
             (None, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("block", [4096, 100])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = vector_rows()
    n = len(rows) - 9
    x = np.array([r[1] for r in rows[:n]] + [rows[-1][1]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(n + 1)
    for _ in range(n):
        new = np.where(linked, root[None, :], root[:, None]).min(axis=1)
        new = np.minimum(new, root)
        if (new == root).all():
            break
        root = new
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = near_vectors.near_vectors(vectors)
    found = {r["vec_id"]: r for r in df.collect()}
    assert len(found) == len(rows)
    for i in range(n):
        assert found[i]["n_links"] == linked[i].sum() and found[i]["component_id"] == root[i]
        assert found[i]["kept"] == (root[i] == i)
    for i in range(n, n + 6):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert found[n + 7]["component_id"] == n + 6 and found[n + 6]["n_links"] == 1
    assert found[None]["n_links"] == linked[n].sum() and found[None]["component_id"] == 0 and not found[None]["kept"]
    assert near_vectors.near_vectors(vectors.limit(0)).count() == 0
    m, half, need = near_vectors.calibrated(0.95, 64)
    assert m == near_vectors.DIRECTIONS and 0 < need < m and half > 0


@pytest.fixture(scope="module")
def page_model():
    return html_text.fit()


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(3)
    parents = np.array([-1, 0, 0, 1, 1, 2, 5])
    levels = [np.array(x) for x in ([0], [1, 2], [3, 4, 5], [6])]
    kinds = draw.integers(0, html_text.KINDS, 7)
    f = html_text.Forest(parents, kinds, np.zeros((7, 1)), levels)
    unary, pair = draw.standard_normal(7), draw.standard_normal((html_text.KINDS, 2, 2))
    weight, one, joint = 0.0, np.zeros(7), np.zeros((7, 2, 2))
    for code in range(1 << 7):
        y = [(code >> i) & 1 for i in range(7)]
        p = np.exp(sum(unary[i] * y[i] for i in range(7)) + sum(pair[kinds[i], y[parents[i]], y[i]] for i in range(1, 7)))
        weight += p
        one += p * np.array(y)
        for i in range(1, 7):
            joint[i, y[parents[i]], y[i]] += p
    p, both = html_text.marginals(f, unary, pair)
    assert p == pytest.approx(one / weight) and both[1:] == pytest.approx(joint[1:] / weight)


def test_page_texts_on_unseen_layouts(page_model):
    pages = [html_text.parse(x, labelled=True) for x in html_text.labelled_pages(150, seed=77)]
    same = 0
    for page, chance in zip(pages, page_model.marginals(pages)):
        same += html_text.main_text(page, chance) == html_text.main_text(page, np.array(page.labels))
    assert same >= 0.9 * len(pages)


def test_pages_of_the_table(spark, page_model):
    def want(source):
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())
                  for b in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(b for b in blocks if b)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "plain &amp; short  text"), (-3, "u", "<div><p>"),
                                 (-4, "u", "<i>" * 3000 + "deep" + "</i>" * 3000)], pages.schema)
    found = html_text.extract(pages.union(odd).withColumn("n_chars", F.lit(1)), page_model).collect()
    assert found[0].__fields__ == ["page_id", "url", "n_chars", "text"]
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(r["text"] == want(sources[r["page_id"]]) for r in found if r["page_id"] >= 0)
    by_id = {r["page_id"]: r["text"] for r in found if r["page_id"] != -3}
    assert by_id[-1] == "" and by_id[-2] == "" and len(found) == len(sources) + 5
    assert "plain & short text" in [r["text"] for r in found if r["page_id"] == -3]
    assert html_text.extract(pages.limit(0), page_model).count() == 0


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/1?x=/es/", "http://example.com/en/a", "http://a.example.com/en/", "http://b.net/es/1#t",
            "http://b.net/en/1", "http://c.net", "x://net/fr/", "ftp://evilcom/", "no scheme/en", None, "", "http:///en/", "http://u@b.net:80/fr/",
            "http://d.org/p", "http://e.org?q://r/s", "a://b://c/d"]
    pages = [(i, u, f'<a href="http://b.net/en/{i}">x</a><A class=k HREF=//t.org/>y</a><a href="/own">z</a>' if i == 13 else None, "x")
             for i, u in enumerate(urls)]
    table = spark.createDataFrame(pages + [pages[0]], "page_id long, url string, html string, host string")
    df = host_trust.judge(table, URL_RULES)
    assert "Python" not in plan_text(df)
    found = df.collect()
    assert len(found) == len(pages) + 1
    for r in found:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].lower(), m[2] if m[2].startswith("/") else "") if m else ("", "")
        fits = [x for x in URL_RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0] + best[1])
        if best:
            assert r["verdict"] == best[2]
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert verdict[4] == "block"  # its host has blocked pages
    assert verdict[13] == "block"  # it links to that host
    assert verdict[9] == verdict[14] == "allow"
    assert host_trust.judge(table.limit(0), URL_RULES).count() == 0


def test_many_hosts_share_a_seeds_distrust(spark):
    own = '<a href="/own">z</a>' * 1000  # the seed's own links take a share too
    pages = [(-1, "http://bad.net/es/1", own), (-2, "http://good.com/", '<a href="http://seen.org/">s</a>'), (-3, "http://far.org/", None)]
    pages += [(i, f"http://h{i}.org/", '<a href="http://bad.net/">x</a>') for i in range(300)]
    # Trusted and with one link of many to the blocked host.
    pages += [(1000, "http://seen.org/", '<a href="http://bad.net/">x</a>')]
    found = host_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert {verdict[i] for i in range(300)} == {"block"} and verdict[-1] == "block"
    assert verdict[-2] == verdict[-3] == verdict[1000] == "allow"


def by_equations(weights, good, bad, damping=0.85):
    """Trust and distrust by linear equations; weight without a way on returns to the seeds."""
    m = np.zeros((len(good), len(good)))
    for (a, b), n in weights.items():
        m[a, b] = n
    out = []
    for links, seed in ((m, good), (m.T, bad)):
        all_out = links.sum(axis=1)
        step = np.where(all_out[:, None] > 0, links / np.maximum(all_out, 1e-9)[:, None], seed[None, :])
        out.append(np.linalg.solve(np.eye(len(seed)) - damping * step.T, (1 - damping) * seed))
    return out


@pytest.mark.parametrize("shape", ["random", "path", "dead ends"])
def test_propagation_equals_equations(spark, shape):
    draw = np.random.default_rng(2)
    n = 12 if shape == "random" else 40
    if shape == "path":
        weights = {(i, i + 1): 1.0 for i in range(n - 1)}  # far more links than a few rounds reach
    else:
        weights = {(int(a), int(b)): float(draw.integers(1, 5)) for a, b in draw.integers(0, n, (40, 2))}
    good, bad = draw.dirichlet(np.ones(n)), draw.dirichlet(np.ones(n))
    if shape == "path":
        good, bad = np.eye(n)[0], np.eye(n)[n - 1]
    trust, distrust = by_equations(weights, good, bad)
    table = spark.createDataFrame([(f"h{a}", f"h{b}", n) for (a, b), n in weights.items()], "a string, b string, n double")
    seeds = spark.createDataFrame([(f"h{i}", float(good[i]), float(bad[i])) for i in range(n)], "host string, good double, bad double")
    found = {int(r["host"][1:]): r for r in host_trust.propagate(table, seeds).collect()}
    assert set(found) == {i for i in range(n) if trust[i] > 0 or distrust[i] > 0}
    for i, r in found.items():
        assert r["trust"] == pytest.approx(trust[i], abs=2e-5) and r["distrust"] == pytest.approx(distrust[i], abs=2e-5)
    assert sum(r["trust"] for r in found.values()) == pytest.approx(1) == sum(r["distrust"] for r in found.values())


def test_verdicts_far_from_the_seeds(spark):
    # A chain of forty links ends at a blocked page: the first host in it is as suspect as the last.
    pages = [(i, f"http://h{i}.org/", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(40)]
    pages += [(40, "http://h40.org/", '<a href="http://bad.net/">x</a>'), (41, "http://bad.net/es/", None), (42, "http://z.org/", None)]
    found = host_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert {verdict[i] for i in range(42)} == {"block"} and verdict[42] == "allow"
    none = host_trust.propagate(spark.createDataFrame([], "a string, b string, n double"),
                                spark.createDataFrame([("a", 0.0, 0.0)], "host string, good double, bad double"))
    assert none.count() == 0
