"""Estimates against all subsets, pages against a plain reading of their own structure, and edge cases of several operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, html_extract, quality_classifier, quality_rules, secret_scan, substring_dedup

from .test_llm import table


def test_minimum_covariance_determinant_against_all_subsets(spark):
    """Of all subsets of a group the estimate rests on the one whose covariance has the least determinant."""
    rnd = np.random.default_rng(4)
    n, more = 14, np.diag(np.square(quality_rules._FLOOR))
    groups = {}
    for g in range(10):
        mixing = rnd.normal(0, 1, (5, 5))
        x = rnd.normal(0, 1, (n, 5)) @ mixing + rnd.normal(0, 3, 5)
        x[: g % 4] += rnd.normal(0, 1, 5) * 30 + 20
        groups[f"g{g}"] = x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "grp string, z1 double, z2 double, z3 double, z4 double, z5 double")
    got = {r.grp: r for r in quality_rules.estimates(rows).collect()}
    exact, close = 0, 0
    size = int(np.ceil(quality_rules.SUPPORT * n))
    for g, x in groups.items():
        best = min((np.linalg.slogdet(np.cov(s.T, bias=True) * quality_rules.CONSISTENCY + more)[1], k) for k, c in enumerate(itertools.combinations(range(n), size)) if len(s := x[list(c)]))
        chosen = x[list(next(itertools.islice(itertools.combinations(range(n), size), best[1], None)))]
        r = got[g]
        centre = np.array([r[f"m{i}"] for i in range(5)])
        cov = np.array([[r[f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
        exact += np.allclose(centre, chosen.mean(axis=0)) and np.allclose(cov, np.cov(chosen.T, bias=True) * quality_rules.CONSISTENCY)
        close += np.linalg.slogdet(cov + more)[1] <= best[0] + 1.5
        outliers = x[: int(g[1:]) % 4]
        far = [(v - centre) @ np.linalg.inv(cov + more) @ (v - centre) for v in outliers]
        assert all(d > quality_rules.cutoff() for d in far), g
    assert close == len(groups) and exact >= len(groups) // 2, (exact, close)


def pages(rnd, n):
    """Pages whose article is known: blocks of sentences among menus, adverts, notices, forms and comments."""
    words = ["alpha", "river", "stone", "market", "quiet", "window", "letter", "garden", "summer", "engine", "paper", "bridge"]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(9, 22))).capitalize() + "."
    out = []
    for k in range(n):
        blocks = [" ".join(sentence() for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(3, 7))]
        links = "".join(f'<li><a href="/{i}">{rnd.choice(words)}</a></li>' for i in range(rnd.randint(4, 9)))
        body = "".join(f"<p>{b.replace('river', 'ri&#118;er')}</p>\n" for b in blocks)
        html = f"""<html><head><title>t</title><style>p {{ color: red }}</style></head><body><header><h1>Site</h1><nav><ul>{links}</ul></nav></header>
<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><main><article>{body}</article></main>
<aside class="sidebar"><h3>More</h3><ul>{links}</ul></aside><div class="ad"><p>Buy now</p></div>
<section id="comments"><div class="comment"><p>Nice one, thanks a lot</p></div></section><form><input name="q"><label>Search</label></form>
<footer><p>&copy; 2024 Site</p></footer><script>var x = "<p>no</p>";</script></body></html>"""
        out.append((k, html, "\n\n".join(blocks)))
    return out


def test_articles_are_found_whole(spark):
    made = pages(random.Random(6), 60)
    docs = spark.createDataFrame([(k, f"http://x/{k}", html, "mine", 1) for k, html, _ in made], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_extract.extract(docs).collect()}
    right = sum(got[k].text == want for k, _, want in made)
    assert right >= 0.9 * len(made), right
    assert all(got[k].n_chars == len(got[k].text) for k, _, _ in made)


def test_pages_of_repeated_ids_nulls_and_none(spark):
    made = pages(random.Random(7), 12)
    rows = [(None if k % 3 == 0 else 5, None if k % 2 else "u", html) for k, html, _ in made] + [(1, "u", None), (1, "u", ""), (1, "u", "<p"), (5, "u", made[1][1])]
    schema = "page_id long, url string, html string"
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    alone = {html: t for (_, html, _), t in zip(made, (r.text for r in html_extract.extract(spark.createDataFrame([(k, "u", h) for k, h, _ in made], schema)).orderBy("page_id").collect()), strict=True)}
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.page_id == 5) == sorted(alone[h] for i, _, h in rows if i == 5)
    assert [r.text for r in got if r.page_id == 1][:2] == ["", ""] and sum(r.page_id is None for r in got) == 4
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []


def test_items_and_documents_without_ids(spark):
    item = "one two three four five six seven eight"
    docs = table(spark, [f"a b {item} c", "x " + item, "nothing here at all of it"], [None, None, 3])
    found = decontaminate.contained(docs, spark.createDataFrame([(None, item), (4, item), (5, None), (6, "")], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) in ([("None", "4")] * 2 + [("None", "None")] * 2, [("None", "4"), ("None", "None")])
    assert [r.doc_id for r in decontaminate.clean(docs, spark.createDataFrame([(None, item)], "item_id long, text string")).collect()] == [3]


def test_columns_named_as_the_operators_own(spark):
    docs = spark.createDataFrame([(1, "some words token=abcdefghijklmnop", "en", "s", 9), (2, "other words here", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *(F.lit("mine").alias(c) for c in ("base", "spans", "tokens", "kind0", "p_content", "quality", "kept", "body", "sure", "view", "c", "m")))
    assert sorted(map(str, secret_scan.scan(clash).collect())) == sorted(map(str, secret_scan.scan(docs).collect()))
    labels = spark.createDataFrame([(1, 1, "x", "y"), (2, 0, "x", "y")], "doc_id long, quality int, text string, id string")
    assert sorted(map(str, quality_classifier.classify(clash, labels).collect())) == sorted(map(str, quality_classifier.classify(docs, labels.select("doc_id", "quality")).collect()))


@pytest.mark.parametrize(("limit", "bands"), [(1, (8, 1)), (2, (40, 3)), (1, (1,))])
def test_substring_shards_dealt_by_places(spark, monkeypatch, limit, bands):
    """Large shards give the same, however they are dealt; texts that repeat themselves and near copies among them."""
    monkeypatch.setattr(substring_dedup, "BANDS", bands)
    rnd = random.Random(37)
    words = [f"w{i}" for i in range(2000)]
    base = [rnd.choice(words) for _ in range(150)]
    texts = ["rep " * 130, "a b c " * 50, "a b c " * 30 + "d", None, ""]
    for _ in range(40):
        t = list(base)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join([rnd.choice(words) for _ in range(rnd.randint(0, 9))] + t[rnd.randint(0, 40) :]))
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(table(spark, texts)).collect()}
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(table(spark, texts), shard_limit=limit).collect()}
    assert got == want and sum(n > 0 for n, _ in got.values()) > 30
