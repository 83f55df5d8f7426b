"""The pipeline's stages against brute force, with nulls, repeated rows and ids, clashing names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import decontaminate, language_id, line_dedup

from .test_llm import WORD, shingles, table

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], FIELDS)


def benchmark(spark, tmp_path, items):
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect())


def plain(rows):
    return sorted((i is None, i or 0, t is None, t or "") for i, t in rows)


def test_unique_texts_under_one_id_stay(spark):
    """Rows with a repeated or null id go by their text, not by their id."""
    rnd = random.Random(1)
    a, b, c = (" ".join(f"n{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    docs = documents(spark, [(1, a, "en"), (5, a, "en"), (5, b, "en"), (None, a, "en"), (None, c, "en"), (7, None, "en")])
    assert rows_of(STAGES["minhash_dedup"](spark, docs, "")) == plain([(1, a), (5, b), (None, c), (7, None)])


@pytest.mark.parametrize("name", ["gone__", "bad__", "body__", "id__", "score", "lang_pred", "n_lines", "n_removed", "body", "h", "w", "kept", "GONE__"])
def test_columns_of_any_name_stay(spark, tmp_path, name):
    """No stage takes a further column for one of its own; each but the last returns it unchanged."""
    docs = documents(spark, [(1, "some words in a line\nand more of them", "en"), (2, None, None)]).withColumn(name, F.lit("mine"))
    sf = benchmark(spark, tmp_path, ["nothing of this is there at all"])
    out = docs
    for key, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns, key
        assert [r[name] for r in out.collect()] == ["mine"], key
    assert STAGES["byte_bpe"](spark, out, sf).count() == 1


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrs')}{rnd.choice('aeiou')}{i}x" for i in range(900)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    runs = ["\n".join(line(8) for _ in range(4)) for _ in range(4)]
    items = [line(12), line(30), line(3)]
    rows = []
    for i in range(70):
        parts = ["\n".join(line(9) for _ in range(rnd.randint(3, 8)))]
        if rnd.random() < 0.3:
            parts.insert(rnd.randrange(2), rnd.choice(runs))
        if rnd.random() < 0.12:
            parts.append(rnd.choice(items))
        if rows and rnd.random() < 0.15:
            parts = [(rows[rnd.randrange(len(rows))][1] or "x") + " " + line(1)]
        rows.append((i, "\n".join(parts), "xx"))
    rows += [(100, None, "xx"), (101, "", None), (102, "12 !? 34", "xx"), (103, rows[5][1], None), (5, *rows[5][1:])]
    sf = benchmark(spark, tmp_path, items)
    docs = documents(spark, rows)

    found = STAGES["language_id"](spark, docs, sf).cache()
    want = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    assert rows_of(found) == plain(want)
    assert found.where("lang is null").count() == 0

    lined = STAGES["line_dedup"](spark, found, sf).cache()
    gone, seen = {}, {}
    for i, t in sorted(set(want)):
        bare = [(n, x.strip(" \t\x0b\x0c\r")) for n, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")]
        for k in (1, 2, 3):
            for at in range(len(bare) - k + 1):
                run = tuple(x for _, x in bare[at : at + k])
                if k == 3 or sum(len(WORD.findall(x)) for x in run) >= 50:
                    if run in seen:
                        gone.setdefault((i, t), set()).update(n for n, _ in bare[at : at + k])
                    seen.setdefault(run, (i, at))
    cut = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), ()))) for i, t in want]
    assert gone and rows_of(lined) == plain(cut)

    near = STAGES["minhash_dedup"](spark, lined, sf).cache()
    sets = [shingles(t) for _, t in cut]
    root = list(range(len(cut)))
    for _ in cut:
        for x in range(len(cut)):
            for y in range(x):
                if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    least = {r: min(cut[j][0] for j in range(len(cut)) if root[j] == r) for r in set(root)}
    kept = [cut[j] for j in range(len(cut)) if cut[j][0] == least[root[j]]]
    assert len(kept) < len(cut) and rows_of(near) == plain(kept)

    clean = STAGES["decontaminate"](spark, near, sf)
    holds = lambda t: any(100 * len(s & shingles_of(t, min(5, len(q.split())))) >= 80 * len(s) for q in items if (s := shingles_of(q, min(5, len(q.split())))))
    left = [(i, t) for i, t in kept if not holds(t)]
    assert len(left) < len(kept) and rows_of(clean) == plain(left)


def shingles_of(text, size):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_empty_table(spark, tmp_path):
    sf = benchmark(spark, tmp_path, ["a b c d e f"])
    docs = documents(spark, [(1, "x", "en")]).limit(0)
    for key, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, key


def test_operators_that_carry_columns(spark):
    docs = documents(spark, [(1, "some words here", "en"), (1, "some words here", "en"), (None, "a\nb\nc", None)]).withColumns({"score": F.lit(1), "n_lines": F.lit("x")})
    told = language_id.annotate(docs, language_id.fit(docs, F.lit(True)))
    assert told.columns == [*docs.columns, "lang_pred", "score_"] and told.count() == 3
    lined = line_dedup.dedup(docs)
    assert lined.columns == [*docs.columns, "n_lines_", "n_removed"] and lined.count() == 3
    assert decontaminate.clean(docs, spark.createDataFrame([(None, "some words here")], "item_id long, text string")).columns == docs.columns
