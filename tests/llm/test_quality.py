"""Quality classifier and rules: base columns against plain Python, learning, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from docspark.llm import quality_gam, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, n_words string, base_failed int, lang string"


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(1, 8)))
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        ws = [word() for _ in range(rnd.randrange(25, 120))]
        if kind == 1:
            ws = [w.upper() + "!!" for w in ws]
        elif kind == 2:
            ws = [x for w in ws for x in [w] * 12]
        text = " ".join(ws) if i % 3 else "\n".join(" ".join(ws[k : k + 6]) for k in range(0, len(ws), 6))
        rows.append((i, text))
        labels.append((i, int(kind in (0, 3)), i % 2))
    rows += [(None, None), (500, ""), (500, ""), (501, None), (502, "x"), (503, "long " * 30_000), (504, "a b\n\na b\n \na b\n"), (505, "#*$%&|<> é")]
    labels += [(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 1, 0), (5, 0, 0), (9999, 0, 0)]
    return rows, labels


def tables(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "s", "n", 1, "en") for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = {i + j for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(ws) < 20 or 100 * len(cover) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)


def test_rules_query_equals_plain_python(spark, tmp_path):
    rows, labels = corpus()
    got = queries.op9_quality_rules(spark, tables(spark, tmp_path, rows, labels)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *base(t)) for i, t in rows)
    assert all(not r.kept for r in got if r.base_failed) and all(r.kept == (not r.base_failed and r.rule is None) for r in got)
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 400}
    assert all(kept[i] == (i % 4 in (0, 3)) for i in kept)


def test_classifier_query(spark, tmp_path):
    rows, labels = corpus()
    got = queries.op4_quality_classifier(spark, tables(spark, tmp_path, rows, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 in (0, 3)) for r in held) >= 0.97 * len(held)


def plain_score(text, model):
    """A score by loops over characters and words, from the model's tables alone."""
    import bisect
    import math

    text = text or ""
    ws, marks = WORD.findall(text), set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = base(text)
    small, large = set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    counts = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "n_chars": len(text), "n_lines": sum(1 for x in text.split("\n") if WORD.search(x)),
        "n_digits": sum(c in "0123456789" for c in text), "n_punctuation": sum(c in marks for c in text),
        "n_letters": sum(c in small or c in large or ord(c) > 127 for c in text),
        "n_distinct_words": len(set(ws)), "n_same_words": sum(a == b for a, b in zip(ws, ws[1:], strict=False)),
        "n_marked_words": sum(w[-1] in marks and w[-1] not in ".," for w in ws),
        "n_upper_words": sum(bool(set(w) & large) and not set(w) & small for w in ws),
    }
    x = [counts[a] / max(counts[b], 1) if b else math.log1p(counts[a]) for a, b in quality_rules.RATIOS.values()]
    z = model.base + sum(float(t[bisect.bisect_left(list(e), v)]) for t, e, v in zip(model.tables, model.edges, x, strict=True))
    cell = lambda j: bisect.bisect_left(list(model.coarse[j]), x[j])
    return 1 / (1 + math.exp(-z - sum(float(t[cell(a), cell(b)]) for (a, b), t in model.pairs.items())))


def test_classifier_query_equals_plain_scores(spark, tmp_path):
    rows, labels = corpus()
    rows += [(600, "Aé ÉA AB ab. AB, AB! x_ 12 #a"), (601, "same same SAME same\n\n1")]
    folder = tables(spark, tmp_path, rows, labels)
    model = quality_gam.fit_quality(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")))
    got = sorted((str(r.doc_id), round(r.score, 9)) for r in queries.op4_quality_classifier(spark, folder).collect())
    assert model.pairs and got == sorted((str(i), round(plain_score(t, model), 9)) for i, t in rows)


def test_held_out_labels_are_not_learned(spark, tmp_path):
    rows, labels = corpus()
    first = queries.op4_quality_classifier(spark, tables(spark, tmp_path / "a", rows, labels)).collect()
    turned = [(i, 1 - q if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    second = queries.op4_quality_classifier(spark, tables(spark, tmp_path / "b", rows, turned)).collect()
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, first)) == sorted(map(key, second))


def test_no_rows_no_labels_one_class(spark, tmp_path):
    rows, labels = corpus()
    for k, (r, lab) in enumerate((([], []), ([], labels), (rows[:5], []), (rows[:5], [(0, 1, 0), (3, 1, 0)]))):
        folder = tables(spark, tmp_path / str(k), r, lab)
        assert queries.op4_quality_classifier(spark, folder).count() == queries.op9_quality_rules(spark, folder).count() == len(r)


def test_tables_add_up_and_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_rules.RATIOS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x, y)
    assert (0, 1) in m.pairs or (1, 0) in m.pairs
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    assert quality_gam.Gam(0.0).score(x[:2]).tolist() == [0.5, 0.5]


def test_rule_lists_cover_in_order(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    stats = pd.DataFrame({c: rng.integers(1, 100, 2000) for c in {b for p in quality_rules.RATIOS.values() for b in p if b}})
    bad = (quality_rules.ratios(stats)["symbol_ratio"] > 1.5).to_numpy() | (stats["n_words"] < 5).to_numpy()
    rules = quality_rules.learn_rules(stats, bad)
    hit = np.zeros(len(stats), bool)
    for r in rules:
        hit |= quality_rules.covers(r, quality_rules.ratios(stats))
    assert rules and (hit == bad).mean() > 0.97
    df = spark.createDataFrame(stats).withColumns({"ok": quality_rules.rules_expression(rules), "n": quality_rules.rule_number(rules)})
    got = df.select("ok", "n").toPandas()
    assert (got["ok"].to_numpy() == ~hit).all() and (got["n"].notna().to_numpy() == hit).all()
