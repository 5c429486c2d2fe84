import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docspark.llm import decontaminate as d
from docspark.llm.textcore import slices, words


def material(seed=4):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "é"]
    rare = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(600)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else rnd.choice(rare)
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + ". "
    items = [(i, sentence(rnd.randrange(8, 20)) + sentence(rnd.randrange(8, 20))) for i in range(60)]
    docs = [(i, sentence(rnd.randrange(1, 400))) for i in range(80)]
    return rnd, items, docs, sentence


TOKEN = re.compile("[a-z0-9\x80-\U0010ffff]+")


def brute(items, texts, threshold):
    """BM25 of every passage against every item, from the raw texts."""
    words_of = {i: TOKEN.findall(t.lower()) for i, t in items}
    df = Counter(w for ws in words_of.values() for w in set(ws))
    mean = sum(map(len, words_of.values())) / len(items)
    length = max(64, *map(len, words_of.values()))
    own = {}
    for i, ws in words_of.items():
        idf = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) for w in ws}
        v = {w: idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, tf in Counter(ws).items()}
        own[i] = {w: x / sum(v.values()) for w, x in v.items()}
    out = {}
    for doc, t in enumerate(texts):
        ws = TOKEN.findall(t.lower())
        for a in range(0, max(len(ws) - length, 1), length):
            have = set(ws[a : a + 2 * length])
            for i, v in own.items():
                score = sum(x for w, x in v.items() if w in have)
                if score >= threshold:
                    out[doc, i] = max(out.get((doc, i), 0), round(score, 6))
    return out


def found(df):
    return {(r.doc_id, x.item_id): round(x.score, 6) for r in df.collect() for x in r.leaks}


def test_search_finds_all_that_brute_force_finds_however_items_are_dealt(spark):
    rnd, items, docs, sentence = material()
    texts = [t + items[rnd.randrange(60)][1] + t if i % 3 == 0 else t for i, (_, t) in enumerate(docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    for threshold in (0.26, 0.35, 0.6):
        want = brute(items, texts, threshold)
        assert len(want) >= 26
        for words_of_index in (10**9, 300, 1) if threshold == 0.35 else (10**9,):
            assert found(d.find_leaks(df, it, threshold=threshold, overlap=0.0, words_of_index=words_of_index)) == want


def test_short_items_count_where_their_words_stand_in_a_row(spark):
    rows = [(1, "A b, c! d"), (2, "a c b"), (3, "x a\nB c"), (4, None), (5, "zu 東京タワー行く"), (6, "東 京"), (7, "yes"), (8, "a-b-c a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "A B C."), (3, "京タ"), (4, "Yes?"), (5, " "), (None, "a")], "item_id long, text string")
    got = {r.doc_id: [(x.item_id, x.score, x.overlap) for x in r.leaks] for r in d.find_leaks(docs, items).collect()}
    both = [(1, 1.0, 1.0), (2, 1.0, 1.0)]
    assert got == {1: both, 2: [], 3: both, 4: [], 5: [(3, 1.0, 1.0)], 6: [], 7: [(4, 1.0, 1.0)], 8: both}


def test_leaks_whole_and_clean(spark):
    rnd, items, docs, sentence = material()
    rows, want = [], {}
    for i, t in docs:
        if i % 4 == 0:
            leak = items[i % 60]
            text = leak[1] if i % 8 else " ".join(x.upper() + "!!" for x in leak[1].split())
            t, want[i] = t + text + sentence(30), leak[0]
        rows.append((i, t, "src"))
    rows += [(900, None, ""), (901, "", None), (902, "the of and", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    it = spark.createDataFrame([(*x, 1) for x in items] + [(99, None, 1), (98, "too short", 1)], "item_id long, text string, doc_id int")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in d.find_leaks(df, it).collect()}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v} == {k: [v] for k, v in want.items()}
    assert all(not r.leaks for r in d.find_leaks(df, it.limit(0)).collect())
    assert d.find_leaks(df.limit(0), it).count() == 0


def test_registered_query_finds_the_planted_passages(spark):
    """op10 over sf0.001 against plain Python: documents that hold an item, word for word."""
    from docspark.llm.queries import op10_decontamination

    got = {r.doc_id: set(filter(None, r.item_ids.split(","))) for r in op10_decontamination(spark, "/root/testdata/sf0.001").collect()}
    read = lambda name, k: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(k, "text").collect()
    plain = lambda t: " " + " ".join(TOKEN.findall((t or "").lower())) + " "
    items = [(str(i), plain(t)) for i, t in read("benchmark", "item_id")]
    docs = {i: plain(t) for i, t in read("documents", "doc_id")}
    assert got.keys() == docs.keys() and any(got.values())
    assert all(i in got[k] for k, t in docs.items() for i, x in items if x in t)


def test_passages_cover_runs():
    s = next(slices(pa.array(["w " * 500, "", "a"])))
    doc, a, b = d.passages(words(s), 64)
    assert all(any(x <= i and i + 64 <= y for x, y, k in zip(a, b, doc) if k == 0) for i in range(437))
    assert doc.tolist().count(1) == 0 and np.all(b[doc == 2] - a[doc == 2] == 1)
