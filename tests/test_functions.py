"""Text and geometry functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from docspark.functions import geometry, text
from docspark.operators import evaluation
from docspark.sources.papers import fetchable, is_private_address


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[1] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    rows = ["", "a", "w " * 10, "w " * 394, "w " * 395]
    assert values(spark, rows, text.approx_tokens) == [1, 1, 13, 512, 513]


def test_sentences(spark):
    rows = ["One. Two!  “Three” end. four. 12 Five? Six", "", "  no break  ", "A. 1 B."]
    assert values(spark, rows, text.sentences) == [["One.", "Two!", "“Three” end. four. 12 Five?", "Six"], [], ["no break"], ["A. 1 B."]]


def test_strip_knows_all_blanks(spark):
    s = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert values(spark, [s + "x y" + s, s], lambda c: text.strip(c)) == ["x y", ""]


def test_words_and_slugs(spark):
    assert values(spark, ["The Model-7 uses a BERT_base, paper x2y9 it"], text.normalized_words) == [["the", "model-7", "uses", "bert_base", "x2y9"]]
    assert values(spark, ["Figure 3", "Fig. 12 (b)", "--"], text.slug) == ["figure_3", "fig_12_b", ""]


def test_models_lists_and_addresses(spark):
    got = values(spark, [None, "", "x", " Gemini : a:b ", "foo:bar", "openai:"], text.model_spec)
    assert [tuple(r) for r in got] == [
        ("openai", "gpt-4o-mini", None), ("openai", "gpt-4o-mini", None), ("openai", "x", None), ("gemini", "a:b", None), (None, None, "unknown provider: foo"), (None, None, "empty model name"),
    ]
    assert values(spark, [None, " a, ,b ,,"], text.csv_list) == [[], ["a", "b"]]
    assert values(spark, [" https://arxiv.org/abs/1.2 ", "http://arxiv.org/pdf/1.pdf", "http://x/abs/1"], text.paper_url) == ["https://arxiv.org/pdf/1.2.pdf", "http://arxiv.org/pdf/1.pdf", "http://x/abs/1"]
    assert values(spark, ["zh", " Chinese", None, "fr"], text.language) == ["Chinese", "Chinese", "English", "English"]
    assert values(spark, ["http://h/x", "ftp://h", "https://", None], fetchable) == [True, False, False, False]
    assert [is_private_address(x) for x in ("10.0.0.1", "127.0.0.1", "8.8.8.8", "::1", "224.0.0.1", "nonsense", None)] == [True, True, False, True, True, True, True]


def test_json_and_citations(spark):
    assert values(spark, ["a ```JSON\n {1} \n``` b ```x```", " {2} "], text.json_block) == ["{1}", "{2}"]
    assert values(spark, ["x [chunk_id: 00112233aabb][CHUNK_ID:aaaabbbbcccc] [chunk_id: short]"], text.citations) == [["00112233aabb", "aaaabbbbcccc"]]


def test_rectangles(spark):
    def box(name, x0, y0, x1, y1, page):
        return F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))), F.lit(page).alias("page")).alias(name)

    df = spark.range(1).select(box("a", 0, 0, 10, 10, 0), box("b", 5, 5, 15, 15, 0), box("c", 5, 5, 15, 15, 1), box("d", 3, 3, 3, 3, 0), box("e", 1.9, 0, 10, 10, 0), box("f", 2, 0, 10, 10, 0))
    c = F.col
    r = df.select(
        geometry.iou(c("a"), c("b")), geometry.iou(c("a"), c("c")), geometry.iou(c("d"), c("d")), geometry.near(c("a"), c("e"), 2.0), geometry.near(c("a"), c("f"), 2.0),
        geometry.padded(c("b"), F.lit(18.0), F.lit(30.0)),
    ).first()
    assert r[0] == pytest.approx(25 / 175) and (r[1], r[2], r[3], r[4]) == (0, 0, True, False)
    assert tuple(r[5]) == (0, 0, 18, 20)


def test_scores(spark):
    n = [0, 299, 300, 3500, 5250, 7000]
    assert [round(x, 3) for x in values(spark, ["x" * k for k in n], evaluation.length_score)] == [0, 0.997, 1, 1, 0.5, 0]
    assert values(spark, ["## Limitations ## Future Work x", "", "## future work"], evaluation.header_score) == [pytest.approx(2 / 6), 0, 0]


def test_longest_common_subsequence():
    assert evaluation.lcs_length("abcbdab", "bdcaba") == 4
    assert evaluation.lcs_length([], ["a"]) == 0
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert evaluation.lcs_length(a, b) == row[-1] == evaluation.lcs_length(b, a) <= min(len(a), len(b))
