import random
import re
import time

from pyspark.sql import functions as F

from docspark.llm import license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def base(ws):
    out = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    return out


def texts():
    rnd = random.Random(6)
    bits = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by", "nc", "under", "the", "MIT", "license", "Licenſe", "K", "é", "ÉCC", "-", "\n", "version", "2", "İ", "apache", "under_the_mit_license", "x" * 9, "\x00", "😀"]
    out = [None, "", "...", "cc by nc", "a cc-by-nc cc BY\tnc", "under the mit license" * 3, "under the mit license " * 900]
    return out + [" ".join(rnd.choice(bits) + rnd.choice(["", ",", ". "]) for _ in range(rnd.randrange(60))) for _ in range(300)]


def brute_spans(ws, k=license_scan.K):
    """Labels and scores by counting votes in dictionaries."""
    found = []
    n = 0
    for label, ts in license_scan.TEMPLATES.items():
        for t in ts:
            tw = license_scan.template_words(t)
            grams = {}
            for i in range(len(tw) - k + 1):
                grams.setdefault(tuple(tw[i : i + k]), []).append(i)
            diagonals = {}
            for p in range(len(ws) - k + 1):
                for i in grams.get(tuple(ws[p : p + k]), ()):
                    diagonals.setdefault(p - i, []).append((p, i))
            group, last = [], None
            for d in [*sorted(diagonals), None]:
                if group and (d is None or d - last > license_scan.SLACK):
                    score = len({i for _, i in group}) / (len(tw) - k + 1)
                    if score >= license_scan.VERIFIED:
                        found.append((min(p for p, _ in group), max(p for p, _ in group) + k - 1, label, n, score))
                    group = []
                if d is not None:
                    group += diagonals[d]
                    last = d
            n += 1
    return sorted(found)


def test_base_equals_plain_python(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ws = words(t)
        want = base(ws)
        r = got[i]
        places = [p for _, p in want]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(want), min(places, default=None), max(places, default=None)), t
        assert r.base_labels == ",".join(sorted({x for x, _ in want}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1 if want else r.score <= 1)


def test_spans_equal_plain_python(spark):
    rnd = random.Random(2)
    whole = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    rows = []
    for i in range(120):
        w = rnd.choice(whole).split()
        if i % 3:  # lose and gain words
            for _ in range(rnd.randrange(1, 4)):
                j = rnd.randrange(len(w))
                w[j : j + 1] = rnd.choice([[], ["extra", w[j]]])
        around = " ".join(rnd.choice(["so", "it", "is"]) for _ in range(rnd.randrange(30)))
        rows.append((i, rnd.choice(["", "...", "A "]) + f"{around} {' '.join(w).upper() if i % 2 else ' '.join(w)} {around}"))
    rows += [(None, whole[0]), (None, whole[0]), (1, None), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(df, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and sum(len(r.spans) > 0 for r in got) > 70
    for r in got:
        assert [tuple(s)[:4] for s in r.spans] == [s[:4] for s in brute_spans(words(r.text))]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_work_is_linear_in_a_texts_matches(spark, tmp_path):
    n = 100_000
    spark.createDataFrame([(1, "under the MIT license, é " * n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    r = queries.op3_license_scan(spark, str(tmp_path)).first()
    assert time.monotonic() - began < 90
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (5 * n, n, 0, 5 * n - 5, "mit")


def test_only_ascii_letters_are_folded(spark):
    rows = [(1, "Lice\u0130nsed under the \u212aelvin License"), (2, "TEXT IS AVAILABLE UNDER THE CREATIVE COMMONS ATTRIBUTION-SHAREALIKE LICENSE")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", license_scan.pieces(license_scan.folded(F.col("text"))).alias("w")).collect()
    assert "kelvin" not in got[0].w and got[1].w == words(rows[1][1])
