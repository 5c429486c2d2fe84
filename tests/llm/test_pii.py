import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from docspark.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def texts():
    rnd = random.Random(8)
    bits = ["a@b.c", "a@b.c_d@e.f", "x.y+z@q-r.com.", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.1.1.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0199",
            "+49 30 1234567", "++1 2", "+1((((", "é", "😀", " ", "\n", "-", "word", "+", "12", "4" * 17, "1." * 5, "%", "+4111111111111111", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "joe [at] site [dot] com", "call (212) 555-0187"]
    out = [None, "", "a@b", "x" * 50_000, "1" * 30_000, "+" + "(" * 20_000, "a.b" * 9_000 + "@", ("1.2.3.4 ") * 700, "1 " * 9000]
    return out + ["".join(rnd.choice(bits) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(40))) for _ in range(400)]


def test_base_spans_equal_plain_python(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x.startswith(k + ":") for x in want) for k in BASE]
        assert got[i].spans.startswith(",".join(want))


def test_votes_add_spans_and_clean_texts_stay(spark):
    rows = [(0, 'set token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now'), (1, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), (2, "plain words only"), (3, "write to joe [at] site [dot] com today")]
    rows += [(i, f"mail a{i}@x{i}.com or {i}.2.3.4 and +1 212 555 01{i:02d} end") for i in range(4, 60)]
    rows += [(i, f"n {i}77.2.3.400 and 1234 5678 9012 3{i}") for i in range(60, 99)]
    rows += [(i, f'the secret="{i}86d081884c7d659a2feaa0c55ad015{i}" ') for i in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(df, ["doc_id", "text"]).withColumn("red", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert [s.kind for s in got[0].spans] == ["secret"] and got[0].red == 'set token = "[SECRET]" now'
    assert not got[2].spans and got[2].red == "plain words only"
    assert [s.kind for s in got[3].spans] == ["handle"]
    assert got[5].red == "mail [EMAIL] or [IP] and [PHONE] end"
    assert not got[70].spans


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.fit(pii.candidates(df)) == [] and pii.detect(df).count() == 0


def test_em_trusts_labelers_that_agree():
    counts = {("card", (1, 1, 1, 1, 1)): 50, ("card", (-1, 0, 0, 1, 1)): 60, ("card", (1, 0, 0, 1, 1)): 20, ("card", (-1, -1, 0, -1, 1)): 9}
    p = pii.estimate(counts)
    assert p["card", (1, 1, 1, 1, 1)] > 0.95 and p["card", (1, 0, 0, 1, 1)] > p["card", (-1, 0, 0, 1, 1)] > p["card", (-1, -1, 0, -1, 1)]


def test_work_is_linear_in_a_texts_matches(spark):
    """100,000 addresses and others in one text: spans and the redacted text within seconds."""
    n = 25_000
    text = "".join(f"é u{i}@h{i % 7}.org or 10.0.{i % 256}.9, tel +1 212 555 01{i % 90 + 10} token = {i:032x} " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    r = pii.detect(df, ["doc_id", "text"]).select("spans", pii.redact(F.col("text"), F.col("spans")).alias("red")).first()
    assert time.monotonic() - began < 60
    assert r.red == "é [EMAIL] or [IP], tel [PHONE] token = [SECRET] " * n
    assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == brute(text) and len(r.spans) == 4 * n


def test_precision_and_recall_of_added_spans(spark):
    rnd = random.Random(5)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    yes = [
        lambda: ("handle", f"mail me: jo.{hexed(4)} [at] site{digits(2)} [dot] com today"),
        lambda: ("handle", f"contact x{hexed(5)} (at) host (dot) org"),
        lambda: ("number", f"please call (2{digits(2)}) {digits(3)}-{digits(4)} soon"),
        lambda: ("number", f"phone 3{digits(2)}-{digits(3)}-{digits(4)}."),
        lambda: ("secret", f'api token = "{hexed(40)}"'),
        lambda: ("secret", f"password: {hexed(36)}"),
        lambda: ("secret", f"key AKIA{''.join(rnd.choice('ABCDEF2345') for _ in range(16))} here"),
    ]
    no = [
        lambda: f"commit {hexed(40)} fixes it",
        lambda: f"checksum {hexed(32)}",
        lambda: f"a_very_long_identifier_without_any_{'x' * rnd.randrange(9)}_digits",
        lambda: f"part no 1{digits(2)} {digits(3)} {digits(4)} in stock",
        lambda: f"meet at [at] {rnd.choice(['noon', 'one', 'two'])}",
    ]
    rows, want = [], {}
    for i in range(1400):
        if i % 2:
            want[i], text = yes[i // 2 % len(yes)]()
        else:
            text = no[i // 2 % len(no)]()
        rows.append((i, f"words before {text} and after"))
    rows += [(2000 + i, f"a{i}@b{i}.com and 10.{i}.2.3 and +1 212 555 01{i:02d}") for i in range(90)]
    got = {r.doc_id: [s.kind for s in r.spans if not s.base] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(got[i] == [k] for i, k in want.items())
    wrong = sum(len(v) for i, v in got.items() if i not in want)
    assert hit / len(want) >= 0.9 and hit / (hit + wrong) >= 0.95, (hit / len(want), wrong, {k: sum(got[i] == [k] for i, x in want.items() if x == k) for k in pii.MORE_KINDS})
