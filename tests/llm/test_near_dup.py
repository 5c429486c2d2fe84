import random
import re

import numpy as np
import pyarrow as pa

from docspark.llm import near_dup as n
from docspark.llm.textcore import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(x), root(i)) for i, x in sets}


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows = [None, "", "  \n", "One two", "one TWO", "one two three", "x"]
    shared = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    for _ in range(40):
        rows.append(" ".join(shared + [word() for _ in range(rnd.randrange(5, 150))]))
    for k in range(120):  # near copies, from hardly to much changed
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(30):
        w = [word() for _ in range(rnd.randrange(4, 30))]
        rows += [" ".join(w), " ".join(w[:-1]), " ".join(w + [word()]), "\n".join(w).upper()]
    rows += rows[10:20]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_same_components_as_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = brute(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert n.near_duplicates(empty).count() == 0
    odd = [(None, "a b c d e f"), (3, None), (3, None), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")]
    got = n.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, kept string, component_id int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False)]


def test_sketches_fill_and_estimate_similarity():
    rnd = np.random.default_rng(5)
    for size in (1, 3, 40, 2000):
        common, own = rnd.integers(0, 2**63, size, dtype=np.uint64), rnd.integers(0, 2**63, size, dtype=np.uint64)
        both = np.concatenate((common, own))
        off = np.array([0, size, 3 * size])
        v = n.sketch(np.concatenate((common, both)), off)
        assert (v != np.uint64(2**64 - 1)).all()
        assert abs((v[0] == v[1]).mean() - 0.5) < 0.25
    assert n.unpack_set(n.pack_set(np.sort(both))).tolist() == (np.sort(both) >> np.uint64(16)).tolist()


def test_sets_match_plain_python():
    rows = corpus()
    at = 0
    for s in slices(pa.array([t for _, t in rows], pa.string()), 2000):
        _, off = n.shingle_sets(s)
        for c in np.diff(off):
            assert c == len(shingles(rows[at][1]))
            at += 1


def test_rows_that_share_an_id_are_one_document(spark):
    """It has the links of all its texts, however rows are ordered."""
    text = lambda k, n=12: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(7, text(1)), (7, text(2)), (9, text(1)), (8, text(2) + " more"), (5, text(3)), (6, text(3)), (6, text(4)), (10, text(4)), (11, text(5)), (12, text(4, 13))]
    want = {7: 7, 9: 7, 8: 7, 5: 5, 6: 5, 10: 5, 12: 5, 11: 11}
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        got = n.near_duplicates(spark.createDataFrame(mixed, "doc_id long, text string").repartition(seed + 1)).collect()
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


def test_boilerplate_of_many_documents_makes_few_pairs(spark):
    """10,000 documents of one boilerplate, none similar to another: what is left to verify grows with them, not with their pairs."""
    shared = " ".join(f"b{i}" for i in range(40))
    rows = [(i, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(10))) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = docs.select(docs.doc_id.alias("rep"), "text")
    sets = n.arrow_map(sets, "text", ["rep"], "shingles binary", n._packed)
    assert n._prefix_pairs(sets, None).count() <= len(rows)
