"""Text kernels against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docspark.llm import textcore as t

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(3)
    parts = ["a", "b", "Éa", "THE", "the", "x#y", "|", "\n", "\n\n", " ", "\t", "  ", "12", "ß", "\x85", "　", "😀", "a!!", "\x00"]
    out = [None, "", " ", "\n", "one", "A b\nA b\n\nA b \n", "w " * 40, "q\n" * 30]
    return out + ["".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(60))) for _ in range(300)]


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = {i + j for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_chars": len(text),
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(cover),
        "n_distinct_words": len(set(ws)),
        "n_same_words": sum(a == b for a, b in zip(ws, ws[1:])),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
    }


def test_statistics():
    xs = texts()
    for most in (t.SLICE_BYTES, 50):
        t.SLICE_BYTES, old = most, t.SLICE_BYTES
        got = t.statistics(pa.array(xs, pa.string()))
        t.SLICE_BYTES = old
        for i, x in enumerate(xs):
            want = brute(x)
            assert {k: int(got[k][i]) for k in want} == want, x


def test_statistics_of_nothing_and_of_a_slice_of_an_array():
    assert all(len(v) == 0 for v in t.statistics(pa.array([], pa.string())).values())
    a = pa.array(texts(), pa.string())
    whole, part = t.statistics(a), t.statistics(a.slice(7, 40))
    assert all((whole[k][7:47] == part[k]).all() for k in whole)


def test_equal_spans_hash_alike_wherever_they_stand():
    s = next(t.slices(pa.array(["ab cd", "cd ab ab", "abcd"])))
    w = t.words(s)
    assert w.counts.tolist() == [2, 3, 1]
    a, b = w.hash[0], w.hash[1]
    assert w.hash.tolist() == [a, b, b, a, a, w.hash[5]] and len(np.unique(w.hash)) == 3


def test_windows_stay_within_documents():
    s = next(t.slices(pa.array(["a b c", "d e", "", "a b c d"])))
    at, doc, h = t.windows(t.words(s), 3)
    assert doc.tolist() == [0, 3, 3] and h[0] == h[1] != h[2]
