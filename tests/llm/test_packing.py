import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from docspark.llm import packing, tokens

TOK = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def rows():
    rnd = random.Random(2)
    texts = [None, "", " ", "\n\n  x", "hi <|endoftext|> there", "é" * 500, "a" * 5000, " " * 3000, "😀ß x\r\n\t1,234"]
    texts += [" ".join(rnd.choice(["the", "Über", "ñandú", "42", "x-y", "\n"]) for _ in range(rnd.randrange(2500))) for _ in range(40)]
    return list(enumerate(texts)) + [(3, "again"), (None, "no id")]


def test_ids_are_those_of_tokenizers():
    e = tokens.encoder(tokens.byte_bpe_50k())
    slow = tokens.Encoder(tokens.Vocabulary(P.path("byte_bpe_50k.json")))
    for _, t in rows():
        want = TOK.encode(t or "", add_special_tokens=False).ids
        assert e.ids(t or "").tolist() == want == slow.ids(t or "").tolist()
    long = "\n" * 1_200_000 + "x"
    assert len(e.ids(long)) == len(TOK.encode(long, add_special_tokens=False).ids)


def test_pieces_tile_documents_and_sequences(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(df).collect()
    want = sorted((TOK.encode(t or "", add_special_tokens=False).ids + [0] for i, t in data), key=str)
    places = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length > 0
        places[r.sequence_id].append((r.offset, r.length))
    for k, v in places.items():
        v.sort()
        assert [o for o, _ in v] == [0, *itertools.accumulate(n for _, n in v)][:-1]
        assert sum(n for _, n in v) == 1024 or k == max(places)
    assert sorted(places) == list(range(len(places)))
    rebuilt, run = [], []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):  # a document's pieces follow one another on the curve
        run.append(r)
        assert r.start == sum(x.length for x in run[:-1])
        if r.start + r.length == r.doc_tokens:
            rebuilt.append(np.frombuffer(b"".join(bytes(x.ids) for x in run), "<u4").tolist())
            run = []
    assert not run and sorted(rebuilt, key=str) == want


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hilbert_curve_is_a_walk():
    side = 8
    pts = np.array(list(itertools.product(range(side), repeat=3)))
    key = packing.hilbert(pts, 3)
    assert sorted(key) == list(range(side**3))
    path = pts[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_equal_texts_share_a_key_and_languages_gather():
    a = [np.array([1, 2, 3] * 50), np.array([1, 2, 3] * 50)]
    k = packing.curve_keys(a)
    assert k[0] == k[1]
