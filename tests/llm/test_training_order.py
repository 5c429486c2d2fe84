import random
import zlib

import numpy as np

from docspark.llm import training_order as t
from docspark.llm.tokens import byte_bpe_50k, encoder


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 10, 257, 5000):
        x = np.arange(n)
        p = t.Feistel(n, 5)
        assert sorted(p.slot(x)) == x.tolist() and (p.sequence(p.slot(x)) == x).all()
    assert (t.Feistel(5000, 1).slot(x) != t.Feistel(5000, 2).slot(x)).mean() > 0.9


def test_round_trip_and_resume(spark, tmp_path):
    rnd = random.Random(1)
    data = [(None, None), (1, ""), (1, "twice")] + [(i, " ".join(rnd.choice(["the", "ñu", "\n", "x9"]) for _ in range(rnd.randrange(900)))) for i in range(2, 60)]
    df = spark.createDataFrame([(*r, 3) for r in data], "doc_id long, text string, slot int").repartition(3)
    path = f"file://{tmp_path}/shards"
    rows = {r.slot: r for r in t.materialise(df, path, key=9, size=64, per_shard=50).collect()}
    got = list(t.read_slots(path))
    assert sorted(rows) == list(range(len(got)))
    for s, x in enumerate(got):
        r = rows[s]
        assert zlib.crc32(x.tobytes()) == r.ids_crc32 and (r.shard, r.position) == (s // 50, s % 50 * 128)
    assert [x.tolist() for x in t.read_slots(path, 77, 40)] == [x.tolist() for x in got[77:117]]
    # put back in order of sequence, the streams hold each document once
    e = encoder(byte_bpe_50k())
    want = sorted(tuple(e.ids(x or "").tolist()) for _, x in data)
    stream, docs = [], []
    for r in sorted(rows.values(), key=lambda r: r.sequence_id):
        stream += got[r.slot].tolist()[: r.n_tokens]
    while stream:
        end = stream.index(0)
        docs.append(tuple(stream[:end]))
        stream = stream[end + 1 :]
    assert sorted(docs) == want
    assert {d for r in rows.values() for d in r.doc_ids} == {d for d, _ in data}
    assert len(list((tmp_path / "shards").glob("*.bin"))) == -(-len(got) // 50)


def test_shards_follow_from_the_rows_alone(spark, tmp_path):
    """Byte for byte the same shards for any partitions, several shards in a task, and those of plain Python."""
    rnd = random.Random(3)
    data = [(i, " ".join(rnd.choice(["the", "ñu", "\n", "x9"]) for _ in range(rnd.randrange(400)))) for i in range(80)]
    e, size, per_shard, shards = encoder(byte_bpe_50k()), 64, 20, []
    most, t.MOST_TASKS = t.MOST_TASKS, 3
    try:
        for n in (2, 5, 50):
            df = spark.createDataFrame(rnd.sample(data, len(data)), "doc_id long, text string").repartition(n)
            rows = t.materialise(df, f"file://{tmp_path}/{n}", key=4, size=size, per_shard=per_shard).collect()
            shards.append([f.read_bytes() for f in sorted((tmp_path / str(n)).glob("*.bin"))])
    finally:
        t.MOST_TASKS = most
    assert shards[0] == shards[1] == shards[2] and len(shards[0]) > 4
    stream = np.concatenate([[*e.ids(x), 0] for _, x in data])
    owner = np.repeat([i for i, _ in data], [len(e.ids(x)) + 1 for _, x in data])
    total = -(-len(stream) // size)
    stream = np.concatenate((stream, np.zeros(total * size - len(stream), stream.dtype))).reshape(total, size)
    back = t.Feistel(total, 4).sequence(np.arange(total))
    assert b"".join(shards[0]) == stream[back].astype(e.dtype).tobytes()
    assert sorted((r.slot, r.sequence_id, r.doc_ids) for r in rows) == [(k, q, sorted(set(owner[q * size : (q + 1) * size].tolist()))) for k, q in enumerate(back.tolist())]


def test_registered_query_writes_the_whole_table(spark):
    """op6 over sf0.001: its slots hold the documents by doc_id, read back and compared with the tokenizer's ids."""
    from docspark.llm.queries import op6_training_order

    got = {r.sequence_id: r for r in op6_training_order(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    e = encoder(byte_bpe_50k())
    stream = np.concatenate([[*e.ids(x), 0] for _, x in docs])
    assert sorted(got) == list(range(-(-len(stream) // t.SIZE))) and sorted(r.slot for r in got.values()) == sorted(got)
    for k, r in got.items():
        piece = np.zeros(t.SIZE, e.dtype)
        mine = stream[k * t.SIZE : (k + 1) * t.SIZE]
        piece[: len(mine)] = mine
        assert (r.ids_crc32, r.n_tokens) == (zlib.crc32(piece.tobytes()), len(mine))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert t.materialise(df, f"file://{tmp_path}/x").count() == 0 and list(t.read_slots(f"{tmp_path}/x")) == []
