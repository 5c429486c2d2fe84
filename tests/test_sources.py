import pandas as pd
from pyspark.sql import functions as F

from docspark.operators import blocks
from docspark.plans.queries import QUERIES
from docspark.sources import papers
from docspark.sources.cache import ResultStore, as_json
from docspark.sources.html import html_blocks
from docspark.streaming.ingest import document_stream, ingest, members


def test_papers_and_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 hello")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(b"%PDF" + b"x" * 5000)
    p = papers.papers(spark, str(tmp_path), 4000)
    assert [(r.path.rsplit("/", 1)[1], r.size_bytes, len(r.pdf_sha256)) for r in p.collect()] == [("a.pdf", 14, 64)]

    def extractor(content, max_pages):
        size = {"page_width": 612.0, "page_height": 792.0}
        box = {"x0": 54.0, "y0": 100.0, "x1": 294.0, "y1": 120.0}
        for i, (kind, words) in enumerate([(0, content.decode()), (0, "  "), (1, "")]):
            yield {"page": 0, "block_ord": i, "kind": kind, **box, **size, "lines": [[{"text": words, "size": 12.0, "flags": 16}]]}

    raw = papers.extract(p.withColumn("doc_id", F.lit(7).cast("long")), extractor)
    got = blocks.classify(papers.raw_blocks(raw)).collect()
    assert [(r.doc_id, r.text, r["size"], r.bold, r.block_type) for r in got] == [(7, "%PDF-1.4 hello", 12.0, True, "body")]
    assert papers.raster_rects(raw).count() == 1


def stand_in():
    """An extractor: a heading, a body, an image, two strokes of one drawing and its caption; files of 'bad' are damaged."""

    def pages(content, max_pages):
        if b"bad" in content:
            raise ValueError("damaged")
        size = {"page_width": 612.0, "page_height": 792.0}
        found = [
            (0, (54, 60, 294, 80), ["Intro", "duction"], 14.0),
            (0, (54, 100, 294, 140), ["A sentence", "of the body."], 10.0),
            (1, (54, 150, 294, 250), [], 0.0),
            (2, (54, 300, 154, 400), [], 0.0),
            (2, (160, 300, 294, 400), [], 0.0),
            (2, (60, 160, 200, 240), [], 0.0),
            (0, (54, 410, 294, 425), ["Figure 1: two strokes"], 10.0),
        ]
        for i, (kind, (x0, y0, x1, y1), lines, at) in enumerate(found):
            spans = [[{"text": t, "size": at, "flags": 0}] for t in lines]
            yield {"page": 0, "block_ord": i, "kind": kind, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), **size, "lines": spans}

    return pages


def two_papers(spark):
    rows = [(1, "s1", bytearray(b"%PDF good")), (2, "s2", bytearray(b"%PDF bad"))]
    return spark.createDataFrame(rows, "doc_id long, pdf_sha256 string, content binary")


def test_files_to_chunks_and_regions(spark):
    from docspark.plans.corpus import corpus_of_papers

    c = corpus_of_papers(two_papers(spark), stand_in())
    assert {r.block_type for r in c.blocks.collect()} == {"heading", "body", "caption"}
    assert [(r.doc_id, r.label, r.bbox.x0, r.bbox.x1) for r in c.regions.collect()] == [(1, "Figure 1", 54.0, 294.0)]
    assert {r.doc_id for r in c.chunks.collect()} == {1}
    raw = papers.extract(two_papers(spark), stand_in())
    assert [tuple(r) for r in papers.extract_errors(raw).collect()] == [(2, "ValueError: damaged")]


def test_layout_and_detector(spark):
    raw = papers.extract(two_papers(spark), stand_in())
    ruled = papers.layout(raw)
    got = sorted((r.region_type, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in ruled.collect())
    figures = [("figure", 54.0, 150.0, 294.0, 250.0, 1.0), ("figure", 54.0, 300.0, 294.0, 400.0, 0.9)]
    assert got == [("caption", 54.0, 410.0, 294.0, 425.0, 1.0), *figures, ("text", 54.0, 60.0, 294.0, 80.0, 1.0), ("text", 54.0, 100.0, 294.0, 140.0, 1.0)]
    assert raw.where("block_ord = 0").select(blocks.layout_text(F.col("lines"))).first()[0] == "Introduction"

    def detector(content, max_pages):
        if b"good" in content:
            yield {"page": 0, "region_type": "table", "x0": 1.0, "y0": 1.0, "x1": 2.0, "y1": 2.0, "confidence": 0.5}

    assert [r.region_type for r in papers.detected_layout(two_papers(spark), detector, ruled).collect()] == ["table"]
    assert papers.detected_layout(two_papers(spark), lambda content, max_pages: [], ruled).count() == 5


def test_crops(spark, tmp_path):
    from docspark.sources.crops import write_crops

    box = "struct<x0: double, y0: double, x1: double, y1: double, page: int>"
    rows = [(1, 0, "s1/a.png", (1.0, 2.0, 3.0, 4.0, 0)), (1, 1, "s1/b.png", (9.0, 2.0, 3.0, 4.0, 1)), (1, 2, "s1/c.png", (5.0, 2.0, 3.0, 4.0, 2))]
    regions = spark.createDataFrame(rows, f"doc_id long, page int, crop_path string, bbox {box}")

    def renderer(content, boxes, dpi, padding):
        for page, b in boxes:
            if b[0] == 9.0:
                raise ValueError("no such page")
            yield f"{page} {b[0]} {dpi} {padding}".encode()

    run = lambda **more: [(r.crop_path[3:4], r.status) for r in write_crops(two_papers(spark), regions, str(tmp_path), renderer, **more).collect()]
    assert sorted(run()) == [("a", "written"), ("b", "error"), ("c", "written")]
    assert sorted(p.name for p in (tmp_path / "s1").iterdir()) == ["a.png", "c.png"] and (tmp_path / "s1/c.png").read_text() == "2 5.0 200 5.0"
    assert sorted(run(dpi=72)) == [("a", "present"), ("b", "error"), ("c", "present")]
    assert sorted(run(dpi=72, overwrite=True))[0] == ("a", "written") and (tmp_path / "s1/a.png").read_text() == "0 1.0 72 5.0"


def test_chat_adapters(monkeypatch):
    import sys
    import types

    import pytest

    from docspark.operators.models import FACTORIES, SYSTEM

    seen = {}

    class OpenAI:
        def __init__(self, **options):
            seen.update(options)
            self.chat = types.SimpleNamespace(completions=self)

        def create(self, **call):
            seen.update(call)
            use = types.SimpleNamespace(prompt_tokens=1, completion_tokens=2, total_tokens=3)
            return types.SimpleNamespace(usage=use, choices=[types.SimpleNamespace(message=types.SimpleNamespace(content=" hi "))])

    for name in ("OPENAI_API_KEY", "DEEPSEEK_API_KEY", "GEMINI_API_KEY", "DEEPSEEK_BASE_URL"):
        monkeypatch.delenv(name, raising=False)
    for make in FACTORIES.values():
        with pytest.raises(RuntimeError, match="_API_KEY is not set"):
            make()
    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=OpenAI))
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.setenv("DEEPSEEK_API_KEY", "k")
    got = FACTORIES["openai"]().summarize("p", "m")
    assert (got.text, got.total_tokens) == (" hi ", 3) and seen["base_url"] is None
    assert seen["messages"] == [{"role": "system", "content": SYSTEM}, {"role": "user", "content": "p"}]
    assert FACTORIES["deepseek"]().summarize("p", "m").text == "hi" and seen["base_url"] == "https://api.deepseek.com/v1"
    monkeypatch.setenv("DEEPSEEK_BASE_URL", "http://here")
    FACTORIES["deepseek"]()
    assert seen["base_url"] == "http://here"


def test_fetching_is_checked():
    import io

    import pytest

    from docspark.sources import fetch

    public, inside = (lambda *_: [(0, 0, 0, "", ("8.8.8.8", 0))]), (lambda *_: [(0, 0, 0, "", ("10.0.0.1", 0))])
    opener = lambda data: lambda url, timeout: io.BytesIO(data)
    got = fetch.fetch_pdf("https://h/a.pdf", opener=opener(b"%PDF-1"), resolve=public)
    assert (got["size_bytes"], got["final_url"], got["content"]) == (6, "https://h/a.pdf", b"%PDF-1")
    for url, data, resolve, most in (("ftp://h/a", b"%PDF", public, 9), ("http://h/a", b"%PDF", inside, 9), ("http://h/a", b"<html>", public, 9), ("http://h/a", b"%PDF12345678", public, 9), ("http://h/a", b"", public, 9)):
        with pytest.raises(ValueError):
            fetch.fetch_pdf(url, most, opener=opener(data), resolve=resolve)


def test_fetch_errors_are_rows(spark):
    from docspark.sources.fetch import fetch

    got = fetch(spark.createDataFrame([("ftp://x",), ("http://127.0.0.1/a",), (None,)], "url string")).collect()
    assert len(got) == 3 and all(r.error and r.content is None for r in got)


def test_settings(monkeypatch):
    from docspark.settings import Settings

    assert Settings.from_env("NONE_").max_tokens == 512
    for k, v in {"MODELS": " a, ,b", "MAX_PAGES": "99", "BASE_URL": "http://x/"}.items():
        monkeypatch.setenv(f"T_{k}", v)
    s = Settings.from_env("T_")
    assert (s.models, s.default_model, s.max_pages, s.base_url) == (("a", "b"), "a", 60, "http://x")


def test_html(spark):
    html = "<title>T &amp;</title><script>var p='<p>';</script><nav><ul><li>one</ul></nav><!-- <p>no --><P class=x>first<p>second <b>bold</b></p><pre>x</pre><footer> f </footer><h2></h2>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = [(r.tag, r.block_type, r.text) for r in html_blocks(df).orderBy("block_ord").collect()]
    assert got == [("title", "heading", "T &amp;"), ("li", "other", "one"), ("p", "body", "first"), ("p", "body", "second bold x"), ("footer", "header_footer", "f")]


def test_store_keeps_parameters_apart(spark, tmp_path):
    a, b = (ResultStore(spark, str(tmp_path), max_tokens=n) for n in (1, 2))
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "pdf_sha256 string, v int")
    assert a.load() is None and a.missing(rows).count() == 2
    a.save(rows.where("v = 1"))
    assert [r.v for r in a.missing(rows).collect()] == [2] and b.missing(rows).count() == 2
    a.save(a.missing(rows))
    assert a.load().count() == 2 and a.missing(rows).count() == 0
    assert as_json(rows.withColumn("doc_id", F.lit(1))).first().json == '{"pdf_sha256":"x","v":1,"doc_id":1}'


def test_stream_skips_what_it_has_seen(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), v=1)
    plan = lambda d: d.select("pdf_sha256", "doc_id", F.length("text").alias("n"))
    for k, texts in enumerate((["a", "bb"], ["bb", "ccc"])):
        pd.DataFrame({"doc_id": [10 * k, 10 * k + 1], "text": texts}).to_parquet(tmp_path / f"in{k}.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in{k}.parquet").rename(tmp_path / "in" / f"{k}.parquet")
        ingest(document_stream(spark, str(tmp_path / "in")), store, plan, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.n for r in store.load().collect()) == [1, 2, 3]
    named = members(store).join(store.load().select("pdf_sha256", "n"), "pdf_sha256")
    assert sorted((r.doc_id, r.n) for r in named.collect()) == [(0, 1), (1, 2), (10, 2), (11, 3)]


def test_queries_and_sql_have_the_same_names():
    from docspark.plans.oracle import oracle_sql

    assert set(oracle_sql()) == set(QUERIES) - {"compare_models", "private_addresses"}
