"""Figure crops as PNG files in a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DPI, PADDING = 200, 5.0
RESULT = "doc_id long, crop_path string, status string, error string"

Box = tuple[float, float, float, float]
Renderer = Callable[[bytes, Iterable[tuple[int, Box]], int, float], Iterator[bytes]]


def pymupdf_renderer(content: bytes, boxes: Iterable[tuple[int, Box]], dpi: int, padding: float) -> Iterator[bytes]:
    """PNG bytes of each page's rectangle, padded and kept on the page, by PyMuPDF where that is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page, (x0, y0, x1, y1) in boxes:
            p = doc.load_page(page)
            clip = fitz.Rect(max(0.0, x0 - padding), max(0.0, y0 - padding), min(p.rect.width, x1 + padding), min(p.rect.height, y1 + padding))
            yield p.get_pixmap(matrix=fitz.Matrix(dpi / 72.0, dpi / 72.0), clip=clip, alpha=False).tobytes("png")


def write_crops(paper_rows: DataFrame, regions: DataFrame, folder: str, renderer: Renderer = pymupdf_renderer, dpi: int = DPI, padding: float = PADDING, overwrite: bool = False) -> DataFrame:
    """doc_id, crop_path, status (written, present or error) and error of each region's file below ``folder``, a path or URI that all executors share.

    ``paper_rows`` has doc_id and content, ``regions`` is that of ``figures.figures_tables``.  Files that are there and not empty are left, unless
    ``overwrite``.  A file is written under a temporary name and then moved, so a task that runs again does no harm.  Lazy: files
    are written as rows are read.
    """
    per = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "crop_path", "bbox"))).alias("crops"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as files

        store, base = files.FileSystem.from_uri(folder)
        for b in batches:
            for doc, content, crops in zip(b["doc_id"], b["content"], b["crops"], strict=True):
                rows, todo = [], []
                for crop in crops:
                    path = f"{base.rstrip('/')}/{crop['crop_path']}"
                    if not overwrite and (store.get_file_info(path).size or 0) > 0:
                        rows.append((doc, crop["crop_path"], "present", None))
                    else:
                        todo.append((crop["crop_path"], path, (int(crop["page"]), tuple(float(crop["bbox"][k]) for k in ("x0", "y0", "x1", "y1")))))
                pngs = None
                for i, (name, path, _) in enumerate(todo):
                    try:
                        if pngs is None:
                            pngs = iter(renderer(bytes(content), [box for _, _, box in todo[i:]], dpi, padding))
                        png = next(pngs)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        part = f"{path}.{uuid.uuid4().hex}.part"
                        with store.open_output_stream(part) as out:
                            out.write(png)
                        store.move(part, path)
                        rows.append((doc, name, "written", None))
                    except Exception as e:  # one crop's failure is its own row's; the next ones are rendered anew
                        pngs = None
                        rows.append((doc, name, "error", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["doc_id", "crop_path", "status", "error"])

    return paper_rows.select("doc_id", "content").join(per, "doc_id").mapInPandas(run, RESULT)
