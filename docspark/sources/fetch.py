"""Papers from the network: an optional connector that lands files; queries read what has landed."""

from __future__ import annotations

import hashlib
import socket
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from docspark.sources.papers import MAX_BYTES, is_private_address

PIECE = 256 * 1024
FETCHED = "url string, final_url string, pdf_sha256 string, size_bytes long, content binary, error string"


def check_address(url: str, resolve: Callable[..., list] = socket.getaddrinfo) -> None:
    """Raise unless the address is http(s) and every address that its host resolves to is public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError("only http and https addresses with a host")
    try:
        found = resolve(parts.hostname, None)
    except OSError as e:
        raise ValueError("the host can't be resolved") from e
    if not found or any(is_private_address(x[4][0]) for x in found):
        raise ValueError("the host isn't public")


class _Checked(urllib.request.HTTPRedirectHandler):
    """Redirects are checked like the first address."""

    def redirect_request(self, req: Any, fp: Any, code: int, msg: str, headers: Any, newurl: str) -> Any:
        check_address(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def _open(url: str, timeout: float) -> Any:
    return urllib.request.build_opener(_Checked).open(url, timeout=timeout)


def fetch_pdf(url: str, max_bytes: int = MAX_BYTES, timeout: float = 60, opener: Callable[[str, float], Any] = _open, resolve: Callable[..., list] = socket.getaddrinfo) -> dict[str, Any]:
    """Content, hash, size and final address of a PDF; stops as soon as it is too large or isn't one."""
    check_address(url, resolve)
    digest, parts, size = hashlib.sha256(), [], 0
    with opener(url, timeout) as r:
        final = getattr(r, "url", url)
        while piece := r.read(PIECE):
            if not parts and not piece.startswith(b"%PDF"):
                raise ValueError("not a PDF")
            size += len(piece)
            if size > max_bytes:
                raise ValueError("too large")
            digest.update(piece)
            parts.append(piece)
    if not parts:
        raise ValueError("not a PDF")
    return {"final_url": final, "pdf_sha256": digest.hexdigest(), "size_bytes": size, "content": b"".join(parts)}


def fetch(urls: DataFrame, **options: Any) -> DataFrame:
    """A row per address (column url) with the file, or the error; write it before it is used twice."""
    names = [x.split()[0] for x in FETCHED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for url in b["url"]:
                row: dict[str, Any] = dict.fromkeys(names) | {"url": url}
                try:
                    row |= fetch_pdf(url or "", **options)
                except Exception as e:  # an address that fails is its own row's error
                    row["error"] = str(e)
                yield pd.DataFrame([row], columns=names).astype({"size_bytes": "Int64"})

    return urls.select("url").mapInPandas(run, FETCHED)
