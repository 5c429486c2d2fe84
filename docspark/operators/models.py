"""Model calls: provider registry, an offline provider, and a driver that keeps errors to their row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import PROVIDERS, model_spec


@dataclass
class Reply:
    text: str
    prompt_tokens: int | None = None
    output_tokens: int | None = None
    total_tokens: int | None = None


class Client(Protocol):
    def summarize(self, prompt: str, model: str) -> Reply: ...


class Offline:
    """A deterministic stand-in: the prompt's first sentences as bullets; the model ``fail`` raises."""

    def summarize(self, prompt: str, model: str) -> Reply:
        if model == "fail":
            raise RuntimeError("the offline model fails on request")
        from docspark.operators.chunking import pack_sentences

        parts = pack_sentences(prompt, 12, 0)[:3]
        text = "## Research Background\n" + "\n".join(f"- {p}" for p in parts)
        n, m = len(prompt.split()), len(text.split())
        return Reply(text, n, m, n + m)


SYSTEM = "You summarise academic papers: brief, well structured, in markdown."


def _key(name: str) -> str:
    import os

    key = os.environ.get(name)
    if not key:
        raise RuntimeError(f"{name} is not set")
    return key


class _Chat:
    """A chat service with the interface of the openai package; imported and connected where it is used.

    ``address`` names the environment variable that may replace ``base_url``; ``strip`` takes blanks off replies.
    """

    def __init__(self, key: str, base_url: str | None = None, address: str | None = None, strip: bool = False, timeout: float = 120.0, retries: int = 2) -> None:
        import os

        secret = _key(key)  # a missing key shows as such, whether or not the package is there
        from openai import OpenAI

        url = (address and os.environ.get(address)) or base_url
        self.client, self.strip = OpenAI(api_key=secret, base_url=url, timeout=timeout, max_retries=retries), strip

    def summarize(self, prompt: str, model: str) -> Reply:
        talk = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
        got = self.client.chat.completions.create(model=model, messages=talk, temperature=0.2)
        use, text = got.usage, got.choices[0].message.content or ""
        return Reply(text.strip() if self.strip else text, use and use.prompt_tokens, use and use.completion_tokens, use and use.total_tokens)


class _Gemini:
    def __init__(self) -> None:
        secret = _key("GEMINI_API_KEY")
        from google import genai

        self.client = genai.Client(api_key=secret)

    def summarize(self, prompt: str, model: str) -> Reply:
        got = self.client.models.generate_content(model=model, contents=prompt)
        use = got.usage_metadata
        return Reply((got.text or "").strip(), use and use.prompt_token_count, use and use.candidates_token_count, use and use.total_token_count)


FACTORIES: dict[str, Callable[[], Client]] = {
    "openai": lambda: _Chat("OPENAI_API_KEY"),
    "deepseek": lambda: _Chat("DEEPSEEK_API_KEY", "https://api.deepseek.com/v1", "DEEPSEEK_BASE_URL", strip=True),
    "gemini": _Gemini,
}
OFFLINE: dict[str, Callable[[], Client]] = dict.fromkeys(PROVIDERS, Offline)

RESULT = "status string, error string, text string, llm_ms long, prompt_tokens long, output_tokens long, total_tokens long"


def call_models(requests: DataFrame, factories: dict[str, Callable[[], Client]] | None = None) -> DataFrame:
    """Requests (doc_id, .., model, prompt) with a row of results each: status OK or ERROR, the text, time and token use.

    One client per provider and task.  Calls cost money and differ each time: write the result before it is used twice.
    """
    makers = FACTORIES if factories is None else factories
    kept = [c for c in requests.columns if c != "prompt"]
    df = requests.withColumn("__spec", model_spec(F.col("model"))).select(*kept, "prompt", "__spec.provider", F.col("__spec.model").alias("name"), F.col("__spec.error").alias("bad"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema if f.name != "prompt") + ", " + RESULT
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Client] = {}
        for b in batches:
            rows = []
            for prompt, provider, name, bad in zip(b["prompt"], b["provider"], b["name"], b["bad"], strict=True):
                began = time.perf_counter()
                try:
                    if bad:
                        raise ValueError(bad)
                    if provider not in clients:
                        clients[provider] = makers[provider]()
                    r = clients[provider].summarize(prompt or "", name)
                    rows.append(("OK", None, r.text, int((time.perf_counter() - began) * 1000), r.prompt_tokens, r.output_tokens, r.total_tokens))
                except Exception as e:  # one model's failure is its own row's
                    rows.append(("ERROR", str(e), None, None, None, None, None))
            out = b[kept].reset_index(drop=True)
            for i, n in enumerate(names):
                out[n] = pd.Series([r[i] for r in rows], dtype="object" if i < 3 else "Int64")
            yield out

    return df.mapInPandas(run, schema)


def compare(prompts: DataFrame, models: list[str], factories: dict[str, Callable[[], Client]] | None = None) -> DataFrame:
    """Every document's shared prompt (doc_id, prompt) with every model of a short list: results in the list's order (input_ord)."""
    each = F.posexplode(F.array(*(F.lit(m) for m in models))).alias("input_ord", "model")
    return call_models(prompts.select("doc_id", each, "prompt"), factories)


def latency(results: DataFrame, preprocess_ms: int = 0) -> DataFrame:
    """Results with preprocess_ms and latency_ms; null where the model gave no time."""
    return results.withColumn("preprocess_ms", F.lit(preprocess_ms).cast("long")).withColumn("latency_ms", F.col("preprocess_ms") + F.col("llm_ms"))
