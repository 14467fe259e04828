"""Model calls behind plain callables, with deterministic stand-ins that need no network."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as T

DIM = 64


def embed_text(text: Column, dim: int = DIM) -> Column:
    """Hashed bag of words of unit length, on the JVM; zeros for texts without words."""
    bins = F.transform(T.lexical_terms(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))
    length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda r: T.let(length(r), lambda n: F.transform(r, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return T.let(T.let(bins, counts), scaled)


def embedder(fn: Callable[[list[str]], list[list[float]]]):
    """A vectorised expression from a function that embeds a list of texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fn(texts.fillna("").tolist()))

    return embed


def text_model(fn: Callable[[str], str], fallback: str | None = None):
    """A vectorised expression from a model of one text; what it raises gives the fallback."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                return fn(t or "")
            except Exception:  # the model's failure is part of the contract
                return fallback

        for texts in batches:
            yield texts.map(one, na_action=None)

    return call


def overlap_scores(question: Column, passages: Column) -> Column:
    """A stand-in reranker: shared words of question and passage, as an array of scores."""
    q = F.array_distinct(T.lexical_terms(question))
    return F.transform(passages, lambda p: F.size(F.array_intersect(q, F.array_distinct(T.lexical_terms(F.substring(p, 1, 2000))))).cast("double"))


def post_json(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def chat_model(url: str, model: str, temperature: float = 0.2, most: int = 800, timeout: float = 240, post: Callable[[str, dict, float], dict] = post_json) -> Callable[[list[dict]], str]:
    """A function from messages to the model's answer, without its reasoning. The wire format is told by the path: one that ends in
    /api/chat takes options and gives one message, any other takes the limits beside the messages and gives choices."""
    native = "/api/chat" in urlparse(url).path
    limits = {"stream": False, "think": False, "options": {"temperature": temperature, "num_predict": most}} if native else {"temperature": temperature, "max_tokens": most}

    def answer(messages: list[dict]) -> str:
        reply = post(url, {"model": model, "messages": messages, **limits}, timeout)
        first = reply if native else next(iter(reply.get("choices") or []), {})
        said = (first.get("message") or {}).get("content") or ""
        return said.rpartition("</think>")[2].strip()

    return answer


#: Notes that stand in the text of a page that could not be read, and of pages left out.
OCR_ERROR, OCR_LIMIT, DESCRIBED_LIMIT = "[OCR error on page {n}: {error}]", "[NOTE: OCR limited to first {most} of {total} pages]", "[NOTE: described first {most} of {total} pages]"


def paged(pages: list[Callable[[], bytes]], read: Callable[[bytes], str], most: int, limit_note: str, error_note: str = "") -> tuple[str, int]:
    """(text, pages read): what ``read`` tells of the first ``most`` pages, each under its [Page N] mark, then a note of those left out.

    Pages are pictures made when they are asked for. A page that fails has the error's note, or nothing where there is none.
    """
    blocks, good = [], 0
    for n, page in enumerate(pages[:most], 1):
        try:
            said = read(page())
            good += 1
        except Exception as e:  # one page's failure doesn't take the others
            said = error_note.format(n=n, error=e) if error_note else ""
        if said:
            blocks.append(f"[Page {n}] {said}")
    if len(pages) > most:
        blocks.append(limit_note.format(most=most, total=len(pages)))
    return "\n\n".join(blocks), good


def transcribed(pages: list[Callable[[], bytes]], read: Callable[[bytes], str], most: int = 25) -> tuple[str, int]:
    """A scan's pages as text, and how many were read."""
    return paged(pages, read, most, OCR_LIMIT, OCR_ERROR)


def described(pages: list[Callable[[], bytes]], read: Callable[[bytes], str], most: int = 4) -> str:
    """What a vision model says of the first pages; pages that fail say nothing."""
    return paged(pages, read, most, DESCRIBED_LIMIT)[0]
