"""Where search responses and model replies come from: tables joined offline, or HTTP from the executors.

A provider takes the distinct requests and returns a table; the pipeline writes its output before using it, so that a
remote call is not made again when a task is.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matches import parse_response

# Default addresses of the services.
SEARCH_URL = "https://api.inaturalist.org"
OLLAMA_URL, OPENAI_URL, ANTHROPIC_URL = "http://localhost:11434", "https://api.openai.com", "https://api.anthropic.com"
ANTHROPIC_VERSION, MAX_TOKENS = "2023-06-01", 1024


def table_searcher(responses: DataFrame, locale: str) -> Callable[[DataFrame], DataFrame]:
    """Searches by a table (query, locale, response_json)."""

    def search(queries: DataFrame) -> DataFrame:
        own = responses.where(F.col("locale") == locale).select("query", "response_json")
        return queries.join(own, "query").select("query", parse_response(F.col("response_json"), F.col("query"), locale).alias("matches"))

    return search


@dataclass
class TokenBucket:
    """`rate` permits a second, at most `burst` at once."""

    rate: float
    burst: int
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    level: float = field(init=False)
    last: float = field(init=False)

    def __post_init__(self):
        self.level, self.last = float(self.burst), self.clock()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            self.level, self.last = min(self.burst, self.level + (now - self.last) * max(self.rate, 0.0)), now
            if self.level >= 1:
                self.level -= 1
                return
            self.sleep(max((1 - self.level) / self.rate, 0.01) if self.rate > 0 else 0.1)


def backoff(attempt: int) -> float:
    return 3 * 2**attempt * random.uniform(0.5, 1.0)


def _get(url: str, headers: dict[str, str], timeout: float, body: bytes | None = None) -> tuple[int, str]:
    request = urllib.request.Request(url, data=body, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def fetch(url: str, headers: dict[str, str], timeout: float, retries: int, get=_get, sleep=time.sleep) -> str:
    """The body of a 200 reply; 429 and 5xx are tried again, others raise."""
    for attempt in range(retries + 1):
        status, body = get(url, headers, timeout)
        if status == 200:
            return body
        if not (status == 429 or status >= 500) or attempt == retries:
            raise RuntimeError(f"HTTP {status} from {url}")
        sleep(backoff(attempt))
    raise AssertionError


def http_responses(queries: DataFrame, locale: str, base_url: str = SEARCH_URL, user_agent: str = "binomia/0.1", timeout: float = 30, retries: int = 3, rate: float = 1.0, burst: int = 5, partitions: int = 1, on_error: str = "raise", get=_get) -> DataFrame:
    """(query, locale, response_json, created_at) of a remote autocomplete search. Each of `partitions` tasks has its share of
    the rate, so the sum keeps to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(rate / partitions, max(1, burst // partitions))
        for part in batches:
            out = []
            for q in part["query"]:
                bucket.acquire()
                try:
                    body = fetch(f"{base_url}/v1/taxa/autocomplete?{urllib.parse.urlencode({'q': q, 'locale': locale})}", {"User-Agent": user_agent}, timeout, retries, get)
                except Exception:
                    if on_error == "raise":
                        raise
                    continue
                out.append((q, locale, body, pd.Timestamp.now("UTC").tz_localize(None)))
            yield pd.DataFrame(out, columns=["query", "locale", "response_json", "created_at"])

    return queries.select("query").distinct().coalesce(partitions).mapInPandas(run, "query string, locale string, response_json string, created_at timestamp")


class LlmError(RuntimeError):
    pass


def request_of(provider: str, model: str, url: str | None, key: str, system: str, user: str, schema: dict | None = None) -> tuple[str, dict[str, str], dict]:
    """(address, headers, payload) of a completion request."""
    messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    headers = {"Content-Type": "application/json"}
    if provider == "ollama":
        return f"{url or OLLAMA_URL}/api/chat", headers, {"model": model, "messages": messages, "stream": False, "format": "json"}
    if provider == "openai":
        form = {"response_format": {"type": "json_schema", "json_schema": {"name": "response", "schema": schema}}} if schema else {}
        return f"{url or OPENAI_URL}/v1/chat/completions", headers | {"Authorization": f"Bearer {key}"}, {"model": model, "messages": messages} | form
    if provider == "anthropic":
        return f"{url or ANTHROPIC_URL}/v1/messages", headers | {"x-api-key": key, "anthropic-version": ANTHROPIC_VERSION}, {"model": model, "max_tokens": MAX_TOKENS, "system": system, "messages": messages[1:]}
    raise ValueError(f"Unknown LLM provider: {provider}")


def reply_of(provider: str, status: int, body: str) -> str:
    """The text of a completion reply."""
    if status >= 400:
        raise LlmError(f"HTTP {status}: {body[:200]}")
    try:
        data = json.loads(body)
        if provider == "ollama":
            text = data["message"]["content"]
        elif provider == "openai":
            text = data["choices"][0]["message"]["content"]
        else:
            text = data["content"][0]["text"]
    except (KeyError, IndexError, TypeError, ValueError) as e:
        raise LlmError(f"no content in the reply: {body[:200]}") from e
    if not text:
        raise LlmError("empty content in the reply")
    return text


def table_llm(replies: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Replies by a table (prompt_key, raw); prompt_key is sha256 of system and user prompt, joined by a newline."""
    return lambda prompts: prompts.join(replies, "prompt_key")


def prompt_key(system: str, user):
    return F.sha2(F.concat(F.lit(system + "\n"), user), 256)


def http_llm(provider: str, model: str, system: str, url: str | None = None, key: str = "", timeout: float = 60, attempts: int = 3, partitions: int = 8, get=_get) -> Callable[[DataFrame], DataFrame]:
    """Replies by HTTP, (prompt_key, raw) for prompts (prompt_key, user); raw is null where all attempts fail."""
    request_of(provider, model, url, key, "", "")  # an unknown provider fails here

    def ask(prompts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                out = []
                for user in part["user"]:
                    raw = None
                    for _ in range(attempts):
                        address, headers, payload = request_of(provider, model, url, key, system, user)
                        try:
                            raw = reply_of(provider, *get(address, headers, timeout, json.dumps(payload).encode()))
                            break
                        except LlmError:
                            continue
                    out.append(raw)
                yield pd.DataFrame({"prompt_key": part["prompt_key"], "raw": out})

        return prompts.select("prompt_key", "user").repartition(partitions, "prompt_key").mapInPandas(run, "prompt_key string, raw string")

    return ask
