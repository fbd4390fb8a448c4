"""Model endpoints as a source: request rows in, response rows out, through a function the caller provides."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests a minute that providers allow.
LIMITS = {"nvidia_nim": 30, "google_ai": 60, "deepseek": 30}


class Bucket:
    """Token bucket: ``rate`` tokens a minute, at most ``rate`` saved up."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.tokens, self.last = rate, clock()

    def acquire(self) -> float:
        """Wait until a token is free; seconds waited."""
        now = self.clock()
        self.tokens = min(self.rate, self.tokens + (now - self.last) * self.rate / 60)
        self.last = now
        wait = 0.0
        if self.tokens < 1:
            wait = (1 - self.tokens) * 60 / self.rate
            self.sleep(wait)
            self.last = self.clock()
            self.tokens = 1.0
        self.tokens -= 1
        return wait


def limit_of(provider: str, default: int = 30) -> int:
    return LIMITS.get(provider, default)


def complete(requests: DataFrame, call: Callable[[str, str], str], provider: str, parallel: int = 4, retries: int = 5, backoff: float = 1.0) -> DataFrame:
    """Responses to (request_id, model, prompt) rows: request_id, model, prompt, response, error, attempts.

    ``parallel`` partitions bound the calls in flight and share the provider's limit. A failing request is tried again
    with doubling pauses and becomes a row with its error, so one request never fails the batch.
    """
    rate = limit_of(provider) / parallel

    def run(batches):
        bucket = Bucket(rate)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                answer, error, tries = None, None, 0
                for tries in range(1, retries + 1):
                    bucket.acquire()
                    try:
                        answer, error = call(r.model, r.prompt), None
                        break
                    except Exception as problem:
                        error = str(problem)
                        if tries < retries:
                            time.sleep(backoff * 2 ** (tries - 1))
                out.append((r.request_id, r.model, r.prompt, answer, error, tries))
            yield pd.DataFrame(out, columns=["request_id", "model", "prompt", "response", "error", "attempts"])

    kind = dict(requests.dtypes)["request_id"]
    return requests.select("request_id", "model", "prompt").repartition(parallel).mapInPandas(run, f"request_id {kind}, model string, prompt string, response string, error string, attempts int")


def registry(models: DataFrame, role: str | None = None, provider: str | None = None) -> DataFrame:
    """Registered models of a role and provider, by name."""
    if role:
        models = models.where(F.col("role") == role)
    if provider:
        models = models.where(F.col("provider") == provider)
    return models.orderBy("model")
