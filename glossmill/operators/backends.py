"""External models as pluggable batch columns: sampling, judging and embedding run in mapInPandas with an injected client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

SAMPLES, MAX_RETRIES, WORKERS = 3, 4, 8


def with_retry(call: Callable[[], str], retries: int = MAX_RETRIES, wait: Callable[[float], None] = time.sleep) -> str:
    """Call again after 1, 2, 4, ... seconds; the last failure is raised."""
    for attempt in range(retries):
        try:
            return call()
        except Exception:
            if attempt == retries - 1:
                raise
            wait(2.0**attempt)
    raise ValueError("no attempts")


def ordered_calls(client: Callable, asked: Iterable, workers: int = WORKERS, retries: int = MAX_RETRIES, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[object, str | None]]:
    """(reply, error) of every question, in order, with up to `workers` calls in flight; each is retried by itself."""

    def one(question) -> tuple[object, str | None]:
        try:
            return with_retry(lambda: client(question), retries, wait), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(workers) as pool:
        yield from pool.map(one, asked)


def sample(prompts: DataFrame, make_client: Callable[[], Callable[[list], str]], samples: int = SAMPLES, prompt: str = "prompt", workers: int = WORKERS, retries: int = MAX_RETRIES) -> DataFrame:
    """`outputs` and `error` for each row of prompts: `samples` completions, or the error after the retries.

    make_client is called once for each partition, on the executor, and its client by several threads at once; write the result
    to a table before using it twice.
    """
    def run(batches: Iterator):
        client = make_client()
        for pdf in batches:
            found = list(ordered_calls(client, [t for t in pdf[prompt] for _ in range(samples)], workers, retries))
            rows = [found[k : k + samples] for k in range(0, len(found), samples)] if samples else [[] for _ in range(len(pdf))]
            errors = [next((e for _, e in row if e is not None), None) for row in rows]
            yield pdf.assign(outputs=[None if e else [r for r, _ in row] for row, e in zip(rows, errors, strict=True)], error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{schema}, outputs array<string>, error string")


def client_from_key(key: str | None, connect: Callable[[str], object]) -> object:
    """A client, or an end of the program with a message where there is no key."""
    if not key:
        raise SystemExit("no API key is set")
    return connect(key)
