"""Completions of (system, user) prompts as columns: a deterministic mock, or a client that each Python worker builds."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Executor, ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import let, stripped, token_estimate

#: From a system and a user prompt to the answer.
Completion = Callable[[Column, Column], Column]

# Attempts after the first, first pause, longest pause in seconds, statuses worth another attempt.
RETRIES = 5
PAUSE = 1.0
LONGEST_PAUSE = 120.0
RETRYABLE = (408, 429)
EQUIVALENT_ANSWER = '{"equivalent": true, "severity": "low", "explanation": "mock equivalent"}'
JSON_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
FALSY = r'"equivalent"\s*:\s*(?:false|null|-?0+(?:\.0+)?|""|\[\s*\]|\{\s*\})\s*[,}]'


def mock(prefix: str = "[EN] ", responses: dict[str, str] | None = None) -> Completion:
    """Answers that the first contained key of ``responses`` gives, else those that the system prompt's kind gives."""

    def complete(system: Column, user: Column) -> Column:
        s = F.lower(system)
        has = lambda *words: s.rlike("|".join(words))
        answer = F.when(F.lit(False), F.lit(""))
        for key, response in (responses or {}).items():
            answer = answer.when(F.contains(user, F.lit(key)), F.lit(response))
        variant = F.split(F.element_at(F.split(user, "Variant"), 2), "\n")[0]
        chosen = F.when(F.contains(user, F.lit("Variant")), variant).otherwise(F.concat(F.lit(prefix), F.left(user, F.lit(80))))
        answer = answer.when(has("semantic", "equivalent"), F.lit(EQUIVALENT_ANSWER)).when(has("adjudicate", "choose"), chosen)
        return answer.when(has("language"), F.lit("es")).otherwise(F.concat(F.lit(prefix), user))

    return complete


def pause(attempt: int, hint: float | None = None, base: float = PAUSE, most: float = LONGEST_PAUSE) -> float:
    """Seconds to wait after an attempt (from 0): the server's hint or a doubling pause."""
    return min(hint if hint is not None else base * 2**attempt, most)


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE) | (status >= 500)


#: What a call gives: the answer or why there is none, tokens, attempts; null where there was nothing to ask.
CALL = "struct<answer:string,error:string,tokens_in:bigint,tokens_out:bigint,attempts:int>"
#: What a client's function may return: the answer, or the answer with its tokens in and out.
Answer = str | tuple[str, int, int]


class Asking(NamedTuple):
    """Completions whose failures and tokens are data: a column of (system, user) to a CALL; a null user prompt is not asked.

    ``tasks`` deals dear calls over as many tasks, whatever their texts' size.
    """

    call: Completion
    tasks: int | None = None

    def text(self, system: Column, user: Column) -> Column:
        return self.call(system, user)["answer"]


def _call(answer: Column, error: Column, into: Column, out: Column) -> Column:
    some = F.when(error.isNull(), 1).otherwise(0)
    return F.struct(answer.alias("answer"), error.alias("error"), (into * some).cast("long").alias("tokens_in"), (out * some).cast("long").alias("tokens_out"), F.lit(1).alias("attempts"))


def counted(complete: Completion, fails: Completion | None = None) -> Asking:
    """A completion as calls, its tokens by the estimate of texts; where ``fails`` gives a message the call has failed with it."""

    def call(system: Column, user: Column) -> Column:
        error = F.lit(None).cast("string") if fails is None else fails(system, user)
        made = let(F.struct(complete(system, user).alias("answer"), error.alias("error")), lambda x: _call(
            F.when(x["error"].isNull(), x["answer"]), x["error"], token_estimate(system) + token_estimate(user), F.coalesce(token_estimate(x["answer"]), F.lit(0)),
        ))
        return F.when(user.isNotNull(), made)

    return Asking(call)


class RetryClock:
    """When a worker's threads may ask again: a server's hint to one of them holds for all."""

    def __init__(self) -> None:
        self.lock, self.until = threading.Lock(), 0.0

    def hold(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, time.monotonic() + seconds)

    def wait(self) -> None:
        while (left := self.until - time.monotonic()) > 0:
            time.sleep(left)


def ask_once(ask: Callable[[str, str], Answer], clock: RetryClock, system: str, user: str | None, retries: int, base: float) -> tuple | None:
    """A CALL's values: ConnectionError and TimeoutError are tried again, any other error is the call's at once."""
    if user is None:
        return None
    error = ""
    for attempt in range(1, retries + 2):
        clock.wait()
        try:
            got = ask(system, user)
        except (ConnectionError, TimeoutError) as e:
            error = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                clock.hold(pause(attempt - 1, getattr(e, "retry_after", None), base))
        except Exception as e:  # the document's failure, not the job's
            return None, f"{type(e).__name__}: {e}", 0, 0, attempt
        else:
            text, into, out = got if isinstance(got, tuple) else (got, estimate(system) + estimate(user), estimate(got))
            return text, None, max(0, into), max(0, out), attempt
    return None, error, 0, 0, retries + 1


def estimate(text: str) -> int:
    """Tokens of a text where a client counts none: a quarter of its characters, at least one."""
    n = len(text.strip())
    return max(1, -(-n // 4)) if n else 0


def in_order(pool: Executor, function: Callable, rows: Iterable, ahead: int) -> Iterator:
    """Results in the rows' order; at most ``ahead`` rows are taken before their turn, so a slow one holds the reading back."""
    waiting: deque = deque()
    for row in rows:
        if len(waiting) >= ahead:
            yield waiting.popleft().result()
        waiting.append(pool.submit(function, *row))
    while waiting:
        yield waiting.popleft().result()


def asking(factory: Callable[[], Callable[[str, str], Answer]], workers: int = 4, retries: int = RETRIES, base: float = PAUSE, tasks: int | None = None) -> Asking:
    """``factory`` runs once per task, whose ``workers`` threads ask at the same time; failures are data."""

    @F.pandas_udf(CALL)
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask, clock = factory(), RetryClock()
        names = ["answer", "error", "tokens_in", "tokens_out", "attempts"]
        with ThreadPoolExecutor(workers) as pool:
            one = lambda system, user: ask_once(ask, clock, system, user, retries, base)
            for systems, users in batches:
                rows = [r or (None,) * 5 for r in in_order(pool, one, zip(systems, users), 2 * workers)]
                out = pd.DataFrame(rows, columns=names, dtype="object")
                yield out.astype({"tokens_in": "Int64", "tokens_out": "Int64", "attempts": "Int32"})

    call = call.asNondeterministic()
    return Asking(lambda system, user: call(system, user), tasks)


def client(factory: Callable[[], Callable[[str, str], Answer]], retries: int = RETRIES, base: float = PAUSE) -> Completion:
    """The answers alone: a call that fails after its retries ends the job.  asking() makes failures data instead."""

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ask, clock = factory(), RetryClock()

        def one(system: str, user: str | None) -> str | None:
            made = ask_once(ask, clock, system, user, retries, base)
            if made is not None and made[1] is not None:
                raise RuntimeError(made[1])
            return made and made[0]

        for systems, users in batches:
            yield pd.Series([one(s, u) for s, u in zip(systems, users)], dtype="object")

    call = call.asNondeterministic()
    return lambda system, user: call(system, user)


def answer_object(raw: Column) -> Column:
    """The first JSON object in an answer as a variant, or null."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, JSON_OBJECT, 0), F.lit("")))


def answer_field(raw: Column, name: str) -> Column:
    return F.try_variant_get(answer_object(raw), f"$.{name}", "string")


def says_equivalent(raw: Column) -> Column:
    """Whether the object's ``equivalent`` is true as Python takes values: any text counts, even "false"."""
    found = F.regexp_extract(raw, JSON_OBJECT, 0)
    return answer_object(raw).isNotNull() & found.rlike(r'"equivalent"\s*:') & ~found.rlike(FALSY)


def language_answer(raw: Column) -> Column:
    """The two letters of a language answer, else unknown."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(F.lower(stripped(raw)), "[^a-z]", ""), F.lit(2)), F.lit("")), F.lit("unknown"))
