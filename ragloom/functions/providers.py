"""Plug-ins: embedders, rerankers, language models. Only those that need no network are built in."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.vectors import mock_embedding


class ProviderError(RuntimeError):
    """A model can't be made or doesn't answer."""


Embedder = Callable[[Column], Column]
_EMBEDDERS: dict[str, Callable[[], Embedder]] = {"mock": lambda: mock_embedding}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    _EMBEDDERS[name] = make


def embedder(name: str = "mock", fallback: str | None = "mock", timeout: float | None = None) -> tuple[str, Embedder]:
    """(name, embedder); where it can't be made, or not within timeout seconds, the fallback's, or ``ProviderError`` without one."""
    last: BaseException | None = None
    for each in dict.fromkeys([name, *([fallback] if fallback else [])]):
        try:
            return each, _in_time(_EMBEDDERS[each], timeout)
        except Exception as problem:  # noqa: BLE001 - whatever a model's loading raises
            last = problem
    raise ProviderError(f"no embedder {name!r}") from last


def _in_time(make: Callable[[], Embedder], timeout: float | None) -> Embedder:
    if timeout is None:
        return make()
    made: list = []

    def work() -> None:
        try:
            made.append((make(), None))
        except Exception as problem:  # noqa: BLE001
            made.append((None, problem))

    thread = threading.Thread(target=work, daemon=True)  # one that hangs must not keep the process alive
    thread.start()
    thread.join(timeout)
    if not made:
        raise TimeoutError(f"no answer within {timeout} s")
    if made[0][1] is not None:
        raise made[0][1]
    return made[0][0]


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Embedder:
    """An embedder that loads its model once a task and embeds a batch of texts a call; null stays null."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            known = [t for t in texts.to_pylist() if t is not None]
            vectors = iter(model(known) if known else [])
            yield pa.array([None if not t.is_valid else next(vectors) for t in texts], pa.list_(pa.float64()))

    return lambda text: embed(text)


def generated(prompt: Column, generate: Callable[[str], str]) -> Column:
    """STRUCT<answer, error, ms> of each prompt; a failure is a row's error, not the query's."""

    @F.arrow_udf("struct<answer:string,error:string,ms:double>")
    def run(prompts: pa.Array) -> pa.Array:
        out = []
        for p in prompts.to_pylist():
            began = time.perf_counter()
            try:
                said, error = (generate(p) if p is not None else None), None
            except Exception as problem:  # noqa: BLE001
                said, error = None, str(problem)
            out.append({"answer": said, "error": error, "ms": (time.perf_counter() - began) * 1000})
        return pa.array(out, pa.struct([("answer", pa.string()), ("error", pa.string()), ("ms", pa.float64())]))

    return run.asNondeterministic()(prompt)


@dataclass(frozen=True)
class ChatModel:
    """A language model behind a chat-completions address; an instance is a function of a prompt, so it can be given as ``generate``.

    The key goes to tasks with the function; where none is given it is read from the variable ``key_from`` there. It is never part of a plan, a text or an error.
    """

    address: str
    model: str
    key_from: str = "LLM_API_KEY"
    system: str = ""
    temperature: float = 0.0
    timeout: float = 60.0
    key: str = field(default="", repr=False)

    @classmethod
    def from_environment(cls, system: str = "") -> "ChatModel":
        """LLM_BASE_URL and LLM_MODEL name the model, LLM_API_KEY has the key; ``ProviderError`` where one is missing."""
        missing = [v for v in ("LLM_BASE_URL", "LLM_MODEL", "LLM_API_KEY") if not os.environ.get(v, "").strip()]
        if missing:
            raise ProviderError(f"not set: {', '.join(missing)}")
        return cls(os.environ["LLM_BASE_URL"].strip().rstrip("/") + "/chat/completions", os.environ["LLM_MODEL"].strip(), system=system, key=os.environ["LLM_API_KEY"].strip())

    def body(self, prompt: str) -> dict:
        said = [{"role": "system", "content": self.system}] if self.system else []
        return {"model": self.model, "temperature": self.temperature, "messages": [*said, {"role": "user", "content": prompt}]}

    def __call__(self, prompt: str) -> str:
        key = self.key or os.environ.get(self.key_from, "").strip()
        if not key:
            raise ProviderError(f"not set: {self.key_from}")
        request = Request(self.address, json.dumps(self.body(prompt)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"] or ""
        except Exception as problem:
            raise ProviderError(f"the model did not answer: {problem}") from problem
