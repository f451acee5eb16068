"""Text generators: objects with generate(messages) and, for streams, stream(messages).

Messages are (role, content) pairs. The fake ones are deterministic; the HTTP
one speaks the chat-completions protocol, unary and as server-sent events.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from ..schema import EngineError

Message = tuple[str, str]


class TextGenerator(Protocol):
    def generate(self, messages: list[Message]) -> str: ...

    def stream(self, messages: list[Message]) -> Iterator[str]: ...


class CannedGenerator:
    """The same reply to everything."""

    def __init__(self, reply: str) -> None:
        self.reply = reply

    def generate(self, messages: list[Message]) -> str:
        return self.reply

    def stream(self, messages: list[Message]) -> Iterator[str]:
        yield from re.findall(r"\S+\s*", self.reply)


class FirstSentenceGenerator:
    """Answers with the first sentence of the first numbered passage and its mark, or the refusal token."""

    def generate(self, messages: list[Message]) -> str:
        m = re.search(r"^\[1\] \(.*?\)\n(.+?(?:[.!?](?=\s|$)|$))", messages[-1][1], re.S | re.M)
        return f"{m[1].strip()} [1]" if m else "[NO_ANSWER]"

    def stream(self, messages: list[Message]) -> Iterator[str]:
        yield from re.findall(r"\S+\s*", self.generate(messages))


# Public endpoints of chat-completions services.
ENDPOINTS = {
    "openai": "https://api.openai.com/v1",
    "groq": "https://api.groq.com/openai/v1",
    "mistral": "https://api.mistral.ai/v1",
    "openrouter": "https://openrouter.ai/api/v1",
    "together": "https://api.together.xyz/v1",
}


class ChatGenerator:
    """Chat completions over HTTP; ``base`` is a URL or the name of an endpoint."""

    def __init__(self, base: str, model: str, api_key: str | None = None, temperature: float | None = None, max_tokens: int | None = None, timeout: float = 60) -> None:
        self.url = f"{ENDPOINTS.get(base, base).rstrip('/')}/chat/completions"
        self.model, self.temperature, self.max_tokens, self.timeout = model, temperature, max_tokens, timeout
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})

    def _open(self, messages: list[Message], stream: bool):
        body = {"model": self.model, "messages": [{"role": r, "content": c} for r, c in messages], "stream": stream}
        body |= {k: v for k, v in (("temperature", self.temperature), ("max_tokens", self.max_tokens)) if v is not None}
        try:
            return urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), self.headers), timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise EngineError(e.code, f"the chat service answered {e.code}") from None

    def generate(self, messages: list[Message]) -> str:
        with self._open(messages, False) as answer:
            try:
                return json.loads(answer.read())["choices"][0]["message"]["content"]
            except (ValueError, KeyError, IndexError, TypeError):
                raise EngineError(430, "the chat service's answer is malformed") from None

    def stream(self, messages: list[Message]) -> Iterator[str]:
        with self._open(messages, True) as answer:
            for line in answer:
                text = line.decode("utf-8").strip()
                if not text.startswith("data:"):
                    continue
                data = text[5:].strip()
                if data == "[DONE]":
                    return
                for choice in json.loads(data).get("choices", []):
                    if piece := (choice.get("delta") or {}).get("content"):
                        yield piece


#: What a worker has loaded, by the name of its model.
_LOADED: dict[str, object] = {}


def loaded(name: str, factory):
    """The object that factory makes, made once in each worker process."""
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


class LocalGenerator:
    """A generator in the worker process: ``factory`` loads a model on first use, which has generate() and perhaps stream()."""

    def __init__(self, name: str, factory) -> None:
        self.name, self.factory = name, factory

    def generate(self, messages: list[Message]) -> str:
        return loaded(self.name, self.factory).generate(messages)

    def stream(self, messages: list[Message]) -> Iterator[str]:
        model = loaded(self.name, self.factory)
        yield from model.stream(messages) if hasattr(model, "stream") else re.findall(r"\S+\s*", model.generate(messages))


class ModelPrefix:
    """Context prefixes of chunks by a text generator, for IndexingConfig.context_fn."""

    prompted = True

    def __init__(self, generator: TextGenerator, system: str = "Reply with one short sentence and nothing else.") -> None:
        self.generator, self.system = generator, system

    def many(self, chunks: list[dict]) -> list[str | None]:
        out: list[str | None] = []
        for chunk in chunks:
            try:
                out.append(self.generator.generate([("system", self.system), ("user", chunk["prompt"])]))
            except Exception:  # noqa: BLE001  the rule gives the prefix instead
                out.append(None)
        return out
