"""Seams for models: chat and embedding providers, with offline stand-ins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol


class ChatProvider(Protocol):
    def chat(self, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None, json_mode: bool = False) -> str: ...

    def stream(self, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None) -> Iterator[str]: ...


class ScriptedChat:
    """Replies from a list, in order; raises when it is exhausted."""

    def __init__(self, replies: list[str]):
        self.replies, self.asked = list(replies), []

    def chat(self, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None, json_mode: bool = False) -> str:
        self.asked.append((messages, json_mode))
        if not self.replies:
            raise RuntimeError("no reply left")
        return self.replies.pop(0) or ""

    def stream(self, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None) -> Iterator[str]:
        yield from (x for x in self.chat(messages, temperature, max_tokens).split(" ") if x)


class CachedChat:
    """A provider behind a response cache; all parameters are part of the key, streams aren't cached."""

    def __init__(self, provider: ChatProvider, cache, model: str = ""):
        self.provider, self.cache, self.model = provider, cache, model

    def chat(self, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None, json_mode: bool = False) -> str:
        key = (messages, temperature, max_tokens, json_mode, self.model)
        return self.cache.cached("chat", key, lambda: self.provider.chat(messages, temperature, max_tokens, json_mode))

    def stream(self, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None) -> Iterator[str]:
        yield from self.provider.stream(messages, temperature, max_tokens)
