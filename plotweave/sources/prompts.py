"""Prompt templates: versions in numeric order, Mustache variables, few shots, cache keys."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from dataclasses import dataclass, field
from hashlib import md5


@dataclass
class Template:
    name: str
    version: str
    system: str = ""
    user: str = ""
    few_shots: list[tuple[str, str]] = field(default_factory=list)
    rules: list[tuple[str, str, str | None]] = field(default_factory=list)

    def render(self, variables: dict) -> tuple[str, str]:
        """System and user text."""
        system = self.system
        if self.few_shots:
            shots = "\n\n".join(f"[{k}]\n{a}\n{b}" for k, (a, b) in enumerate(self.few_shots, 1))
            system = f"{system}\n\n---\n{shots}\n\n---"
        return system, mustache(self.user, variables)


def mustache(text: str, values: dict) -> str:
    """Variables and sections ({{#list}}, {{^list}}); a missing variable is empty."""
    section = re.compile(r"\{\{([#^])(\w+)\}\}(.*?)\{\{/\2\}\}", re.DOTALL)

    def block(m: re.Match) -> str:
        value = values.get(m[2])
        if m[1] == "^":
            return "" if value else mustache(m[3], values)
        some = value if isinstance(value, list) else [value] if value else []
        return "".join(mustache(m[3], values | (x if isinstance(x, dict) else {".": x})) for x in some)

    return re.sub(r"\{\{\{?([\w.]+)\}\}\}?", lambda m: str(values.get(m[1], "")), section.sub(block, text))


class Registry:
    """Templates by name; the newest version is the largest by its numbers, not by its text."""

    def __init__(self):
        self._all: dict[str, dict[str, Template]] = {}

    @staticmethod
    def order(version: str) -> tuple[int, ...]:
        return tuple(int(x) for x in re.findall(r"\d+", version))

    def register(self, template: Template) -> None:
        self._all.setdefault(template.name, {})[template.version] = template

    def versions(self, name: str) -> list[Template]:
        return sorted(self._all.get(name, {}).values(), key=lambda t: self.order(t.version))

    def latest(self, name: str) -> Template | None:
        found = self.versions(name)
        return found[-1] if found else None


class Cache:
    """Answers by prompt, model and temperature, for a while and up to a number."""

    def __init__(self, seconds: float = 7200, most: int = 500, clock=time.monotonic):
        self._held: OrderedDict[str, tuple[float, str]] = OrderedDict()
        self._seconds, self._most, self._clock = seconds, most, clock
        self.hits = self.misses = 0

    @staticmethod
    def key(prompt: str, model: str, temperature: float) -> str:
        return md5(f"{prompt}|{model}|{temperature}".encode()).hexdigest()

    def get(self, prompt: str, model: str, temperature: float) -> str | None:
        key = self.key(prompt, model, temperature)
        made, answer = self._held.get(key, (None, None))
        if made is None or self._clock() - made > self._seconds:
            self._held.pop(key, None)
            self.misses += 1
            return None
        self._held.move_to_end(key)
        self.hits += 1
        return answer

    def put(self, prompt: str, model: str, temperature: float, answer: str) -> None:
        key = self.key(prompt, model, temperature)
        self._held[key] = (self._clock(), answer)
        self._held.move_to_end(key)
        while len(self._held) > self._most:
            self._held.popitem(last=False)
