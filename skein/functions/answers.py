"""Prompts, model routing, structured answers and their display; model calls are a hook.

Templates are parameters; the ones here are defaults of this engine.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import ConfigurationError, ProviderError
from skein.shared import exists

#: Language names, headers, most sources, model prefixes and the default model.
LANGUAGES = {"hu": "Hungarian", "en": "English"}
HEADERS = {"hu": "📚 Források:", "en": "📚 Sources:"}
MOST_SOURCES = 5
PROVIDERS = {"claude-": "anthropic", "gpt-": "openai"}
DEFAULT_MODEL = "claude-sonnet-4-5"

SYSTEM = "{persona}\n\nAnswer in {language}, from the given context only, as JSON with answer, personality_reply, sources and smalltalk."
USER = "## Context\n{chunks}\n\n## Question\n{question}\n"
ANSWER = "answer string, personality_reply string, sources array<string>, smalltalk boolean"


def provider(model: Column) -> Column:
    """The provider of a model name, null for an unknown prefix."""
    out = F.lit(None).cast("string")
    for prefix, name in PROVIDERS.items():
        out = F.when(model.startswith(prefix), name).otherwise(out)
    return out


def system_prompt(persona: str, language: str = "hu", template: str = SYSTEM) -> str:
    return template.replace("{persona}", persona.strip()).replace("{language}", LANGUAGES.get(language, language))


def user_prompt(chunks: Column, question: Column, template: str = USER) -> Column:
    """The user prompt as a column; texts that hold braces are taken as they are."""
    before, _, rest = template.partition("{chunks}")
    middle, _, after = rest.partition("{question}")
    return F.concat(F.lit(before), chunks, F.lit(middle), question, F.lit(after))


def display(answer: Column, language: str = "hu") -> Column:
    """A structured answer (JSON text) for display: small talk is the reply alone; else answer, reply and at most five sources."""
    a = F.from_json(answer, ANSWER)
    sources = F.coalesce(a["sources"], F.array().cast("array<string>"))
    listed = F.concat(F.lit(f"\n{HEADERS.get(language, HEADERS['en'])}\n"), F.array_join(F.transform(F.slice(sources, 1, MOST_SOURCES), lambda u: F.concat(F.lit("- "), u)), "\n"))
    long = F.concat_ws("\n", F.when(a["answer"] != "", a["answer"]), F.concat(F.lit("\n"), a["personality_reply"]), F.when(F.size(sources) > 0, listed))
    return F.when(a["smalltalk"], a["personality_reply"]).otherwise(long)


display_discord = display


class Templates:
    """Template files of a folder, read once each; with a session from any file system that Spark knows, else from the local one."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        from pathlib import Path

        self.folder, self.spark, self.cache = folder, spark, {}
        if not (exists(spark, folder) if spark else Path(folder).is_dir()):
            raise ConfigurationError(f"no folder {folder}")

    def load(self, name: str) -> str:
        if name not in self.cache:
            path = f"{self.folder}/{name}"
            try:
                if self.spark and not exists(self.spark, path):
                    raise FileNotFoundError(path)
                self.cache[name] = self.spark.read.text(path, wholetext=True).first()[0] if self.spark else open(path, encoding="utf-8").read()
            except FileNotFoundError as e:
                raise ConfigurationError(f"no template {name}") from e
        return self.cache[name]

    def clear(self) -> None:
        self.cache.clear()


@dataclass
class Router:
    """Calls by model name: ``providers`` maps a provider's name to ``call(system, user, model) -> (text, prompt_tokens, completion_tokens)``."""

    providers: dict[str, Callable]
    default_model: str = DEFAULT_MODEL
    tries: int = 3
    wait: Callable[[float], None] = time.sleep

    def __post_init__(self):
        self.name(self.default_model)

    def name(self, model: str) -> str:
        for prefix, name in PROVIDERS.items():
            if model.startswith(prefix):
                return name
        raise ProviderError(f"unknown model {model}")

    def generate(self, system: str, user: str, model: str | None = None) -> dict:
        """Text, tokens, cost and seconds of a call; retryable failures are tried again after 2, 4, ... s."""
        from skein.operators.analytics import cost

        model = model or self.default_model
        call = self.providers.get(self.name(model))
        if call is None:
            raise ConfigurationError(f"no provider for {model}")
        began = time.time()
        for k in range(self.tries):
            try:
                text, prompt, completion = call(system, user, model)
                return {"text": text, "model": model, "prompt_tokens": prompt, "completion_tokens": completion, "cost_usd": cost(model, prompt, completion), "seconds": time.time() - began}
            except ProviderError as e:
                if not e.retryable or k == self.tries - 1:
                    raise
                self.wait(2.0 ** (k + 1))
        raise ProviderError("no try was made")

    def generate_structured(self, system: str, user: str, model: str | None = None) -> dict:
        """``generate``, with the text read as a structured answer."""
        out = self.generate(system, user, model)
        return out | {"answer": structured(out["text"])}


def generate(rows: DataFrame, router: Callable[[], Router], system: str, prompt: str = "prompt", model: str = "model") -> DataFrame:
    """``rows`` with reply, prompt_tokens, completion_tokens, cost_usd and error: one call for each row, by a router made in each task.

    A call that fails for good leaves its row with an error and no reply.
    """
    new = "reply string, prompt_tokens int, completion_tokens int, cost_usd double, error string"
    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = router()
        for part in batches:
            out: list[tuple] = []
            for text, name in zip(part[prompt], part[model]):
                try:
                    got = made.generate(system, text, name)
                    out.append((got["text"], got["prompt_tokens"], got["completion_tokens"], got["cost_usd"], None))
                except (ProviderError, ValueError) as e:
                    out.append((None, None, None, None, str(e)))
            columns = pd.DataFrame(out, columns=["reply", "prompt_tokens", "completion_tokens", "cost_usd", "error"], index=part.index)
            yield pd.concat([part, columns.astype({"prompt_tokens": "Int32", "completion_tokens": "Int32"})], axis=1)

    return rows.mapInPandas(run, f"{have}, {new}")


def structured(text: str) -> dict:
    """A structured answer from JSON; ``ValueError`` where a rule is broken."""
    a = json.loads(text)
    if not isinstance(a.get("personality_reply"), str) or not isinstance(a.get("smalltalk"), bool):
        raise ValueError("personality_reply and smalltalk are required")
    if not a["smalltalk"] and not (a.get("answer") and a.get("sources")):
        raise ValueError("answer and sources are required unless it is small talk")
    if any(not str(u).startswith(("http://", "https://")) for u in a.get("sources") or ()):
        raise ValueError("sources must be web addresses")
    return a


def json_schema() -> dict:
    """The structured answer's JSON schema."""
    text = {"anyOf": [{"type": "string"}, {"type": "null"}]}
    return {
        "title": "StructuredAnswer", "type": "object", "required": ["personality_reply", "smalltalk"],
        "properties": {"answer": text, "personality_reply": {"type": "string"}, "smalltalk": {"type": "boolean"}, "sources": {"anyOf": [{"type": "array", "items": {"type": "string", "format": "uri"}}, {"type": "null"}]}},
    }
