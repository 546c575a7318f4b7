"""Settings from environment variables, and the engine that they ask for."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..events import TRUE
from ..sources.templates import existing, read_templates
from . import model as M
from .engine import Engine, Options, required_names

# Where templates are unless told otherwise, and a provider's limits.
TEMPLATES = "/app/templates"
SECONDS = {"openrouter": 30, "ollama": 60}
PAGES = 4


def flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    return env[name].strip().lower() in TRUE if name in env else default


def number(env: Mapping[str, str], name: str, default: int) -> int:
    """The default for what is no number."""
    try:
        return int(env.get(name, default))
    except ValueError:
        return default


@dataclass(frozen=True)
class Provider:
    """What an adapter needs to reach its model."""

    name: str
    url: str
    key: str
    model: str
    template_model: str
    seconds: int
    retries: int
    backoff_ms: int
    pages: int

    @staticmethod
    def read(env: Mapping[str, str], name: str) -> Provider:
        told = lambda what: env.get(f"{name.upper()}_{what}", "").strip()
        whole = lambda what, default: number(env, f"{name.upper()}_{what}", default)
        model = told("MODEL")
        return Provider(
            name, told("BASE_URL"), told("API_KEY"), model, told("TEMPLATE_MODEL") or model, whole("TIMEOUT", SECONDS.get(name, 30)),
            whole("RATE_LIMIT_RETRIES", M.RETRIES), whole("RATE_LIMIT_BACKOFF_MS", M.BACKOFF_MS), whole("MAX_PDF_PAGES", PAGES),
        )


@dataclass(frozen=True)
class Settings:
    options: Options
    #: Folders that templates are read from, in order, and the one that new ones are written to.
    folders: tuple[str, ...]
    store: str
    provider: Provider | None

    @staticmethod
    def read(env: Mapping[str, str] | None = None, country: str = "NL") -> Settings:
        env = dict(os.environ) if env is None else env
        named = M.provider(dict(env))
        one = env.get("OCR_TEMPLATE_DIR", TEMPLATES)
        folders = tuple(s for p in env.get("OCR_TEMPLATE_DIRS", "").split(",") if (s := p.strip())) or (one,)
        rounds = max(1, number(env, "OCR_TEMPLATE_HEALING_MAX_ATTEMPTS", 3))
        options = Options(country, required_names(env.get("OCR_REQUIRED_FIELDS")), named != "none", flag(env, "OCR_AUTO_GENERATE_TEMPLATES"), rounds)
        return Settings(options, folders, env.get("OCR_TEMPLATE_DIR", folders[-1]), Provider.read(env, named) if named != "none" else None)

    def engine(self, spark: SparkSession, adapters: Mapping[str, Callable[[Provider], M.Adapter]] | None = None) -> Engine:
        """An engine with the templates of the folders (none of one that isn't there), and the provider's adapter."""
        there = [f for f in self.folders if existing(spark, f)]
        make = (adapters or {}).get(self.provider.name) if self.provider else None
        return Engine(read_templates(spark, *there)[0] if there else [], make(self.provider) if make else None, self.options)
