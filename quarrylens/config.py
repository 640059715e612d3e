"""Configuration: dataclasses, TOML, limits and command-line overrides."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from .errors import ConfigError
from .functions import names as N


@dataclass
class Project:
    name: str = "Untitled Project"
    description: str | None = None
    version: str | None = None


@dataclass
class Analysis:
    exclude: list[str] = field(default_factory=lambda: list(N.DEFAULT_EXCLUDE))
    include: list[str] = field(default_factory=lambda: ["**/*.py"])
    entry_points: list[str] = field(default_factory=list)
    max_depth: int = 5


@dataclass
class Output:
    format: str = "html"
    directory: str = "./docs-out"
    theme: str = "default"


@dataclass
class Diagrams:
    enabled: bool = True
    max_nodes: int = 100
    layout: str = "hierarchical"


@dataclass
class Llm:
    enabled: bool = False
    provider: str = "ollama"
    model: str = "llama3.2"
    api_url: str | None = None
    api_key: str | None = None


CHOICES = {"format": ("html", "json", "markdown"), "layout": ("hierarchical", "force", "radial"), "provider": ("ollama", "openai")}


@dataclass
class Config:
    project: Project = field(default_factory=Project)
    analysis: Analysis = field(default_factory=Analysis)
    output: Output = field(default_factory=Output)
    diagrams: Diagrams = field(default_factory=Diagrams)
    llm: Llm = field(default_factory=Llm)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        out = cls()
        for part in fields(out):
            section = getattr(out, part.name)
            known = {f.name for f in fields(section)}
            for k, v in data.get(part.name, {}).items():
                if k not in known:
                    continue
                if k in CHOICES and v not in CHOICES[k]:
                    raise ConfigError(f"{part.name}.{k}: {v!r} is none of {', '.join(CHOICES[k])}")
                setattr(section, k, v)
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            with open(path, "rb") as f:
                data = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{path}: {e}") from e
        out = cls.from_dict(data)
        out.validate()
        return out

    @classmethod
    def load_or_default(cls, path: str) -> Config:
        try:
            return cls.load(path)
        except ConfigError:
            return cls()

    def validate(self) -> None:
        if self.analysis.max_depth < 1:
            raise ConfigError("max_depth must be at least 1")
        if self.analysis.max_depth > 100:
            raise ConfigError("max_depth cannot exceed 100")
        if self.diagrams.max_nodes < 1:
            raise ConfigError("diagram max_nodes must be at least 1")
        if not self.analysis.include:
            raise ConfigError("at least one include pattern required")

    def merge_cli(self, output=None, exclude=(), format=None, depth=None, no_diagrams=False, no_explain=False) -> Config:
        """Command-line values win; further exclude patterns are added to those that are there."""
        if output:
            self.output.directory = output
        self.analysis.exclude += list(exclude)
        if format:
            self.output.format = {"json": "json", "markdown": "markdown", "md": "markdown"}.get(format, "html")
        if depth is not None:
            self.analysis.max_depth = depth
        self.diagrams.enabled &= not no_diagrams
        self.llm.enabled &= not no_explain
        return self
