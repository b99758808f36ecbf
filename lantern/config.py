"""Settings of an engine: a TOML file found upwards from the working folder, with overrides from the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

NAME = ".lantern"

TEMPLATE = """# where the notes are
roots = ["~/notes"]
# where the index goes
index = "~/.local/share/lantern/index"

[scorer]
backend = "lexical"

[budget]
max_usd_per_query = 0.05
daily_cap_usd = 1.0
# evaluations are refused while this is 0
eval_daily_cap_usd = 0.0
"""


@dataclass
class Config:
    roots: list[str]
    index: str
    exclude: list[str] = field(default_factory=lambda: [".git/**", "node_modules/**", "**/.obsidian/**"])
    extensions: list[str] = field(default_factory=lambda: [".md"])
    embed_model: str = "hash:64"
    embedding: dict = field(default_factory=dict)
    chunk_words: int = 350
    rrf_k: int = 60
    keyword_weight: float = 0.5
    vector_pool: int = 50
    section_pool: int = 400
    k: int = 20
    widen_at: float | str = "auto"
    widen_k: int = 150
    rare_max_df: int = 12
    max_windows: int = 24
    question_gate: bool = True
    question_kinds: bool = False
    widen_kinds: list[str] = field(default_factory=lambda: ["aggregate", "temporal"])
    scorer: dict = field(default_factory=lambda: {"backend": "lexical"})
    max_usd_per_query: float = 0.05
    daily_cap_usd: float = 1.0
    widen_reserve_frac: float = 0.35
    session_share_frac: float = 0.4
    eval_daily_cap_usd: float = 0.0
    labels: dict = field(default_factory=dict)

    @property
    def ledger(self) -> str:
        return f"{self.index}-spend"

    @property
    def recall_log(self) -> str:
        return f"{self.index}-log"


def extensions(given: str | list[str] | None) -> list[str]:
    """With a leading dot and in lower case; one may be given alone."""
    many = [given] if isinstance(given, str) else list(given or [".md"])
    return [e.lower() if e.startswith(".") else f".{e.lower()}" for e in many]


def find(start: Path | None = None) -> Path | None:
    if named := os.environ.get("LANTERN_CONFIG"):
        return Path(named).expanduser()
    here = (start or Path.cwd()).resolve()
    for folder in [here, *here.parents, Path.home()]:
        for name in (f"{NAME}/config.toml", f"{NAME}.toml"):
            if (folder / name).is_file():
                return folder / name
    return None


def load(path: str | Path | None = None) -> Config:
    """The configuration; flat keys and those of the tables embedding, search, scorer, budget and labels."""
    source = Path(path) if path else find()
    raw = tomllib.loads(source.read_text()) if source else {}
    flat = {k: v for k, v in raw.items() if not isinstance(v, dict)}
    for name in ("search", "budget"):
        flat |= raw.get(name, {})
    flat |= {k: raw[k] for k in ("scorer", "labels") if k in raw}
    # the table's other keys are options of the model
    embedding = dict(raw.get("embedding", {}))
    for key, name in (("model", "embed_model"), ("chunk_words", "chunk_words")):
        if key in embedding:
            flat[name] = embedding.pop(key)
    flat["embedding"] = embedding
    if roots := os.environ.get("LANTERN_ROOTS"):
        flat["roots"] = roots.split(os.pathsep)
    if index := os.environ.get("LANTERN_INDEX"):
        flat["index"] = index
    if backend := os.environ.get("LANTERN_SCORER"):
        flat["scorer"] = {**flat.get("scorer", {}), "backend": backend}
    unknown = set(flat) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if not flat.get("roots"):
        raise ValueError("no roots are set")
    flat["roots"] = [os.path.expanduser(r) for r in flat["roots"]]
    flat["index"] = os.path.expanduser(flat.get("index") or "~/.local/share/lantern/index")
    flat["extensions"] = extensions(flat.get("extensions"))
    return Config(**flat)
