"""Settings of a correction run; environment variables override the defaults at each load."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

_OFF = {"0", "false", "False"}


@dataclass(frozen=True)
class Settings:
    llm_host: str = "http://127.0.0.1:11434"
    llm_model: str = "gemma3:4b"
    llm_timeout_s: int = 300
    llm_temperature: float = 0.0
    max_chunk_chars: int = 800
    sentence_overlap_chars: int = 0
    min_sequence_ratio: float = 0.75
    max_relative_length: float = 1.30
    lexicon_path: str | None = None
    use_lexicon: bool = True
    use_llm: bool = True
    use_heuristics: bool = True


#: The environment's names.
_VARIABLES = {
    "OLLAMA_HOST": ("llm_host", str),
    "OLLAMA_MODEL": ("llm_model", str),
    "OLLAMA_TIMEOUT": ("llm_timeout_s", int),
    "OLLAMA_TEMPERATURE": ("llm_temperature", float),
    "MAX_CHUNK_CHARS": ("max_chunk_chars", int),
    "SENTENCE_OVERLAP_CHARS": ("sentence_overlap_chars", int),
    "MIN_SEQUENCE_RATIO": ("min_sequence_ratio", float),
    "MAX_RELATIVE_LENGTH": ("max_relative_length", float),
}
_TOGGLES = {"TESSERA_LEXICON_ENABLE": "use_lexicon", "TESSERA_LLM": "use_llm", "TESSERA_HEURISTICS": "use_heuristics"}
_LEXICON, _DEFAULT_LEXICON = "TESSERA_LEXICON", "data/words.txt"


def load_settings(env: Mapping[str, str] = os.environ, root: str = ".") -> Settings:
    """An unset lexicon variable means the default list if that file exists; "" or "none" means no lexicon."""
    found: dict = {field: kind(env[name]) for name, (field, kind) in _VARIABLES.items() if name in env}
    found |= {field: env.get(name, "1") not in _OFF for name, field in _TOGGLES.items()}
    default = Path(root, _DEFAULT_LEXICON)
    named = env.get(_LEXICON)
    if named is None:
        found["lexicon_path"] = str(default) if default.is_file() else None
    else:
        found["lexicon_path"] = None if named.strip().lower() in ("", "none") else named
    return Settings(**found)
