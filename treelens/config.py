"""Settings of the service surface, from the environment or a .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    app_name: str = "treelens"
    version: str = "0.1.0"
    debug: bool = False

    @classmethod
    def load(cls, env_file: str | None = ".env") -> Settings:
        """Values of the environment go before those of the file, and these before the defaults."""
        found: dict[str, str] = {}
        if env_file and Path(env_file).is_file():
            lines = (line.strip() for line in Path(env_file).read_text().splitlines())
            found = {k.strip(): v.strip().strip("\"'") for k, _, v in (line.partition("=") for line in lines if "=" in line and not line.startswith("#"))}
        found |= os.environ
        return cls(found.get("APP_NAME", cls.app_name), found.get("VERSION", cls.version), found.get("DEBUG", "").lower() in ("1", "true", "yes", "on"))
