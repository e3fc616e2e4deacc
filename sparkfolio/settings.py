"""Settings, read once on the driver from the environment; values out of bounds are errors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "SPARKFOLIO_"
# The bounds of each numeric setting.
BOUNDS = {
    "jobs": (1, 20), "recognitions": (1, 20), "attempts": (1, 10), "timeout_seconds": (1, 3600), "upload_mib": (1, 2048),
    "table_font": (4, 24), "table_least_font": (4, 24), "table_line_height": (1, 3),
}


@dataclass(frozen=True)
class Settings:
    jobs: int = 2
    recognitions: int = 2
    attempts: int = 3
    timeout_seconds: int = 180
    upload_mib: int = 200
    table_font: float = 9.0
    table_least_font: float = 6.0
    table_line_height: float = 1.25
    translator_url: str = ""
    translator_key: str = ""
    recognizer_url: str = ""
    recognizer_key: str = ""

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        """From variables with PREFIX; blank ones count as not set, a recogniser without a key uses the translator's."""
        env = os.environ if env is None else env
        given = {f.name: v.strip() for f in fields(cls) if (v := env.get(PREFIX + f.name.upper(), "")).strip()}
        out = {f.name: type(f.default)(given[f.name]) for f in fields(cls) if f.name in given}
        for name, (low, high) in BOUNDS.items():
            if name in out and not low <= out[name] <= high:
                raise ValueError(f"{PREFIX}{name.upper()} has to be from {low} to {high}")
        for name in ("translator_url", "recognizer_url"):
            if name in out:
                out[name] = normal_url(out[name])
        if "recognizer_key" not in out and "translator_key" in out:
            out["recognizer_key"] = out["translator_key"]
        return cls(**out)

    def lacking(self, recognize: bool) -> list[str]:
        """What a run needs and these settings do not have."""
        wanted = ["translator_key", *(["recognizer_key"] if recognize else [])]
        return [w for w in wanted if not getattr(self, w)]


def normal_url(url: str) -> str:
    """Without a slash at the end and without the name of an endpoint."""
    return url.rstrip("/").removesuffix("/chat/completions").rstrip("/")
