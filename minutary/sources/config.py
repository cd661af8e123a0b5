"""Settings of a run: limits and the model client, from defaults, a file's values and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    """Limits of a run. Secrets are kept out of its text form."""

    stage_seconds: int = 1800
    model_seconds: int = 120
    model_retries: int = 3
    upload_bytes: int = 30 << 20
    chunk_size: int = 2400
    chunk_overlap: int = 160
    use_model: bool = False
    model_name: str = ""
    model_url: str = ""
    model_key: str = field(default="", repr=False)

    @classmethod
    def load(cls, values: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, prefix: str = "MINUTARY_", inherited: Mapping[str, object] | None = None) -> "Settings":
        """Defaults, overlaid by inherited values (another file's), by values, by variables such as MINUTARY_UPLOAD_BYTES.

        A value such as ``model_key_env`` names another variable to take ``model_key`` from. Nulls and empty variables overlay nothing.
        """
        env, values, inherited = os.environ if env is None else env, values or {}, inherited or {}
        out = {}
        for f in fields(cls):
            named = values.get(f.name + "_env")
            found = (env.get(prefix + f.name.upper()) or None, env.get(str(named)) or None if named else None, values.get(f.name), inherited.get(f.name))
            raw = next((x for x in found if x is not None), None)
            if raw is not None:
                out[f.name] = _typed(raw, type(f.default))
        made = replace(cls(), **out)
        for name in ("stage_seconds", "model_seconds", "upload_bytes", "chunk_size"):
            if getattr(made, name) <= 0:
                raise ValueError(f"{name} must be positive")
        return made

    def with_model(self) -> "Settings":
        """These settings, or an error that names the model's missing fields (never their values)."""
        missing = [n for n in ("model_key", "model_url", "model_name") if not getattr(self, n)]
        if missing:
            raise ValueError("missing settings: " + ", ".join(missing))
        return self


def _typed(raw: object, kind: type):
    if kind is bool:
        return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on")
    return kind(raw)


def require_sections(config: Mapping[str, object], names: tuple[str, ...]) -> None:
    missing = [n for n in names if not isinstance(config.get(n), Mapping)]
    if missing:
        raise ValueError("missing sections: " + ", ".join(missing))
