"""Settings: mode and level of redaction, from arguments or the environment."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping

log = logging.getLogger(__name__)

OFF, LOCAL, STUB, SERVICE = "off", "local", "stub", "guardrail"
IDENTITY, GAZETTEER, LOWERCASE = "identity", "gazetteer", "gazetteer-lowercase"
_MODES = {
    LOCAL: "local on 1 true yes", STUB: "stub simulate fake", SERVICE: "guardrail guardrails managed", OFF: "off none 0 false no",
}
_LEVELS = {
    IDENTITY: "identity off none 0 false no", GAZETTEER: "gazetteer on 1 true yes names", LOWERCASE: "gazetteer-lowercase gazetteer_lowercase lowercase full",
}
_PRODUCTION = {"production", "prod", "live"}
MODE_VAR, LEVEL_VAR, OUTBOUND_VAR, DEPLOYMENT_VAR = "INKVEIL_REDACTION", "INKVEIL_NAMES", "INKVEIL_NAMES_OUTBOUND", "INKVEIL_ENV"
#: Earlier names of the same settings, tried in order; the first use of each is logged.
LEGACY: dict[str, tuple[str, ...]] = {MODE_VAR: ("PII_REDACTION",), LEVEL_VAR: ("PII_NAMES",), OUTBOUND_VAR: ("PII_NAMES_OUTBOUND",), DEPLOYMENT_VAR: ("DEPLOY_ENV",)}
_warned: set[str] = set()


def get(name: str, env: Mapping[str, str] | None = None, fallback: Mapping[str, str] | None = None) -> str:
    """A setting, stripped: under its name, else under a legacy one, else what the host falls back to, else empty."""
    env = os.environ if env is None else env
    if value := env.get(name, "").strip():
        return value
    for old in LEGACY.get(name, ()):
        if value := env.get(old, "").strip():
            if old not in _warned:
                _warned.add(old)
                log.warning("%s is a legacy name; use %s", old, name)
            return value
    return (fallback or {}).get(name, "").strip()


def is_production(env: Mapping[str, str] | None = None, aliases: frozenset[str] = frozenset()) -> bool:
    """``aliases``: what a host calls production besides."""
    return get(DEPLOYMENT_VAR, env).lower() in _PRODUCTION | {a.lower() for a in aliases}


def _among(raw: str, table: dict[str, str]) -> str | None:
    return next((k for k, words in table.items() if raw in words.split()), None)


def mode(value: bool | str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The argument decides, then the environment, then whether this is production; unknown values switch off."""
    if isinstance(value, bool):
        return LOCAL if value else OFF
    raw = (value or get(MODE_VAR, env)).strip().lower()
    if not raw:
        return LOCAL if is_production(env) else OFF
    return _among(raw, _MODES) or OFF


def level(value: str | None = None, env: Mapping[str, str] | None = None, name: str = LEVEL_VAR) -> str:
    raw = (value or get(name, env)).strip().lower()
    known = _among(raw, _LEVELS)
    if raw and known is None:
        log.warning("%s=%r is no level (%s); using %s", name, raw, ", ".join(_LEVELS), LOWERCASE)
    return known or LOWERCASE


def outbound_level(value: str | None = None, inbound: str | None = None, env: Mapping[str, str] | None = None) -> str:
    raw = (value or get(OUTBOUND_VAR, env)).strip()
    return level(raw, env) if raw else inbound or level(None, env)
