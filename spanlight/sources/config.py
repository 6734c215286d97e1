"""Settings in TOML files that may extend one another."""

from __future__ import annotations

import tomllib
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """Tables merge key by key; anything else is taken from over."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def settings(path: str | Path, known: set[str] | None = None, _above: tuple[Path, ...] = ()) -> dict:
    """A file's settings over those of the file it ``extends``; a circle, or a key at the top that is not known, is an error."""
    place = Path(path).resolve()
    if place in _above:
        raise ValueError(f"settings extend themselves: {place}")
    own = tomllib.loads(place.read_text(encoding="utf-8"))
    parent = own.pop("extends", None)
    if known is not None and (odd := sorted(set(own) - known)):
        raise ValueError(f"unknown settings in {place}: {', '.join(odd)}")
    return merged(settings(place.parent / parent, known, (*_above, place)), own) if parent else own
