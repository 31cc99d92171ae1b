"""Driver-side configuration: flat ``KEY: value`` files with environment overrides, and pinned protocol files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Mapping
from pathlib import Path


#: A line of a flat file: blank, a comment, or a key, a colon and a value, maybe with a comment behind it.
_FLAT_LINE = re.compile(r"\s*(?:(?P<key>[^:#\s][^:#]*):(?P<value>[^#]*))?(?:#.*)?")


def read_flat_config(path: str, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Keys and values of a flat file, where a set environment variable of a key's name wins. All lines that are neither blank nor
    a comment nor ``KEY: value`` are named in the error."""
    lines = [_FLAT_LINE.fullmatch(line) for line in Path(path).read_text(encoding="utf-8").splitlines()]
    if bad := [str(k) for k, found in enumerate(lines, 1) if found is None]:
        raise ValueError(f"{path} is no flat configuration: see line {', '.join(bad)}")
    stated = {m["key"].strip(): m["value"].strip().strip("\"'") for m in lines if m["key"]}
    return stated | {k: v for k, v in (os.environ if environ is None else environ).items() if k in stated}


def canonical_json(value: object) -> str:
    """JSON with sorted keys, without spaces, other than ASCII signs kept: equal values give equal digests."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def require_digest(path: str, expected: str) -> str:
    if (found := sha256_of(path)) != expected:
        raise ValueError(f"{path}: sha256 {found}, expected {expected}")
    return found


def read_protocol(path: str, sha256: str, version: str) -> dict[str, str]:
    """The top-level keys of a pinned protocol file; another digest or version raises. Nested parts are left out."""
    require_digest(path, sha256)
    top = [line for line in Path(path).read_text(encoding="utf-8").splitlines() if _FLAT_LINE.fullmatch(line) and line[:1].strip(" \t-")]
    found = {m["key"].strip(): m["value"].strip().strip("\"'") for m in map(_FLAT_LINE.fullmatch, top) if m["key"]}
    if found.get("version") != version:
        raise ValueError(f"{path}: version {found.get('version')}, expected {version}")
    return found


def copy_verified(source: str, target: str, digests: Mapping[str, str]) -> list[str]:
    """Copies the named files and checks the digests of the copies; a file that is there already with its digest stays. Returns the
    names copied."""
    copied = []
    for name, expected in digests.items():
        place = Path(target) / name
        if not place.exists() or sha256_of(str(place)) != expected:
            require_digest(str(Path(source) / name), expected)
            place.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(Path(source) / name, place)
            require_digest(str(place), expected)
            copied.append(name)
    return copied
