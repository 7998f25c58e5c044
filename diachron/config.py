"""Settings from a flat text of ``key: value`` lines."""

import os


def parse(text: str) -> dict[str, str]:
    """Keys and values; blank lines, lines that start with # and lines without a colon are skipped, quotes around values go."""
    out = {}
    for line in (x.strip() for x in text.splitlines()):
        key, colon, value = line.partition(":")
        if colon and not line.startswith("#") and key.strip():
            out[key.strip()] = value.strip().strip('"').strip("'")
    return out


def load(path: str) -> dict[str, str]:
    """The settings of a file, none if there is no file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def folder(settings: dict[str, str], key: str, default: str, root: str) -> str:
    """A path setting; relative ones start at ``root``, addresses of a store stay as they are."""
    value = settings.get(key)
    if not value:
        return default
    return value if os.path.isabs(value) or "://" in value else os.path.join(root, value)
