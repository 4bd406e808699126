"""Registered domains by a public suffix list, which is a file named by a parameter."""

from __future__ import annotations

import os
from functools import lru_cache

DEFAULT_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"


class Suffixes:
    """Rules of the list: exact, wildcard (`*.x`) and exception (`!x`); any other top level is a suffix by itself."""

    def __init__(self, lines):
        self.exact, self.wild, self.exceptions = set(), set(), set()
        for line in lines:
            rule = line.split("//")[0].strip().split(" ")[0]
            if not rule:
                continue
            kind = self.exceptions if rule[0] == "!" else self.wild if rule[:2] == "*." else self.exact
            name = rule.lstrip("!").removeprefix("*.")
            kind.add(name)
            if not name.isascii():
                try:
                    kind.add(name.encode("idna").decode())
                except UnicodeError:
                    pass

    def registered(self, host: str) -> str:
        """The suffix and the label before it, or the host itself if it is no more than a suffix."""
        labels = host.split(".")
        if not all(labels):
            return host
        length = 1
        for k in range(len(labels)):
            name = ".".join(labels[k:])
            if name in self.exceptions:
                length = len(labels) - k - 1
                break
            if name in self.exact:
                length = max(length, len(labels) - k)
            if name in self.wild and k:
                length = max(length, len(labels) - k + 1)
        return ".".join(labels[-length - 1 :]) if len(labels) > length else host


@lru_cache
def load(path: str | None = None) -> Suffixes:
    """The list at `path`, at $URLATLAS_SUFFIX_LIST, or the system's. Without one, domains would silently be wrong."""
    path = path or os.environ.get("URLATLAS_SUFFIX_LIST", DEFAULT_LIST)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no public suffix list at {path}: name one by `suffix_list` or URLATLAS_SUFFIX_LIST")
    with open(path, encoding="utf-8") as f:
        return Suffixes(f.read().splitlines())
