"""What may be called and what may be read."""

from __future__ import annotations

import os
from urllib.parse import urlparse

#: Hosts and schemes of clients that texts may be sent to.
HOSTS, SCHEMES = ("localhost", "127.0.0.1", "::1"), ("http", "https")


def local_url(url: str, hosts: tuple[str, ...] = HOSTS) -> str:
    """The url, if its scheme and host are allowed; else a ValueError."""
    parsed = urlparse(url)
    if parsed.scheme not in SCHEMES:
        raise ValueError(f"scheme not allowed: {parsed.scheme!r}")
    if (parsed.hostname or "") not in hosts:
        raise ValueError(f"host not allowed: {parsed.hostname!r}")
    return url


def inside(workspace: str, path: str) -> str:
    """The path with links resolved, if it lies in the workspace; else a ValueError."""
    root, real = os.path.realpath(workspace), os.path.realpath(os.path.join(workspace, path))
    if os.path.commonpath([root, real]) != root:
        raise ValueError(f"outside the workspace: {path}")
    return real
