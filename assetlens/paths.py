"""Where the archive and its by-products lie by default, and helpers for addresses and folder names."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

#: Addresses of local models of the two dialects.
GENERATE_URL, CHAT_URL = "http://127.0.0.1:11434/api/generate", "http://127.0.0.1:1234/v1/chat/completions"


@dataclass(frozen=True)
class RuntimePaths:
    config: str
    data: str
    cache: str
    logs: str
    share: str

    @classmethod
    def default(cls, app: str = "assetlens", env: dict[str, str] | None = None) -> RuntimePaths:
        """The user's folders: the XDG ones, where they are set, else those under the home folder."""
        e = os.environ if env is None else env
        home = e.get("HOME", "~")
        of = lambda name, rest: os.path.join(e.get(name) or os.path.join(home, rest), app)
        data, state = of("XDG_DATA_HOME", ".local/share"), of("XDG_STATE_HOME", ".local/state")
        return cls(os.path.join(of("XDG_CONFIG_HOME", ".config"), "config.toml"), data, of("XDG_CACHE_HOME", ".cache"), os.path.join(state, "logs"), os.path.join(data, "share"))

    @property
    def archive(self) -> str:
        return os.path.join(self.data, "archive")

    @property
    def evaluations(self) -> str:
        return os.path.join(self.data, "evals")

    @property
    def originals_cache(self) -> str:
        return os.path.join(self.cache, "originals")

    @property
    def place_cache(self) -> str:
        return os.path.join(self.cache, "place-context")

    @property
    def place_backfill(self) -> str:
        return os.path.join(self.data, "backfills", "place-context")


def _with_path(url: str, default: str, whole: str, parents: tuple[str, ...]) -> str:
    """url, completed to end in `whole`, of which it may have the beginning already."""
    url = url.strip().rstrip("/")
    if not url:
        return default
    for parent in parents:
        if url.endswith(parent):
            return url + whole.removeprefix(parent)
    return url + whole


def generate_url(url: str) -> str:
    return _with_path(url, GENERATE_URL, "/api/generate", ("/api/generate", "/api"))


def chat_url(url: str) -> str:
    url = url.strip().rstrip("/")
    return url if url.endswith("/chat/completions") else _with_path(url, CHAT_URL, "/v1/chat/completions", ("/v1",))


def output_dir(given: str, root: str, now: datetime | None = None) -> str:
    """The given folder, or a new one under root that is named by the time."""
    if given.strip():
        return os.path.abspath(given)
    if not root.strip():
        raise ValueError("eval output root is required")
    stamp = (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%d-%H%M%S")
    return os.path.join(os.path.abspath(root), f"{stamp}-photo-card")


def cache_dir(given: str, default: str) -> str:
    if not given.strip() and not default.strip():
        raise ValueError("eval cache dir is required")
    return os.path.abspath(given if given.strip() else default)


def reject_repository_path(path: str, start: str | None = None) -> None:
    """Private output doesn't go into the repository that the working folder is part of."""
    here = Path(start or os.getcwd()).resolve()
    root = next((p for p in (here, *here.parents) if (p / ".git").exists()), None)
    if root is not None and Path(path).resolve().is_relative_to(root):
        raise ValueError(f"{Path(path).resolve()} is inside repo {root}")


def safe_name(text: str) -> str:
    return text.strip().translate(str.maketrans("/: \\", "____")) or "default"
