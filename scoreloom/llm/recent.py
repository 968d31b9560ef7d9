"""A bounded per-task memory of computed values."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable
from sys import getsizeof

#: Bytes of a table's slot for one entry, with its room to grow.
SLOT = 104


class Recent:
    """Values by text key in two generations; when the young one is full it becomes the old one.

    Keys and values together take `limit` bytes and those of one call at most, whatever the texts look like;
    keys longer than `longest` (texts without spaces are one key) are worked out each time and never kept. The memory only
    saves time: what is forgotten is computed again. `compute` gives the values of these keys, perhaps with others.
    """

    def __init__(self, limit: int, compute: Callable[[list[str]], dict], longest: int = 64):
        self.half, self.longest = max(1, limit // 2), longest
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.size = 0

    def values(self, keys: list[str]) -> list:
        """The values of these keys, in their order."""
        found = list(map(self.young.get, keys))
        at = [i for i, v in enumerate(found) if v is None]
        if at:
            look = self._more(list({keys[i] for i in at}))
            for i in at:
                found[i] = look[keys[i]]
        return found

    def known(self, key: str) -> object | None:
        return self.young.get(key) or self.old.get(key)

    def _more(self, keys: list[str]) -> dict:
        look = dict(zip(keys, map(self.old.get, keys)))
        look.update(self.compute([k for k, v in look.items() if v is None]))
        kept = look if max(map(len, look)) <= self.longest else {k: v for k, v in look.items() if len(k) <= self.longest}
        if self.size >= self.half:
            self.old, self.young, self.size = self.young, {}, 0
        self.young.update(kept)
        self.size += SLOT * len(kept) + sum(map(getsizeof, kept)) + sum(map(getsizeof, kept.values()))
        return look


def give_back() -> None:
    """Free memory that Python, Arrow and the C library keep for later goes back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class Rest:
    """Calls `forget` when nothing has been at work for `after` seconds, so that a worker that waits gives its memory back."""

    def __init__(self, forget: Callable[[], None], after: float = 5.0):
        self.forget, self.after = forget, after
        self.lock, self.busy, self.timer = threading.Lock(), 0, None

    def __enter__(self) -> None:
        with self.lock:
            self.busy += 1
            if self.timer:
                self.timer.cancel()

    def __exit__(self, *_) -> None:
        with self.lock:
            self.busy -= 1
            if not self.busy:
                self.timer = threading.Timer(self.after, self._fire)
                self.timer.daemon = True
                self.timer.start()

    def _fire(self) -> None:
        with self.lock:
            if not self.busy:
                self.forget()
                give_back()
