"""Objects built once per Python worker process (tokenizers, encoders).

A loader is a zero-argument function (e.g. reading a tokenizer or model from a
path).  Inside Arrow UDFs ``cached(loader)`` calls it on first use in each
worker process and reuses the object for every later batch and task that the
reused worker runs.
"""

from __future__ import annotations

_CACHE: dict = {}


def cached(loader):
    key = (getattr(loader, "__module__", ""), getattr(loader, "__qualname__", repr(loader)))
    obj = _CACHE.get(key)
    if obj is None:
        obj = loader()
        _CACHE[key] = obj
    return obj
