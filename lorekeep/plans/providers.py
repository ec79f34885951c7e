"""Providers of the store's queries, in a module of their own as tasks import it."""

from __future__ import annotations

import hashlib

from ..sources import tables as S

BEGIN = "00"


class Refusing(S.HashedEmbeddings):
    """A provider that refuses texts by their md5."""

    model = "refusing"

    def embed(self, texts: list[str]) -> list[list[float]]:
        for name in (hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in texts):
            if name.startswith(BEGIN):
                raise RuntimeError(f"refused {name}")
        return super().embed(texts)


class Failing:
    """Deletions of keys whose md5 begins with 0 or 1 fail."""

    def remove(self, page_key: str) -> None:
        if hashlib.md5(page_key.encode(), usedforsecurity=False).hexdigest() < "2":
            raise RuntimeError(f"kept {page_key}")
