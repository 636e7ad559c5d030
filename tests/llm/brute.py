"""Plain versions of the operators, to hold the real ones against."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from netspark.llm.near_dup import simhash

ODD = "id bigint, doc_id bigint, text string, a string, b string, key string, s0 bigint, block string, n string, keep string, host string, shard string"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(["ka", "lo", "mi", "ren", "tos", "u", "vel", "dra", "sin", "po"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())


def odd_rows(texts: list[str | None]) -> list[tuple]:
    """Rows of ODD, whose columns have the names that operators use within."""
    return [(7, i, t, "x", None, "k", 1, None, "n", "no", "h", "s") for i, t in enumerate(texts)]


def words(text: str) -> list[str]:
    return re.findall("[0-9a-z_\x80-\U0010ffff]+", text.lower())


def groups(n: int, links: list[tuple[int, int]]) -> list[int]:
    own = list(range(n))

    def root(x: int) -> int:
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        own[y] = x
    return [root(i) for i in range(n)]


def near_groups(texts: list[str], most: int) -> tuple[list[int], np.ndarray]:
    """The least index of each text's group, and all distances; texts without words are alone."""
    s, n = simhash(pa.array(texts, pa.large_string()))
    u = s.view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None]).sum(axis=-1).astype(int)
    d[n == 0] = d[:, n == 0] = 999
    return groups(len(texts), [(int(a), int(b)) for a, b in zip(*np.nonzero(d <= most), strict=True) if a < b]), d


def contained(text: str, item: str, k: int) -> tuple[float, int, int]:
    """Best share of the item's distinct k-word shingles over the text's windows of the item's length, the first window that has it, and their number."""
    w, v = words(text), words(item)
    need = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
    span, best, at = len(v) - k, 0, -1
    have = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    for i in range(len(have)):
        if have[i] in need and (n := len(need & set(have[i : i + span + 1]))) > best:
            best, at = n, i
    return best / len(need) if need else 0.0, at, len(need)
