"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import xxhash

BLANKS = b" \t\n\x0b\x0c\r"


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def words(text: str | None) -> list[bytes]:
    out, word = [], b""
    for b in raw(text) + b" ":
        if bytes([b]) in [BLANKS[i:i + 1] for i in range(6)]:
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([b])
    return out


def lowered(data: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    def shards_for(capacity: int) -> int:
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if shards_for(middle) <= shards else (middle + 1, high)
    return low


def fingerprint(text: str | None) -> int:
    w = [lowered(x) for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    prints = [(d, fingerprint(t)) for d, t in docs]
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(prints)}


def without_repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        data = raw(t)
        flags = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                flags[s:s + length] = b"\1" * length
            else:
                seen.add(data[s:s + length])
        kept = bytes(b for b, f in zip(data, flags) if not f)
        runs = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        out[d] = (len(data), sum(flags), runs, hashlib.sha256(kept).hexdigest())
    return out


def exact_groups(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool, str]]:
    digest = {d: hashlib.sha256(lowered(raw(t))).hexdigest() for d, t in docs}
    last, size = {}, Counter(digest.values())
    for d, h in digest.items():
        last[h] = max(d, last.get(h, d))
    return {d: (last[h], size[h], last[h] == d, h) for d, h in digest.items()}


def crc(text: str | None) -> int:
    return zlib.crc32(raw(text))


def luhn_valid(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
