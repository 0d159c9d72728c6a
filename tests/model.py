"""Plain models that the vectorised code is compared with.

Written from the rules in words: one base at a time, one hash at a time.
"""

CODES = {b: i for i, pair in enumerate(("aA", "cC", "gG", "tT")) for b in pair} | {"u": 3, "U": 3}


def mix(x: int, k: int) -> int:
    m = 4**k
    x = (m - 1 - x + x * 2**21) % m
    x ^= x >> 24
    x = x * 265 % m
    x ^= x >> 14
    x = x * 21 % m
    x ^= x >> 28
    return x * (2**31 + 1) % m


class Strand:
    """The k most recent bases and the state a scan carries along."""

    def __init__(self, k: int):
        self.k, self.recent, self.run, self.latest = k, [], 0, 0

    def feed(self, char: str) -> bool:
        """Take a character; False if it completes a palindrome and is passed over."""
        if char not in CODES:
            self.run = 0
            return True
        self.recent = (self.recent + [CODES[char]])[-self.k :]
        absent = self.k - len(self.recent)
        forward = sum(c * 4**i for i, c in enumerate(reversed(self.recent)))
        turned = sum((3 - c) * 4 ** (absent + i) for i, c in enumerate(self.recent))
        if forward == turned:
            return False
        self.run += 1
        if self.run >= self.k:
            self.latest = (mix(min(forward, turned), self.k) * 256 + self.k) % 2**64
        return True


def emissions(seq: str, k: int) -> list[int]:
    """Everything a sequence emits in compat mode, in order."""
    strand, out = Strand(k), []
    for i, char in enumerate(seq):
        if strand.feed(char) and i >= k:
            out.append(strand.latest)
    return out


def plain(seq: str, k: int) -> set[int]:
    """Hashes of all complete windows."""
    found = set()
    for i in range(len(seq) - k + 1):
        window = seq[i : i + k]
        if all(c in CODES for c in window):
            digits = [CODES[c] for c in window]
            forward = sum(c * 4**j for j, c in enumerate(reversed(digits)))
            turned = sum((3 - c) * 4**j for j, c in enumerate(digits))
            found.add((mix(min(forward, turned), k) * 256 + k) % 2**64)
    return found


def sketch(seq: str, k: int, size: int, compat: bool = True) -> list[int]:
    """The smallest distinct hashes, largest first."""
    found = set(emissions(seq, k)) if compat else plain(seq, k)
    return sorted(sorted(found)[:size], reverse=True)


def murmur(data: bytes, seed: int) -> int:
    m, w = 0x5BD1E995, 2**32
    h = seed ^ len(data)
    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        k = int.from_bytes(data[at : at + 4], "little") * m % w
        k = (k ^ (k >> 24)) * m % w
        h = (h * m % w) ^ k
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m % w
    h = (h ^ (h >> 13)) * m % w
    return h ^ (h >> 15)
