"""The models' scores in plain Python, one text at a time, from the same trained weights."""

import math
import re

from finlake.llm import op3_toxicity as op3
from finlake.llm import op6_quality as op6
from finlake.llm import op7_language as op7

M = 2**64 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hashed(b: bytes) -> int:
    out = mixed((len(b) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & M)
    if len(b) > 64:
        row = b"".join(hashed(b[k : k + 64]).to_bytes(8, "little") for k in range(0, len(b), 64))
        return mixed(out ^ hashed(row))
    for k in range(0, len(b), 8):
        out = mixed(((out ^ int.from_bytes(b[k : k + 8], "little")) * 0xA0761D6478BD642F + 1) & M)
    return out


def folded(parts: list[int], seed: int) -> int:
    out = seed
    for p in parts:
        out = mixed((out * 0xA0761D6478BD642F + p) & M)
    return out


def gram_bucket(gram, n: int, buckets: int) -> int:
    code = n
    for c in gram:
        code = (code * 0x01000193 & 0xFFFFFFFF) ^ (c + 1)
    code ^= code >> 15
    code = code * 0x2C1B3C6D & 0xFFFFFFFF
    return (code ^ code >> 13) % buckets


def unit(counts: dict[int, float]) -> dict[int, float]:
    size = max(math.sqrt(sum(v * v for v in counts.values())), 1e-9)
    return {k: v / size for k, v in counts.items()}


def counted(keys) -> dict[int, int]:
    out: dict[int, int] = {}
    for k in keys:
        out[k] = out.get(k, 0) + 1
    return out


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def letters(text: str) -> bytes:
    return bytes(b if b >= 128 else b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in text.encode())


def quality(text: str, m: dict) -> float:
    words = [hashed(w) for w in WORD.findall(text.encode())]
    words += [folded([a, b], 2) for a, b in zip(words, words[1:])]
    chars = [ord(c) for c in text]
    grams = [gram_bucket(chars[k : k + n], n, op6.CHAR_BUCKETS) for n in op6.ORDERS for k in range(len(chars) - n + 1)]
    parts = [counted(h % op6.WORD_BUCKETS for h in words), counted(grams)]
    z, base = float(m["b"]), 0
    for part, size in zip(parts, (op6.WORD_BUCKETS, op6.CHAR_BUCKETS)):
        z += sum(v * float(m["w"][base + k]) for k, v in unit({k: math.log1p(v) for k, v in part.items()}).items())
        base += size
    return logistic(m["slope"] * z + m["offset"])


def language(text: str, m: dict) -> tuple[str, float]:
    data = letters(text)
    grams = []
    for n in op7.ORDERS:
        for k in range(len(data) - n + 1):
            g = data[k : k + n]
            if not (b"  " in g or g == b" "):
                grams.append(gram_bucket(g, n, op7.BUCKETS))
    v = unit({k: math.log1p(c) * float(m["idf"][k]) for k, c in counted(grams).items()})
    near = [sum(x * float(c[k]) for k, x in v.items()) for c in m["centroids"]]
    best = max(range(len(near)), key=lambda i: near[i])
    return m["langs"][best], max(0.0, min(1.0, near[best]))


def toxicity(text: str, m: dict) -> float:
    words = WORD.findall(letters(text))
    a = [hashed(w) % op3.BUCKETS for w in words]
    b = [mixed((hashed(w[: op3.PREFIX]) + 1) & M) % op3.BUCKETS for w in words]
    x = [[float(p) + float(q) for p, q in zip(m["table"][i].astype("float32"), m["table"][j].astype("float32"))] for i, j in zip(a, b)]
    z, f = m["offset"], 0
    for w in m["filters"]:
        for k in range(op3.FILTERS):
            pooled = max((sum(x[i + t][d] * float(w[t][d][k]) for t in range(len(w)) if i + t < len(x) for d in range(op3.DIMENSIONS)) for i in range(len(x))), default=None)
            z += max(0.0, pooled + float(m["bias"][f])) * float(m["out"][f]) if pooled is not None else 0.0
            f += 1
    return logistic(m["slope"] * z + m["shift"])
