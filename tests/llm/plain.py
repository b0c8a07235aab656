"""Plain versions that several tests compare with."""

import hashlib


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    places = {}
    for i, t in enumerate(raw):
        for a in range(len(t) - length + 1):
            places.setdefault(hash(t[a : a + length]), []).append((i, a))
    gone = [bytearray(len(t)) for t in raw]
    for found in places.values():
        if len(found) > 1:
            for i, a in found:
                gone[i][a : a + length] = b"\1" * length
    out = []
    for t, g in zip(raw, gone, strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        out.append((len(t), sum(g), sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
