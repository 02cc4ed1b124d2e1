"""Plain restatements of what the operators' queries return."""

import hashlib
import re
import zlib

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i:i + 4]) for i in range(len(w) - 3)}


def components(nodes, links):
    """Smallest node reachable from each."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def near_duplicates(texts):
    """component by id of {id: text}: 100 * intersection >= 80 * union."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and 100 * min(n, m) >= 80 * max(n, m):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (n + m - both):
                    links.append((a, b))
    return components(ids, links)
