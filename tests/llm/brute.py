"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = (
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text):
    """Base spans (start, kind rank, end) of a text."""
    out = []
    for rank, (_, pattern, group, least) in enumerate(SECRETS):
        out += [(m.start(), rank, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def secrets_sha(text):
    body = ",".join(f"{SECRETS[r][0]}:{s}:{e}" for s, r, e in secrets(text))
    return hashlib.sha256(body.encode()).hexdigest()


def nearest(ids, vectors, queries, k):
    """{query id: [(id, cosine), ...]} over usable vectors."""
    ok = [(i, np.array(v, "f8")) for i, v in zip(ids, vectors) if i is not None and v is not None
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q in queries:
            near = [(-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in ok if i != q]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def repeated_windows(docs, size=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}; docs is a list of (doc_id, text)."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), (d, i))
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] != (d, i):
                gone[i:i + size] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_components(docs, percent=75):
    """{doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    tried = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edit_distance(a, b, most):
    """Edit distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def line_dedup(docs, most, least):
    """{doc_id: kept text}: a line goes if a line within ``most`` edits starts earlier."""
    place = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for i, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                place.setdefault(line, (d, i))
    lines = sorted(place, key=place.get)
    gone = {x for i, x in enumerate(lines) if any(edit_distance(x, y, most) <= most for y in lines[:i])}
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = None
            continue
        keep = [x for i, x in enumerate(t.split("\n")) if len(x) < least or (place[x] == (d, i) and x not in gone)]
        out[d] = "\n".join(keep)
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def alignment(texts, encode_a, bytes_a, encode_b, bytes_b):
    """For each text (n_a, n_b, n_groups, n_links, groups, {(a, b): times}) by comparing all byte ranges."""
    def spans(ids, table):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(table[i]), i))
            at += len(table[i])
        return out

    out = []
    for text in texts:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            out.append((0, 0, 0, 0, "", {}))
            continue
        a, b = spans(a, bytes_a), spans(b, bytes_b)
        cuts = sorted({x[1] for x in a} & {x[1] for x in b})
        within = lambda ids, lo, hi: ",".join(str(i) for _, end, i in ids if lo < end <= hi)
        groups = [within(a, lo, hi) + "|" + within(b, lo, hi) for lo, hi in zip([0, *cuts], cuts)]
        links = {}
        for s, e, i in a:
            for s2, e2, j in b:
                if max(s, s2) < min(e, e2):
                    links[i, j] = links.get((i, j), 0) + 1
        out.append((len(a), len(b), len(groups), sum(links.values()), ";".join(groups), links))
    return out


def link_scores(aligned):
    """(n_best, count_sum) of each text from the pairs of all texts."""
    count, best = {}, {}
    for *_, links in aligned:
        for pair in links:
            count[pair] = count.get(pair, 0) + 1
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(sum(t for p, t in links.items() if count[p] == best[p[0]]), sum(t * count[p] for p, t in links.items()))
            for *_, links in aligned]


def hard_negatives(rows, is_anchor, k=5, low=80):
    """{(anchor_id, positive_id): [(negative_id, positive_score, negative_score), ...]}; rows are distinct (id, label, vector)."""
    ok = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok.append((i, label, [int(np.floor(256.0 * x)) for x in v]))
    out = {}
    for i, label, v in ok:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in ok if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            p = -s
            near = [(n, p, -t) for t, n, m in scored if m != label and low * p <= 100 * -t <= 100 * p][:k]
            if near:
                out[i, j] = near
    return out


def byte_bpe(word, ranks):
    """Ids of one word (bytes): the leftmost pair of least rank is merged until there is none."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


# --- fingerprints: one text at a time, symbol by symbol -----------------------------

_64 = 2**64 - 1


def _scramble(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _64
    return x ^ (x >> 31)


def _toss(x, before):
    low = ((x ^ before) & -(x ^ before)).bit_length() - 1
    return 2 * low + ((x >> low) & 1)


def _next_level(symbols):
    step = 0x9E3779B97F4A7C15
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [s if n == 1 else _scramble((s * step + n) & _64) for s, n in runs]
    labels = [_toss(s, symbols[i - 1] if i else s ^ _64) for i, s in enumerate(symbols)]
    for _ in range(3):
        labels = [_toss(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    phrases = []
    for i, s in enumerate(symbols):
        peak = i > 1 and labels[i] > labels[i - 1] and (i == len(symbols) - 1 or labels[i] >= labels[i + 1])
        if i == 0 or peak:
            phrases.append([])
        phrases[-1].append(s)
    names = []
    for phrase in phrases:
        total, power = 0, 1
        for s in phrase:
            power = power * step & _64
            total = (total + _scramble((s + 1) & _64) * power) & _64
        names.append(_scramble(total))
    return names


def fingerprint(text, keep=64, first=3, last=5):
    """The text's fingerprint as hex: the smallest upper halves of the names of its phrases."""
    symbols, kept = [_scramble(ord(c) + 1) for c in text], set()
    for level in range(1, last + 1):
        if not symbols:
            break
        symbols = _next_level(symbols)
        if level >= first or len(symbols) == 1:
            kept |= {s >> 32 for s in symbols}
        if len(symbols) == 1:
            break
    return "".join(f"{x:08x}" for x in sorted(kept)[:keep])


def likeness(a, b, keep=64):
    """Share of common hashes among the smallest of two fingerprints (hex)."""
    a, b = ({x[i:i + 8] for i in range(0, len(x), 8)} for x in (a, b))
    if not a or not b:
        return float(a == b)
    both = sorted(a | b)[:keep]
    return sum(x in a and x in b for x in both) / len(both)


# --- language ID: sizes with a compressor and dictionary made for each text ----------

def language(text, learned, level=6, block=8192, margin=0.001):
    """(language, score, rejected); ``learned`` maps a language to its dictionary's content."""
    import zstandard

    if text is None or not any(c.isalpha() for c in text) or not learned:
        return "und", 0.0, True
    body = " ".join("".join(c if c.isalnum() and not c.isdecimal() else " " for c in text.lower()).split()).encode()
    sizes = []
    for name, content in sorted(learned.items()):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((sum(len(c.compress(body[i:i + block])) for i in range(0, len(body), block)), name))
    sizes.sort()
    gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], min(1.0, 0.5 + 5 * gap), gap < margin
