"""Plain versions of the operators, row by row, for small inputs."""

import base64
import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers as P
import tiktoken
import tokenizers
import xxhash

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def library_counter():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def library_encoder():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(encoder, text):
    ids = encoder.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def fingerprint(text):
    w = words(ascii_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """Index of the smallest member of each fingerprint's component."""
    f = np.array(prints, dtype=np.uint64)
    parent = list(range(len(f)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= bits):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            parent[b] = a
    return [root(i) for i in range(len(f))]


def base_quality(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def lm_scores(rows, mu, level_count, end="\x20end"):
    """``{index: (n_tokens, n_known, N, base, score)}`` of ``(text, train)`` rows, with exact quantised pair counts."""
    toks = [words(ascii_lower(t)) + [end] for t, _ in rows]
    one, two, docs = collections.Counter(), collections.Counter(), 0
    for w, (_, train) in zip(toks, rows):
        if train:
            one.update(w)
            two.update(zip([None, *w], w))
            docs += 1
    n, v = sum(one.values()), len(one)
    out = {}
    for i, w in enumerate(toks):
        base = score = 0.0
        for a, b in zip([None, *w], w):
            p, c, k = (one[b] + 1) / (n + v + 1), docs if a is None else one[a], two[(a, b)]
            base += math.log10(p)
            pair = float(level_count(np.array([1 + int(math.log2(k) + 1e-9) if k else 0]))[0])
            score += math.log10((min(pair, c) + mu * p) / (c + mu))
        out[i] = (len(w), sum(one[t] > 0 for t in w), n, base, score)
    return out


def top_k(vectors, k=5, every=50, scale=256):
    """``{(query, rank, id, score)}``; ``vectors`` by id."""
    dim = max(map(len, vectors.values()))
    ids = np.array(sorted(vectors))
    m = np.zeros((len(ids), dim), np.int64)
    for row, i in zip(m, ids):
        v = np.floor(scale * np.array(vectors[i], np.float64)).astype(np.int64)
        row[:len(v)] = v
    out = set()
    for at in np.flatnonzero(ids % every == 0):
        scores = m @ m[at]
        order = [j for j in np.lexsort((ids, -scores)) if j != at][:k]
        out |= {(int(ids[at]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    return out


def pieces(line, near=3):
    """A line cut after words whose MD5 is the least nearby."""
    found = list(re.finditer(r"[^ \t\n\r\x0b\x0c]+", line))
    keys = [hashlib.md5(m[0].encode()).hexdigest()[:16] for m in found]
    ends = [m.end() for i, m in enumerate(found[:-1])
            if all(keys[i] < k for k in keys[max(0, i - near):i]) and all(keys[i] <= k for k in keys[i + 1:i + 1 + near])]
    return [line[a:b] for a, b in zip([0, *ends], [*ends, len(line)])]


def cut_lines(docs):
    """``{id: text}`` of ``{id: text}`` without later occurrences of three-piece windows."""
    units, solid, seen, gone = {}, {}, set(), collections.defaultdict(set)
    for i in sorted(docs):
        units[i] = [p for line in re.split(r"(?<=\n)", docs[i] or "") for p in pieces(line) if p]
        solid[i] = [n for n, p in enumerate(units[i]) if p.strip(" \t\r\n\x0b\x0c")]
        for o in range(len(solid[i]) - 2):
            key = tuple(units[i][n].strip(" \t\r\n\x0b\x0c") for n in solid[i][o:o + 3])
            if key in seen:
                gone[i] |= {o, o + 1, o + 2}
            seen.add(key)
    out = {}
    for i, parts in units.items():
        cut = {solid[i][o] for o in gone[i]}
        for a, b in zip(sorted(gone[i]), sorted(gone[i])[1:]):
            if b == a + 1:  # blank lines between two cut lines go too
                cut |= set(range(solid[i][a], solid[i][b]))
        out[i] = docs[i] if not cut else "".join(p for n, p in enumerate(parts) if n not in cut)
    return out


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))


def ranked(docs, items, k=10):
    """``{(item row, rank, id, score)}`` of ``[(id, text)]`` and ``[text]``, by scoring every document."""
    tf = [collections.Counter(plain_terms(t)) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    n, total = sum(s > 0 for s in size), sum(size)
    df = collections.Counter(w for c in tf for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for w, f in df.items()}
    out = set()
    for q, text in enumerate(items):
        terms, rows = plain_terms(text), []
        for (i, _), c, s in zip(docs, tf, size):
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * (25 + 75 * s * n // total))) for w in terms if w in c)
            if score > 0:
                rows.append((-score, i is None, i))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out |= {(q, r + 1, i, -s) for r, (s, _, i) in enumerate(rows[:k])}
    return out


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, fan=2):
    """``[(id, leaf, subroot, root, proof, folded, verified)]`` of ``(doc_id, source, lang, n_chars, text)`` rows."""
    import zlib

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node, beside = leaf((*r[:3], r[3] + 1, r[4]) if hit else r), []
            for tree, place in ((trees[x], i), (top, at)):
                for level in tree[:-1]:
                    start = place // fan * fan
                    run = level[start:start + fan]
                    run[place - start] = node
                    beside += [h for j, h in enumerate(level[start:start + fan]) if start + j != place]
                    node, place = sha(*run), place // fan
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(*beside), node, node == top[-1][0]))
    return out


def phrase_places(text, phrases):
    w = plain_terms(text)
    return sorted((label, i, i + len(p.split()) - 1) for p, label in phrases.items()
                  for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def subword_shares(text, buckets):
    """Shares of the hashed two- to four-byte runs of letters and word ends, one by one."""
    data = (" " + text.lower() + " ").encode("utf-8", "surrogatepass")
    letters = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in data)
    spaced = b" " + b" ".join(letters.split()) + b" " if letters.split() else b" "
    total = collections.Counter()
    for n in (2, 3, 4):
        for i in range(len(spaced) - n + 1):
            gram = spaced[i:i + n]
            if 32 in gram[1:-1]:
                continue
            code = gram[0]
            for b in gram[1:]:
                code = (code * 257 + b) % 2**32
            total[((code ^ (n * 0x1F123BB5) % 2**32) * 2654435761 % 2**32) >> (33 - buckets.bit_length())] += 1
    whole = sum(total.values())
    return {k: v / whole for k, v in total.items()}


def language(model, text, buckets):
    """Label and probability of a text by plain sums over the model's numbers."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    mean = [0.0] * model.embedding.shape[1]
    for k, share in subword_shares(text, buckets).items():
        for d, e in enumerate(model.embedding[k].tolist()):
            mean[d] += share * e
    z = [(sum(m * w for m, w in zip(mean, col)) + b) / model.temperature
         for col, b in zip(model.weights.T.tolist(), model.bias.tolist())]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(e)), key=lambda i: e[i])
    return model.labels[best], e[best] / sum(e)
