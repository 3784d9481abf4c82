"""Plain versions of what the operators compute."""

import re
from collections import Counter

import xxhash

from veilstream.llm import quality


def brute_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            lines += 1
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, lines, len(covered)


def brute_fences(rows):
    """(features, base_failed, function from a row's number and a rate to low, high, spread, size), with the sketches as plain lists."""
    feats = [dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"), brute_features(t))) for _, _, t in rows]
    for f in feats:
        f |= {n: f[a] * parts // f[b] if f[b] else 0 for n, (a, b, parts, *_) in quality.RATES.items()}
    failed = [f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"] for f in feats]
    down = lambda v: v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6)

    def quartile(at, name, q):
        out = None
        for same in (lambda x: True, lambda x: x[0] == rows[at][0], lambda x: x[:2] == rows[at][:2]):
            pool = sorted(down(f[name]) for f, row, bad in zip(feats, rows, failed) if not bad and same(row))
            own = pool[-(-len(pool) * round(100 * q) // 100) - 1]
            out = own if out is None else (len(pool) * own + quality.PRIOR * out) / (len(pool) + quality.PRIOR)
        return out

    def fences(at, name):
        _, den, parts, one, _ = quality.RATES[name]
        low, high, size = quartile(at, name, 0.25), quartile(at, name, 0.75), quartile(at, den, 0.5)
        return low, high, max(high - low, 1, one * parts / max(1, size)), size

    return feats, failed, fences


def brute_verdicts(rows):
    """The rule over (lang, source, text) rows."""
    feats, failed, fences = brute_fences(rows)
    out, known = [], {}
    for i, (f, bad) in enumerate(zip(feats, failed)):
        for n, (num, den, parts, one, both) in quality.RATES.items():
            if failed[i]:
                break
            if (rows[i][:2], n) not in known:
                known[rows[i][:2], n] = fences(i, n)
            low, high, spread, median = known[rows[i][:2], n]
            size = max(1, f[den])
            value, room = max(0, f[num] - one) * parts / size, quality.WIDTH * spread * max(1, median / size) ** 0.5
            bad = bad or value > high + room or (both and value < low - room)
        out.append(not bad)
    return out


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_reach(fps, radius=2):
    """Smallest fingerprint reachable from each."""
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}
