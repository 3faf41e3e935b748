"""Plain restatements of the contracts, for comparison on small tables."""

import hashlib
import re
from collections import Counter

from patronus.llm.shared import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def components(docs):
    """doc -> least id reachable, from (id, text) pairs with unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                if x != y:
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def contamination(docs, items):
    """id -> (n_words, n_hit, sorted item ids)."""
    wins = {}
    for item, text in items:
        w = LETTERS.findall((text or "").translate(FOLD))
        size = min(len(w), 13)
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = LETTERS.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i:i + size])) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[x]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def luhn(s):
    return sum((int(x) * (1 + i % 2) - 9 * (int(x) * (1 + i % 2) > 9)) for i, x in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[^0-9]", "", m.group())
        if 14 <= len(s) <= 19 and luhn(s):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def word_counts(texts):
    return Counter(w for t in texts for w in [*words(t), None])


def alignments(docs, a_path, b_path):
    """id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), all pairs written out."""
    import sentencepiece
    from tokenizers import Tokenizer
    ta = Tokenizer.from_file(a_path)
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in ta.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode()
    grouped = {}
    for doc, text in docs:
        text = text or ""
        a, b = ta.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        full = (" " + text).encode()
        if not text or b"".join(a_bytes[i] for i in a) != full or b"".join(map(b_bytes, b)) != full:
            grouped[doc] = ([], [], [])
            continue
        ends = []
        for ids, of in ((a, a_bytes.__getitem__), (b, b_bytes)):
            at, e = 0, []
            for i in ids:
                at += len(of(i))
                e.append(at)
            ends.append(e)
        groups, cuts = [], sorted(set(ends[0]) & set(ends[1]))
        low = 0
        for c in cuts:
            groups.append(([i for i, e in zip(a, ends[0], strict=True) if low < e <= c] if len(a) < 4000 else None,
                           [i for i, e in zip(b, ends[1], strict=True) if low < e <= c] if len(a) < 4000 else None))
            low = c
        if len(a) >= 4000:  # the same by one pass
            groups, x, y = [], 0, 0
            for c in cuts:
                p, q = x, y
                while x < len(a) and ends[0][x] <= c:
                    x += 1
                while y < len(b) and ends[1][y] <= c:
                    y += 1
                groups.append((a[p:x], b[q:y]))
        grouped[doc] = (a, b, groups)
    links = {doc: [(i, j) for xa, xb in g for i in xa for j in xb] for doc, (_, _, g) in grouped.items()}
    count = Counter(x for pairs in links.values() for x in set(pairs))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = {}
    for doc, (a, b, groups) in grouped.items():
        text = ";".join(",".join(map(str, xa)) + "|" + ",".join(map(str, xb)) for xa, xb in groups)
        out[doc] = (len(a), len(b), len(groups), len(links[doc]), sum(count[x] == best[x[0]] for x in links[doc]), sum(count[x] for x in links[doc]),
                    hashlib.sha256(text.encode()).hexdigest() if text else "")
    return out
